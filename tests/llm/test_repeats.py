"""Removal of repeated strings against plain search and its SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from barloom.llm import lines, repeats

SCHEMA = "doc_id long, text string, lang string, th long, p int, spans string"


def plain(texts, length):
    """(bytes, spans, rest) of each text, from counts of all its strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        edge = np.diff(gone)
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((len(d), spans, bytes(b for b, g in zip(d, gone[1:]) if not g)))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdé", "abcdefghij\x00", "ab\x00"][seed % 4]
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 50))))
            passage = rng.choice(passages)
            cut = rng.randint(0, 12)
            parts.append(passage[cut : len(passage) - rng.randint(0, 8)])
        texts.append("".join(parts))
    texts += [None, "", "a" * 70, "abab" * 20, texts[0], texts[1][:-1] + "!", "short", passages[0], "xyz" * 6 + "x", "xyz" * 6 + "xy"]
    return texts


@pytest.mark.parametrize("seed,group,block,cut", [(0, 4000, 30_000, 1 << 20), (1, 2, 1, 40), (2, 3, 20, 64), (3, 1, 50, 33)])
def test_like_search(spark, monkeypatch, seed, group, block, cut):
    """Whole cores, and cores split down to whole strings; texts in one and in many slices."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "SLICE", cut)
    texts = texts_of(seed)
    ids = [None if i == 3 else i % 25 for i in range(len(texts))]
    rows = [(i, t, "en", 1, 2, "x") for i, t in zip(ids, texts)]
    rows += rows[4:6] + [(77, "only here, and of more than twenty bytes", None, None, None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=24, reach=12, group=group).collect()
    want = plain([r[1] for r in rows], 24)
    found = sorted((str(r.doc_id), r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got)
    assert found == sorted((str(r[0]), n, spans, rest) for r, (n, spans, rest) in zip(rows, want))
    assert all(r.n_removed == r.n_bytes - len(r.kept) and r.n_spans == len(r.spans) for r in got)


def test_query_like_sql(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghé") for _ in range(6)) for _ in range(900)]
    body = " ".join(rng.choice(words) for _ in range(900))
    texts = [body, body[:900] + "X" + body[901:], "own " + body[100:500] + " text", "own " + body[100:498], body[:399], body[2000:2400]]
    texts += [None, "", "é" * 300, " ".join(rng.choice(words) for _ in range(300)), "none " * 79]
    rows = [(i, t, "en", 1, 2, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text").toPandas())
    want = con.execute(repeats.SQL_REPEATS).fetchdf()
    got = repeats.op11_repeats(spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert (got.n_removed > 0).sum() > 4 and hashlib.sha256().hexdigest() in set(got.kept_sha256)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_with_long_arrays_are_not_broadcast(spark, monkeypatch):
    """Two long texts have few rows of spans and contexts, but large ones."""
    hinted = []
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 20_000)
    monkeypatch.setattr(lines.F, "broadcast", lambda df: hinted.append(df.columns) or df)
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(100)]
    rows = [(k, "".join(s + "".join(rng.choice("xyz") for _ in range(60)) for s in shared)) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs).collect()
    assert all(r.n_spans >= 100 and r.n_removed >= 100 * 500 for r in got)
    assert hinted and not [c for c in hinted if "found" in c]


def test_texts_move_alike_at_any_size(spark, monkeypatch):
    """Few spans or many: the join with the texts is the same, so what it moves grows as the input."""
    hinted = []
    monkeypatch.setattr(lines.F, "broadcast", lambda df: hinted.append(df.columns) or df)
    body = "".join(random.Random(5).choice("abcdefgh ") for _ in range(900))
    docs = spark.createDataFrame([(k, body[k:] + str(k)) for k in range(5)], "doc_id long, text string")
    assert all(r.n_removed >= 890 for r in repeats.remove_repeats(docs).collect())
    assert all(columns == ["k1"] for columns in hinted)
