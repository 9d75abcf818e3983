"""Phrase mining against its SQL on odd input, and its automata against plain counts."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, h1 long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["of", "The", "new", "york", "Été", "state", "a_b", "x y", "\x00", "wide-open", "mill"]
    rows = []
    for i in range(700):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        for mark in ".,;:!?\n\r\x0b\t ":
            text = text.replace(" of ", f" of{mark} ", 1) if rng.random() < 0.3 else text
        rows.append((i % 500, text, rng.choice(["en", "en", "fr", None, "und"]), 1, 2))
    rows += [(900 + i, "New York state of mind", "de", 1, 2) for i in range(40)]
    rows += [(1000, None, "en", 1, 2), (1001, "", None, 1, 2), (None, "the the the the the", "en", 1, 2)]
    rows += [(2000, "again and again and " * 900 + "again", "en", 1, 2), (2001, "long" * 3000, "en", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_like_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas())
    want = con.execute(phrases.SQL_PHRASES).fetchdf()
    got = phrases.collocations(docs).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    found = set(want[want.lang == "de"].phrase)
    assert len(want) > 60 and found == {"new york state of", "york state of mind"}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0


def plain(text: bytes):
    """Counts of all n-grams of 1 to 4 words within pieces."""
    found = Counter()
    for mark in b".,;:!?\n\x0b\x0c\r":
        text = text.replace(bytes([mark]), b"\n")
    for piece in text.lower().split(b"\n"):
        w = piece.replace(b"\t", b" ").split(b" ")
        w = [x for x in w if x]
        for n in range(1, 5):
            found.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return found


@pytest.mark.parametrize("size", [17, 40, 4 << 20])
def test_slices_lose_nothing(monkeypatch, size):
    """Texts longer than a slice, with and without piece ends, count as in one go."""
    monkeypatch.setattr(phrases, "SLICE", size)
    rng = random.Random(size)
    texts = ["".join(rng.choice(["ab ", "c\t", "d. ", "E  ", "\n", "fgh ", "ij"]) for _ in range(120)) for _ in range(20)]
    texts += ["word " * 60, "x" * 90, "", None, " " * 70, "a " * 30 + "b" * 60 + " c" * 30, ". " * 50]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})
    everything = phrases.Bits(16, np.full(1 << 13, 255, np.uint8))
    got, names = Counter(), {}
    for words in phrases._slices([batch]):
        _, found, hashes, n = words.counts()
        for word, h, k in zip(found, hashes.tolist(), n.tolist()):
            got[(h,)] += k
            assert names.setdefault(h, word) == word
        for m in (2, 3, 4):
            pairs = words.pairs(everything)
            at = pairs
            for k in range(1, m - 1):
                at = at[:-1] & pairs[k:]
            got.update(map(tuple, words.grams(at, m).tolist()))
    want = sum((plain((t or "").encode()) for t in texts), Counter())
    assert Counter({tuple(names[h] for h in key): n for key, n in got.items()}) == want


def test_automata_keep_counts():
    rng = np.random.default_rng(2)
    for width, n in ((2, 1), (2, 400), (4, 3000)):
        rows = rng.integers(1, 7, (n, width), np.uint64)
        rows[rng.random(n) < 0.3, width - 1] = 0
        distinct, counts = phrases.merged(rows, np.ones(n, np.int64))
        again, totals = phrases.merged(*phrases.paths(phrases.build(distinct, counts)))
        assert (again == distinct).all() and (totals == counts).all()
    # Equal ends are stored once: 1,000 first words with the same 50 followers.
    rows = np.stack([np.repeat(np.arange(1, 1001, dtype=np.uint64), 50), np.tile(np.arange(1, 51, dtype=np.uint64), 1000)], axis=1)
    assert len(phrases.build(rows, np.full(len(rows), 2))) < 10_000


def test_full_shards_and_filters(spark, docs, monkeypatch):
    """Shards that are cut often, and filters that let almost everything pass, change nothing."""
    want = sorted(map(tuple, phrases.collocations(docs).collect()))
    monkeypatch.setattr(phrases, "SHARD", 50)
    monkeypatch.setattr(phrases, "FILTER_BITS", 16)
    monkeypatch.setattr(phrases, "SLICE", 900)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 3)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == want
