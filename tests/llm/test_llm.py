"""Operators for training data: odd input, and results against SQL or brute force."""

import hashlib
import os
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, html, jaccard, langid, lines, mixing, tiling, tokens, urls, vectors
from barloom.llm.components import components
from barloom.session import CLEANUP, shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.execute(sql).fetchdf()
    got = spark_rows.toPandas()[list(want.columns)]

    def rows(f):
        return sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(base)]
    for k, t in enumerate(base[:6]):  # copies, and near copies with one to five other words
        rows.append((100 + k, t, "en", None, len(t)))
        w = t.split(" ")
        for n in range(1, 6):
            w[n * 9] = f"new{k}{n}"
            rows.append((200 + 10 * k + n, "\t".join(w), "en", "c", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "", 0), (302, "One two", "en", "c", 0), (303, "one TWO", None, "c", 0)]
    rows += [(304, " \n", "en", "c", 0), (305, base[0] + " " + " ".join(words * 8), "en", "b", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("set_id", F.lit(1))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (5, 5), (None, 4), (30, 31), (31, 30)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long"), "u", "v").collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 6, 7, 8, 9)} | {(20, 20), (21, 20), (30, 30), (31, 30)}


def test_jaccard_like_sql(spark, docs):
    same(jaccard.join(docs).select("doc_id", "n_shingles", "component_id"), jaccard.SQL_JACCARD, documents=docs.toPandas())
    assert jaccard.join(docs.limit(0)).count() == 0


def test_mixing_like_sql(spark, docs):
    got = mixing.mix(docs)
    same(got.select("doc_id", "size", "source_size", "target", "taken"), mixing.SQL_MIX, documents=docs.toPandas())
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    assert all(abs(r.t - r.target) <= 1 and r.over <= 0 for r in per.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat_like_sql_and_back(spark):
    rows = [(1, 0, "user", "a<b [x] \\ </s>"), (1, 1, "assistant", "<|im_end|>\\<"), (1, 1, "assistant", "<|im_end|>\\<"), (1, 3, None, None)]
    rows += [(2, 5, "assistant", ""), (3, None, "user", "é𝔘\n"), (3, 1, "assistant", "[/INST]é"), (3, 2, "user", "z"), (None, 0, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sql = chat.SQL_CHAT.replace("  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'\n", "").replace(
        "\n  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'", ""
    )
    examples = chat.format_chats(turns)
    same(chat.digest(examples), sql, conversations=turns.toPandas())
    ones = {(r.conv_id, r.example_no): r for r in examples.collect()}
    assert sorted(k for k in ones if k[0] == 1) == [(1, 0), (1, 1), (1, 2)]
    assert ones[(1, 2)].loss_start == ones[(1, 2)].loss_end  # turns after the last reply
    assert "<|im_end|>\\" not in ones[(1, 0)].formatted.replace("<\\|im_end|>", "")
    back = examples.where("conv_id = 3 and example_no = 1").select(chat.read_turns(F.col("formatted"))).first()[0]
    assert [tuple(t) for t in back] == [("user", "é𝔘\n"), ("assistant", "[/INST]é"), ("user", "z")]
    assert chat.format_chats(turns.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == chat.digest(examples).where("conv_id = 2").first().loss_sha256


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x = np.vstack([x, x[:20] + rng.normal(size=(20, 8)) * 0.15, x[:20] * 3, x[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] * 4), (903, [float("nan")] * 8), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [])]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[near[i]].min() for i in range(len(x))])
    assert [got[i].component_id for i in range(len(x))] == low.tolist()
    assert [got[i].n_links for i in (900, 901, 902, 903, 904, 905, 906)] == [0, 0, 0, 0, 1, 1, 0]
    assert got[900].kept and got[905].component_id == 904 and not got[905].kept
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _greedy(doc, item, least):
    free_d, free_t, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_t[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            free_d[best[0] + k] = free_t[best[1] + k] = False


def test_tiles_like_greedy_search():
    rng = random.Random(3)
    for _ in range(200):
        kinds = rng.choice((2, 3, 6))
        doc, item = ([rng.randrange(kinds) for _ in range(rng.randint(0, n))] for n in (50, 20))
        least = rng.choice((1, 2, 3, 5))
        got = tiling.tiles(*(np.array(x, np.uint64) * np.uint64(777777777) for x in (doc, item)), least)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in _greedy(doc, item, least))


def test_leaks(spark):
    item = " ".join(f"q{i}" for i in range(30))
    words = item.split()
    moved = "x y z " + " ".join(words[15:]).upper() + ", and then " + " ".join(words[:15])
    rows = [(1, moved, 7), (2, " ".join(words[:10]), 7), (3, None, 7), (4, "", 7), (5, "short one here", 7), (1, moved, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "one here"), (13, "...")], "item_id long, text string")
    for block_words in (1_000_000, 3):
        got = tiling.find_leaks(docs, bench, block_words=block_words).collect()
        assert sorted((r.doc_id, [x.item_id for x in r.leaks]) for r in got) == [(1, [10]), (1, [10]), (2, []), (3, []), (4, []), (5, [12])]
    assert tiling.find_leaks(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert tiling.find_leaks(docs.limit(0), bench).count() == 0


def test_tokens_like_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [(f"<0x{i:02X}>", -9.0) for i in range(256)]
    pieces += [("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -6.0), ("ba", -5.5), ("▁a", -5.0), ("aba", -9.0), ("bab", -8.0)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0)] + pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="first", split=True)
    counter, rng = tokens.Counter(pieces), random.Random(1)
    texts = ["", " ", "  a", "▁a", "é", "a" * 5000] + ["".join(rng.choice("ab é▁") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for text in texts:
        assert counter.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids), text


def test_tokens_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a a", 5), (3, "a a", 5)], "id int, text string, n_tokens int")
    got = tokens.count_tokens(rows, [("▁", -1.0), ("▁a", -1.5)]).collect()
    assert sorted((r.id, r.n_tokens, r.best_score) for r in got) == [(1, 0, 0.0), (2, 0, 0.0), (3, 2, -3.0), (3, 2, -3.0)]


def test_urls(spark):
    rows = [("http://A.B.example.NET/en/x?q", "a.b.example.net", "/en/x", "example.net/en/", "allow"), ("ftp://net/", "net", "/", "net/", "block")]
    rows += [("http://x.net?a/b", "x.net", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("", "", "", None, None)]
    rows += [("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://myexample.com/de/", "myexample.com", "/de/", None, None)]
    good = [f"http://site{i}.example.org/p/{i}" for i in range(60)]
    bad = [f"http://cheap-pills-{i}.example.org/p/{i}" for i in range(60)]
    df = spark.createDataFrame([(u, "x") for u, *_ in rows] + [(u, "y") for u in good + bad], "url string, verdict string")
    model = urls.fit(df.select("url", urls.label_by_words(urls.host_of(F.col("url"))).alias("label")))
    got = {r.url: r for r in urls.judge(df, model).collect()}
    for url, host, path, rule, verdict in rows:
        assert (got[url].host, got[url].path, got[url].rule) == (host, path, rule)
        assert got[url].verdict == (verdict or got[url].verdict) and got[url].verdict in ("allow", "block")
    right = [got[u].verdict == "allow" for u in good] + [got[u].verdict == "block" for u in bad]
    assert np.mean(right) > 0.95
    empty = df.limit(0)
    none = urls.fit(empty.select("url", F.lit(1).alias("label")))
    assert urls.judge(empty, none).count() == 0 and {r.verdict for r in urls.judge(df.where("url is null"), none).collect()} == {"allow"}


def test_languages(spark):
    rng = random.Random(5)
    parts = {"xx": ["tha", "ing", "er"], "yy": ["ción", "mente", "os"], "zz": ["ung", "sch", "ü"]}
    rows = [(i, " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(25)), k) for i, (k, p) in enumerate(list(parts.items()) * 40)]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "", None), (902, "12 %", "yy"), (903, "中", None)], "doc_id long, text string, lang string")
    filters = langid.fit(docs.where(langid.part_of("doc_id") != 1))
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("own")), filters).collect()}
    held = [got[i].lang_pred == lang for i, _, lang in rows]
    assert np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in parts
    assert filters.predict(["thaing " * 200_000])[0] == ["xx"]  # several pieces
    nothing = langid.fit(docs.where("lang is null"))
    assert nothing.predict(["abc"])[0] == ["und"] and langid.identify(docs.limit(0), filters).count() == 0


def test_lines_like_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 40))) for _ in range(60)]
    rows = [(i, "\n".join(base[i * 3 : i * 3 + 3])) for i in range(20)]
    for i in range(20):
        w = base[i].split(" ")
        w[len(w) // 2] = "edited"
        rows.append((100 + i, " ".join(w) + "\n\n" + base[i + 20].upper() + "  \nown line %d %s" % (i, rng.choice(words))))
    rows += [(200, None), (201, ""), (202, "\n"), (0, rows[0][1]), (203, base[1]), (204, "x" * 20000 + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_kept", F.lit("own"))
    got = {(r.doc_id): r for r in lines.dedup_lines(docs).collect()}
    all_ = [(i, k, x.strip().lower()) for i, t in sorted(dict(rows).items()) if t for k, x in enumerate(t.split("\n")) if x.strip()]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for *_, x in all_]
    low = list(range(len(all_)))
    for i in range(len(all_)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low = [min(low[i], low[j]) if v in (low[i], low[j]) else v for v in low]
    kept = {}
    for n, (i, k, _) in enumerate(all_):
        if low[n] == n:
            kept.setdefault(i, []).append(k)
    for i, text in dict(rows).items():
        mine = got[i].text
        if text is None:
            assert mine is None and got[i].n_lines == 0
        elif kept.get(i):
            split = text.split("\n")
            assert mine == "\n".join(x for k, x in enumerate(split) if k in kept[i] or not x.strip()), i
        else:
            assert mine == (text if not text.strip() else "")
    assert lines.dedup_lines(docs).count() == len(rows) and lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_with_one_edit_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = ["subscribe to newsletter now", "subscribe to newsletter now!", "hello world", "hello worlds"]
    for n in [2, 3, 4, 5, 6, 8, 12, 20] * 25:
        line = " ".join(rng.choice(words) for _ in range(n))
        at = rng.randrange(len(line))
        texts += [line, (line[:at] + "q" + line[at + 1 :]).strip()]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    like = [(i, i + 1) for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])]
    assert like[:2] == [(0, 1), (2, 3)] and len(like) > 100
    table = spark.createDataFrame(list(enumerate(texts)), "key long, line string")
    found = {r.key: r.component for r in lines.line_classes(table).collect()}
    assert [p for p in like if p[0] not in found or found[p[0]] != found.get(p[1])] == []


def test_lines_leave_no_files_behind(spark):
    """Only what the result still reads stays on disk: no intermediate files, nothing that a step shuffled."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        """Shuffle files but those of a few sums."""
        found = [f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]
        return {f for f in found if os.path.exists(f) and os.path.getsize(f) > 2000}

    folders = lambda: {f for f in os.listdir(shared_folder(spark)) if f.startswith("barloom-")}
    rng = random.Random(14)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(80)]
    docs = spark.createDataFrame([(i, f"{base[i % 80]}\n{base[i * 7 % 80]}x") for i in range(200)], "doc_id long, text string")
    files, kept = shuffled(), folders()
    rows = lines.dedup_lines(docs)
    assert len(folders() - kept) <= 8  # small lists of pairs and the lines to leave out
    for _ in range(100):
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert not shuffled() - files
    assert sum(r.n_kept for r in rows.collect()) == 80
    assert spark.conf.get(CLEANUP) == "false"


def test_unlike_lines_of_one_passage_move_as_keys(spark, monkeypatch):
    """Unlike lines of a common passage are told apart without their texts, like ones are found."""
    rng = random.Random(12)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(14))
    words = lambda n: " ".join("".join(rng.choice("ijklmnop") for _ in range(7)) for _ in range(n))
    texts = [f"{passage} {words(24)}" for _ in range(120)]
    texts += [texts[0] + " x", texts[1].replace("i", "q", 1)]
    asked = []
    exact = lines.similar
    monkeypatch.setattr(lines, "similar", lambda a, b, percent=75: asked.append(1) or exact(a, b, percent))
    written, widths = lines.materialized, []
    monkeypatch.setattr(lines, "materialized", lambda df: widths.append((df.columns, written(df))) or widths[-1][1])
    table = spark.createDataFrame(list(enumerate(texts)), "key long, line string")
    found = {r.key: r.component for r in lines.line_classes(table).collect()}
    assert found[120] == found[0] == 0 and found[121] == found[1] == 1
    assert all(found.get(k, k) == k for k in range(120))
    pairs = [df.count() for columns, df in widths if columns == ["a", "b"]]
    assert asked and pairs and max(pairs) <= 10
    assert not [c for c, _ in widths if "s" in c]  # whole sets of hashes beside each entry


def test_main_text(spark):
    def page(i):
        body = "".join(f"<p>Sentence {k} of page {i} has several words. It goes on.</p>" for k in range(4))
        return f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T{i}</h1>{body}</article><footer>&copy; us</footer></body></html>"

    odd = '<body><div class="cookie-notice">Take them.</div><main>A &amp; <b>B</b>&nbsp;c.<p>Longer text is here. And more.<aside>See also</aside></main><div id="comments"><p>Nice. Very nice.</p></div><script>x="</p>"</script>'
    rows = [(i, page(i)) for i in range(40)] + [(100, None), (101, ""), (102, odd), (103, "<"), (104, "<p" * 2000), (0, page(0))]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))
    trees = html.fit(pages)
    got = {r.page_id: r for r in html.extract(pages, trees).collect()}
    assert got[3].text == "T3\n" + "\n".join(f"Sentence {k} of page 3 has several words. It goes on." for k in range(4))
    assert got[102].text == "A & B c.\nLonger text is here. And more."
    assert got[100].text == got[101].text == "" and got[3].n_chars == len(got[3].text)
    assert html.extract(pages.limit(0), trees).count() == 0


def test_pipeline(spark, docs, tmp_path_factory):
    import corpus_pipeline

    folder = str(tmp_path_factory.mktemp("sf"))
    pd.DataFrame({"item_id": [1], "text": ["w1 w2 w3 w4 w5 w6 w7 w8"]}).to_parquet(f"{folder}/benchmark.parquet")
    docs.drop("set_id").write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out.columns) == {*docs.drop("set_id").columns, "taken"} and (out.taken > 0).all()
    assert 305 not in set(out.doc_id) and not set(range(100, 106)) & set(out.doc_id)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.drop("set_id").limit(0), folder).count() == 0


def test_jaccard_of_common_passages(spark):
    """Texts made of a few passages that many share: hot lists of unlike sets, near and at the border."""
    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(9)]
    texts = [" ".join(rng.choices(passages, k=rng.choice([3, 4, 5, 8]))) for _ in range(110)]
    texts += [None, "", "w1", texts[0], texts[0] + " x", " ".join(texts[:40])]
    base = [f"v{i}" for i in range(25)]
    # 18 of 24 runs shared is 75 of 100 exactly; 17 of 25 is below.
    texts += [" ".join(base), " ".join(base[:22] + ["a", "b", "c"]), " ".join(base[:21] + ["d", "e", "f", "g"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    same(jaccard.join(docs).select("doc_id", "n_shingles", "component_id"), jaccard.SQL_JACCARD, documents=docs.toPandas())


def _written(monkeypatch):
    """What line_classes writes from now on: (columns, rows, distinct rows)."""
    write, written = lines.materialized, []

    def kept(df):
        df = write(df)
        written.append((df.columns, df.count(), df.distinct().count()))
        return df

    monkeypatch.setattr(lines, "materialized", kept)
    return written


def test_lists_of_unlike_lines_are_left_early(spark, monkeypatch):
    """Short lines of few words share bands by chance: hardly any stays in a list, like ones all do."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 9))) for _ in range(1500)]
    texts += [t + " x" for t in texts[:40]]
    written = _written(monkeypatch)
    table = spark.createDataFrame(list(enumerate(texts)), "key long, line string")
    found = {r.key: r.component for r in lines.line_classes(table).collect()}
    assert all(found[1500 + i] == found[i] == i for i in range(40))
    nodes = next(n for columns, n, _ in written if columns == ["key"])
    assert 80 <= nodes <= 160  # 1,540 lines


def test_bands_are_dealt_out_in_steps(spark, monkeypatch):
    """Only some bands are on their way at once, each with all its lines; equal lines count once."""
    rng = random.Random(22)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n))
    texts = [words(n) for n in (4, 6, 12, 30, 60) for _ in range(30)]
    texts = texts + texts + [t + " z" for t in texts]
    keys = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    written = _written(monkeypatch)
    table = spark.createDataFrame([(keys[t], t) for t in texts], "key long, line string")
    found = {r.key: r.component for r in lines.line_classes(table).collect()}
    assert all(found[keys[t]] == found[keys[t + " z"]] for t in texts[:150])
    listed = [(n, distinct) for columns, n, distinct in written if sorted(columns) == ["list", "node"]]
    assert len(listed) > 4 and all(n == distinct for n, distinct in listed)
    # Each step but the last, that of rare shingles, holds a part of the entries.
    assert all(0 < n <= sum(n for n, _ in listed) / 4 for n, _ in listed[:-1])


def test_lines_are_signed_by_compiled_methods(spark, monkeypatch):
    """Also on a session that allows longer methods than the JVM compiles; its setting stays."""
    before, write, limits = spark.conf.get(lines.METHOD_LIMIT), lines.materialized, []
    monkeypatch.setattr(lines, "materialized", lambda df: limits.append((df.columns, spark.conf.get(lines.METHOD_LIMIT))) or write(df))
    spark.conf.set(lines.METHOD_LIMIT, "65535")
    try:
        lines.line_classes(spark.createDataFrame([(1, "a line of some words"), (2, "a line of some words!")], "key long, line string"))
        assert spark.conf.get(lines.METHOD_LIMIT) == "65535"
    finally:
        spark.conf.set(lines.METHOD_LIMIT, before)
    assert [limit for columns, limit in limits if "b0" in columns] == ["8000"]
