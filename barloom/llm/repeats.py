"""Removal of long repeated byte strings, by backward extension on a Burrows-Wheeler transform.

A string of LENGTH bytes that occurs twice has, in both places, an anchor at the same distance
from its start: the byte whose 8-gram hashes least among its first REACH bytes. Strings are thus
compared only with those whose anchor has the same bytes behind it, its core. For all anchors of
a core, the suffixes that start there are sorted; the bytes before them are their column of the
transform. From there strings grow backward byte by byte, all at once: an interval of suffixes
with the same string falls apart by the next byte of the column, common prefixes grow by one, and
intervals of one suffix go. A string counts as repeated once its common prefix with a neighbour
reaches LENGTH; nothing is extended further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.lines import sized
from barloom.llm.shingles import mix
from barloom.session import discard, materialized

LENGTH = 400
#: Starts that one anchor can serve; the core has LENGTH + 1 - REACH bytes.
REACH = 200
GRAM = 8
#: Bytes of text looked at at a time (below 2**24), and contexts extended at a time.
SLICE, BLOCK = 2 << 20, 30_000
#: A core with more different contexts than this is split before its contexts meet in a task.
GROUP = 4000


def anchors_of(data: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) for all starts of strings of `length` in one text."""
    starts = len(data) - length + 1
    if starts < 1:
        return (np.zeros(0, np.int64),) * 3
    n = starts + reach - 1
    words = np.zeros(n, np.uint64)
    for k in range(GRAM):
        words |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    words = mix(words) & ~np.uint64(0xFFFFFF) | np.arange(n, dtype=np.uint64)
    # Least of each window of `reach`, from least values of blocks up to and from each place.
    blocks = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max)
    blocks[:n] = words
    blocks = blocks.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[reach - 1 : reach - 1 + starts])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return anchor[first], first, np.r_[first[1:] - 1, starts - 1]


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def anchor_rows(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """(doc, th, p, low, high, k1, k2, ctx): all anchors of texts (doc, th, text).

    The strings of anchor p start `low` to `high` bytes before it. k1, k2: hash of the core; ctx:
    hash of all bytes of these strings.
    """
    core = length + 1 - reach

    def run(batches):
        for batch in batches:
            docs, p, low, high, keys, ctx = [], [], [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                text = text.as_py() or b""
                for begin in range(0, max(1, len(text) - length + 1), SLICE):
                    part = text[begin : begin + SLICE + length - 1]
                    at, first, last = (x.tolist() for x in anchors_of(np.frombuffer(part, np.uint8), length, reach))
                    docs += [i] * len(at)
                    p += [begin + x for x in at]
                    low += [x - y for x, y in zip(at, last)]
                    high += [x - y for x, y in zip(at, first)]
                    keys += [xxhash.xxh3_128_digest(part[x : x + core]) for x in at]
                    ctx += [
                        _signed(xxhash.xxh3_64_intdigest(part[a : b + length], seed=(x - a) << 16 | x - b))
                        for x, a, b in zip(at, first, last)
                    ]
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"].take(at), batch["th"].take(at), pa.array(p, pa.int32()), pa.array(low, pa.int32()),
                    pa.array(high, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ctx, pa.int64()),
                ],
                ["doc", "th", "p", "low", "high", "k1", "k2", "ctx"],
            )

    schema = f"doc {texts.schema['doc'].dataType.simpleString()}, th long, p int, low int, high int, k1 long, k2 long, ctx long"
    return texts.mapInArrow(run, schema)


CONTEXT = "o1 long, o2 long, ctx long, weight long, k1 long, k2 long, need int, base int, low int, high int, left binary, right binary"


def contexts(texts: DataFrame, chosen: DataFrame, length: int, reach: int) -> DataFrame:
    """The bytes around the core, for one occurrence of each context.

    left: the bytes from the first start to the anchor; right: those from the core's end to the
    last end. A string that starts j bytes before the anchor has j of the left bytes and
    need - j of the right ones.
    """
    core = length + 1 - reach
    names = [part.split()[0] for part in CONTEXT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch["text"].cast(pa.binary()), batch["found"].to_pylist()):
                text = text.as_py() or b""
                for f in found:
                    p, low, high = f["p"], f["low"], f["high"]
                    rows.append(
                        (f["k1"], f["k2"], f["ctx"], f["weight"], f["k1"], f["k2"], reach - 1, 0, low, high,
                         text[p - high : p], text[p + core : p - low + length])
                    )
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            types = [pa.int64()] * 6 + [pa.int32()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    by_doc = chosen.groupBy(F.col("doc").alias("of"), F.col("th").alias("oth")).agg(
        F.collect_list(F.struct("p", "low", "high", "k1", "k2", "ctx", "weight")).alias("found")
    )
    joined = texts.join(by_doc, F.col("doc").eqNullSafe(F.col("of")) & (F.col("th") == F.col("oth")))
    return joined.select("text", "found").mapInArrow(run, CONTEXT)


def split(rows: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Contexts whose cores have at most `group` different ones, and strings found by the way.

    The strings of a larger core are halved by the distance of their start: the nearer ones all
    have the first bytes on the right, the farther ones the last on the left, and these bytes
    join the core. Halves without a second context go. After at most 8 rounds a core is a whole
    string, and its contexts need no comparison.
    """
    done, found = [], []
    while True:
        sizes = rows.groupBy("k1", "k2").count()
        large = materialized(sizes.where(F.col("count") > group).select("k1", "k2"))
        if large.isEmpty():
            return _all([*done, rows]), _all(found) if found else rows.limit(0)
        large = sized(large, 32)
        done.append(rows.join(large, ["k1", "k2"], "left_anti"))
        hot = rows.join(large, ["k1", "k2"])
        half = F.floor(F.col("need") / 2).cast("int")
        near = hot.where((F.col("need") > 0) & (F.col("low") <= half)).select(
            "o1", "o2", "ctx", "weight", *_keys(F.lit(0), F.expr("substring(right, 1, need - need div 2)")),
            half.alias("need"), "base", "low", F.least("high", half).alias("high"),
            F.expr("substring(left, greatest(length(left) - need div 2, 0) + 1)").alias("left"),
            F.expr("substring(right, need - need div 2 + 1)").alias("right"),
        )
        far = hot.where((F.col("need") > 0) & (F.col("high") > half)).select(
            "o1", "o2", "ctx", "weight", *_keys(F.lit(1), F.expr("substring(left, length(left) - need div 2)")),
            (F.col("need") - half - 1).alias("need"), (F.col("base") + half + 1).alias("base"),
            F.greatest(F.col("low") - half - 1, F.lit(0)).alias("low"), (F.col("high") - half - 1).alias("high"),
            F.expr("substring(left, 1, length(left) - need div 2 - 1)").alias("left"),
            F.expr("substring(right, 1, int(need) - greatest(int(need div 2) + 1, low))").alias("right"),
        )
        halves = materialized(near.unionByName(far).select(rows.columns))
        twice = halves.groupBy("k1", "k2").agg(F.sum("weight").alias("total")).where("total > 1").select("k1", "k2")
        found.append(hot.where("need = 0"))
        rows = materialized(halves.join(twice, ["k1", "k2"]).select(rows.columns))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _keys(side, added):
    parts = [F.col("k1"), F.col("k2"), side, F.col("need"), added]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2")]


def _padded(strings: list[bytes], backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A matrix with a string in each row, and their lengths."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(sizes.max()) if len(sizes) else 0
    fill = (lambda s: s[::-1].ljust(width, b"\0")) if backward else (lambda s: s.ljust(width, b"\0"))
    return np.frombuffer(b"".join(map(fill, strings)), np.uint8).reshape(len(strings), width), sizes


def repeated(group: np.ndarray, need: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each context and distance j, whether its string that starts j before the anchor occurs
    in another context of the group.

    Contexts come sorted by group and right bytes, which is the order of the suffixes at the
    anchors.
    """
    n, top = len(group), int(need.max()) + 1
    marks = np.zeros((n, top), bool)
    ahead, ahead_sizes = _padded(right)
    column, _ = _padded(left, backward=True)  # column[i, j]: the byte before the string of distance j
    same = np.zeros(n, np.int64)  # common prefix with the suffix before; -1 at the start of an interval
    if n > 1:
        equal = ahead[1:] == ahead[:-1]
        equal = np.c_[equal, np.zeros(n - 1, bool)]
        same[1:] = np.minimum(equal.argmin(axis=1), np.minimum(ahead_sizes[1:], ahead_sizes[:-1]))
    same[np.r_[True, group[1:] != group[:-1]]] = -1
    rows = np.arange(n)
    for j in range(top):
        alive = high[rows] >= j
        rows, same = _without(rows, same, alive)
        lone = (same < 0) & np.r_[same[1:] < 0, True]
        rows, same = _without(rows, same, ~lone)
        if not len(rows):
            break
        link = same >= need[rows] - j
        link &= same >= 0
        both = link | np.r_[link[1:], False]
        marks[rows[both & (need[rows] >= j)], j] = True
        if j + 1 == top or j >= column.shape[1]:
            break
        # Backward extension: stable by the byte before, within each interval.
        byte = column[rows, j].astype(np.int64)
        inside = same >= 0
        if (byte[1:] != byte[:-1])[inside[1:]].any():
            interval = np.cumsum(~inside)
            order = np.argsort(interval << 8 | byte, kind="stable")
            shared = _range_least(same, order)
            new = (interval[order][1:] != interval[order][:-1]) | (byte[order][1:] != byte[order][:-1])
            rows = rows[order]
            same = np.r_[-1, np.where(new, -1, shared)]
    return marks


def _without(rows, same, keep):
    """Leaves suffixes out; the next one's common prefix is then the least of those between."""
    if keep.all():
        return rows, same
    if not keep.any():
        return rows[:0], same[:0]
    at = np.flatnonzero(keep)
    return rows[at], np.minimum.reduceat(same[: at[-1] + 1], np.r_[0, at[:-1] + 1])


def _range_least(same, order):
    """Least of `same` behind order[i] up to order[i + 1], for each i where these rise."""
    a, b = order[:-1] + 1, order[1:]
    length = np.maximum(b - a + 1, 1)
    level = np.frexp(length.astype(float))[1] - 1
    out, table, step = np.empty(len(a), np.int64), same, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            table = np.minimum(table[:-step], table[step:])
            step *= 2
        of = level == k
        last = len(table) - 1
        out[of] = np.minimum(table[np.minimum(a[of], last)], table[np.clip(b[of] - (1 << k) + 1, 0, last)])
    return out


def extend(rows: DataFrame, length: int) -> DataFrame:
    """(o1, o2, ctx, begin, end): covered bytes of each context, relative to its anchor."""

    def runs(held) -> Iterator[tuple]:
        o1, o2, ctx, weight, k1, k2, need, base, low, high, left, right = zip(*held)
        key = np.array([k1, k2])
        group = np.cumsum(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        need, base, low, high = (np.array(x, np.int64) for x in (need, base, low, high))
        marks = repeated(group, need, high, list(left), list(right))
        j = np.arange(marks.shape[1])
        marks |= (np.array(weight) > 1)[:, None] & (j >= low[:, None]) & (j <= high[:, None])
        edges = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (at, first), (_, behind) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        for i, a, b in zip(at.tolist(), first.tolist(), behind.tolist()):
            shift = int(base[i])
            yield o1[i], o2[i], ctx[i], -(b - 1 + shift), length - a - shift

    def run(batches):
        held, now = [], None
        names = ["o1", "o2", "ctx", "begin", "end"]

        def packed():
            columns = list(zip(*runs(held))) if held else []
            types = [pa.int64()] * 3 + [pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns or [[]] * 5, types)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[4:6] != now:
                    if len(held) >= BLOCK:
                        yield packed()
                        held = []
                    now = row[4:6]
                held.append(row)
        yield packed()

    columns = [part.split()[0] for part in CONTEXT.split(", ")]
    ordered = rows.select(columns).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "right", "left")
    return ordered.mapInArrow(run, "o1 long, o2 long, ctx long, begin int, end int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH, group: int = GROUP) -> DataFrame:
    """(doc, th, spans): the covered byte ranges of texts with repeated strings.

    `th` is the xxhash64 of the text; with the id it names a row. Rows that repeat both are
    copies of each other, so all of them is repeated (if they have `length` bytes).
    """
    if not GRAM <= reach <= length - GRAM:
        raise ValueError("reach must leave room for an anchor in a string")
    texts = _texts(docs, id_col, text)
    anchors = anchor_rows(texts, length, reach)
    twice = materialized(anchors.groupBy("k1").count().where(F.col("count") > 1).select("k1"))
    found = materialized(anchors.join(sized(twice, 40), "k1"))
    discard(twice)
    first = F.min(F.struct("doc", "th", "p", "low", "high")).alias("one")
    chosen = found.groupBy("k1", "k2", "ctx").agg(F.count("*").alias("weight"), first)
    chosen = chosen.select("k1", "k2", "ctx", "weight", "one.*")
    around = materialized(contexts(texts, chosen, length, reach).dropDuplicates(["k1", "k2", "ctx"]))
    rows, whole = split(around, group)
    whole = whole.select("o1", "o2", "ctx", (-F.col("base")).alias("begin"), (length - F.col("base")).cast("int").alias("end"))
    marks = materialized(extend(rows, length).unionByName(whole).distinct())
    discard(around, rows, whole)
    named = marks.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), "ctx", "begin", "end")
    spans = found.join(named, ["k1", "k2", "ctx"])
    span = F.struct((F.col("p") + F.col("begin")).alias("begin"), (F.col("p") + F.col("end")).alias("end"))
    spans = materialized(spans.groupBy("doc", "th").agg(F.collect_set(span).alias("spans")))
    discard(found, marks)
    return spans


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(plain).alias("th"), plain.alias("text"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH, group: int = GROUP
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans and kept (the rest, as bytes).

    Every byte is removed that a string of `length` bytes covers which also starts anywhere
    else, in the same or another text; strings are judged on the input, and overlapping and
    touching ones are one span. Null texts are empty; texts below `length` bytes stay; repeated
    rows remove each other; null ids are one id; an empty table gives no rows; other columns are
    not read. Long texts are looked at SLICE bytes at a time.
    """
    found = repeats(docs, id_col, text, length, reach, group)
    # Texts are dealt out to their spans, however few: the plan and what it moves a GB stay the same at any size.
    found = found.select(F.col("doc").alias("of"), F.col("th").alias("oth"), "spans")
    joined = _texts(docs, id_col, text).join(found, F.col("doc").eqNullSafe(F.col("of")) & (F.col("th") == F.col("oth")), "left")
    doc = joined.schema["doc"].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, spans in zip(batch["text"].cast(pa.binary()), batch["spans"]):
                text = text.as_py() or b""
                sizes.append(len(text))
                joint, rest, last = [], [], 0
                for s in sorted((x["begin"], x["end"]) for x in spans.as_py() or ()):
                    if joint and s[0] <= joint[-1]["end"]:
                        joint[-1]["end"] = max(joint[-1]["end"], s[1])
                    else:
                        joint.append({"begin": s[0], "end": s[1]})
                for s in joint:
                    rest.append(text[last : s["begin"]])
                    last = s["end"]
                merged.append(joint)
                kept.append(b"".join([*rest, text[last:]]))
            arrays = [batch["doc"], pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_bytes", "spans", "kept"])

    out = joined.select("doc", "text", "spans").mapInArrow(
        run, f"doc {doc}, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary"
    )
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select(
        F.col("doc").alias(id_col), "n_bytes", removed.cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "spans", "kept",
    )


def op11_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each document without byte strings that occur elsewhere too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL_REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT r, i, md5(b[i:i + 399]::BLOB) AS h
  FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i FROM w SEMI JOIN twice USING (h)),
runs AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM starts)),
spans AS (SELECT r, run, min(i) AS a, max(i) + 399 AS z FROM runs GROUP BY r, run),
pieces AS (
  SELECT s.r, run, hex(b[coalesce(lag(z) OVER (PARTITION BY s.r ORDER BY run), 0) + 1:a - 1]::BLOB) AS piece
  FROM spans s JOIN d ON d.r = s.r
  UNION ALL
  SELECT d.r, 1000000000, hex(b[coalesce(last, 0) + 1:octet_length(b)]::BLOB)
  FROM d LEFT JOIN (SELECT r, max(z) AS last FROM spans GROUP BY r) l ON l.r = d.r),
kept AS (SELECT r, sha256(unhex(string_agg(piece, '' ORDER BY run))) AS kept_sha256 FROM pieces GROUP BY r),
sums AS (SELECT r, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
