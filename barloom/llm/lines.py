"""Fuzzy line deduplication by MinHash, with SQL functions only.

Pairs travel as keys. Sizes and a sketch of both signatures tell most unlike pairs, also in large
buckets; only the rest fetch their texts, once a pair, for the exact check.
"""

from __future__ import annotations

from functools import reduce
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.linking import across, link
from barloom.session import discard, materialized

#: Characters of a shingle, of the signature and of the exact check.
SHINGLE = 5
#: Bands of a signature, and hashes of a band.
BANDS, ROWS = 16, 4
#: Bins of each band, by their places: two deals of all bins.
DEALS = [Random(seed).sample(range(BANDS * ROWS), BANDS * ROWS) for seed in (1, 2)]
#: Where the bins of a signature start.
START = [(b << 64) // (BANDS * ROWS) - (1 << 63) for b in range(BANDS * ROWS)]
#: The entries of the bands are dealt out in so many steps.
PASSES = 8
#: Lines of up to so many distinct shingles get all their partners, by prefixes.
FEW = 24
#: Lines of up to so many have bands of both deals.
TWICE = 256
#: Lines of up to so many have sketches of their sets.
SHORT = 128
#: What is known of a line before its text is read: its size and sketches.
MARKS = ["n", "p0", "p1", "q0", "q1"]
PERCENT = 75
#: Standard deviations by which a like pair's sketches may differ more than expected.
DEVIATIONS = 5
#: Above so many bytes of a method Spark splits it; sessions may allow more than HotSpot compiles.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: A table is broadcast up to so many bytes, measured; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def shingles(line: Column) -> Column:
    """All distinct runs of SHINGLE characters; the whole line if it is shorter."""
    runs = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(F.array_distinct(runs))


def similar(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether 100 * shared shingles >= percent * all shingles."""
    return _with(
        F.struct(shingles(a).alias("x"), shingles(b).alias("y")), lambda s: _enough(s.x, s.y, percent)
    )


def _enough(x: Column, y: Column, percent: int) -> Column:
    """The same for sets of distinct shingles; sizes are looked at first."""
    n = F.size(x) + F.size(y)
    sizes = F.least(F.size(x), F.size(y)) * 100 >= F.greatest(F.size(x), F.size(y)) * percent
    # shared >= percent * (n - shared) / 100
    return sizes & (F.size(F.array_intersect(x, y)) * (100 + percent) >= n * percent)


def hashed(line: Column) -> Column:
    """Sorted 64-bit hashes of all shingles, equal ones together."""
    runs = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.sort_array(F.transform(F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(runs), lambda x: F.xxhash64(x)))


def signature(hashes: Column, marked: Column) -> Column:
    """The BANDS * ROWS bins of a one-permutation MinHash signature of sorted shingle hashes.

    The hashes lie on a circle cut into BANDS * ROWS equal bins; each bin stands for the first
    hash from its start on, be it in a later bin. So sets of Jaccard similarity J agree in a bin
    with probability J however few hashes they have. `marked` holds the hashes and the bins' starts,
    sorted: before the start of bin b are b other starts, the rest are hashes.
    """
    before = lambda b: F.array_position(marked, START[b]) - F.lit(b + 1)
    return F.array(*[F.get(hashes, F.pmod(before(b), F.size(hashes)).cast("int")) for b in range(BANDS * ROWS)])


def with_starts(hashes: Column) -> Column:
    """The hashes and the starts of all bins, sorted."""
    return F.sort_array(F.concat(hashes, F.array(*[F.lit(x).cast("long") for x in START])))


def bands_of(bins: Column, deals: int) -> list[Column]:
    """Hashes of ROWS bins each, PASSES arrays of them: every deal gives each bin to one of BANDS bands.

    Neighbouring bins of a line with few shingles stand for the same one, so bins are dealt at random.
    """
    bands = [F.hash(F.lit(t), *[F.get(bins, F.lit(b)) for b in DEALS[d][t : t + ROWS]]) for d in range(deals) for t in range(0, BANDS * ROWS, ROWS)]
    return [F.array(*bands[k::PASSES]) for k in range(PASSES)]


def _plane(bins: Column, bit: int) -> Column:
    """One bit of each bin, in a number."""
    bits = [F.shiftleft(F.shiftright(F.get(bins, F.lit(b)), bit).bitwiseAND(F.lit(1)), b) for b in range(BANDS * ROWS)]
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2])]
    return bits[0]


def _parity(hashes: Column, word: int) -> Column:
    """Bit b tells whether an odd number of the hashes fall on b, of those with this `word`."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    mine = F.filter(hashes, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1)) == word)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))


def signed(hashes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For sorted hashes (key, h): key, the number `n` of distinct ones, sketches `q0`, `q1` of the
    set or `p0`, `p1` of the signature, themselves in `few` if prefixes are to be looked at, and
    the bands in `b0`, `b1`, ...

    A line of at most FEW shingles has no bands; those that can be like one have both. A line of at
    most SHORT shingles has a sketch of its set; those that can be like a longer one have both.
    """
    sets = hashes.select("key", "h", F.array_distinct("h").alias("d"), with_starts(F.col("h")).alias("e"))
    sets = sets.select("key", "d", F.size("d").alias("n"), F.when(F.size("d") > FEW, signature(F.col("h"), F.col("e"))).alias("g"))
    n, d, g = F.col("n"), F.col("d"), F.col("g")
    bands = [F.when(n > TWICE, one).when(n > FEW, two) for one, two in zip(bands_of(g, 1), bands_of(g, 2))]
    return sets.select(
        "key",
        "n",
        *[F.when(n * 100 > SHORT * percent, _plane(g, i)).alias(f"p{i}") for i in range(2)],
        *[F.when(n <= SHORT, _parity(d, i)).alias(f"q{i}") for i in range(2)],
        F.when(n * percent <= FEW * 100, d).alias("few"),
        *[b.alias(f"b{k}") for k, b in enumerate(bands)],
    )


def may_be_like(x: str, y: str, percent: int) -> Column:
    """Whether two lines can be like each other by their marks: sizes and sketches.

    Two bits of each bin agree with probability J + (1 - J) / 4; n shingles fill about n / 2 bins
    independently, 60 at most. A like pair is missed if it lies DEVIATIONS off. Where sketches of
    sets differ in a bit, the sets differ in a shingle; that misses none.
    """
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    small = F.least(nx, ny)
    agree = (percent + (100 - percent) / 4) / 100
    spread = F.sqrt(F.lit(agree * (1 - agree)) / F.least(small / 2, F.lit(60.0)))
    differ = lambda p: F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))
    same = BANDS * ROWS - F.bit_count(differ("p0").bitwiseOR(differ("p1")))
    near = same >= (F.lit(agree) - DEVIATIONS * spread) * (BANDS * ROWS)
    apart = (F.bit_count(differ("q0")) + F.bit_count(differ("q1"))) * (100 + percent)
    sizes = small * 100 >= F.greatest(nx, ny) * percent
    return sizes & F.coalesce(apart <= (nx + ny) * (100 - percent), F.lit(True)) & F.coalesce(near, F.lit(True))


def prefixes(few: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, band) of sets (key, few): any two that are similar share a band.

    They share all but so few shingles that one is among the first n - ceil(n * percent / 100) + 1
    of each, in any common order; rare shingles come first.
    """
    each = few.select("key", F.explode("few").alias("band"))
    counts = each.groupBy("band").agg(F.count("*").alias("n"))
    ordered = each.join(counts, "band").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("all"))
    n = F.size("all")
    first = F.slice("all.band", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return ordered.select("key", F.explode(first).alias("band"))


def _with(value: Column, body) -> Column:
    """body(value) with value computed once, not at each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _compiled(df: DataFrame) -> DataFrame:
    """The written table, by generated methods that are small enough for HotSpot to compile them."""
    conf = df.sparkSession.conf
    before = conf.get(METHOD_LIMIT)
    conf.set(METHOD_LIMIT, "8000")
    try:
        return materialized(df)
    finally:
        conf.set(METHOD_LIMIT, before)


def sized(df: DataFrame, width: int | Column) -> DataFrame:
    """A written table, to be broadcast if it is small; rows with arrays differ in width."""
    total = df.count() * width if isinstance(width, int) else df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def line_classes(lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, component) of the distinct lines (key, line) that are like another one.

    Lines of one bucket, those with equal bands or a rare shingle in common, are compared. Buckets
    are never cut.
    """
    signs = signed(lines.select("key", hashed(F.col("line")).alias("h")), percent)
    marked = F.struct(*[c for c in signs.columns if c != "key"])
    # Equal lines are told apart by nothing.
    signs = _compiled(signs.groupBy("key").agg(F.first(marked).alias("m")).select("key", "m.*"))

    def several(entries: DataFrame) -> DataFrame:
        """Those of lists with a line that may be like theirs; most lists have none."""
        dealt = entries.repartition("list")
        met = (F.col("x.list") == F.col("y.list")) & (F.col("x.node") != F.col("y.node"))
        met = dealt.alias("x").join(dealt.alias("y"), met & may_be_like("x", "y", percent), "left_semi")
        return materialized(met.select("list", "node"))

    # Some bands at a time, so that only their entries are on their way at once. One plan serves all,
    # so that it is compiled once: steps may share a list by chance, as 32 bits of a hash may.
    parts = []
    for k in range(PASSES):
        band = signs.select(F.col("key").alias("node"), *MARKS, F.posexplode(f"b{k}").alias("at", "band"))
        parts.append(several(band.withColumn("list", F.shiftleft(F.col("at").cast("long"), 32) + F.col("band")).drop("at", "band")))
    near = prefixes(signs.where("few is not null").select("key", "few"), percent)
    near = near.join(signs.select("key", *MARKS), "key")
    parts.append(several(near.withColumnsRenamed({"key": "node", "band": "list"})))
    members = reduce(DataFrame.unionByName, parts)
    keys = sized(materialized(members.select(F.col("node").alias("key")).distinct()), 16)
    marks = materialized(signs.select("key", *MARKS).join(keys, "key"))
    discard(signs)
    done = [marks, keys]
    texts = materialized(lines.join(keys, "key").groupBy("key").agg(F.min("line").alias("line")))

    def alike(pairs: DataFrame) -> DataFrame:
        # Only the texts that are asked for move.
        pairs = materialized(pairs)
        rows = pairs
        for end in "ab":
            asked = sized(materialized(pairs.select(F.col(end).alias("key")).distinct()), 16)
            done.append(asked)
            found = texts.join(asked, "key", "left_semi").select(F.col("key").alias(end), F.col("line").alias(f"l{end}"))
            rows = rows.join(found, end)
        return rows.where(similar(F.col("la"), F.col("lb"), percent)).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        for end, side in (("a", "x"), ("b", "y")):
            pairs = pairs.join(marks.select(F.col("key").alias(end), F.struct(*MARKS).alias(side)), end)
        return alike(pairs.where(may_be_like("x", "y", percent)).select("a", "b"))

    def rest(open_: DataFrame) -> DataFrame:
        # Many lines may share a passage and be unlike: sizes and sketches are compared in the join itself.
        signed_ = materialized(open_.join(marks.withColumnRenamed("key", "node"), "node"))
        done.append(signed_)
        return alike(across(signed_, may_be_like("x", "y", percent)))

    classes = link(members, linked, [], rest).withColumnRenamed("node", "key")
    # All links are found by now.
    discard(texts, *done)
    return classes


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Documents with only the first line of each class of like lines, and n_lines, n_kept.

    Lines end at \\n; those that are equal after trimming and lower-casing, or whose character
    shingles are similar, are one class with all that they reach. The line with the smallest
    (id, place) stays, the others go, over all documents. Blank lines are no duplicates and
    stay, unless all other lines of the document go: then its text is empty. Null texts stay
    null with no lines. Rows that repeat both id and text are treated alike, as one document;
    an empty table gives no rows; own columns n_lines and n_kept are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_kept", "_doc", "_gone")]
    docs = docs.select(*own, F.xxhash64(F.col(id_col), F.col(text)).alias("_doc"))
    lines = docs.select("_doc", F.col(id_col).alias("id"), F.posexplode_outer(F.split(F.lower(text), "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("key", F.xxhash64("line"))
    places = materialized(lines.select("_doc", "id", "at", "key"))
    place = F.struct("id", "at", "_doc")
    firsts = places.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classes = line_classes(lines.select("key", "line"), percent)
    firsts = firsts.join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # Lines of classes with one line only need no look.
    first_of = firsts.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    keepers = firsts.select("key", "component").join(first_of, "component").select("key", "first")
    gone = places.join(keepers, "key").where(place != F.col("first"))
    gone = materialized(gone.groupBy("_doc").agg(F.array_sort(F.collect_set("at")).alias("_gone"), F.lit(1).alias("_some")))
    discard(places, classes)
    bytes_ = gone.agg(F.sum(F.size("_gone") * 8 + 64)).first()[0] or 0
    split = F.split(F.col(text), "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    rows = docs.join(F.broadcast(gone) if bytes_ <= BROADCAST_BYTES else gone, "_doc", "left").withColumn("_kept", kept)
    full = F.size(F.filter("_kept", lambda x: F.trim(x) != ""))
    new = F.when(F.col("_some").isNull(), F.col(text)).when(full == 0, "").otherwise(F.array_join("_kept", "\n"))
    before = F.size(F.filter(split, lambda x: F.trim(x) != ""))
    counts = [F.coalesce(F.when(F.col(text).isNotNull(), n), F.lit(0)).cast("long") for n in (before, full)]
    columns = [new.alias(text) if c == text else F.col(c) for c in own]
    return rows.select(*columns, counts[0].alias("n_lines"), counts[1].alias("n_kept"))


def op6_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without their repeated lines."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")
