"""Exact Jaccard join of word-shingle sets, in components.

Equal sets are one set from the start. Shingles are ordered by the number of sets that hold
them, so that the first ones of a set, one of which every partner must share, are rare; a set
whose first shingles are all its own has no partner. Each set is first compared with one leader of its
list and size, in turns, and sets that hang together by then share their component; only sets
of different components are compared after that. For them the index lists of first shingles
are cut into blocks by what an entry's position leaves of its set: a set asks only the blocks
that leave as much as it needs and skips the others. Signatures bound the difference of two
sets from below, so that few pairs are fetched and counted.

Shingles travel packed, some thousand to a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.linking import link
from barloom.llm.shingles import WORDS, mix, set_id, shingle_set
from barloom.session import materialized

#: Similarity in hundredths.
PERCENT = 75
#: Shingles that a task holds before it sends them.
HELD = 2_000_000
#: Signatures of a set, 64 bits each.
SIGNATURES = 8
_PACK = "r int, ids binary, sizes binary, hashes binary, planes int, owners binary, counts binary"


def needed(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def _packed(r: int, ids, sizes, hashes, owners, counts) -> dict:
    """One row of `_PACK`: entries sorted by hash, as differences, byte by byte."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    first, gaps = gaps[:1], gaps[1:]
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    body = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T[:planes])
    small = owners.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
    return {
        "r": r,
        "ids": ids.tobytes(),
        "sizes": sizes.astype(np.uint32).tobytes(),
        "hashes": first.tobytes() + body.tobytes(),
        "planes": planes,
        "owners": _spread(small),
        "counts": _spread(counts.astype(np.uint32)),
    }


def _spread(x: np.ndarray) -> bytes:
    """Byte by byte, so that high zero bytes stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


def _joined(x: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _unpacked(rows: list[dict]):
    """(hash, set id, set size, count) of all entries of some rows."""
    parts = []
    for row in rows:
        ids, sizes = np.frombuffer(row["ids"], np.uint64), np.frombuffer(row["sizes"], np.uint32)
        body = np.frombuffer(row["hashes"], np.uint8, offset=8).reshape(row["planes"], -1)
        gaps = np.zeros((body.shape[1] + 1, 8), np.uint8)
        gaps[1:, : row["planes"]] = body.T
        gaps = gaps.view(np.uint64).ravel()
        gaps[0] = np.frombuffer(row["hashes"], np.uint64, 1)[0]
        owners = _joined(row["owners"], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        counts = _joined(row["counts"], np.uint32) if row["counts"] else np.ones(len(gaps), np.uint32)
        parts.append((np.cumsum(gaps, dtype=np.uint64), ids[owners], sizes[owners], counts))
    return [np.concatenate(x) for x in zip(*parts)]


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """0 to parts - 1 by the keys' upper half."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    types = [pa.int32(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 2]
    names = [c.split()[0] for c in _PACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)


def _send(h, ids, sizes, owners, counts, by, parts):
    """Entries sorted by hash, cut into one packed row for each range of `by`."""
    r = _ranges(by, parts)
    order = np.argsort(r, kind="stable")
    cuts = np.flatnonzero(np.diff(r[order], prepend=-1))
    for part in np.split(order, cuts[1:]) if len(order) else []:
        used, own = np.unique(owners[part], return_inverse=True)
        yield _packed(int(r[part[0]]), ids[used], sizes[used], h[part], own, counts[part] if counts is not None else np.zeros(0))


def _index(parts: int, k: int):
    """Texts to packed (shingle, set) entries by range of the shingle's hash."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush():
            ids = np.array(list(held), np.int64).view(np.uint64)
            sizes = np.array([len(s) for s in held.values()])
            h = np.concatenate(list(held.values()))
            owners = np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(h)
            return _send(h[order], ids, sizes, owners[order], None, h[order], parts)

        for batch in batches:
            for text in batch["text"].to_pylist():
                s = shingle_set(text, k)
                if len(s) and held.setdefault(set_id(s), s) is s:
                    size += len(s)
                if size >= HELD:
                    yield _rows(list(flush()))
                    held, size = {}, 0
        if size:
            yield _rows(list(flush()))

    return run


def _shared(parts: int):
    """Entries of one hash range to those of shingles with several sets, by range of the set."""

    def run(table: pa.Table) -> pa.Table:
        h, ids, sizes, _ = _unpacked(table.to_pylist())
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        h, ids, sizes = h[several], ids[order][several], sizes[order][several]
        order = np.lexsort((ids, h))
        h, ids, sizes = h[order], ids[order], sizes[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])][: len(h)]
        h, ids, sizes = h[first], ids[first], sizes[first]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        lengths = np.diff(np.r_[starts, len(h)]).astype(np.int64)
        counts = np.repeat(lengths, lengths)
        keep = counts > 1
        h, ids, sizes, counts = h[keep], ids[keep], sizes[keep], counts[keep]
        sets, at, owners = np.unique(ids, return_index=True, return_inverse=True)
        return pa.Table.from_batches([_rows(list(_send(h, sets, sizes[at], owners, counts, ids, parts)))])

    return run


def _signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SIGNATURES numbers for each set: bit b tells whether an odd number of its shingles fall on b.

    Where two sets differ in a bit, they differ in a shingle.
    """
    at = mix(h)
    bits = np.uint64(1) << (at & np.uint64(63))
    word = (at >> np.uint64(6)) % np.uint64(SIGNATURES)
    rows = [np.bitwise_xor.reduceat(np.where(word == i, bits, np.uint64(0)), starts) for i in range(SIGNATURES)]
    return np.array(rows).view(np.int64)


def _prefixes(percent: int):
    """Entries of one range of sets to the sets that may have a partner."""

    def run(table: pa.Table) -> pa.Table:
        h, ids, sizes, counts = _unpacked(table.to_pylist())
        order = np.lexsort((h, counts, ids))
        h, ids, sizes = h[order], ids[order], sizes[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        lengths = np.diff(np.r_[starts, len(ids)])
        n = sizes[starts]
        alone = n - lengths
        first = n - needed(n, percent) + 1 - alone
        some = np.flatnonzero(first > 0)
        signed = _signatures(h, starts)
        tokens = pa.array([h[starts[i] : starts[i] + lengths[i]].view(np.int64) for i in some], pa.list_(pa.int64()))
        return pa.table(
            {
                "set_id": pa.array(ids[starts][some].view(np.int64)),
                "n": pa.array(n[some]),
                "alone": pa.array(alone[some]),
                "first": pa.array(np.minimum(first, lengths)[some]),
                "tokens": tokens,
                **{f"s{i}": pa.array(signed[i][some]) for i in range(SIGNATURES)},
            }
        )

    return run


def _candidates(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different labels in one list that may be similar.

    An entry leaves `room`, the shingles of its set from it on. A partner of m shingles needs
    m * percent / 100 of them, and no partner has more than m * 100 / percent: a set asks the
    blocks between, whatever its own position, and skips the rest of the list.
    """
    step = float(-np.log(percent / 100))
    scale = lambda x: F.log(x.cast("double")) / F.lit(step)
    names = [f"s{i}" for i in range(SIGNATURES)]
    signed = open_.join(sets.select(F.col("set_id").alias("node"), "alone", *names), "node")
    signed = signed.withColumn("room", F.col("n") - F.col("at"))
    index = signed.withColumn("level", F.floor(scale(F.col("room")))).alias("x")
    # One step either way; the margin is for the rounding of logarithms.
    levels = F.sequence(F.floor(scale(F.col("n")) - F.lit(1 + 1e-9)), F.floor(scale(F.col("n")) + F.lit(1 + 1e-9)))
    asking = signed.withColumn("level", F.explode(levels)).alias("y")
    both = F.col("x.n") + F.col("y.n")
    bits = [F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in names]
    apart = sum(bits, F.col("x.alone") + F.col("y.alone"))
    may = (
        (F.least("x.room", "y.room") * (100 + percent) >= both * percent)
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
        & (apart * (100 + percent) <= both * (100 - percent))
    )
    same = (F.col("x.list") == F.col("y.list")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.label") < F.col("y.label"))
    pairs = index.join(asking, same & may)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches):
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            ta, tb = batch["ta"], batch["tb"]
            va, oa = np.asarray(ta.values), np.asarray(ta.offsets)
            vb, ob = np.asarray(tb.values), np.asarray(tb.offsets)
            ok = np.zeros(len(na), bool)
            for i in range(len(na)):
                both = np.concatenate([va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = common * 100 >= percent * (na[i] + nb[i] - common)
            yield pa.RecordBatch.from_pydict({"a": batch["a"].filter(pa.array(ok)), "b": batch["b"].filter(pa.array(ok))})

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return rows.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, set_id, component_id.

    A set holds the distinct runs of k words of the whole text (A-Z lower-cased, words between
    spaces and \\t to \\r); with fewer words, the whole sequence; null or empty texts have an
    empty set and link with nothing. Sets link when 100 * shared >= percent * union.
    component_id is the smallest id that links reach, own ids included. Repeated rows stay, an
    empty table gives no rows, other columns are not read. Shingles and sets are told apart by
    64-bit hashes.
    """
    spark = docs.sparkSession
    # Ranges of hashes, and of sets: those get a packed row from each range of hashes.
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-parts // 4)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def describe(batches):
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch["text"].to_pylist()]
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(s) for s in sets], pa.int64()), ids], ["id", "n_shingles", "set_id"])

    kind = texts.schema["id"].dataType.simpleString()
    documents = materialized(texts.mapInArrow(describe, f"id {kind}, n_shingles long, set_id long"))
    signed = ", ".join(f"s{i} long" for i in range(SIGNATURES))
    sets = materialized(
        texts.select("text")
        .mapInArrow(_index(parts, k), _PACK)
        .groupBy("r")
        .applyInArrow(_shared(groups), _PACK)
        .groupBy("r")
        .applyInArrow(_prefixes(percent), f"set_id long, n long, alone long, first long, tokens array<long>, {signed}")
    )
    entries = sets.select("set_id", "n", "alone", F.posexplode(F.slice("tokens", F.lit(1), F.col("first"))).alias("i", "h"))
    # Blocks of a list hold sizes of one step of the similarity.
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100)))).alias("block")
    entries = entries.select(
        F.col("h").alias("list"), F.col("set_id").alias("node"), "n", (F.col("alone") + F.col("i")).alias("at"), block
    )

    def compare(pairs: DataFrame) -> DataFrame:
        return _linked(pairs, sets, percent)

    grouped = link(materialized(entries), compare, ["block"], lambda open_: compare(_candidates(open_, sets, percent)))
    grouped = grouped.withColumnRenamed("node", "set_id")
    classes = documents.where("set_id is not null").groupBy("set_id").agg(F.min("id").alias("least"))
    classes = classes.join(grouped, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    lowest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialized(classes.join(lowest, "component").select("set_id", "component_id"))
    return documents.join(named, "set_id", "left").select(
        F.col("id").alias(id_col), "n_shingles", "set_id", F.coalesce("component_id", "id").alias("component_id")
    )


def op9_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return join(docs).select("doc_id", "n_shingles", "component_id")


SQL_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g
  FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY 1, 2
"""
