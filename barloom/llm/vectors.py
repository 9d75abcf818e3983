"""Embedding near-duplicates by product quantisation: probed lists, table distances, exact cosine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.session import materialized

COSINE = 0.95
#: Vectors to fit the quantisers on, about; lists at most; codes of a subspace at most; subspaces.
SAMPLE, LISTS, CODES, PARTS = 20_000, 1024, 256, 8
#: Members, and vectors that ask for partners, that meet in a task, about.
BLOCK, ASKED = 256, 2048
#: Room for rounding in bounds of distances.
SLACK = 1e-6
#: A pair across two lists is found if it lies at most so many standard deviations of a random
#: direction apart across the plane between them; with few components that is the whole reach.
DEVIATIONS = 4.0
#: Vectors that are placed at a time.
PLACED = 1000


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and for each subspace the codes of residuals."""

    centres: np.ndarray
    codes: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Quantiser:
        centres = _means(x, lists)
        rest = x - centres[_nearest(x, centres)[0]]
        return Quantiser(centres, [_means(rest[:, s], CODES) for s in _spaces(x.shape[1])])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance between a vector and what its codes stand for)."""
        at = _nearest(x, self.centres)[0]
        rest = x - self.centres[at]
        codes = np.zeros((len(x), len(self.codes)), np.uint8)
        error = np.zeros(len(x))
        for m, s in enumerate(_spaces(x.shape[1])):
            codes[:, m], square = _nearest(rest[:, s], self.codes[m])
            error += square
        return at, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists in which a row asks for vectors within reach; its own is one.

        Whatever lies in another list is beyond the plane half way between both centres. Across
        that plane a partner moves by its distance times the cosine of its direction, which for
        a random one has a deviation of 1 / sqrt(components). One of both is no farther from the
        plane than half of that, so it is enough that a row asks beyond planes so near.
        """
        reach = 0.5 * reach * min(1.0, DEVIATIONS / np.sqrt(x.shape[1]))
        square = _squares(x, self.centres)
        own = square.argmin(axis=1)
        apart = np.sqrt(np.maximum(_squares(self.centres, self.centres), 0))[own]
        gap = (square - square[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart, 1e-12)
        near = gap <= reach + SLACK
        near[np.arange(len(x)), own] = True
        return np.nonzero(near)

    def near(self, at: int, queries: np.ndarray, codes: np.ndarray, error: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of one list that may be within reach, by distances from lookup tables.

        A member lies within its own error of what its codes stand for, so none is missed.
        """
        rest = queries - self.centres[at]
        total = np.zeros((len(queries), len(codes)))
        for m, s in enumerate(_spaces(queries.shape[1])):
            total += _squares(rest[:, s], self.codes[m])[:, codes[:, m]]
        return np.nonzero(np.sqrt(np.maximum(total, 0)) <= reach + error[None, :] + SLACK)


def _spaces(width: int) -> list[slice]:
    cuts = np.linspace(0, width, min(PARTS, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([_squares(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
    return at, ((x - centres[at]) ** 2).sum(1)


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres, from a fixed start."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)[0]
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(at, x[:, d], k) / np.maximum(n, 1), centres[:, d])
    return centres


def _unit(column) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least `cosine`. Quantisers are
    fitted on about SAMPLE vectors chosen by a hash; every vector is indexed. Of two partners the
    one nearer to the other's list asks there, but for rare directions (see DEVIATIONS; the
    README has measured recall); table distances leave those that may be near enough, with each
    member's own error as room, so none of these is lost, and their cosine is computed.

    Null or zero vectors and those with a null or non-finite component link with nothing, as do
    vectors of unlike lengths, each length having its own index. Ids stand for one vector: rows
    that repeat one count once, the smallest vector stays if they differ; a null id links with
    nothing. Equal vectors are compared once and count as many as they are. An empty table gives
    no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialized(rows.groupBy("id").agg(F.min("v").alias("v")))
    good = (
        F.col("id").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("v", lambda c: c != 0)
    )
    groups = rows.where(F.coalesce(good, F.lit(False))).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    groups = materialized(groups.withColumn("width", F.size("v")))
    found = None
    for width, n in sorted(groups.groupBy("width").count().collect()):  # usually one length
        part = _links(groups.where(F.col("width") == width), n, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    found = materialized(found)
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("links = 0"), "a", "b").select(F.col("node").alias("id"), "component")
    classes = groups.join(counts.withColumnRenamed("a", "id"), "id", "left").join(joined, "id", "left")
    classes = classes.select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    # The smallest id of a component is that of one of its groups.
    out = rows.join(classes, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(groups: DataFrame, n: int, cosine: float) -> DataFrame:
    """(a, b, links): for links > 0 the links of a, else a and b hang together.

    A list's members are dealt by a hash of their ids over blocks of about BLOCK, and who asks in
    it over those of about ASKED. Each pair of blocks is one group, so a hot list spreads over many
    tasks; a group returns counts and a spanning forest of the links it found.
    """
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = groups.where(share if n > SAMPLE else F.lit(True)).select("v").orderBy("v").toArrow()["v"].combine_chunks()
    quantiser = Quantiser.fit(_unit(sample), min(LISTS, max(1, int(np.sqrt(n)))))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def binary(rows: np.ndarray) -> pa.Array:
        """The bytes of each row."""
        width = rows.shape[1] * rows.itemsize
        buffers = [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), buffers).cast(pa.binary())

    def place(batches):
        for whole in batches:
            for batch in (whole.slice(i, PLACED) for i in range(0, len(whole), PLACED)):
                raw = np.asarray(batch["v"].flatten(), dtype=np.float64).reshape(len(batch), -1)
                x = _unit(batch["v"])
                at, codes, error = quantiser.encode(x)
                rows, lists = quantiser.probes(x, reach)
                # Half the bytes for what floats hold exactly.
                with np.errstate(over="ignore"):
                    exact = (raw.astype(np.float32).astype(np.float64) == raw).all(axis=1)
                    short, long = binary(raw.astype(np.float32)), binary(raw)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch["id"],
                        "copies": batch["copies"],
                        "at": pa.array(at, pa.int32()),
                        "x": pc.if_else(pa.array(exact), short, long),
                        "codes": binary(codes),
                        "error": error,
                        "asks": pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(rows, np.arange(len(x) + 1)), pa.int32()), pa.array(lists, pa.int32())
                        ),
                    }
                )

    schema = "id long, copies long, at int, x binary, codes binary, error double, asks array<int>"
    placed = materialized(groups.select("id", "v", "copies").mapInArrow(place, schema))
    asking = placed.select("id", "copies", "at", "x", F.explode("asks").alias("list"))
    # Blocks of members and of those who ask, of each list; there are at most LISTS lists.
    sizes = placed.groupBy(F.col("at").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    asked = asking.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("columns"))
    sizes = F.broadcast(materialized(sizes.join(asked, "list")))

    # Each block of members meets each block of those who ask, one such pair to a group.
    def spread(df: DataFrame, own: str, count: str, other: str, others: str):
        part = F.pmod(F.xxhash64("id", F.lit(5)), F.col(count)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other)
        return df.join(sizes, "list").select("*", part).select(*[F.col(c).alias(c) for c in df.columns], own, every).groupBy("list", "r", "c")

    members = spread(placed.withColumnRenamed("at", "list"), "r", "rows", "c", "columns")
    asking = spread(asking, "c", "columns", "r", "rows")

    def meet(key, member, query):
        if not len(member) or not len(query):
            return found_schema.empty_table()
        here = key[0].as_py()
        a, b = query["id"].to_numpy(), member["id"].to_numpy()
        q, x = (_unpacked(t["x"].to_pylist(), quantiser.centres.shape[1]) for t in (query, member))
        codes = np.frombuffer(b"".join(member["codes"].to_pylist()), np.uint8).reshape(len(b), -1)
        i, j = quantiser.near(here, q, codes, member["error"].to_numpy(), reach)
        home = query["at"].to_numpy()
        asks = member["asks"].combine_chunks()
        owner = np.repeat(np.arange(len(b)), asks.value_lengths().to_numpy())
        # Where both ask in each other's list, the pair counts in the later list.
        both = np.isin(j.astype(np.int64) << 32 | home[i], owner << 32 | asks.flatten().to_numpy())
        keep = (a[i] != b[j]) & ((home[i] <= here) | ~both)
        i, j = i[keep], j[keep]
        keep = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]) >= cosine
        i, j = i[keep], j[keep]
        links = np.bincount(i, member["copies"].to_numpy()[j], len(a)).astype(np.int64)
        # Within a list both ends ask; across lists a pair is met once.
        far = home[i] != here
        back = np.bincount(j[far], query["copies"].to_numpy()[i[far]], len(b)).astype(np.int64)
        some, others = np.flatnonzero(links), np.flatnonzero(back)
        u, v = _forest(a[i], b[j]) if len(i) else (a[:0], a[:0])
        ends = np.r_[a[some], b[others]]
        return pa.table(
            {"a": np.r_[ends, u], "b": np.r_[ends, v], "links": np.r_[links[some], back[others], np.zeros(len(u), np.int64)]}, found_schema
        )

    found_schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "links")])
    return members.cogroup(asking).applyInArrow(meet, "a long, b long, links long")


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors of length 1 of the bytes of floats or doubles."""
    x = np.empty((len(rows), width))
    for kind in (np.float32, np.float64):
        at = [i for i, row in enumerate(rows) if len(row) == width * np.dtype(kind).itemsize]
        if at:
            x[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), width)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked id with the smallest one that it reaches."""
    ids, flat = np.unique(np.r_[a, b], return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = np.flatnonzero(low != np.arange(len(ids)))
    return ids[far], ids[low[far]]


def op1_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


SQL_VECTORS = r"""
WITH RECURSIVE g AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
u AS MATERIALIZED (
  SELECT vec_id, v, sqrt(list_sum([c * c for c in v])) AS n FROM g
  WHERE len([c for c in v if c IS NULL OR isnan(c) OR isinf(c)]) = 0 AND len([c for c in v if c <> 0]) > 0),
e AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a),
m AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT DISTINCT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN m ON m.node = vec_id LEFT JOIN k ON k.a = vec_id
"""
