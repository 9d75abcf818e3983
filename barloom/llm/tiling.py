"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the shortest tile, and the part of an item's words under tiles from which it counts as leaked.
LEAST, COVERAGE = 5, 0.5
#: Words of benchmark items that go to the tasks at once; a larger benchmark goes in several blocks.
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LEAKS = "array<struct<item_id:{kind},coverage:double,tiles:int,longest:int>>"


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words (letters, digits and _, lower-cased), equal within one process."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.full(len(words), _BASE), dtype=np.uint64)
    down = np.cumprod(np.full(len(words), _INVERSE), dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(words * up, dtype=np.uint64)]
    # Divided by the power of the start, so that equal runs are equal wherever they stand.
    return (sums[n:] - sums[:-n]) * down[: len(words) - n + 1]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in doc, start in item, length), the longest first.

    Rounds run Karp-Rabin for a falling window length over the words that no tile covers, and
    grow the matches. The longest is tiled first; one that loses words to it goes back in line
    with what is left. Among equal ones the first in the item, then in the document, goes first.
    """
    free_d, free_t = np.ones(len(doc), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while len(item) >= least:
        size = max(least, size // 2)
        line = [(-n, j, i) for i, j, n in _matches(doc, item, free_d, free_t, size)]
        heapq.heapify(line)
        while line:
            n, j, i = heapq.heappop(line)
            free = free_d[i : i - n] & free_t[j : j - n]
            if free.all():
                found.append((i, j, -n))
                free_d[i : i - n] = free_t[j : j - n] = False
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
            for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if end - start >= size:
                    heapq.heappush(line, (start - end, j + start, i + start))
        if size == least:
            break
    return found


def _starts(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n free words."""
    taken = np.r_[0, np.cumsum(~free)]
    return np.flatnonzero(taken[n:] == taken[:-n]) if len(free) >= n else np.zeros(0, np.int64)


def _matches(doc, item, free_d, free_t, n) -> list[tuple[int, int, int]]:
    """Maximal matches of n free words at least."""
    at_t, at_d = _starts(free_t, n), _starts(free_d, n)
    if not len(at_t) or not len(at_d):
        return []
    ht, hd = window_hashes(item, n)[at_t], window_hashes(doc, n)[at_d]
    at_d = at_d[np.isin(hd, ht)]
    by: dict[int, list[int]] = {}
    for j, h in zip(at_t.tolist(), ht.tolist()):
        by.setdefault(h, []).append(j)
    out = []
    for i, h in zip(at_d.tolist(), window_hashes(doc, n)[at_d].tolist()):
        for j in by[h]:
            if i and j and free_d[i - 1] and free_t[j - 1] and doc[i - 1] == item[j - 1]:
                continue  # part of a match that starts before
            room = min(len(doc) - i, len(item) - j)
            same = (doc[i : i + room] == item[j : j + room]) & free_d[i : i + room] & free_t[j : j + room]
            length = room if same.all() else int(same.argmin())
            if length >= n:
                out.append((i, j, length))
    return out


class Items:
    """Benchmark items with an index of their seeds, the runs of `least` words."""

    def __init__(self, items: list[tuple], least: int):
        self.least = least
        self.items = [(key, w) for key, text in items if len(w := words_of(text))]
        self.lengths = sorted({min(least, len(w)) for _, w in self.items})
        self.seeds: dict[int, dict[int, list[int]]] = {n: {} for n in self.lengths}
        for k, (_, w) in enumerate(self.items):
            n = min(least, len(w))
            for h in np.unique(window_hashes(w, n)).tolist():
                self.seeds[n].setdefault(h, []).append(k)
        self.sorted = {n: np.array(sorted(s), np.uint64) for n, s in self.seeds.items()}

    def leaks(self, text: str | None, coverage: float) -> list[dict]:
        doc = words_of(text)
        hit: set[int] = set()
        for n in self.lengths:
            h, known = window_hashes(doc, n), self.sorted[n]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for x in np.unique(h[known[at] == h]).tolist():
                hit.update(self.seeds[n][x])
        out = []
        for k in sorted(hit):
            key, item = self.items[k]
            found = tiles(doc, item, min(self.least, len(item)))
            covered = sum(n for *_, n in found) / len(item)
            if covered >= coverage:
                out.append({"item_id": key, "coverage": covered, "tiles": len(found), "longest": max(n for *_, n in found)})
        return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    least: int = LEAST,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Adds `leaks` to every row: the benchmark items of whose words tiles cover enough.

    Leaks are (item_id, coverage, tiles, longest), by rising block and place in the benchmark.
    Tiles are runs of `least` words at least, shared and not overlapping, in any order, so that
    reordered passages count; an item with fewer words counts whole. Words are lower-cased runs
    of letters, digits and _. Null and empty texts have no leaks, items without words never
    leak; repeated rows and items count each; empty tables give no leaks. `keep` names the
    columns to return (all but `leaks` itself).

    The benchmark goes to the tasks in blocks of about `block_words` words, one pass of the
    texts for each; the documents aren't shuffled.
    """
    keep = [c for c in (keep or docs.columns) if c != "leaks"]
    kind = benchmark.schema[item_id].dataType.simpleString()
    size = F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"\W+"))
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"), size.alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    rows = docs.select(*keep, *([] if text in keep else [text]), F.array().cast(LEAKS.format(kind=kind)).alias("leaks"))
    for b in range(blocks):
        part = [tuple(r) for r in items.where(block == b).select("id", "text").orderBy("id", "text").collect()]
        rows = rows.mapInArrow(_run(part, text, least, coverage), rows.schema)
    return rows.select(*keep, "leaks")


def _run(part: list[tuple], text: str, least: int, coverage: float):
    def run(batches):
        items = Items(part, least)
        for batch in batches:
            at = batch.schema.get_field_index("leaks")
            before = batch["leaks"].to_pylist()
            found = [a + items.leaks(t, coverage) for a, t in zip(before, batch[text].to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return run


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of every leak in all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
