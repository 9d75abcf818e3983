"""Language identification by Bloom filters whose slots hold one bit per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.boosting import bounded

#: Documents of each language to learn from, and n-grams of each language in the filters, at most.
SAMPLE, GRAMS = 2_000, 50_000
#: An n-gram belongs to the languages where it is at least this part as frequent as where it is most frequent.
RATIO = 0.25
SLOTS = 1 << 19
SIZES = (3, 4)
#: Characters that one step turns into n-grams; longer texts go in pieces.
PIECE = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _pieces(texts):
    """Lists of (row, padded piece) of about PIECE characters; a piece holds the windows' ends too."""
    held, size = [], 0
    over = max(SIZES) - 1
    for row, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for i in range(0, len(text), PIECE):
            held.append((row, text[i : i + PIECE + over]))
            size += len(held[-1][1])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def gram_hashes(texts):
    """(row of each n-gram, its 64-bit hash, rows with a letter), step by step.

    An n-gram is a run of letters with the space or other character before or after it, if
    any, as one mark; it never spans two words. Letter case doesn't count.
    """
    gap, letters = " " * max(SIZES), _letters()
    for held in _pieces(texts):
        codes = np.frombuffer(gap.join(p for _, p in held).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(p) for _, p in held])
        starts = np.cumsum(lengths + len(gap)) - lengths - len(gap)
        rows = np.repeat(np.array([r for r, _ in held]), lengths + len(gap))[: len(codes)]
        codes = np.where(letters[codes], codes, 0).astype(np.uint64)
        counts = np.ones(len(codes), bool)
        for i in np.flatnonzero(lengths > PIECE):
            counts[starts[i] + PIECE : starts[i] + lengths[i]] = False
        letter = np.unique(rows[codes > 0])
        for n in SIZES:
            m = len(codes) - n + 1
            ok = counts[:m].copy()
            h = np.full(m, n, np.uint64)
            for j in range(n):
                part = codes[j : j + m]
                if 0 < j < n - 1:
                    ok &= part > 0
                h = h * np.uint64(0x110001) + part
            yield rows[:m][ok], _mix(h[ok]), letter


@dataclass(frozen=True)
class Filters:
    """slots: (words of 64 languages, SLOTS) bit masks; rates: false positives by language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    rates: np.ndarray
    prior: str

    @staticmethod
    def build(languages, hashes: np.ndarray, masks: list[int], prior: str) -> Filters:
        words = max(1, -(-len(languages) // 64))
        slots = np.zeros((words, SLOTS), np.uint64)
        for w in range(words):
            part = np.array([m >> (64 * w) & (1 << 64) - 1 for m in masks], np.uint64)
            for at in Filters._places(hashes):
                np.bitwise_or.at(slots[w], at, part)
        share = [float(((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        return Filters(tuple(languages), slots, np.array(share) ** 3, prior)

    @staticmethod
    def _places(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(s)) % np.uint64(SLOTS)).astype(np.int64) for s in (0, 20, 40)]

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text: whose n-grams, less the expected false ones, are most."""
        n, k = len(texts), len(self.languages)
        found, total, letter = np.zeros((k, n)), np.zeros(n), np.zeros(n, bool)
        for rows, h, with_letter in gram_hashes(texts):
            letter[with_letter] = True
            total += np.bincount(rows, minlength=n)
            a, b, c = self._places(h)
            for w in range(len(self.slots)):
                mask = self.slots[w][a] & self.slots[w][b] & self.slots[w][c]
                for i in range(64 * w, min(k, 64 * w + 64)):
                    found[i] += np.bincount(rows[(mask >> np.uint64(i % 64)) & np.uint64(1) > 0], minlength=n)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        true = np.maximum(0, found - total * self.rates[:, None]) / (1 - np.minimum(self.rates, 0.999))[:, None]
        best, all_ = true.argmax(axis=0), true.sum(axis=0)
        score = np.where(letter & (all_ > 0), true.max(axis=0) / np.where(all_ > 0, all_, 1), 0.0)
        names = [self.languages[b] if s > 0 else self.prior for b, s in zip(best, score)]
        return [name if ok else UNKNOWN for name, ok in zip(names, letter)], score


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, grams: int = GRAMS) -> Filters:
    """Filters from documents with a language; null languages and texts are left out.

    About `sample` documents of each language are read, whole, chosen by a hash of the id. Its
    `grams` most frequent n-grams make a language's filter. Without any labelled document the
    filters know no language and everything is `und`.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filters.build((), np.zeros(0, np.uint64), [], UNKNOWN)

    def count(batches):
        for batch in batches:
            langs, texts = np.array(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
            for name in sorted(set(langs)):
                for _, h, _ in gram_hashes([t for t, of in zip(texts, langs) if of == name]):
                    h, n = np.unique(h, return_counts=True)
                    names = pa.array([name] * len(h), pa.string())
                    yield pa.RecordBatch.from_pydict({"lang": names, "h": h.view(np.int64), "n": n.astype(np.int64)})

    counts = bounded(rows, "lang", F.col("id"), sample).select("lang", "text").mapInArrow(count, "lang string, h long, n long")
    counts = counts.groupBy("lang", "h").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    chosen = (
        counts.withColumn("p", share)
        .withColumn("top", F.max("p").over(W.partitionBy("h")))
        .where(F.col("p") >= F.col("top") * RATIO)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "h")))
        .where(F.col("rank") <= grams)
    )
    languages = sorted(sizes)
    bit = {name: 1 << i for i, name in enumerate(languages)}
    masks: dict[int, int] = {}
    for name, h in chosen.select("lang", "h").collect():  # at most `grams` for each language
        masks[h] = masks.get(h, 0) | bit[name]
    hashes = np.array(list(masks), np.int64).view(np.uint64)
    prior = min(languages, key=lambda x: (-sizes[x], x))
    return Filters.build(languages, hashes, list(masks.values()), prior)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row, from its whole text alone.

    The score is the best language's part of all found n-grams, 0 to 1. Null texts and those
    without a letter are `und` with score 0; texts with letters but no known n-gram get the
    most frequent learned language with score 0; ties go to the first language by name.
    Repeated rows stay; own columns of those names are replaced. The filters go to every
    task; SLOTS fixes their size.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        for batch in batches:
            names, score = filters.predict(batch[text].to_pylist())
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "lang_pred", "score"])

    schema = docs.select(*own).schema
    schema = type(schema)(list(schema.fields)).add("lang_pred", "string").add("score", "double")
    return docs.select(*own).mapInArrow(run, schema)


def part_of(doc_id) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def op7_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of all documents, learned from those whose id's crc32 mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = fit(docs.where(part_of("doc_id") != 1))
    rows = docs.select("doc_id", (part_of("doc_id") == 1).alias("held_out"), "text")
    return identify(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
