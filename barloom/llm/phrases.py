"""Phrase collocations from weighted acyclic automata over n-grams of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.lines import sized
from barloom.llm.shingles import mix
from barloom.session import materialized

LEAST, TOP, PERCENT, LONGEST = 30, 2000, 80, 4
#: Bytes of text cut into words at a time; n-grams of a shard that are sorted at a time.
SLICE, SHARD = 4 << 20, 4_000_000
#: Words of the corpus for each prefix range, and the most bits of the number of ranges.
RANGE_WORDS, RANGE_BITS = 500_000, 24
#: A filter has 16 to 32 bits for each key, and so many bits (64 MB) at most; a fuller one lets
#: more n-grams pass that are counted in vain, and changes no result.
FILTER_BITS = 29
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(ENDS)] = 1, 2
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD1342543DE82EF95
_NEXT = np.uint64(0xA0761D6478BD642F)


class Words:
    """The words of a slice of texts: hashes of (language, word), and which follow each other.

    `skip` leading words were in the slice before; n-grams that end in them are left out.
    """

    def __init__(self, texts: list[bytes], langs: list[str], skip: int, powers):
        self.data = b"\n".join(texts)
        codes = np.frombuffer(self.data, np.uint8)
        kind = _KIND[codes]
        word = np.zeros(len(codes) + 2, np.int8)
        word[1:-1] = kind == 0
        edge = np.diff(word)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.skip, count = skip, len(self.starts)
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_BYTE[codes] * up[: len(codes)], out=sums[1:])
        plain = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.names = sorted(set(langs))
        of_text = np.array([self.names.index(x) for x in langs], np.int64)
        self.lang = of_text[np.searchsorted(firsts, self.starts, "right") - 1] if count else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.names], np.uint64)
        self.hash = mix(plain + seeds[self.lang])
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        self.joined = breaks[self.starts[1:]] == breaks[self.ends[:-1] - 1]

    def counts(self) -> tuple[list, list, np.ndarray, np.ndarray]:
        """(language, word, hash, count) of the distinct words."""
        new = self.hash[self.skip :]
        hashes, first, n = np.unique(new, return_index=True, return_counts=True)
        first += self.skip
        spans = zip(self.starts[first].tolist(), self.ends[first].tolist())
        return [self.names[i] for i in self.lang[first]], [self.data[a:b] for a, b in spans], hashes, n

    def totals(self) -> np.ndarray:
        return np.bincount(self.lang[self.skip :], minlength=len(self.names))

    def pairs(self, words: Bits) -> np.ndarray:
        """For each word, whether it and the next one are a pair of words that pass the filter."""
        ok = words.has(self.hash)
        return ok[:-1] & ok[1:] & self.joined

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n-grams that start where `at` holds, as rows of hashes."""
        i = np.flatnonzero(at)
        i = i[i + n > self.skip]
        return np.stack([self.hash[i + k] for k in range(n)], axis=1)


def pair_key(a, b):
    return mix(a * _NEXT + b)


def _cut(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a text of about SLICE bytes, and how many leading words the part before has too."""
    skip, limit = 0, SLICE
    while len(text) > limit:
        end = max(text.rfind(ENDS[i : i + 1], 0, limit) for i in range(len(ENDS)))
        if end >= 0:
            yield text[: end + 1], skip
            text, skip, limit = text[end + 1 :], 0, SLICE
            continue
        # One piece: cut between words and carry the last words over.
        gap = max(text.rfind(b" ", 0, limit), text.rfind(b"\t", 0, limit), 0)
        starts = np.flatnonzero(np.diff(np.r_[0, _KIND[np.frombuffer(text, np.uint8, gap)] == 0].astype(np.int8)) == 1)
        if len(starts) < 2 * LONGEST:
            limit *= 2
            continue
        yield text[:gap], skip
        skip, limit = LONGEST - 1, SLICE
        text = text[starts[-skip] :]
    yield text, skip


def _slices(batches) -> Iterator[Words]:
    known: dict = {}

    def powers(n: int):
        """Powers of an odd number modulo 2**64, and of its inverse."""
        if n > known.get("n", 0):
            steps = [np.full(n, x, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            known.update(n=n, up=np.cumprod(steps[0]), down=np.cumprod(steps[1]))
        return known["up"], known["down"]

    for batch in batches:
        held, langs, size = [], [], 0
        for text, lang in zip(batch["text"].cast(pa.binary()), batch["lang"].to_pylist()):
            text = (text.as_py() or b"").lower()
            if len(text) > SLICE:
                for part, skip in _cut(text):
                    yield Words([part], [lang], skip, powers)
                continue
            held.append(text)
            langs.append(lang)
            size += len(text) + 1
            if size > SLICE:
                yield Words(held, langs, 0, powers)
                held, langs, size = [], [], 0
        if held:
            yield Words(held, langs, 0, powers)


class Bits:
    """A set of 64-bit keys by their leading bits; may have more keys, never fewer."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, keys: np.ndarray) -> np.ndarray:
        i = keys >> np.uint64(64 - self.bits)
        return (self.data[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(keys: DataFrame) -> Bits:
        """From one long column. Tasks pack the bits; the driver gets packed blocks of fixed total size."""
        size = min(FILTER_BITS, max(16, (16 * keys.count()).bit_length()))
        at = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - size)
        rows = keys.select(F.shiftright(at, 16).alias("block"), at.bitwiseAND(65535).cast("int").alias("at")).distinct()

        def pack(table):
            bits = np.zeros(65536, np.uint8)
            bits[table["at"].to_numpy()] = 1
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.table({"block": table["block"].slice(0, 1), "data": pa.array([packed], pa.binary())})

        data = np.zeros(1 << size - 3, np.uint8)
        for block, packed in rows.groupBy("block").applyInArrow(pack, "block long, data binary").collect():
            data[block << 13 : block + 1 << 13] = np.frombuffer(packed, np.uint8)
        return Bits(size, data)


def merged(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, n
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[new], np.add.reduceat(n, new)


def build(rows: np.ndarray, n: np.ndarray) -> bytes:
    """The automaton of sorted n-grams: from the last words up, states with equal arcs are one.

    A row is an n-gram, filled up with 0 if it is shorter than the longest. An arc has a word,
    the count of the n-gram that ends with it (0: none does) and the state it leads to; arcs of
    level d lead from n-grams of d - 1 words to those of d.
    """
    width = rows.shape[1]
    differ = np.ones((len(rows), width), bool)
    differ[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    target, levels = None, []
    for d in range(width - 1, -1, -1):
        first = np.flatnonzero(differ[:, d] & (rows[:, d] > 0))
        ends = np.ones(len(first), bool) if d == width - 1 else rows[first, d + 1] == 0
        label, weight = rows[first, d], np.where(ends, n[first], 0)
        target = np.zeros(len(first), np.int64) if target is None else target
        # The n-grams of d words that these arcs leave, and how many leave each.
        parent = np.flatnonzero(differ[:, d - 1] & (rows[:, d - 1] > 0)) if d else np.zeros(1, np.int64)
        arcs = np.bincount(np.searchsorted(parent, first, "right") - 1, minlength=len(parent))
        begin = np.cumsum(arcs) - arcs
        sign = mix(label + mix(weight.astype(np.uint64) * _NEXT + target.astype(np.uint64) + np.uint64(1)))
        total = np.zeros(len(first) + 1, np.uint64)
        np.cumsum(sign, out=total[1:])
        signs = mix(total[begin + arcs] - total[begin] + arcs.astype(np.uint64))
        _, keep, state = np.unique(signs, return_index=True, return_inverse=True)
        size = arcs[keep]
        take = np.repeat(begin[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        levels.append((size, label[take], weight[take], target[take]))
        target = state
    parts = [np.array([width], np.uint8).tobytes()]
    for level in reversed(levels):
        for a in level:
            a = a.astype(np.min_scalar_type(a.max())) if len(a) else a.astype(np.uint8)
            parts += [np.array([len(a), a.itemsize], np.int64).tobytes(), a.tobytes()]
    return b"".join(parts)


def paths(automaton: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and counts of an automaton: all its paths, level by level."""
    width, at = automaton[0], 1
    state, prefix, out, counts = np.zeros(1, np.int64), np.zeros((1, 0), np.uint64), [], []
    for d in range(width):
        level = []
        for _ in range(4):
            length, size = np.frombuffer(automaton, np.int64, 2, at)
            level.append(np.frombuffer(automaton, np.dtype(f"u{size}"), length, at + 16).astype(np.int64 if len(level) != 1 else np.uint64))
            at += 16 + int(length * size)
        arcs, label, weight, target = level
        begin, size = (np.cumsum(arcs) - arcs)[state], arcs[state]
        take = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        prefix = np.concatenate([np.repeat(prefix, size, axis=0), label[take][:, None]], axis=1)
        found = weight[take] > 0
        out.append(np.pad(prefix[found], ((0, 0), (0, width - d - 1))))
        counts.append(weight[take][found])
        state = target[take]
    return np.concatenate(out), np.concatenate(counts)


class Shard:
    """N-grams of a shard, counted run by run, then cut into automata by prefix range."""

    def __init__(self, width: int, bits: int):
        self.width, self.bits, self.rows, self.n, self.held = width, bits, [], [], 0

    def add(self, rows: np.ndarray, n: np.ndarray | None = None) -> bool:
        """Whether the shard is full."""
        self.rows.append(np.pad(rows, ((0, 0), (0, self.width - rows.shape[1]))))
        self.n.append(np.ones(len(rows), np.int64) if n is None else n)
        self.held += len(rows)
        if self.held > SHARD:
            self._merge()
        return self.held > SHARD // 2

    def _merge(self):
        if len(self.rows):
            rows, n = merged(np.concatenate(self.rows), np.concatenate(self.n))
            self.rows, self.n, self.held = [rows], [n], len(rows)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        rows, n = (self.rows[0], self.n[0]) if self.rows else (np.zeros((0, self.width), np.uint64), np.zeros(0, np.int64))
        self.rows, self.n, self.held = [], [], 0
        return rows, n

    def automata(self) -> pa.RecordBatch:
        """(range, automaton): ranges by the leading bits of the first and of the second word.

        Both count, so that n-grams after a very frequent first word fall into many ranges.
        """
        rows, n = self.take()
        low = self.bits // 2
        high = self.bits - low
        of = (rows[:, 0] >> np.uint64(64 - high)) << np.uint64(low) | rows[:, 1] >> np.uint64(64 - low)
        order = np.argsort(of, kind="stable")
        rows, n, of = rows[order], n[order], of[order]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        end = np.r_[begin[1:], len(of)]
        blocks = [build(rows[a:b], n[a:b]) for a, b in zip(begin, end)]
        return pa.RecordBatch.from_arrays([pa.array(of[begin].astype(np.int64)), pa.array(blocks, pa.binary())], ["range", "automaton"])


def count(texts: DataFrame, width: int, bits: int, least: int, grams) -> DataFrame:
    """(h1, ..., n) of the n-grams of up to `width` words that occur `least` times.

    `grams(words)` gives the n-grams of a slice to count. Tasks build automata of their sorted
    n-grams; the automata of a prefix range meet in one task, which unites them run by run and
    sums the weights.
    """

    def shards(batches):
        shard = Shard(width, bits)
        for words in _slices(batches):
            for rows in grams(words):
                full = shard.add(rows)
            if full:
                shard._merge()
                if shard.held > SHARD // 2:
                    yield shard.automata()
        yield shard.automata()

    names = [f"h{k + 1}" for k in range(width)] + ["n"]

    def union(batches):
        shard, now = Shard(width, bits), None

        def frequent():
            rows, n = shard.take()
            rows, n = rows[n >= least], n[n >= least]
            arrays = [pa.array(rows[:, k].astype(np.int64)) for k in range(width)] + [pa.array(n)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for of, automaton in zip(batch["range"].to_pylist(), batch["automaton"]):
                if of != now and now is not None:
                    yield frequent()
                now = of
                shard.add(*paths(automaton.as_py()))
        if now is not None:
            yield frequent()

    blocks = texts.mapInArrow(shards, "range long, automaton binary").repartition("range").sortWithinPartitions("range")
    return blocks.mapInArrow(union, ", ".join(f"{c} long" for c in names))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, h1, n); word is null in the row that has the number of all words of a language."""

    def run(batches):
        for words in _slices(batches):
            langs, found, hashes, n = words.counts()
            k, totals = len(words.names), words.totals()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs + words.names, pa.string()),
                    pa.array(found + [None] * k, pa.binary()).cast(pa.string()),
                    pa.array(np.r_[hashes.view(np.int64), np.zeros(k, np.int64)]),
                    pa.array(np.r_[n, totals].astype(np.int64)),
                ],
                ["lang", "word", "h1", "n"],
            )

    rows = texts.mapInArrow(run, "lang string, word string, h1 long, n long")
    return rows.groupBy("lang", "word", "h1").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Words with counts, (lang, word, h1, n), and phrases with counts, (h1, h2, h3, h4, n).

    A phrase occurs at most as often as any part of it, so words below `least` are no part of a
    pair looked for, nor pairs below it of longer phrases: filters of fixed size leave them out
    early, and what a filter lets pass is counted exactly. Unused hashes are 0.
    """
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    words = materialized(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()))
    total = words.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    bits = min(RANGE_BITS, max(6, (total // RANGE_WORDS).bit_length()))
    known = Bits.of(words.where("word IS NOT NULL").select("h1"))

    def two(found):
        yield found.grams(found.pairs(known), 2)

    pairs = materialized(count(texts, 2, bits, least, two))
    known_pairs = Bits.of(_pair_keys(pairs))

    def more(found):
        at = found.pairs(known)
        at[at] = known_pairs.has(pair_key(found.hash[:-1][at], found.hash[1:][at]))
        three = at[:-1] & at[1:]
        yield found.grams(three, 3)
        yield found.grams(three[:-1] & at[2:], 4)

    longer = materialized(count(texts, LONGEST, bits, least, more))
    zero = F.lit(0).cast("long")
    phrases = pairs.select("h1", "h2", zero.alias("h3"), zero.alias("h4"), "n").unionByName(longer)
    return words, phrases


def _pair_keys(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = (batch[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(a, b).view(np.int64))], ["key"])

    return pairs.mapInArrow(run, "key long")


HASHES = ["h1", "h2", "h3", "h4"]


def _part(a, b):
    """The hashes of words a to b - 1 of a phrase, filled up with 0."""
    return [F.when(b - a > k, F.try_element_at(F.col("hs"), a + k + 1)).otherwise(F.lit(0)).cast("long") for k in range(LONGEST)]


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, percent: int = PERCENT
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), cut at `.,;:!?` and line breaks into pieces and at spaces and
    tabs into words. A phrase occurs a >= `least` times; cut where that scores least, its parts
    occur l and r times; its score is floor(2000000 a / (l + r)). Phrases inside a longer one
    that occurs at least `percent` % as often are dropped. The automata are composed with the
    parts by joins on the parts' words, exactly. Null texts are empty, null languages `und`;
    repeated rows count; ties go by phrase; an empty table gives no rows; other columns are not
    read.
    """
    words, phrases = frequent(docs, text, lang, least)
    single = words.where("word IS NOT NULL")
    zero = F.lit(0).cast("long")
    counts = single.select("h1", zero.alias("h2"), zero.alias("h3"), zero.alias("h4"), "n").unionByName(phrases)
    found = phrases.withColumnRenamed("n", "a").withColumn("hs", F.array_compact(F.transform(F.array(*HASHES), lambda h: F.nullif(h, F.lit(0)))))
    found = found.withColumn("m", F.size("hs"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    k, m = F.col("k"), F.col("m")
    cuts = cuts.select(*HASHES, "m", "a", "k", *(x.alias(f"l{i}") for i, x in enumerate(_part(F.lit(0), k))), *(x.alias(f"r{i}") for i, x in enumerate(_part(k, m))))
    for side in "lr":
        part = counts.select(*(F.col(h).alias(f"{side}{i}") for i, h in enumerate(HASHES)), F.col("n").alias(side))
        cuts = cuts.join(part, [f"{side}{i}" for i in range(LONGEST)])
    # A decimal of 38 digits holds the product of any two counts of 18 digits.
    score = F.expr("CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(10,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy(*HASHES, "m", "a").agg(least_cut)
    inner = (
        found.where("m > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size"))))
    )
    start = F.col("start")
    inner = inner.select(*(x.alias(h) for h, x in zip(HASHES, _part(start, start + F.col("size")))), "a")
    inner = inner.groupBy(*HASHES).agg(F.max("a").alias("around"))
    kept = scored.join(inner, HASHES, "left").where(
        F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent)
    )
    named = kept
    dictionary = sized(materialized(single.select("h1", "lang", "word")), 48)
    for i, h in enumerate(HASHES):
        more = ["lang"] if i == 0 else []
        column = dictionary.select(F.col("h1").alias(h), F.col("word").alias(f"w{i}"), *more)
        named = named.join(column, h, "inner" if i < 2 else "left")
    totals = words.where("word IS NULL").select("lang", "n")
    named = named.select(
        "lang", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("phrase"), "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"),
    ).join(totals, "lang")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Each language's 2000 best phrases in all documents."""
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))


SQL_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(list_transform(
           regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
           lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w
  FROM documents),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) AS r(m))
  GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1),
cuts AS (
  SELECT c.*, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS z FROM cand))
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
