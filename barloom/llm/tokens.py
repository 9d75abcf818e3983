"""Token counts of a unigram tokenizer: Viterbi without the pieces' texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The vocabulary file and how many words a process remembers at once.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY = 500_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, log-probability), in the file's order: by rank as in Zipf's law, -log(rank).

    The file ranks its pieces but holds no probabilities of a unigram model.
    """
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    return [(model.id_to_piece(i), -math.log(rank + 2)) for rank, i in enumerate(pieces)]


class Counter:
    """Counts the pieces of the best segmentation of words.

    Ties as in the tokenizer: a later candidate wins only with a strictly higher score, and
    candidates of an end come by rising start, so the longest last piece stays. A character
    that is no piece costs the lowest score less 10 and counts as its UTF-8 bytes.
    """

    def __init__(self, pieces):
        self.tree = ahocorasick.Automaton()
        for piece, score in pieces:
            self.tree.add_word(piece, (len(piece), score))
        self.tree.make_automaton()
        self.known = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word."""
        best, count = [0.0], [0]
        # Matches come by end, those of an end by rising start.
        if self.known.issuperset(word):
            for end, (length, score) in self.tree.iter(word):
                start = end + 1 - length
                score += best[start]
                if end + 1 == len(best):
                    best.append(score)
                    count.append(count[start] + 1)
                elif score > best[-1]:
                    best[-1], count[-1] = score, count[start] + 1
            return count[-1], best[-1]
        matches: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, match in self.tree.iter(word):
            matches[end].append(match)
        for end, found in enumerate(matches):
            top, n = None, 0
            if word[end] not in self.known:
                found = [*found, (1, None)]
            for length, score in found:
                start = end + 1 - length
                pieces = 1 if score is not None else len(word[end].encode("utf-8", "replace"))
                value = best[start] + (self.unknown if score is None else score)
                if top is None or value > top:
                    top, n = value, count[start] + pieces
            best.append(top)
            count.append(n)
        return count[-1], best[-1]

    def text(self, text: str | None) -> tuple[int, float]:
        """Sums over the words of a text: every space starts a word, as its mark."""
        n, total = 0, 0.0
        if text:
            seen = self.seen
            words = text.replace(" ", MARK).split(MARK)
            for word in words if words[0] else words[1:]:
                found = seen.get(word)
                if found is None:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    found = seen[word] = self.word(MARK + word)
                n += found[0]
                total += found[1]
        return n, total


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """Adds n_tokens and best_score to every row.

    Words are counted apart, as the tokenizer does: each starts with the mark of the space
    before it, and the text with one too unless a space leads it. Null and empty texts have no token and score 0.
    Repeated rows stay, an empty table gives no rows; own columns of those names are replaced.
    The vocabulary goes to every task: it is a tokenizer's file, not data.
    """
    own = [c for c in docs.columns if c not in ("n_tokens", "best_score")]

    def run(batches):
        counter = Counter(pieces)
        for batch in batches:
            found = [counter.text(t) for t in batch[text].to_pylist()]
            arrays = [*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "n_tokens", "best_score"])

    schema = docs.select(*own).schema
    schema = type(schema)(list(schema.fields)).add("n_tokens", "long").add("best_score", "double")
    return docs.select(*own).mapInArrow(run, schema)


def op3_tokens(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, read_vocabulary(vocabulary)).select("doc_id", "n_tokens", "best_score")
