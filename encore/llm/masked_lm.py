"""Language-model scores by masked pseudo-likelihood, on two levels.

Words become tokens of a small vocabulary: the most frequent words of the corpus, and classes of shape for all others. Which word
of its class a word is, is scored in :mod:`.word_lm` from counts of all words and pairs of words of the corpus. A window network sees the tokens on both sides of a masked one and predicts it. Its training data, how often each token
stands between each pair of neighbours, are counted exactly over every document; those counts hold all that the
network's likelihood depends on, so each step of the descent is a step over the whole corpus. A document's score is
the sum of the conditional log-probabilities of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import scan
from .frames import DOUBLE, LONG, column, field, map_batches, map_texts

#: Tokens in all; the table of scores has VOCABULARY ** 3 entries of four bytes.
VOCABULARY = 128
EDGE = 0
SHAPES = 45
_FLUSH = 200_000


@dataclass(frozen=True)
class Fit:
    hidden: int = 32
    steps: int = 300
    rate: float = 0.02
    seed: int = 11


def shapes(data: np.ndarray, found: scan.Words) -> np.ndarray:
    """Class of each word from its length and the kinds of its characters: 1 to ``SHAPES``."""
    start, end = found.start, found.end

    def any_of(low: int, high: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= low) & (data <= high), out=total[1:])
        return total[end] > total[start]

    size = np.digitize(end - start, [4, 7, 10, 14])
    lower, upper, digit, wide = any_of(97, 122), any_of(65, 90), any_of(48, 57), any_of(128, 255)
    kind = np.select(
        [digit & ~lower & ~upper, digit, ~(lower | upper | wide), upper & ~lower & ~wide, upper & wide, upper, wide & ~lower, wide],
        [1, 2, 3, 4, 5, 6, 7, 8],
        0,
    )
    return 1 + size * 9 + kind


@dataclass(frozen=True)
class Lexicon:
    """Sorted keys of the most frequent words; how many other words each shape has, how often they occur, and all words together."""

    frequent: np.ndarray
    sizes: np.ndarray
    totals: np.ndarray
    words: int


def lexicon(documents: DataFrame, text_col: str, number: int) -> Lexicon:
    """Counts every word of all documents; ties for a place among the frequent ones go to the smaller key."""

    def run(batches):
        held, size = [], 0

        def merged():
            key, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
            key, first, back = np.unique(key, return_index=True, return_inverse=True)
            return key, shape[first], np.bincount(back, weights=n).astype(np.int64)

        for batch in batches:
            for _, data, offsets in scan.blocks(batch.column(0)):
                found = scan.words(data, offsets, scan.PLAIN)
                key, first, n = np.unique(found.key, return_index=True, return_counts=True)
                held.append((key, shapes(data, found)[first], n))
                size += len(key)
                if size > 3 * _FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _FLUSH:
                        yield [pa.array(held[0][0].view(np.int64)), *map(pa.array, held[0][1:])]
                        held, size = [], 0
        if held:
            key, shape, n = merged()
            yield [pa.array(key.view(np.int64)), pa.array(shape), pa.array(n)]

    schema = T.StructType([field("key", LONG), field("shape", LONG), field("n", LONG)])
    parts = map_batches(documents.select(column(text_col).cast("string")), schema, run)
    counts = parts.groupBy("key").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(number).select("key", "shape", F.lit(1).cast("long").alias("words"), "n")
    each = counts.groupBy("shape").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
    rows = top.unionByName(each.select(F.lit(None).cast("long").alias("key"), "shape", "words", "n")).collect()
    sizes, totals = np.zeros(1 + SHAPES, np.int64), np.zeros(1 + SHAPES, np.int64)
    for row in rows:
        sign = 1 if row["key"] is None else -1
        sizes[row["shape"]] += sign * row["words"]
        totals[row["shape"]] += sign * row["n"]
    frequent = np.sort(np.array([r["key"] for r in rows if r["key"] is not None], np.int64).view(np.uint64))
    return Lexicon(frequent, sizes, totals, sum(r["n"] for r in rows if r["key"] is None))


class Tokens:
    """Token numbers of the words of a block: edge, shapes, then frequent words."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = scan.words(data, offsets, scan.PLAIN)
        return self.of(data, found), found.ptr

    def of(self, data: np.ndarray, found: scan.Words) -> np.ndarray:
        out = shapes(data, found)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, found.key)
            at[at == len(self.frequent)] = 0
            out = np.where(self.frequent[at] == found.key, 1 + SHAPES + at, out)
        return out

    def between(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of (left, right, token) for every word of the block, and the words' range of each text."""
        tokens, ptr = self(data, offsets)
        return self.coded(tokens, ptr), ptr

    @staticmethod
    def coded(tokens: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        left, right = np.full(len(tokens), EDGE), np.full(len(tokens), EDGE)
        left[1:], right[:-1] = tokens[:-1], tokens[1:]
        filled = np.flatnonzero(np.diff(ptr))
        left[ptr[filled]] = EDGE
        right[ptr[filled + 1] - 1] = EDGE
        return (left * VOCABULARY + right) * VOCABULARY + tokens


def neighbour_counts(documents: DataFrame, text_col: str, frequent: np.ndarray) -> DataFrame:
    """(code, n): how often each token stands between each pair of neighbours, over all documents."""

    def run(batches):
        tokens, seen = Tokens(frequent), np.zeros(VOCABULARY**3, np.int64)
        for batch in batches:
            for _, data, offsets in scan.blocks(batch.column(0)):
                codes, _ = tokens.between(data, offsets)
                np.add(seen, np.bincount(codes, minlength=len(seen)), out=seen) if len(codes) > 50_000 else np.add.at(seen, codes, 1)
        there = np.flatnonzero(seen)
        for low in range(0, len(there), 50_000):
            part = there[low : low + 50_000]
            yield [pa.array(part), pa.array(seen[part])]

    schema = T.StructType([field("code", LONG), field("n", LONG)])
    parts = map_batches(documents.select(column(text_col).cast("string")), schema, run)
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def fit(codes: np.ndarray, counts: np.ndarray, how: Fit = Fit()) -> np.ndarray:
    """The network's log-probabilities, indexed by left neighbour, right neighbour and token.

    Hidden layer: tanh of the sum of a left and a right embedding; output: softmax over the vocabulary. Adam on the
    exact likelihood of all counts, over every pair of neighbours that occurs.
    """
    size, rng = VOCABULARY, np.random.default_rng(how.seed)
    pair, token = codes // size, codes % size
    pairs, row = np.unique(pair, return_inverse=True)
    left, right = pairs // size, pairs % size
    table = np.zeros((len(pairs), size), np.float32)
    table[row, token] = counts
    total = max(float(table.sum()), 1.0)
    table /= np.float32(total)
    weight = table.sum(1, keepdims=True)
    theta = {
        "left": rng.normal(0, 0.3, (size, how.hidden)),
        "right": rng.normal(0, 0.3, (size, how.hidden)),
        "out": rng.normal(0, 0.1, (how.hidden, size)),
        "bias": np.log((np.bincount(token, weights=counts, minlength=size) + 1) / (total + size)),
    }
    theta = {k: v.astype(np.float32) for k, v in theta.items()}
    grown = {k: np.zeros_like(v) for k, v in theta.items()}
    swing = {k: np.zeros_like(v) for k, v in theta.items()}
    by_left, by_right = (np.argsort(x, kind="stable") for x in (left, right))
    first_left, first_right = (np.unique(x[o], return_index=True) for x, o in ((left, by_left), (right, by_right)))
    for step in range(1, how.steps + 1 if len(pairs) else 1):
        hidden = np.tanh(theta["left"][left] + theta["right"][right])
        z = hidden @ theta["out"] + theta["bias"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z *= weight
        z -= table
        back = (z @ theta["out"].T) * (1 - hidden**2)
        slope = {"out": hidden.T @ z, "bias": z.sum(0), "left": np.zeros_like(theta["left"]), "right": np.zeros_like(theta["right"])}
        slope["left"][first_left[0]] = np.add.reduceat(back[by_left], first_left[1], axis=0)
        slope["right"][first_right[0]] = np.add.reduceat(back[by_right], first_right[1], axis=0)
        for k in theta:
            grown[k] = 0.9 * grown[k] + 0.1 * slope[k]
            swing[k] = 0.99 * swing[k] + 0.01 * slope[k] ** 2
            theta[k] = theta[k] - how.rate * (grown[k] / (1 - 0.9**step)) / (np.sqrt(swing[k] / (1 - 0.99**step)) + 1e-10)
    out = np.empty((size, size, size), np.float32)
    for i in range(size):
        z = np.tanh(theta["left"][i] + theta["right"]) @ theta["out"] + theta["bias"]
        top = z.max(1, keepdims=True)
        out[i] = z - top - np.log(np.exp(z - top).sum(1, keepdims=True))
    return out


@dataclass(frozen=True)
class Model:
    """Frequent words and the network's scores; the counted words, and how often each shape follows and precedes each token."""

    frequent: np.ndarray
    table: np.ndarray
    words: Lexicon
    after: np.ndarray
    before: np.ndarray


def train(documents: DataFrame, text_col: str = "text", how: Fit = Fit()) -> Model:
    """Vocabulary, counts and network over all documents. What reaches the driver is bounded by ``VOCABULARY`` cubed."""
    words = lexicon(documents, text_col, VOCABULARY - 1 - SHAPES)
    counts = neighbour_counts(documents, text_col, words.frequent).toArrow()
    order = np.argsort(counts.column("code").to_numpy())
    codes, n = counts.column("code").to_numpy()[order], counts.column("n").to_numpy()[order]
    pair, token = codes // VOCABULARY, codes % VOCABULARY
    beside = [np.bincount(side * VOCABULARY + token, n, VOCABULARY**2).reshape(VOCABULARY, -1) for side in (pair // VOCABULARY, pair % VOCABULARY)]
    return Model(words.frequent, fit(codes, n, how), words, *beside)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, number of words, summed conditional log-probability of their tokens and its mean, from the whole text.

    The table of scores (8 MB) goes out by broadcast. Null, empty and wordless texts have no words, sum 0 and mean null.
    Repeated rows score alike; other columns are not read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    shared, frequent = spark.sparkContext.broadcast(model.table), model.frequent

    def start():
        tokens, table = Tokens(frequent), shared.value.reshape(-1)

        def work(texts):
            number, summed = [], []
            for _, data, offsets in scan.blocks(texts):
                codes, ptr = tokens.between(data, offsets)
                total = np.append(0.0, np.cumsum(table[codes], dtype=np.float64))
                number.append(np.diff(ptr))
                summed.append(np.diff(total[ptr]))
            n = np.concatenate(number) if number else np.zeros(0, np.int64)
            s = np.concatenate(summed) if summed else np.zeros(0)
            return [n, s, pa.array(s / np.maximum(n, 1), mask=n == 0)]

        return work

    return map_texts(
        documents, [id_col], text_col, [field("n_tokens", LONG), field("log_prob", DOUBLE), field("mean_log_prob", DOUBLE)], start
    )
