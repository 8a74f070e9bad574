"""Toxicity by multiple-instance learning: only documents are labelled, but sentences offend.

A sentence's score is logistic in its words and their stems; a document's score is the noisy-or of its sentences. Both are trained
together from document labels, so the model also points at the sentences that offend. A sentence without any word of the model
has probability 0, in the fit and in scores, and so has one that scores no higher than ``BACKGROUND``: neither length nor many
harmless uses of the model's words make a document toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import scan
from .frames import DOUBLE, LONG, column, field, keep_rows, map_batches, map_texts
from .labelled import fit_rows, held_out

ENDS = b".!?\n"
#: Bytes of a word's stem.
STEM = 4
THRESHOLD = 0.5
#: Bias of a model without words.
NOTHING = -30.0
#: Probability that a sentence's words must exceed to count; what lies above is stretched to reach 1 again.
BACKGROUND = 0.05
_SENTENCES = T.ArrayType(T.StructType([field("start", LONG), field("end", LONG), field("score", DOUBLE)]))


@dataclass(frozen=True)
class Model:
    """Sorted word keys with their weights, and what is added to them in a sentence that has any."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit: rows and bytes of the sample, words of the model, steps of the descent."""

    most_rows: int = 12_000
    most_bytes: int = 64 << 20
    most_words: int = 4096
    least_documents: int = 4
    evidence: float = 4.0
    steps: int = 400
    rate: float = 0.1
    ridge: float = 1e-3


@dataclass
class Sentences:
    """Words of a block by sentence: sentence of each word, document and byte range of each sentence."""

    words: scan.Words
    of_word: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def features(self) -> np.ndarray:
        """Keys of all words, then of all stems."""
        return np.concatenate([self.words.key, self.words.stem])


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    found = scan.words(data, offsets, scan.ALNUM, STEM)
    table = np.zeros(256, bool)
    table[list(ENDS)] = True
    passed = np.cumsum(table[data], dtype=np.int64)
    doc = found.doc()
    mark = passed[found.start] if len(found.start) else np.zeros(0, np.int64)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return Sentences(found, np.cumsum(fresh) - 1, doc[first], found.start[first], found.end[last])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _hits(vocabulary: np.ndarray, s: Sentences) -> np.ndarray:
    """Which sentence has which word of the model, once each: sentence number times vocabulary size plus word number."""
    keys = s.features
    at = np.searchsorted(vocabulary, keys)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == keys)
    return np.unique(np.tile(s.of_word, 2)[hit] * len(vocabulary) + at[hit])


def _merged(parts: list[tuple]) -> tuple:
    key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, *(np.bincount(inverse, weights=np.concatenate([p[i] for p in parts]), minlength=len(key)) for i in (1, 2))


def _vocabulary(texts: pa.Array, labels: np.ndarray, how: Fit) -> np.ndarray:
    """Sorted keys of the words and stems that fall most unevenly on the two labels."""
    parts: list[tuple] = []
    for first, data, offsets in scan.blocks(texts):
        s = sentences(data, offsets)
        key, inverse = np.unique(s.features, return_inverse=True)
        n = len(offsets) - 1
        once = np.unique(inverse.astype(np.int64) * n + np.tile(s.words.doc(), 2))
        word, toxic = once // n, labels[first + once % n]
        parts.append((key, np.bincount(word, minlength=len(key)), np.bincount(word, weights=toxic, minlength=len(key))))
        if len(parts) == 16:
            parts = [_merged(parts)]
    key, spread, toxic = _merged(parts)
    rate = labels.mean()
    evidence = np.abs(toxic - spread * rate) / np.sqrt(spread * rate * (1 - rate) + 0.5)
    usable = np.flatnonzero((spread >= how.least_documents) & (evidence >= how.evidence))
    return np.sort(key[usable[np.argsort(-evidence[usable], kind="stable")[: how.most_words]]])


def fit(texts: pa.Array, labels: np.ndarray, how: Fit = Fit()) -> Model:
    """Words are chosen by how unevenly they fall on the two labels; weights and bias by gradient descent on noisy-or."""
    labels = np.asarray(labels, float)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), NOTHING)
    if not len(labels) or labels.min() == labels.max():
        return none
    vocabulary = _vocabulary(texts, labels, how)
    if not len(vocabulary):
        return none
    hits, owners, base = [], [], 0
    for first, data, offsets in scan.blocks(texts):
        s = sentences(data, offsets)
        hits.append(_hits(vocabulary, s) + base * len(vocabulary))
        owners.append(s.doc + first)
        base += len(s.doc)
    hit, owner = np.concatenate(hits), np.concatenate(owners)
    where, what = hit // len(vocabulary), hit % len(vocabulary)
    lit, row = np.unique(where, return_inverse=True)
    lit_owner = owner[lit]

    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = -6.0
    grown, swing = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, how.steps + 1):
        weights, bias = theta[:-1], theta[-1]
        z = bias + np.bincount(row, weights=weights[what], minlength=len(lit))
        p = 1 / (1 + np.exp(-z))
        log_q = -np.bincount(lit_owner, weights=_softplus(z), minlength=len(labels))
        q = np.exp(np.minimum(log_q, -1e-9))
        pull = np.where(labels > 0, -q / np.maximum(1 - q, 1e-9), 1.0)
        per_sentence = pull[lit_owner] * p
        slope = np.append(
            np.bincount(what, weights=per_sentence[row], minlength=len(vocabulary)),
            per_sentence.sum(),
        ) / len(labels)
        slope[:-1] += how.ridge * weights / len(vocabulary)
        grown = 0.9 * grown + 0.1 * slope
        swing = 0.99 * swing + 0.01 * slope**2
        theta = theta - how.rate * (grown / (1 - 0.9**step)) / (np.sqrt(swing / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary, theta[:-1], float(theta[-1]))


class Scorer:
    """Noisy-or scores of batches of texts, with the sentences that offend."""

    def __init__(self, model: Model, threshold: float = THRESHOLD):
        self.model, self.threshold = model, threshold

    def block(self, data: np.ndarray, offsets: np.ndarray):
        """Score of each text of a block; sentence numbers with their scores, and all sentences."""
        model, s, n = self.model, sentences(data, offsets), len(offsets) - 1
        counts = np.bincount(s.doc, minlength=n)
        if len(model.keys):
            pair = _hits(model.keys, s)
            lit, row = np.unique(pair // len(model.keys), return_inverse=True)
            z = model.bias + np.bincount(row, weights=model.weights[pair % len(model.keys)], minlength=len(lit))
        else:
            lit, z = np.zeros(0, np.int64), np.zeros(0)
        owner = s.doc[lit]
        log_q = np.minimum(-_softplus(z) - np.log1p(-BACKGROUND), 0.0)
        return 0.0 - np.expm1(np.bincount(owner, weights=log_q, minlength=n)), counts, lit, 0.0 - np.expm1(log_q), s

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [self.block(data, offsets)[0] for _, data, offsets in scan.blocks(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def __call__(self, texts: pa.Array) -> list:
        score, number, spans = [], [], []
        for _, data, offsets in scan.blocks(texts):
            p, counts, lit, of_sentence, s = self.block(data, offsets)
            score.append(p), number.append(counts)
            mine: list[list] = [[] for _ in range(len(offsets) - 1)]
            for k, value in zip(lit, of_sentence, strict=True):
                if value >= self.threshold:
                    low = offsets[s.doc[k]]
                    mine[s.doc[k]].append({"start": int(s.start[k] - low), "end": int(s.end[k] - low), "score": float(value)})
            spans += mine
        join = lambda x: np.concatenate(x) if x else np.zeros(0)
        return [join(score), join(number), spans]


def train(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", how: Fit = Fit()
) -> Model:
    """A model from labelled documents that are not held out. Without both labels it finds nothing toxic.

    One task fits it, on the bounded sample; what comes back to the driver are the model's words and weights.
    """
    rows = fit_rows(documents, labels, label, id_col, text_col, how.most_rows, how.most_bytes).coalesce(1)

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        texts = pa.concat_arrays([p.column(0) for p in parts])
        model = fit(texts, np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts]), how)
        yield [pa.array([*model.keys.view(np.int64).tolist(), None], pa.int64()), pa.array([*model.weights.tolist(), model.bias])]

    found = map_batches(rows, T.StructType([field("key", LONG), field("weight", DOUBLE)]), run).toArrow()
    if not found.num_rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), NOTHING)
    keys, weights = found.column("key").to_pylist(), found.column("weight").to_numpy()
    return Model(np.array(keys[:-1], np.int64).view(np.uint64), weights[:-1], float(weights[-1]))


def toxicity(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The id, whether it is held out, score, verdict, number of sentences and the offending ones with their byte ranges.

    One pass over whole texts; the model is bounded by ``Fit.most_words``. Null, empty and wordless texts have no
    sentences and score 0. Repeated rows score alike; other columns are not read, so their names cannot clash; an empty
    table gives an empty result.
    """
    fields = [field("score", DOUBLE), field("n_sentences", LONG), field("offending", _SENTENCES)]
    scored = map_texts(documents, [id_col], text_col, fields, lambda: Scorer(model, threshold))
    return scored.select(
        column(id_col), held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending",
    )


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they were. Null and empty texts stay."""

    def start():
        scorer = Scorer(model, threshold)
        return lambda texts: scorer.scores(texts) < threshold

    return keep_rows(documents, text_col, start)
