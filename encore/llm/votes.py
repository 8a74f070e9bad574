"""Quality by nearest neighbours: labelled documents vote in a latent space.

A text becomes weighted counts of its byte trigrams in a fixed number of buckets, and of words that repeat the word before
them, projected on the leading singular
directions of a labelled sample and scaled to length one. The labelled vectors go to every task by broadcast; each
document meets all of them in blocks of exact cosine products, and its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import scan
from .frames import BINARY, DOUBLE, INT, LONG, column, field, keep_rows, map_batches, map_texts
from .labelled import fit_rows, held_out

TRIGRAMS = 2048
#: The last bucket counts words that equal the word before them.
BUCKETS = TRIGRAMS + 1
#: One bucket stands against thousands, so it weighs more.
EMPHASIS = 4.0
THRESHOLD = 0.3
ROWS = 256


@dataclass(frozen=True)
class Fit:
    """Bounds and settings: rows and bytes of the labelled sample, directions kept, neighbours that vote."""

    most_rows: int = 6000
    most_bytes: int = 64 << 20
    directions: int = 64
    neighbours: int = 15
    power: float = 8.0


@dataclass(frozen=True)
class Space:
    """Bucket weights, projection, and the labelled vectors: at most ``most_rows`` x ``directions`` numbers."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the terms of each text by bucket."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(data) < 3:
        return out
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(21)
    at = np.repeat(np.arange(n), np.diff(offsets))
    inside = at[:-2] == at[2:]
    cells = at[:-2][inside] * TRIGRAMS + code[inside]
    out[:, :TRIGRAMS] = np.bincount(cells, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    found = scan.words(data, offsets, scan.PLAIN)
    doc = found.doc()
    again = (found.key[1:] == found.key[:-1]) & (doc[1:] == doc[:-1])
    out[:, TRIGRAMS] = np.bincount(doc[1:][again], minlength=n)
    return out


def _counted(texts: pa.Array):
    """Term counts of a batch in runs of at most ``ROWS`` texts."""
    for _, data, offsets in scan.blocks(texts):
        for low in range(0, len(offsets) - 1, ROWS):
            part = offsets[low : low + ROWS + 1]
            yield terms(data[part[0] : part[-1]], part - part[0])


def bucket_weights(documents: DataFrame, text_col: str) -> np.ndarray:
    """Inverse document frequency of every bucket over all documents."""

    def run(batches):
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for counts in _counted(batch.column(0)):
                seen += (counts > 0).sum(0)
                total += len(counts)
        yield [pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(seen, total))]

    schema = T.StructType([field("bucket", LONG), field("seen", LONG)])
    parts = map_batches(documents.select(column(text_col).cast("string")), schema, run)
    seen = np.zeros(BUCKETS + 1)
    for row in parts.groupBy("bucket").agg(F.sum("seen").alias("seen")).collect():
        seen[row["bucket"]] = row["seen"]
    weights = np.log((seen[-1] + 1) / (seen[:-1] + 1)).astype(np.float32) + np.float32(0.1)
    weights[TRIGRAMS:] *= EMPHASIS
    return weights


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.log1p(counts) * weights


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def singular_directions(rows: np.ndarray, directions: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    width = min(directions + 16, *rows.shape)
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :directions], np.float32)


def train(
    documents: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", how: Fit = Fit()
) -> Space | None:
    """The space and the labelled vectors, from rows that are not held out; None without labels."""
    rows = fit_rows(documents, labels, label, id_col, text_col, how.most_rows, how.most_bytes)
    schema = T.StructType([field("label", INT), field("counts", BINARY)])

    def run(batches):
        for batch in batches:
            counts = [row.astype(np.uint16).tobytes() for part in _counted(batch.column(0)) for row in np.minimum(part, 65535)]
            yield [batch.column(1), pa.array(counts, pa.binary())]

    sample = map_batches(rows, schema, run).toArrow()
    if not sample.num_rows:
        return None
    weights = bucket_weights(documents, text_col)
    table = np.empty((sample.num_rows, BUCKETS), np.float32)
    for i, counts in enumerate(sample.column("counts")):
        table[i] = _weighted(np.frombuffer(counts.as_buffer(), np.uint16).astype(np.float32), weights)
    table = _unit(table)
    projection = singular_directions(table, how.directions)
    marks = sample.column("label").to_numpy().astype(np.float32)
    return Space(weights, projection, _unit(table @ projection), marks, how.neighbours, how.power)


class Voter:
    """Scores of batches of texts: share of the votes that the nearest labelled vectors give to label 1."""

    def __init__(self, space: Space | None):
        self.space = space

    def votes(self, counts: np.ndarray) -> np.ndarray:
        space = self.space
        near = _unit(_weighted(counts, space.weights) @ space.projection) @ space.vectors.T
        k = min(space.neighbours, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        pull = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(float) ** space.power
        total, base = pull.sum(1), float(space.labels.mean())
        return np.where(total > 1e-9, (pull * space.labels[at]).sum(1) / np.maximum(total, 1e-9), base)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.space is None:
            return np.full(len(texts), 0.5)
        parts = [self.votes(counts) for counts in _counted(texts)]
        return np.clip(np.concatenate(parts), 0, 1) if parts else np.zeros(0)


def quality(
    documents: DataFrame, space: Space | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The id, whether it is held out, score and verdict of every document, from its whole text.

    One pass without shuffle. Null, empty and very short texts have no direction and get the share of label 1 in the
    sample; without any labels every score is 0.5. Texts at equal distance share the vote as the selection finds them.
    Repeated rows score alike; other columns are not read; an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(space)

    def start():
        voter = Voter(shared.value)
        return lambda texts: [voter(texts)]

    scored = map_texts(documents, [id_col], text_col, [field("score", DOUBLE)], start)
    return scored.select(
        column(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(documents: DataFrame, space: Space | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, all columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(space)

    def start():
        voter = Voter(shared.value)
        return lambda texts: voter(texts) >= threshold

    return keep_rows(documents, text_col, start)
