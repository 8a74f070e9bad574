"""Importance resampling towards a target: hashed n-gram features, n-gram checksums derived from prefix checksums.

A document's words, joined by one blank, are scanned once. The scan stores the running CRC-32 register at every word's
ends; the register is linear over GF(2), so the CRC of any n-gram follows from two of them: shift the first by the
n-gram's length, and what came before the n-gram cancels out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from encore.functions.ranking import magnitude_bucket

from . import scan
from .frames import LONG, column, field, map_batches, map_texts, shared_folder, written

BUCKETS = 10_000
ORDER = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: The reversed polynomial of CRC-32 (zlib, PNG), a fixed value.
POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
_ROWS = 4096
_FOLD = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)


@lru_cache(maxsize=1)
def _byte_steps() -> np.ndarray:
    """What one byte adds to the register, for each of 256 low bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _step(register: np.ndarray) -> np.ndarray:
    """The register after a zero byte."""
    return _byte_steps()[register & np.uint32(0xFF)] ^ (register >> np.uint32(8))


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Registers moved on by n zero bytes, as tables for each of a register's four bytes: n below 256, and powers of two from there."""
    one = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    small = [one]
    for _ in range(255):
        small.append(_step(small[-1]))
    powers = [_step(small[-1])]
    for _ in range(32):
        last = powers[-1]
        powers.append(_moved(last, last, 0))
    return np.concatenate(small), powers


def _moved(register: np.ndarray, tables: np.ndarray, base) -> np.ndarray:
    byte = np.uint32(0xFF)
    return (
        tables[base + (register & byte)]
        ^ tables[base + 256 + ((register >> np.uint32(8)) & byte)]
        ^ tables[base + 512 + ((register >> np.uint32(16)) & byte)]
        ^ tables[base + 768 + (register >> np.uint32(24))]
    )


def shift(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers moved on by so many zero bytes each."""
    small, powers = _shifts()
    out = _moved(register, small, (length & 255) * 1024)
    rest, k = length >> 8, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        if len(at):
            out[at] = _moved(out[at], powers[k], 0)
        rest, k = rest >> 1, k + 1
    return out


def running(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The register (zero at the start) after the bytes at these sorted places, found in slices of a megabyte.

    The rows of a slice are scanned side by side, each from zero; their ends are then chained by shifts, and a second scan starts
    every row from its true register.
    """
    out, carry, table = np.zeros(len(places), np.uint32), np.uint32(0), _byte_steps()
    for low in range(0, len(data), scan.BLOCK):
        part = data[low : low + scan.BLOCK]
        width = max(1, -(-len(part) // _ROWS))
        rows = -(-len(part) // width)
        grid = np.zeros(rows * width, np.uint8)
        grid[: len(part)] = part
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        state = np.zeros(rows, np.uint32)
        for line in grid:
            state = table[(state ^ line) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        starts, length = np.zeros(rows, np.uint32), np.array([width])
        now, jump = int(carry), [t.tolist() for t in shift(_basis(), np.repeat(length, 1024)).reshape(4, 256)]
        for r in range(rows):
            starts[r] = now
            now = jump[0][now & 255] ^ jump[1][now >> 8 & 255] ^ jump[2][now >> 16 & 255] ^ jump[3][now >> 24] ^ int(state[r])
        states = np.empty((width, rows), np.uint32)
        state = starts
        for i, line in enumerate(grid):
            state = states[i] = table[(state ^ line) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        flat = states.T.reshape(-1)
        a, b = np.searchsorted(places, (low, low + len(part)))
        out[a:b] = flat[places[a:b] - low]
        carry = flat[len(part) - 1]
    return out


def _basis() -> np.ndarray:
    return _shifts()[0][:1024]


def ngram_crcs(data: np.ndarray, offsets: np.ndarray, order: int = ORDER):
    """The words of a block, and for each length up to ``order`` (first words, CRC-32 of the n-grams that begin there)."""
    found = scan.words(data, offsets, scan.ALNUM)
    size = found.end - found.start
    n = len(size)
    letters = np.flatnonzero(scan.ALNUM.letter[data])
    joined = np.full(len(letters) + n, 32, np.uint8)
    joined[np.arange(len(letters)) + np.repeat(np.arange(n), size)] = _FOLD[data[letters]]
    last = np.cumsum(size + 1) - 2
    first = last - size + 1
    after = running(joined, last)
    before = np.zeros(n, np.uint32)
    before[1:] = _byte_steps()[(after[:-1] ^ np.uint32(32)) & np.uint32(0xFF)] ^ (after[:-1] >> np.uint32(8))
    doc, out = found.doc(), []
    for width in range(1, order + 1):
        begins = np.arange(max(0, n - width + 1))
        begins = begins[doc[begins] == doc[begins + width - 1]]
        ends = begins + width - 1
        crc = after[ends] ^ shift(before[begins] ^ _ONES, last[ends] + 1 - first[begins]) ^ _ONES
        out.append((begins, crc))
    return found, out


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts fall into each bucket. Every task adds up its own; what the driver gets is one number a bucket."""

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in scan.blocks(batch.column(0)):
                for _, crc in ngram_crcs(data, offsets, order)[1]:
                    seen += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield [pa.array(at), pa.array(seen[at])]

    schema = T.StructType([field("bucket", LONG), field("n", LONG)])
    counted = map_batches(table.select(column(text_col).cast("string")), schema, run)
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of a bucket's smoothed share in the target to that in the source, floored."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(documents: DataFrame, gains: np.ndarray, keep: list[str], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The kept columns with each document's number of words and features and the sum of its features' gains."""
    shared = documents.sparkSession.sparkContext.broadcast(gains)

    def start():
        gains = shared.value

        def work(texts: pa.Array) -> list:
            words, features, sums = [], [], []
            for _, data, offsets in scan.blocks(texts):
                found, grams = ngram_crcs(data, offsets, order)
                n = np.diff(found.ptr)
                value = np.zeros(len(found.start), np.int64)
                for begins, crc in grams:
                    value[begins] += gains[crc % np.uint32(len(gains))]
                words.append(n)
                features.append(sum(np.maximum(n - j, 0) for j in range(order)))
                sums.append(scan.sums(value, found.ptr))
            return [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (words, features, sums)]

        return work

    return map_texts(documents, keep, text_col, [field("n_words", LONG), field("n_features", LONG), field("weight", LONG)], start)


def _noise(id_col, seed: int):
    """Thousandths of a Gumbel value that id and seed decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def resample(
    documents: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    order: int = ORDER,
) -> DataFrame:
    """Every document's id, features, weight and score, and the rank of those drawn (null: not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (floored) are drawn without replacement: those
    with the highest sum of weight and Gumbel noise, equal scores by smaller id, then by more features. Weights need the totals of
    all documents, so texts are read twice, each time in one scan; the rest needs a few numbers a document. Null and empty texts
    have no features and weight 0. A null id has no noise, hence no score, and is not drawn or counted. Rows that repeat an
    id are documents of their own with the same noise. Empty documents give an empty result, an empty target has no features.
    Other columns are not read.
    """
    spark = documents.sparkSession
    gains = bucket_gains(bucket_counts(documents, text_col, buckets, order), bucket_counts(target, target_text_col, buckets, order))
    plain = documents.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    weighed = weights(plain, gains, ["_id"], "_text", order)
    scored = weighed.select("_id", "n_words", "n_features", "weight", (F.col("weight") + _noise(F.col("_id"), seed)).alias("score"))
    scored = written(scored, "resample-scores", shared_folder(spark, "resample-scores"))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    #: At most some 90,000 values, whatever the scores: as many rows are counted, ordered and broadcast.
    bucket = magnitude_bucket(-F.col("score"))
    counts = scored.filter(able).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()
    draws, before, starts = percent * sum(r["n"] for r in counts) // 100, 0, []
    for row in counts:
        if before >= draws:
            break
        starts.append((row["bucket"], before))
        before += row["n"]
    top = F.broadcast(spark.createDataFrame(starts, "bucket long, before long"))
    marked = scored.withColumn("bucket", F.when(able, bucket)).join(top, "bucket", "left")
    out = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    rest = marked.filter("before IS NULL").select(*out, F.lit(None).cast("long").alias("rank"))
    order_by = Window.partitionBy("bucket").orderBy(F.desc("score"), "_id", F.desc("n_features"))
    placed = marked.filter("before IS NOT NULL").withColumn("place", F.col("before") + F.row_number().over(order_by))
    return placed.select(*out, F.when(F.col("place") <= draws, F.col("place")).cast("long").alias("rank")).unionByName(rest)


def draw(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns as they were; of rows that repeat an id, all if one is drawn."""
    found = resample(documents, target, id_col, text_col, **options)
    ids = found.filter("rank IS NOT NULL").select(column(id_col)).distinct()
    return documents.join(ids, id_col, "left_semi").select(*[column(c) for c in documents.columns])
