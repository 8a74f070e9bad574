"""The word level of the language model: which of all words stands between its neighbours.

A word's probability pools three distributions over every word of the corpus and an unseen one, by the mean of their logarithms: the
network of :mod:`.masked_lm` with the word's share of its shape, the words seen after its left neighbour, and those seen before its
right one. All come from exact counts of words and pairs of words over the whole corpus. A masked word does not see itself: its own
occurrence is taken out of every count.

Each text asks for counts by key. Questions are packed by range of their key, so that a task sees all occurrences of its keys, counts
them and returns, for each chunk of texts, sums per text. The counts grow with the corpus, and so does the number of ranges; what the
driver holds does not. Counts of very frequent words and their pairs are in the network's table already and are not asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from . import scan
from .frames import BINARY, DOUBLE, INT, LONG, column, field, map_batches, returned_memory
from .masked_lm import EDGE, SHAPES, Model, Tokens

#: Words whose questions one task answers, words and texts of a chunk, and ranges of keys at most.
RANGE_WORDS = 4_000_000
CHUNK_WORDS = 1_000_000
CHUNK_TEXTS = 60_000
MOST_RANGES = 1 << 16
#: Weight of all that was not seen, against one occurrence. As it is one, it fills the place of the occurrence taken out of a total.
UNSEEN = 1.0
#: A question's code: shape of the word, or 0 for a pair, and from this bit how many neighbours or words need the count.
TIMES = 6
KEY_BYTES = 5
_EDGE_KEY = np.uint64(0x5851F42D4C957F2D)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two, which depends on their order."""
    return scan.mix(a * _FACTOR + scan.mix(b))


def _known(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of how often each token occurs (the edge: texts with words), and of a shape; weights of pairs of two frequent words or edges."""
    totals = model.after.sum(0)
    totals[EDGE] = model.after[EDGE].sum()
    pairs = model.after.copy()
    pairs[:, EDGE] = model.before[EDGE]
    return np.log(np.maximum(totals, 1)), np.log(np.maximum(model.words.totals, 1)), np.log(np.maximum(pairs, 1) - 1 + unseen_pair(model))


def unseen_pair(model: Model) -> float:
    """Weight of one of the words, the unseen word and the edge, any of which may follow."""
    return UNSEEN / (model.words.sizes.sum() + len(model.frequent) + 2)


def questions(token: np.ndarray, key: np.ndarray, ptr: np.ndarray, known: tuple) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(key, code, text) of all questions of a block's texts, and the part of each text's sum that needs none."""
    tokens, shapes, pairs = known
    texts = len(ptr) - 1
    doc = np.repeat(np.arange(texts, dtype=np.int32), np.diff(ptr))
    place = np.arange(len(token)) + doc + 1
    size = len(token) + texts + 1
    padded, word, home = np.full(size, EDGE), np.full(size, _EDGE_KEY), np.zeros(size, np.int32)
    padded[place], word[place], home[place] = token, key, doc
    inner = padded != EDGE
    rare = inner & (padded <= SHAPES)
    beside = inner[np.maximum(np.arange(size) - 1, 0)].astype(np.uint8)
    beside[:-1] += inner[1:]
    at, often = np.flatnonzero(rare), np.flatnonzero(inner & ~rare)
    first, last = inner[1:] & ~inner[:-1], inner[:-1] & ~inner[1:]
    sums = np.bincount(home[at], -shapes[padded[at]], texts) - np.bincount(home[often], beside[often] * tokens[padded[often]], texts)
    sums -= tokens[EDGE] * (np.bincount(home[1:][first], minlength=texts) + np.bincount(home[:-1][last], minlength=texts))
    times = inner[:-1].astype(np.uint8) + inner[1:]
    told = np.flatnonzero((times > 0) & ~(rare[:-1] | rare[1:]))
    text = np.maximum(home[:-1], home[1:])
    sums += np.bincount(text[told], times[told] * pairs[padded[told], padded[told + 1]], texts)
    pair = np.flatnonzero(rare[:-1] | rare[1:])
    asked = [
        np.concatenate([scan.mix(word[at]), _joined(word[pair], word[pair + 1])]),
        np.concatenate([padded[at].astype(np.uint8) + (beside[at] << TIMES), times[pair] << TIMES]),
        np.concatenate([home[at], text[pair]]),
    ]
    return asked, sums


def _packed(chunk: int, asked: list[tuple], ranges: int):
    """(chunk, range, questions) by range: the lower bytes of the keys, codes, and texts."""
    key, code, text = (np.concatenate(x) for x in zip(*asked, strict=True))
    part = ((key >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    low = key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    code, text = code[order], text[order].astype("<u2")
    ends = np.searchsorted(part[order], np.arange(ranges + 1))
    for p in np.flatnonzero(np.diff(ends)):
        own = slice(ends[p], ends[p + 1])
        yield chunk, int(p), b"".join([low[own].tobytes(), code[own].tobytes(), text[own].tobytes()])


def _keys(blobs: list[bytes]) -> np.ndarray:
    out = np.zeros((sum(len(b) for b in blobs) // (KEY_BYTES + 3), 8), np.uint8)
    low = 0
    for b in blobs:
        n = len(b) // (KEY_BYTES + 3)
        out[low : low + n, :KEY_BYTES] = np.frombuffer(b, np.uint8, KEY_BYTES * n).reshape(n, KEY_BYTES)
        low += n
    return out.view("<u8").ravel()


def _others(key: np.ndarray) -> np.ndarray:
    """For each key, how many others equal it. The keys are overwritten."""
    if len(key) < 1 << 24:
        # Keys of five bytes leave three for their places: one sort in place.
        key <<= np.uint64(24)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        place = (key & np.uint64((1 << 24) - 1)).astype(np.int32)
        key >>= np.uint64(24)
    else:
        place = np.argsort(key)
        key = key[place]
    fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts = np.diff(fresh, append=len(key)).astype(np.int32)
    out = np.empty(len(key), np.int32)
    out[place] = np.repeat(counts - 1, counts)
    return out


def answers(blobs: list[bytes], sizes: np.ndarray, pair: float) -> list[bytes]:
    """For each packed list of questions, texts and the sums of what their counts add; all questions of a key must be there."""
    others = _others(_keys(blobs))
    shape, times = np.arange(256) & ((1 << TIMES) - 1), (np.arange(256) >> TIMES).astype(float)
    unseen = np.where(shape > 0, UNSEEN / (np.append(sizes, np.zeros(256))[shape] + 1), pair)
    weight, under = np.where(shape > 0, 1.0, times), np.where(shape > 0, times, 0.0)
    out, low = [], 0
    for blob in blobs:
        n = len(blob) // (KEY_BYTES + 3)
        code, text = np.frombuffer(blob, np.uint8, n, KEY_BYTES * n), np.frombuffer(blob, "<u2", n, (KEY_BYTES + 1) * n)
        count = others[low : low + n]
        low += n
        value = weight[code] * np.log(count + unseen[code]) - under[code] * np.log(count + UNSEEN)
        there = np.flatnonzero(np.bincount(text))
        out.append(there.astype("<u2").tobytes() + np.bincount(text, value)[there].astype("<f4").tobytes())
    return out


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, number of words, summed conditional log-probability of the words and its mean, from the whole text.

    ``model`` has to come from the same documents. Null, empty and wordless texts have no words, sum 0 and mean null. Repeated rows each
    score, and each counts; other columns are not read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    ranges = max(1, min(MOST_RANGES, -(-model.words.words // RANGE_WORDS)))
    kept, sizes, pair = T.StructField("id", documents.schema[id_col].dataType), model.words.sizes, unseen_pair(model)

    def ask(batches):
        model = shared.value
        tokens, table, known = Tokens(model.frequent), model.table.reshape(-1), _known(model)
        chunk, asked, rows, words, texts = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def flushed():
            ids = pa.concat_arrays([r[0] for r in rows])
            head = pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x)) for x in list(zip(*rows, strict=True))[1:])], ["id", "n", "sum"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as stream:
                stream.write_batch(head)
            found = [(chunk, chunk % ranges, True, sink.getvalue().to_pybytes())]
            size = 0
            for c, p, blob in _packed(chunk, asked, ranges):
                found.append((c, p, False, blob))
                size += len(blob)
                if size > 4 << 20:
                    yield [pa.array(x) for x in zip(*found, strict=True)]
                    found, size = [], 0
            if found:
                yield [pa.array(x) for x in zip(*found, strict=True)]

        for batch in batches:
            for first, data, offsets in scan.blocks(batch.column(1)):
                found = scan.words(data, offsets, scan.PLAIN)
                token, here = tokens.of(data, found), len(offsets) - 1
                if rows and (words + len(found.key) > CHUNK_WORDS or texts + here > CHUNK_TEXTS):
                    yield from flushed()
                    chunk, asked, rows, words, texts = chunk + 1, [], [], 0, 0
                # A block of a quarter of a megabyte may hold more empty texts than a chunk may.
                for low in range(0, here, CHUNK_TEXTS):
                    high = min(here, low + CHUNK_TEXTS)
                    if low:
                        yield from flushed()
                        chunk, asked, rows, words, texts = chunk + 1, [], [], 0, 0
                    ptr = found.ptr[low : high + 1] - found.ptr[low]
                    own = slice(found.ptr[low], found.ptr[high])
                    total = np.append(0.0, np.cumsum(table[Tokens.coded(token[own], ptr)], dtype=np.float64))
                    (key, code, home), sums = questions(token[own], found.key[own], ptr, known)
                    asked.append((key, code, home + np.int32(texts)))
                    rows.append((batch.column(0).slice(first + low, high - low), np.diff(ptr), (np.diff(total[ptr]) + sums) / 3))
                    words, texts = words + int(ptr[-1]), texts + high - low
        if rows:
            yield from flushed()

    def answer(batches):
        chunks, blobs = [], []
        for batch in batches:
            for c, p, head, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if head:
                    yield [pa.array([c], pa.int64()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())]
                else:
                    chunks.append((c, p))
                    blobs.append(blob)
        found = answers(blobs, sizes, pair) if blobs else []
        blobs.clear()
        for low in range(0, len(found), 64):
            c, p = zip(*chunks[low : low + 64], strict=True)
            yield [pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(found[low : low + 64], pa.binary())]

    def told(table: pa.Table) -> pa.Table:
        with returned_memory():
            rows = sorted(zip(table.column("range").to_pylist(), table.column("data").to_pylist(), strict=True), key=lambda r: r[0])
            head = pa.ipc.open_stream(rows[0][1]).read_all().combine_chunks()
            total = head.column("sum").to_numpy().copy()
            for _, blob in rows[1:]:
                n = len(blob) // 6
                total[np.frombuffer(blob, "<u2", n)] += np.frombuffer(blob, "<f4", n, 2 * n).astype(np.float64) / 3
            n = head.column("n").to_numpy()
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            return pa.table({"id": head.column("id"), "n_tokens": pa.array(n), "log_prob": pa.array(total), "mean_log_prob": mean})

    packed = T.StructType([field("chunk", LONG), field("range", INT), field("head", T.BooleanType()), field("data", BINARY)])
    source = documents.select(column(id_col).alias("id"), column(text_col).cast("string").alias("t"))
    asked = map_batches(source, packed, ask).repartitionById(ranges, F.col("range"))
    found = map_batches(asked, T.StructType([field("chunk", LONG), field("range", INT), field("data", BINARY)]), answer)
    out = T.StructType([kept, field("n_tokens", LONG), field("log_prob", DOUBLE), field("mean_log_prob", DOUBLE)])
    return found.groupBy("chunk").applyInArrow(told, out).withColumnRenamed("id", id_col)
