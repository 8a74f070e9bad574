"""Benchmark decontamination: windows of ten words that documents share with a benchmark.

The benchmark's windows become a set of 64-bit keys, cut into parts of bounded size; each part goes to the tasks by
broadcast and every document is scanned against it. A key that matches is verified word by word, so hits are exact.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import scan
from .frames import LONG, TEXT, column, field, map_batches, shared_folder, written

WIDTH = 10
#: Most benchmark windows in one broadcast: about 100 bytes each, 20 MB.
PART_WINDOWS = 200_000

_SPAN = T.ArrayType(T.StructType([field("first", LONG), field("last", LONG), field("start", LONG), field("end", LONG)]))
MARKS = T.StructType([field("n_words", LONG), field("n_hit", LONG), field("spans", _SPAN), field("items", T.ArrayType(TEXT))])


def _folded(raw: bytes) -> bytes:
    return raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(key, length, item, window) of every window of every item, the words joined by blanks.

    An item with fewer words than ``width`` is one window; one without words, null or empty, has none. The item may be null.
    """
    schema = T.StructType([field("key", LONG), field("length", LONG), field("item", TEXT), field("window", T.BinaryType())])
    source = benchmark.select(column(item_col).cast("string"), column(text_col).cast("string"))

    def run(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            for first, data, offsets in scan.blocks(batch.column(1)):
                found = scan.words(data, offsets, scan.ALNUM)
                rows: list[tuple] = []
                for i in range(len(offsets) - 1):
                    low, high = found.ptr[i], found.ptr[i + 1]
                    size = min(width, high - low)
                    if not size:
                        continue
                    keys = scan.windows(found.key[low:high], size).view(np.int64)
                    parts = [_folded(data[a:b].tobytes()) for a, b in zip(found.start[low:high], found.end[low:high], strict=True)]
                    rows += [(int(k), int(size), items[first + i], b" ".join(parts[j : j + size])) for j, k in enumerate(keys)]
                if rows:
                    yield list(zip(*rows, strict=True))

    return map_batches(source, schema, run)


class Matcher:
    """One part of the benchmark: sorted keys by window length, and the windows behind each key."""

    def __init__(self, rows: list):
        self.items: dict[int, list[tuple[str | None, bytes]]] = {}
        by_length: dict[int, set[int]] = {}
        for key, length, item, window in rows:
            self.items.setdefault(key, []).append((item, bytes(window)))
            by_length.setdefault(length, set()).add(key)
        self.keys = {n: np.sort(np.array(list(k), np.int64)) for n, k in by_length.items()}

    def candidates(self, words: np.ndarray):
        """(length, positions) of windows whose key is in the set."""
        for length, keys in self.keys.items():
            mine = scan.windows(words, length).view(np.int64)
            at = np.searchsorted(keys, mine)
            at[at == len(keys)] = 0
            yield length, np.flatnonzero(keys[at] == mine), mine

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """For each text of the block: number of words, covered words as flags (None if none), byte ends, items."""
        found = scan.words(data, offsets, scan.ALNUM)
        doc = found.doc()
        covered = np.zeros(len(doc), bool)
        items: dict[int, set[str | None]] = {}
        for length, places, mine in self.candidates(found.key):
            for p in places:
                if doc[p] != doc[p + length - 1]:
                    continue
                text = b" ".join(_folded(data[a:b].tobytes()) for a, b in zip(found.start[p : p + length], found.end[p : p + length], strict=True))
                owners = [item for item, window in self.items[int(mine[p])] if window == text]
                if owners:
                    covered[p : p + length] = True
                    items.setdefault(int(doc[p]), set()).update(owners)
        return found, covered, items


def _marks(matcher: Matcher, texts: pa.Array, before: list | None) -> list:
    """What a part finds, joined with what earlier parts found."""
    out = []
    for first, data, offsets in scan.blocks(texts):
        found, covered, items = matcher(data, offsets)
        for i in range(len(offsets) - 1):
            low, high = int(found.ptr[i]), int(found.ptr[i + 1])
            mine = covered[low:high]
            names = items.get(i, set())
            if before is not None:
                for span in before[first + i]["spans"]:
                    mine[span["first"] : span["last"]] = True
                names = names | set(before[first + i]["items"])
            edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
            spans = [
                {"first": int(a), "last": int(b), "start": int(found.start[low + a] - offsets[i]), "end": int(found.end[low + b - 1] - offsets[i])}
                for a, b in zip(edge[::2], edge[1::2], strict=True)
            ]
            out.append({"n_words": high - low, "n_hit": int(mine.sum()), "spans": spans, "items": sorted(names, key=lambda x: (x is None, x or ""))})
    return out


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    part_windows: int = PART_WINDOWS,
    marks: str = "marks",
) -> DataFrame:
    """The kept columns and ``marks``: words, hit words, hit spans (word numbers and byte ends) and the items found.

    Documents need no shuffle. The benchmark is counted first; each broadcast holds at most ``part_windows`` windows,
    and a larger benchmark is matched part by part, every part in a pass of its own over what the last one wrote, with
    the marks joined. Null and empty texts have no words and no hits; items without id hit like others and count
    as one item without name; repeated rows are marked
    alike. An empty benchmark hits nothing. Columns that are not kept are not read.
    """
    spark = documents.sparkSession
    windows = written(benchmark_windows(benchmark, item_col, item_text_col, width).distinct(), "benchmark-windows")
    parts = max(1, -(-windows.count() // part_windows))
    if parts > 1:
        part = F.pmod(F.xxhash64("key", "item"), F.lit(2 * parts))
        windows = written(windows.withColumn("part", part).repartition("part"), "benchmark-parts")
        selected = [windows.filter(F.col("part") == i).drop("part") for i in range(2 * parts)]
    else:
        selected = [windows]
    frame = documents.select(*[column(c) for c in dict.fromkeys([*keep, text_col])])
    folder = shared_folder(spark, "leaks")
    for number, rows in enumerate(selected):
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
        frame = _one_part(frame, text_col, shared, marks, number > 0)
        if number + 1 < len(selected):
            frame = written(frame, "leaks", f"{folder}/{number}")
    return frame.select(*[column(c) for c in keep], column(marks))


def _one_part(frame: DataFrame, text_col: str, shared, marks: str, more: bool) -> DataFrame:
    names = [c for c in frame.columns if c != marks]
    source = frame.select(*[column(c) for c in names], *([column(marks)] if more else []))
    schema = T.StructType([frame.schema[c] for c in names] + [field(marks, MARKS)])
    place = names.index(text_col)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            before = batch.column(len(names)).to_pylist() if more else None
            yield [*(batch.column(i) for i in range(len(names))), _marks(matcher, batch.column(place), before)]

    return map_batches(source, schema, run)


def digest(items: Column) -> Column:
    """SHA-256 of the sorted, comma-joined items, without null."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def without_spans(texts: pa.Array, spans: list[list[dict]]) -> list:
    """The texts with the spans cut out, each replaced by a line break that keeps the parts apart."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans, strict=True):
        if text is None or not cuts:
            out.append(text)
            continue
        raw, parts, at = text.encode(), [], 0
        for cut in cuts:
            parts.append(raw[at : cut["start"]].decode())
            at = cut["end"]
        out.append("\n".join([*parts, raw[at:].decode()]))
    return out


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "documents", **options
) -> DataFrame:
    """The documents without leaked ones (``mode='documents'``) or with leaked spans cut out (``mode='spans'``).

    All columns stay as they were, but for the text in the second mode. Rows and texts without hits, null and empty
    texts included, are untouched.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    names = documents.columns
    marks = "marks"
    while marks in names:
        marks = f"_{marks}"
    found = find_leaks(documents, benchmark, names, text_col, marks=marks, **options)
    if mode == "documents":
        return found.filter(column(marks)["n_hit"] == 0).drop(marks)
    place, schema = names.index(text_col), documents.schema

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            spans = [m["spans"] for m in batch.column(len(names)).to_pylist()]
            columns[place] = pa.array(without_spans(columns[place], spans), pa.string())
            yield columns

    return map_batches(found.select(*[column(c) for c in names], column(marks)), schema, run)


def leak_report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: words, hit words, number and digest of the items found, and the verdict."""
    named = documents.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    found = find_leaks(named, benchmark, ["_id"], "_text", **options)
    return found.select(
        F.col("_id").alias(id_col),
        F.col("marks.n_words").alias("n_words"),
        F.col("marks.n_hit").alias("n_hit"),
        F.size("marks.items").cast("long").alias("n_items"),
        digest(F.col("marks.items")).alias("items_sha256"),
        (F.col("marks.n_hit") > 0).alias("contaminated"),
    )
