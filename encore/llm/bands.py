"""Quality rules from compression: texts that compress too well repeat themselves, texts that hardly compress are noise.

A text is compressed whole and in fixed chunks. Limits depend on the length, since short texts never compress well and
long ones always do. Inside wide fixed limits, narrower ones come from the documents themselves (``fences``). Plain counts of words, symbols, repeated lines and repeated windows come with the verdict.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field as member, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import scan
from .frames import BOOL, DOUBLE, INT, LONG, TEXT, column, field, keep_rows, map_batches, map_texts

SYMBOLS = b"#*$%&|<>"
WIDTH = 5
#: Length classes to a doubling of the length; classes with fewer different texts, or chunks, get no limits of their own.
FINE = 4
LEAST = 100
#: Bins of ratios to a unit, and the greatest ratio told apart.
BINS = 200
MOST_RATIO = 64.0
#: Shortest text that is judged by limits from the data, in bytes.
SHORTEST = 128


@dataclass(frozen=True)
class Limits:
    """(bytes from, least ratio, greatest ratio) for whole texts by length, and one pair for chunks.

    A text fails as a whole when its ratio leaves the band of its length; it fails by chunks when more than
    ``odd_chunks`` of its chunks leave theirs. ``fences`` holds narrower limits by kind (0 texts, 1 chunks) and length
    class; where a class has them, both must be met. They lie ``above`` spreads over the upper quartile of the class and
    ``below`` spreads under the lower one; a spread is the distance of the quartiles, at least ``margin`` of the median. Base64 compresses by a third, so the lower limits for longer texts lie above. A last chunk under half the chunk size is not judged, unless it is alone.
    """

    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (128, 0.9, 3.0),
        (512, 1.2, 3.2),
        (2048, 1.4, 3.6),
        (8192, 1.4, 4.2),
        (32768, 1.4, 5.0),
        (262144, 1.4, 6.0),
    )
    chunk: int = 4096
    chunk_least: float = 1.38
    chunk_greatest: float = 4.0
    odd_chunks: float = 0.25
    level: int = 3
    above: float = 2.0
    below: float = 3.0
    margin: float = 0.03
    fences: dict[tuple[int, int], tuple[float, float]] = member(default_factory=dict)

    def of(self, size: int) -> tuple[float, float]:
        least, greatest = 0.0, float("inf")
        for at, low, high in self.bands:
            if size >= at:
                least, greatest = low, high
        return self._fenced(0, size, least, greatest)

    def of_chunk(self, size: int) -> tuple[float, float]:
        return self._fenced(1, size, self.chunk_least, self.chunk_greatest)

    def _fenced(self, kind: int, size: int, least: float, greatest: float) -> tuple[float, float]:
        low, high = self.fences.get((kind, length_class(size)), (least, greatest)) if size >= SHORTEST else (least, greatest)
        return max(least, low), min(greatest, high)


def length_class(size: int) -> int:
    return int(FINE * math.log2(size)) if size else 0


def _flags(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur more than once, and which repeat an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return often, later


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text of a block: words, characters in words, symbols, repeated lines, words in repeated windows."""
    found = scan.words(data, offsets, scan.PLAIN)
    doc = found.doc()
    n_words = np.diff(found.ptr)
    letters = scan.PLAIN.letter[data] & ((data & 0xC0) != 0x80)
    per_doc = scan.mix(np.arange(1, len(offsets), dtype=np.uint64))

    lines = scan.words(data, offsets, scan.LINES)
    filled = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
    line_doc = lines.doc()
    _, later = _twice((lines.key ^ per_doc[line_doc])[filled])
    n_dup = np.bincount(line_doc[filled][later], minlength=len(n_words))

    n_repeat = np.zeros(len(n_words), np.int64)
    runs = scan.windows(found.key, WIDTH)
    if len(runs):
        inside = doc[: len(runs)] == doc[WIDTH - 1 :]
        often = np.zeros(len(runs), bool)
        often[inside], _ = _twice((runs ^ per_doc[doc[: len(runs)]])[inside])
        covered = np.zeros(len(doc), bool)
        for shift in range(WIDTH):
            covered[shift : shift + len(often)] |= often
        n_repeat = np.bincount(doc[covered], minlength=len(n_words))
    return {
        "n_words": n_words,
        "word_chars": scan.sums(letters, offsets),
        "n_symbols": scan.sums(_flags(data, SYMBOLS), offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
    }


def _base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def _pieces(raw: bytes, size: int) -> list[bytes]:
    cut = [raw[i : i + size] for i in range(0, len(raw), size)]
    return cut[:-1] if len(cut) > 1 and 2 * len(cut[-1]) < size else cut


class Judge:
    """Counts, ratios and verdict of batches of texts."""

    NAMES = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "ratio", "n_chunks", "odd_chunks", "reason", "kept",
    )

    def __init__(self, limits: Limits):
        self.limits = limits
        self.packer = zstandard.ZstdCompressor(level=limits.level)

    def _ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.packer.compress(raw)) if raw else 0.0

    def compression(self, raw: bytes) -> tuple[float, int, int, str]:
        """Ratio of the whole, number of chunks, chunks outside their limits, and why the text fails ('' if it does not)."""
        limits = self.limits
        whole = self._ratio(raw)
        least, greatest = limits.of(len(raw))
        judged = len(raw) >= limits.chunk // 2
        pieces = _pieces(raw, limits.chunk) if judged else []
        ratios = [whole] if len(raw) <= limits.chunk and judged else [self._ratio(p) for p in pieces]
        sizes = [len(raw)] if len(pieces) == 1 else [len(p) for p in pieces]
        spans = [limits.of_chunk(n) for n in sizes]
        high = sum(r > most for r, (_, most) in zip(ratios, spans, strict=True))
        low = sum(r < least for r, (least, _) in zip(ratios, spans, strict=True))
        why = ""
        if raw and whole > greatest:
            why = "repetitive"
        elif raw and whole < least:
            why = "incompressible"
        elif high > limits.odd_chunks * len(ratios):
            why = "repetitive chunks"
        elif low > limits.odd_chunks * len(ratios):
            why = "incompressible chunks"
        return whole, len(ratios), high + low, why

    def measured(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """(kind, length class, bin of the ratio, checksum) of a text and of its chunks."""
        parts = [(0, raw)]
        if len(raw) >= self.limits.chunk // 2:
            parts += [(1, raw)] if len(raw) <= self.limits.chunk else [(1, p) for p in _pieces(raw, self.limits.chunk)]
        return [(k, length_class(len(p)), int(BINS * min(self._ratio(p), MOST_RATIO)), zlib.crc32(p)) for k, p in parts]

    def __call__(self, texts: pa.Array) -> list:
        out: dict[str, list[np.ndarray]] = {n: [] for n in self.NAMES}
        for _, data, offsets in scan.blocks(texts):
            counts = text_counts(data, offsets)
            failed = _base_failed(counts)
            whole, number, odd, why = zip(
                *(self.compression(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)),
                strict=True,
            )
            reason = np.where(failed, "base", np.array(why, object))
            rest = (failed, np.array(whole), np.array(number), np.array(odd), reason, reason == "")
            for name, values in zip(self.NAMES, (*counts.values(), *rest), strict=True):
                out[name].append(values)
        return [np.concatenate(v) if v else [] for v in out.values()]


_KINDS = dict.fromkeys(Judge.NAMES, LONG) | {
    "base_failed": BOOL, "ratio": DOUBLE, "reason": TEXT, "kept": BOOL,
}


def _quantile(bins: np.ndarray, counts: np.ndarray, share: float) -> float:
    return float(bins[np.searchsorted(np.cumsum(counts), share * counts.sum())]) / BINS


def fitted(documents: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> Limits:
    """The limits with ``fences`` from all documents that pass the base rules; equal texts and equal chunks count once.

    What reaches the driver are counts by kind, length class and bin of the ratio, bounded however large the table is.
    """
    schema = T.StructType([field("kind", INT), field("size", INT), field("bin", INT), field("crc", LONG)])

    def run(batches):
        judge = Judge(limits)
        for batch in batches:
            for _, data, offsets in scan.blocks(batch.column(0)):
                rows: list[tuple] = []
                for i in np.flatnonzero(~_base_failed(text_counts(data, offsets))):
                    rows += judge.measured(data[offsets[i] : offsets[i + 1]].tobytes())
                if rows:
                    yield list(zip(*rows, strict=True))

    found = map_batches(documents.select(column(text_col).cast("string")), schema, run).distinct()
    counts = found.groupBy("kind", "size", "bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin")
    fences = {}
    for (kind, size), rows in counts.groupby(["kind", "size"]):
        bins, n = rows["bin"].to_numpy(), rows["n"].to_numpy()
        if n.sum() < LEAST:
            continue
        low, middle, high = (_quantile(bins, n, share) for share in (0.25, 0.5, 0.75))
        spread = max(high - low, limits.margin * middle)
        fences[int(kind), int(size)] = (low - limits.below * spread, high + 1 / BINS + limits.above * spread)
    return replace(limits, fences=fences)


def quality_rules(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None
) -> DataFrame:
    """The id and, for each whole text, counts, compression ratio, odd chunks, reason and verdict.

    Limits that are not given are ``fitted`` in a pass of its own; then one pass, no shuffle. Null and empty texts have no words, ratio 0 and fail the base rules. Repeated rows give
    repeated results; other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    limits = limits or fitted(documents, text_col)
    fields = [field(n, _KINDS[n]) for n in Judge.NAMES]
    return map_texts(documents, [id_col], text_col, fields, lambda: Judge(limits))


def keep_by_quality(documents: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows whose text passes, with all columns as they were. Null and empty texts go. Limits as in ``quality_rules``."""
    limits = limits or fitted(documents, text_col)
    return keep_rows(documents, text_col, lambda: lambda texts: Judge(limits)(texts)[-1])
