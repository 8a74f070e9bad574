"""Words of many texts at once, on the UTF-8 bytes of an Arrow batch.

A word is a run of bytes that are not separators. All separators here are ASCII, so byte runs and character runs agree.
Every word gets a 64-bit key that depends on its (folded) bytes only, the same in every process. Texts are handled in
blocks of about a quarter of a megabyte, so the temporary arrays stay small however large a batch is; one longer text is scanned in
slices cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
WHITE_SPACE = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(keys: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range, one to one."""
    keys = keys.astype(np.uint64, copy=True)
    keys ^= keys >> np.uint64(30)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(27)
    keys *= np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(31)
    return keys


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = BLOCK
    while size < length + 1:
        size *= 2
    return _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))


class Alphabet:
    """Which bytes end a word, and whether A-Z counts as a-z."""

    def __init__(self, separators: bytes, fold: bool = False):
        self.letter = np.ones(256, bool)
        self.letter[list(separators)] = False
        folded = np.arange(256)
        if fold:
            folded[65:91] += 32
        self.code = mix(folded.astype(np.uint64) + np.uint64(1))


PLAIN = Alphabet(WHITE_SPACE)
FOLDED = Alphabet(WHITE_SPACE, fold=True)
LINES = Alphabet(b"\n")
#: Words of letters and digits, anything beyond ASCII included: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding.
ALNUM = Alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


@dataclass
class Words:
    """Byte ranges and keys of the words of a block; words ``ptr[i]:ptr[i + 1]`` belong to text ``i``."""

    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    ptr: np.ndarray
    stem: np.ndarray | None = None

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of about ``size`` bytes. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        low = offsets[first]
        yield first, data[low : offsets[last]], offsets[first : last + 1] - low
        first = last


def _scan(data: np.ndarray, opens: np.ndarray, alphabet: Alphabet, stem: int):
    """Start, end, key and stem key of the words of a slice; ``opens`` lists the positions where a text begins."""
    letter = alphabet.letter[data]
    cut = np.ones(len(data) + 1, bool)
    np.logical_not(letter, out=cut[1:])
    cut[opens] = True
    start = np.flatnonzero(letter & cut[:-1])
    gap = np.ones(len(data) + 1, bool)
    np.logical_not(letter, out=gap[:-1])
    gap[opens] = True
    end = np.flatnonzero(letter & gap[1:]) + 1
    powers, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(alphabet.code[data] * powers[: len(data)], out=total[1:])
    key = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    if not stem:
        return start, end, key
    short = np.minimum(end, start + stem)
    return start, end, key, mix((total[short] - total[start]) * inverse[start] + np.uint64(1 << 40))


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, stem: int = 0) -> Words:
    """The words of a block; with ``stem``, also the keys of their first ``stem`` bytes."""
    opens = offsets[:-1]
    if len(data) <= 2 * BLOCK:
        start, end, *key = _scan(data, opens[opens < len(data)], alphabet, stem)
    else:
        parts, low = [], 0
        while low < len(data):
            high, reach = min(len(data), low + BLOCK), BLOCK
            while high < len(data) and alphabet.letter[data[high]]:
                gaps = np.flatnonzero(~alphabet.letter[data[high : high + reach]])
                high = min(len(data), high + (int(gaps[0]) if len(gaps) else reach))
                reach *= 2
            here = opens[(opens >= low) & (opens < high)] - low
            start, end, *key = _scan(data[low:high], here, alphabet, stem)
            parts.append((start + low, end + low, *key))
            low = high
        start, end, *key = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(start, end, key[0], np.searchsorted(start, offsets), *key[1:])


def windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys of all runs of ``width`` words; entry ``i`` begins at word ``i``."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(width):
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
        out += keys[j : j + n] * np.uint64(factor)
    return mix(out + np.uint64(width))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets, as int64."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])
