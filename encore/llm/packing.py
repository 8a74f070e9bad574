"""Packing of token pieces into sequences of fixed capacity: best fit, then a local search by swaps.

Texts longer than a sequence are cut; all other pieces stay whole. Pieces are dealt to groups of bounded size, and every
group is packed in one task: best fit in order of falling length, then exchanges of one piece for one, two for one, and
moves between underfull sequences. Each exchange raises the sum of squared fills, so full sequences get fuller, empty
ones emptier, until no sequence can be emptied or the least possible number is reached.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import BINARY, INT, LONG, column, field, map_batches, written
from .tokens import default_path, encoder

CAPACITY = 2048
#: Pieces of one group: what a task holds, and what a group wastes is at most about one sequence.
GROUP = 8192
END = 0
#: Steps of the search without an emptied sequence after which it ends.
PATIENCE = 1000
_TEXTS = 512


def pieces(
    documents: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and, if asked for, the ids) of every piece of every document.

    A document is its ids and the end id. One that is longer than ``capacity`` is cut into pieces of that length; the
    first takes what is left over.
    """
    source = documents.select(column(id_col), column(text_col).cast("string"))
    schema = T.StructType(
        [
            T.StructField(id_col, documents.schema[id_col].dataType), field("piece", INT), field("start", LONG),
            field("length", LONG), field("ids_crc32", LONG), *([field("ids", BINARY)] if with_ids else []),
        ]
    )
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(path, literal=False)
        for whole in batches:
            for low in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(low, _TEXTS)
                owner, number, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encode(batch.column(1).to_pylist())):
                    raw += last
                    total = len(raw) // 4
                    cuts = [0, *range(total - (total - 1) // capacity * capacity, total + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = raw[4 * a : 4 * b]
                        owner.append(i), number.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [pa.array(x, pa.int64()) for x in (number, start, length, crc)]
                yield [batch.column(0).take(pa.array(owner, pa.int64())), *columns, *([pa.array(ids, pa.binary())] if with_ids else [])]

    return map_batches(source, schema, run)


class Bins:
    """Sequences of one group: free room of each, its pieces, and where pieces of each length are."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.free: list[int] = []
        self.content: list[list[int]] = []

    def best_fit(self) -> None:
        """Every piece, longest first, into the sequence with the least room that suffices."""
        by_free: dict[int, list[int]] = defaultdict(list)
        there = 0
        for item in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[item]
            fits = there >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                home = by_free[room].pop()
                if not by_free[room]:
                    there &= ~(1 << room)
            else:
                room, home = self.capacity, len(self.free)
                self.free.append(room)
                self.content.append([])
            self.content[home].append(item)
            room -= size
            self.free[home] = room
            if room:
                by_free[room].append(home)
                there |= 1 << room

    def least(self) -> int:
        return -(-sum(self.sizes) // self.capacity)

    def used(self) -> int:
        return sum(1 for c in self.content if c)

    def _give(self, donor: int, items: list[int], home: int, back: list[int]) -> None:
        for i in items:
            self.content[donor].remove(i)
            self.content[home].append(i)
        for i in back:
            self.content[home].remove(i)
            self.content[donor].append(i)
        moved = sum(self.sizes[i] for i in items) - sum(self.sizes[i] for i in back)
        self.free[donor] += moved
        self.free[home] -= moved

    def _sums(self, donor: int) -> np.ndarray:
        """Sorted sizes of the donor's pieces and of any two of them; distinct sizes of a sequence are few."""
        count = Counter(self.sizes[i] for i in self.content[donor])
        sizes = np.array(sorted(count))
        pairs = sizes[:, None] + sizes[None, :]
        once = [k for k, size in enumerate(sizes.tolist()) if count[size] < 2]
        pairs[once, once] = sizes[once]
        return np.unique(np.concatenate([sizes, pairs.ravel()]))

    def _most(self, donor: int, homes: np.ndarray) -> np.ndarray:
        """The most tokens that one step can take from the donor into each of these sequences, 0 if none."""
        single = np.array(sorted({self.sizes[i] for i in self.content[donor]}))
        rooms = np.array([self.free[h] for h in homes])
        at = np.searchsorted(single, rooms, "right")
        most = np.where(at > 0, single[at - 1], 0)
        held = [self.content[h] for h in homes]
        back = np.array([self.sizes[i] for c in held for i in c])
        owner = np.repeat(np.arange(len(homes)), [len(c) for c in held])
        sums = self._sums(donor)
        at = np.searchsorted(sums, back + rooms[owner], "right")
        np.maximum.at(most, owner, np.where(at > 0, sums[at - 1], 0) - back)
        return most

    def _step_into(self, donor: int, home: int, gain: int) -> None:
        """The first step, by falling size, that takes so many tokens from the donor into the sequence."""
        mine, sizes = sorted(self.content[donor], key=lambda i: -self.sizes[i]), self.sizes
        whole = {}
        for j in reversed(self.content[home]):
            whole[sizes[j]] = j
        for i in mine:
            if sizes[i] == gain:
                return self._give(donor, [i], home, [])
            if sizes[i] - gain in whole:
                return self._give(donor, [i], home, [whole[sizes[i] - gain]])
        for n, i in enumerate(mine):
            for k in mine[n + 1 :]:
                if sizes[i] + sizes[k] - gain in whole:
                    return self._give(donor, [i, k], home, [whole[sizes[i] + sizes[k] - gain]])

    def _exchange(self, donor: int, homes: list[int]) -> int | None:
        """One improving step that takes tokens out of ``donor``: the largest, looking no further than a room that it would fill."""
        if not homes:
            return None
        most = self._most(donor, np.array(homes))
        best = np.maximum.accumulate(most)
        full = np.flatnonzero(best == [self.free[h] for h in homes])
        pick = int(most[: full[0] + 1 if len(full) else None].argmax())
        if most[pick] <= 0:
            return None
        self._step_into(donor, homes[pick], int(most[pick]))
        return homes[pick]

    def improve(self) -> None:
        """Empties underfull sequences, emptiest first, until exchanges with fuller ones get nowhere for any of them.

        A sequence that found no step is asked again for the sequences that have changed since, and for no others. The search
        ends, too, when ``PATIENCE`` steps in a row have emptied no sequence.
        """
        idle = 0
        clock, changed = 0, [0] * len(self.content)
        asked = [-1] * len(self.content)
        under = sorted((-self.free[h], h) for h, c in enumerate(self.content) if c and self.free[h])
        used, least = self.used(), self.least()
        while used > least and idle < PATIENCE:
            latest = max((changed[h] for _, h in under), default=0)
            donor = next((h for _, h in under if asked[h] < latest or asked[h] < 0), None)
            if donor is None:
                return
            low = bisect_left(under, (-self.free[donor], -1))
            homes = [h for _, h in under[low:] if h != donor and changed[h] > asked[donor]]
            home = self._exchange(donor, homes)
            if home is None:
                asked[donor] = clock
                continue
            clock, used = clock + 1, used - (not self.content[donor])
            idle = idle + 1 if self.content[donor] else 0
            for h in (donor, home):
                changed[h], asked[h] = clock, -1
            under = [(f, h) for f, h in under if h not in (donor, home)]
            for h in (donor, home):
                if self.content[h] and self.free[h]:
                    insort(under, (-self.free[h], h))


def _packed(table: pa.Table, capacity: int, group_at: int) -> list[pa.Array]:
    """Sequence and place of each piece of a group."""
    sizes = table.column("length").to_pylist()
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.improve()
    base = (table.column(group_at)[0].as_py() if table.num_rows else 0) << 32
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for home, content in enumerate(bins.content):
        at = 0
        for item in content:
            sequence[item], offset[item] = base + home, at
            at += sizes[item]
    return [pa.array(sequence), pa.array(offset)]


def pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    group: int = GROUP,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with the sequence that holds each and its place there; with ``with_ids`` also the ids.

    Pieces are written once, numbered, and dealt to groups by the hash of their number, so no value of any column makes
    a group large. Null and empty texts are the end id alone. Repeated rows are packed each. Other columns are not read.
    An empty table gives an empty result.
    """
    path = path or default_path()
    named = documents.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    cut = pieces(named, "_id", "_text", path, capacity, end, with_ids)
    table = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-table.count() // group))
    dealt = table.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    schema = T.StructType([*cut.schema, field("sequence_id", LONG), field("offset", LONG)])
    arrow, width = to_arrow_schema(schema), len(cut.columns)

    def work(part: pa.Table) -> pa.Table:
        columns = [part.column(i).combine_chunks() for i in range(width)]
        return pa.Table.from_arrays([*columns, *_packed(part, capacity, width)], schema=arrow)

    return dealt.groupBy("group").applyInArrow(work, schema).withColumnRenamed("_id", id_col)
