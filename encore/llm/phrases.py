"""Collocations: phrases whose words meet more often than by chance, counted with weighted acyclic automata.

1. Every task sorts the word windows of a shard of its texts and builds tries from them, state by state in sorted order. A state's
   weight is the number of windows in its prefix range, so one trie over windows of five words counts phrases of every length. Tries are
   cut into prefix ranges and packed: two-word windows by their two words, longer ones by their first three.
2. All packed tries of a range meet in one task. Their union adds up weights depth by depth, and states below the least count
   go at once with all that follows them: no longer phrase can be more frequent than its beginning.
3. Parts of a phrase are looked up by composition: the phrases' remaining parts, as paths, run through the union of their range.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import scan
from .frames import BINARY, INT, LONG, TEXT, column, field, map_batches, remove, shared_folder, written

LONGEST = 5
STOPS = b".,;:!?\n\x0b\x0c\r"
WORDS = scan.Alphabet(b" \t" + STOPS, fold=True)
_STOP = np.isin(np.arange(256), list(STOPS))
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words of a shard: bounds a task's memory. Below 2**21, so that three word numbers fit into 64 bits.
SHARD_WORDS = 1_000_000
#: Windows of a prefix range, on average.
RANGE_WINDOWS = 4_000_000
#: Words that packed tries name by two bytes; others are spelled out by their keys.
SHORT_NAMES = 65_535
_KEYS = T.ArrayType(LONG)


@dataclass(frozen=True)
class Mining:
    least: int = 100
    top: int = 2000
    unknown: str = "und"


def _language(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def _read(batch, salts: dict):
    """For each block of texts: its bytes, its words, and the words' keys, which differ between languages."""
    langs = batch.column(0).to_pylist()
    for name in set(langs) - salts.keys():
        salts[name] = _language(name)
    salt = np.array([salts[x] for x in langs], np.uint64)
    for first, data, offsets in scan.blocks(batch.column(1)):
        found = scan.words(data, offsets, WORDS)
        doc = found.doc()
        yield data, found, doc, first, scan.mix(found.key ^ salt[first + doc])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, key, word, f) of all words of (lang, text)."""
    schema = T.StructType([field("lang", TEXT), field("key", LONG), field("word", TEXT), field("f", LONG)])

    def run(batches):
        salts: dict = {}
        seen: dict[int, list] = {}

        def flushed():
            rows = [(lang, key, word, n) for key, (lang, word, n) in seen.items()]
            seen.clear()
            return list(zip(*rows, strict=True))

        for batch in batches:
            for data, found, doc, first, keys in _read(batch, salts):
                some, at, n = np.unique(keys.view(np.int64), return_index=True, return_counts=True)
                for key, i, k in zip(some.tolist(), at.tolist(), n.tolist(), strict=True):
                    if key in seen:
                        seen[key][2] += k
                    else:
                        word = data[found.start[i] : found.end[i]].tobytes().translate(_FOLD).decode()
                        seen[key] = [batch.column(0)[first + int(doc[i])].as_py(), word, k]
                if len(seen) > 500_000:
                    yield flushed()
        if seen:
            yield flushed()

    return map_batches(texts, schema, run).groupBy("lang", "key", "word").agg(F.sum("f").alias("f"))


def frequent_names(words: DataFrame, most: int = SHORT_NAMES) -> np.ndarray:
    """Sorted keys of the most frequent words, at most ``most``: those above a count, found from how many words have counts of each size.

    No task and no driver orders the words; the driver gets a thousand rows at most, then the keys.
    """
    size = F.floor(F.log("f") * 20).alias("size")
    counts = words.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = None, most
    for row in sorted(counts, key=lambda r: -r["size"]):
        if row["n"] > room:
            break
        least, room = row["size"], room - row["n"]
    if least is None:
        return np.zeros(0, np.uint64)
    keys = words.filter(F.floor(F.log("f") * 20) >= least).select("key").collect()
    return np.sort(np.array([r["key"] for r in keys], np.int64).view(np.uint64))


@dataclass
class Automaton:
    """States by depth, each depth sorted by parent, then label: the word's key, the parent's number, the weight."""

    label: list[np.ndarray]
    parent: list[np.ndarray]
    weight: list[np.ndarray]

    def paths(self, depth: int) -> np.ndarray:
        """The words of the paths to all states of a depth, one row each."""
        out, at = np.empty((len(self.label[depth - 1]), depth), np.uint64), np.arange(len(self.label[depth - 1]))
        for d in range(depth - 1, -1, -1):
            out[:, d] = self.label[d][at]
            at = self.parent[d][at]
        return out

    def above(self, depth: int, up: int) -> np.ndarray:
        """For all states of a depth, the weight of the state ``up`` levels above."""
        at = np.arange(len(self.label[depth - 1]))
        for d in range(depth - 1, depth - 1 - up, -1):
            at = self.parent[d][at]
        return self.weight[depth - 1 - up][at]

    def run(self, words: np.ndarray) -> np.ndarray:
        """Composition with paths of equal length: the weight that each path ends with, 0 where it leaves the automaton."""
        state, alive = np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for d in range(words.shape[1]):
            names, number = np.unique(self.label[d], return_inverse=True)
            if not len(names):
                return np.zeros(len(words), np.int64)
            here = self.parent[d] * len(names) + number
            name = np.minimum(np.searchsorted(names, words[:, d]), len(names) - 1)
            want = state * len(names) + name
            at = np.minimum(np.searchsorted(here, want), len(here) - 1)
            alive &= (names[name] == words[:, d]) & (here[at] == want)
            state = at
        return np.where(alive, self.weight[words.shape[1] - 1][state], 0)


def _smallest(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


class Packer:
    """Automata as compressed bytes; frequent words are named by their number in a shared table."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.out, self.back = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def codes(self, labels: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(labels), SHORT_NAMES, np.uint16)
        at = np.minimum(np.searchsorted(self.names, labels), len(self.names) - 1)
        return np.where(self.names[at] == labels, at, SHORT_NAMES).astype(np.uint16)

    def pack(self, depths: list[tuple]) -> bytes:
        """From (codes, spelled keys of the words without code, parents, weights) of each depth."""
        head, body = [], []
        for code, spelled, parent, weight in depths:
            steps = _smallest(np.diff(parent, prepend=0))
            weight = _smallest(weight)
            head.append(struct.pack("<IIBB", len(code), len(spelled), steps.itemsize, weight.itemsize))
            body += [code.tobytes(), spelled.tobytes(), steps.tobytes(), weight.tobytes()]
        return bytes([len(depths)]) + b"".join(head) + self.out.compress(b"".join(body))

    def unpack(self, blob: bytes) -> Automaton:
        n, at, place = blob[0], 0, 1
        raw = self.back.decompress(blob[1 + 10 * n :])
        out = Automaton([], [], [])
        for _ in range(n):
            size, spelled, step, wide = struct.unpack_from("<IIBB", blob, place)
            place += 10
            code = np.frombuffer(raw, np.uint16, size, at)
            at += 2 * size
            label = np.zeros(size, np.uint64)
            short = code != SHORT_NAMES
            label[short] = self.names[code[short]]
            label[~short] = np.frombuffer(raw, np.uint64, spelled, at)
            at += 8 * spelled
            out.label.append(label)
            out.parent.append(np.cumsum(np.frombuffer(raw, f"<u{step}", size, at), dtype=np.int64))
            at += step * size
            out.weight.append(np.frombuffer(raw, f"<u{wide}", size, at).astype(np.int64))
            at += wide * size
        return out

    def whole(self, automaton: Automaton) -> bytes:
        depths = []
        for label, parent, weight in zip(automaton.label, automaton.parent, automaton.weight, strict=True):
            code = self.codes(label)
            depths.append((code, label[code == SHORT_NAMES], parent, weight))
        return self.pack(depths)


def route(words: np.ndarray, ranges: int) -> np.ndarray:
    """The range that phrases (one a row) are counted in: even numbers for two words, odd ones for more."""
    first = min(words.shape[1], 3)
    total = np.zeros(len(words), np.uint64)
    for j in range(first):
        total = scan.mix(total + words[:, j])
    return (total % np.uint64(ranges)).astype(np.int64) * 2 + (first - 2)


def _in_ranges(part: np.ndarray, cols: list[np.ndarray], count: np.ndarray, words: np.ndarray, packer: Packer, code: np.ndarray):
    """(range, packed trie) from distinct windows sorted by range and word numbers (0: the window has ended)."""
    total = np.concatenate([[0], np.cumsum(count)])
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(edge[1:], len(part))
    change = np.zeros(len(part), bool)
    change[edge] = True
    depths, starts = [], None
    for col in cols:
        change[1:] |= col[1:] != col[:-1]
        start = np.flatnonzero(change)
        weight = total[np.append(start[1:], len(part))] - total[start]
        real = col[start] != 0
        start, weight = start[real], weight[real]
        parent = np.zeros(len(start), np.int64) if starts is None else np.searchsorted(starts, start, "right") - 1
        depths.append((start, col[start] - 1, parent, weight))
        starts = start
    cuts = [(np.searchsorted(d[0], edge), np.searchsorted(d[0], ends)) for d in depths]
    for r, p in enumerate(part[edge].tolist()):
        packed, before = [], 0
        for j, (_, number, parent, weight) in enumerate(depths):
            a, b = cuts[j][0][r], cuts[j][1][r]
            mine, name = number[a:b], code[number[a:b]]
            packed.append((name, words[mine[name == SHORT_NAMES]], parent[a:b] - (before if j else 0), weight[a:b]))
            before = a
        yield p, packer.pack(packed)


def shard_automata(keys: np.ndarray, joined: np.ndarray, stop: int, ranges: int, packer: Packer):
    """(range, packed trie) for all windows that begin in ``keys[:stop]``; ``joined[i]``: word ``i + 1`` is in word ``i``'s piece."""
    words, number = np.unique(keys, return_inverse=True)
    code, number = packer.codes(words), number.astype(np.int64) + 1
    follows = [joined]
    for j in range(1, LONGEST - 1):
        follows.append(follows[-1][:-1] & joined[j:])
    cols = [number]
    for j, good in enumerate(follows, 1):
        col = np.zeros(len(keys), np.int64)
        col[: len(good)] = np.where(good, number[j:], 0)
        cols.append(col)
    for size in (2, LONGEST):
        least = min(size, 3)
        begins = np.flatnonzero(cols[least - 1][:stop])
        if not len(begins):
            continue
        mine = [c[begins] for c in cols[:size]]
        if size == 2:
            value, count = np.unique(mine[0] << 21 | mine[1], return_counts=True)
            mine = [value >> 21, value & (1 << 21) - 1]
        else:
            high, low = mine[0] << 42 | mine[1] << 21 | mine[2], mine[3] << 21 | mine[4]
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
            count, high, low = np.diff(np.append(first, len(order))), high[first], low[first]
            mask = (1 << 21) - 1
            mine = [high >> 42, high >> 21 & mask, high & mask, low >> 21, low & mask]
        part = route(np.stack([words[c - 1] for c in mine[:least]], axis=1), ranges)
        order = np.argsort(part, kind="stable")
        yield from _in_ranges(part[order], [c[order] for c in mine], count[order], words, packer, code)


def automata(texts: DataFrame, names: np.ndarray, ranges: int) -> DataFrame:
    """(part, blob): the packed tries of all shards of (lang, text), by range."""
    shared = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        packer, salts, keys, joined, held = Packer(shared.value), {}, [], [], 0

        def shards():
            every, piece = np.concatenate(keys), np.concatenate(joined)
            keys.clear(), joined.clear()
            for low in range(0, len(every), SHARD_WORDS):
                high = min(len(every), low + SHARD_WORDS)
                reach = min(len(every), high + LONGEST - 1)
                rows = list(shard_automata(every[low:reach], piece[low : reach - 1], high - low, ranges, packer))
                for at in range(0, len(rows), 256):
                    yield list(zip(*rows[at : at + 256], strict=True))

        for batch in batches:
            for data, found, doc, _, mine in _read(batch, salts):
                if not len(mine):
                    continue
                stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])
                same = np.zeros(len(mine), bool)
                same[:-1] = (stops[found.start[1:]] == stops[found.end[:-1]]) & (doc[1:] == doc[:-1])
                keys.append(mine), joined.append(same)
                held += len(mine)
                if held >= SHARD_WORDS:
                    yield from shards()
                    held = 0
        if held:
            yield from shards()

    return map_batches(texts, T.StructType([field("part", INT), field("blob", BINARY)]), run)


def union(parts: list[Automaton], least: int) -> Automaton:
    """Adds up automata of one range; states whose weight stays below ``least`` go, with all that follows them."""
    out = Automaton([], [], [])
    maps = None
    for d in range(max(len(p.label) for p in parts)):
        mine = [p for p in parts if len(p.label) > d]
        label = np.concatenate([p.label[d] for p in mine])
        weight = np.concatenate([p.weight[d] for p in mine])
        parent = np.zeros(len(label), np.int64) if maps is None else np.concatenate([m[p.parent[d]] for m, p in zip(maps, mine, strict=True)])
        state = np.full(len(label), -1, np.int64)
        alive = np.flatnonzero(parent >= 0)
        order = alive[np.lexsort((label[alive], parent[alive]))]
        if len(order):
            a, b = parent[order], label[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            sums = np.add.reduceat(weight[order], first)
            kept = sums >= least
            number = np.where(kept, np.cumsum(kept) - 1, -1)
            state[order] = np.repeat(number, np.diff(np.append(first, len(order))))
            out.label.append(b[first][kept]), out.parent.append(a[first][kept]), out.weight.append(sums[kept])
        else:
            out.label.append(np.zeros(0, np.uint64)), out.parent.append(np.zeros(0, np.int64)), out.weight.append(np.zeros(0, np.int64))
        maps = np.split(state, np.cumsum([len(p.label[d]) for p in mine])[:-1])
    return out


def unions(shards: DataFrame, names: np.ndarray, ranges: int, least: int) -> DataFrame:
    """(part, blob): one automaton for each range with frequent phrases."""
    shared = shards.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        packer, at, blobs = Packer(shared.value), None, []

        def merged():
            found = union([packer.unpack(b) for b in blobs], least)
            if len(found.label[min(len(found.label), 3) - 1]):
                yield [[at], [packer.whole(found)]]

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at and blobs:
                    yield from merged()
                    blobs = []
                at = part
                blobs.append(blob)
        if blobs:
            yield from merged()

    return map_batches(shards.repartitionById(2 * ranges, "part").sortWithinPartitions("part"), shards.schema, run)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def candidates(merged: DataFrame, names: np.ndarray) -> DataFrame:
    """(words, a, l3, l4): the frequent phrases as word keys, with their counts and those of their beginnings of three and four words."""
    shared = merged.sparkSession.sparkContext.broadcast(names)
    schema = T.StructType([field("words", _KEYS), field("a", LONG), field("l3", LONG), field("l4", LONG)])

    def run(batches):
        packer = Packer(shared.value)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                found = packer.unpack(blob)
                for m in range(min(len(found.label), 3), len(found.label) + 1):
                    if len(found.label[m - 1]):
                        left = [pa.array(found.above(m, m - k)) if m > k else pa.nulls(len(found.label[m - 1]), pa.int64()) for k in (3, 4)]
                        yield [_lists(found.paths(m)), pa.array(found.weight[m - 1]), *left]

    return map_batches(merged.select("part", "blob"), schema, run)


#: The parts of two words and more that a phrase of so many words asks other ranges for: (name, first word, end).
_ASKED = {m: ([("l2", 0, 2)] if m > 2 else []) + [(f"r{k}", k, m) for k in range(1, m - 1)] for m in range(2, LONGEST + 1)}


def questions(found: DataFrame, ranges: int) -> DataFrame:
    """(part, path, words, name): the parts of all phrases that are looked up in the automata."""
    schema = T.StructType([field("part", INT), field("path", _KEYS), field("words", _KEYS), field("name", TEXT)])

    def run(batches):
        for batch in batches:
            column, sizes = batch.column(0), np.diff(np.asarray(batch.column(0).offsets))
            for m in np.unique(sizes).tolist():
                rows = column.filter(pa.array(sizes == m)).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, m)
                for name, low, high in _ASKED[m]:
                    path = rows[:, low:high]
                    yield [pa.array(route(path, ranges)), _lists(path), _lists(rows), pa.array([name] * len(rows))]

    return map_batches(found.select("words"), schema, run)


def compose(asked: DataFrame, merged: DataFrame, names: np.ndarray) -> DataFrame:
    """(words, name, f): the answers of the range's automaton to the questions."""
    shared = merged.sparkSession.sparkContext.broadcast(names)
    out = pa.schema([("words", pa.list_(pa.int64())), ("name", pa.string()), ("f", pa.int64())])

    def answer(questions: pa.Table, blobs: pa.Table) -> pa.Table:
        if not questions.num_rows or not blobs.num_rows:
            return out.empty_table()
        found, tables = Packer(shared.value).unpack(blobs.column("blob")[0].as_py()), []
        paths = questions.column("path").combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(paths))
        for m in np.unique(sizes).tolist():
            some = pa.array(sizes == m)
            rows = paths.filter(some).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, m)
            mine = questions.filter(some)
            tables.append(pa.table([mine.column("words"), mine.column("name"), pa.array(found.run(rows))], schema=out))
        return pa.concat_tables(tables)

    schema = T.StructType([field("words", _KEYS), field("name", TEXT), field("f", LONG)])
    return asked.groupBy("part").cogroup(merged.groupBy("part")).applyInArrow(answer, schema)


def _score(a, n, left, right):
    """floor(1000 * a * n / (l * r)), exactly."""
    wide = [f"CAST({x} AS DECIMAL(20, 0))" for x in (a, n, left, right)]
    return f"(1000 * {wide[0]} * {wide[1]}) DIV ({wide[2]} * {wide[3]})"


def phrases(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", mining: Mining = Mining()) -> DataFrame:
    """The best phrases of two to five words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``n`` all words of the language, ``l`` and ``r`` the parts before and after the cut that scores lowest,
    ``score`` is floor(1000 * a * n / (l * r)). A phrase inside a longer one that is as frequent is left out. Words are folded (A-Z)
    and never cross ``.,;:!?`` or a line end. A null language is ``und``; null and empty texts have no words; repeated rows
    count again; equal scores are ordered by count, then by phrase. An empty table, or one without frequent phrases, gives
    an empty result. Other columns are not read. Tables of words, tries and counts in the shared folder are removed, but for those that
    the result reads.
    """
    spark, scratch = documents.sparkSession, shared_folder(documents.sparkSession, "phrases")
    language = F.coalesce(column(lang_col).cast("string"), F.lit(mining.unknown))
    texts = documents.select(language.alias("lang"), column(text_col).cast("string").alias("text"))
    words = written(word_counts(texts), "words", f"{scratch}/words")
    total = words.agg(F.sum("f")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_WINDOWS))
    names = frequent_names(words)
    merged = written(unions(automata(texts, names, ranges), names, ranges, mining.least), "unions", f"{scratch}/unions")
    found = written(candidates(merged, names), "candidates", f"{scratch}/candidates")
    answers = compose(questions(found, ranges), merged, names)

    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = words.filter(F.col("f") >= mining.least)
    asked = ["l2", "r1", "r2", "r3"]
    rows = found.select("words", "a", "l3", "l4", *[F.lit(None).cast("long").alias(c) for c in asked])
    rows = rows.unionByName(answers.select("words", *[F.when(F.col("name") == c, F.col("f")).alias(c) for c in asked]), allowMissingColumns=True)
    rows = rows.groupBy("words").agg(*[F.max(c).alias(c) for c in ("a", "l3", "l4", *asked)])
    rows = rows.withColumns({"m": F.size("words"), "head": F.col("words")[0], "tail": F.element_at("words", -1)})
    rows = rows.join(single.select(F.col("key").alias("head"), "lang", F.col("f").alias("l1")), "head")
    rows = rows.join(single.select(F.col("key").alias("tail"), F.col("f").alias("last")), "tail").join(sizes, "lang")
    cuts = []
    for k in range(1, LONGEST):
        right = f"CASE WHEN m = {k + 1} THEN last ELSE {f'r{k}' if k < LONGEST - 1 else 'last'} END"
        cuts.append(f"CASE WHEN m > {k} THEN struct({_score('a', 'n', f'l{k}', right)} AS score, {k} AS k, l{k} AS l, {right} AS r) END")
    rows = rows.withColumn("cut", F.expr(f"array_min(array_compact(array({', '.join(cuts)})))"))
    rows = rows.withColumn("most", F.expr("CASE m WHEN 3 THEN l2 WHEN 4 THEN l3 WHEN 5 THEN l4 END"))
    scored = rows.select("lang", "words", "a", "n", "m", "most", "r1", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
    scored = written(scored, "scored", f"{scratch}/scored")

    inside = scored.filter("m > 2 AND most = a").select(F.expr("slice(words, 1, m - 1)").alias("words"))
    inside = inside.unionByName(scored.filter("m > 2 AND r1 = a").select(F.expr("slice(words, 2, m - 1)").alias("words"))).distinct()
    kept = scored.join(inside, "words", "left_anti").select("lang", "words", "a", "l", "r", "n", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = kept.withColumn("place", F.rank().over(best)).filter(F.col("place") <= mining.top).drop("place")
    near = written(near, "best", f"{scratch}/best")
    spelled = near.select("words", F.posexplode("words").alias("at", "key")).join(single.select("key", "word"), "key")
    spelled = spelled.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    named = near.join(spelled.select("words", F.array_join(F.col("spelled.word"), " ").alias("phrase")), "words")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= mining.top)
    out = written(placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    remove(spark, scratch)
    return out
