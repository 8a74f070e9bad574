"""Near-duplicate documents: an exact Jaccard join on sets of word n-grams.

1. Equal sets collapse to the smallest id, so copies never meet.
2. N-grams are ordered from rare to frequent, by counts over all documents in a sketch of fixed size. Two sets can reach the
   similarity only if they share an n-gram among the first few of their order, the prefix.
3. Prefix n-grams that several sets have are joined: first every set with the smallest id of each n-gram, which links
   most near copies without pairing them all; then, between sets that are not yet connected, all pairs that pass the length
   and the positional filter. No link between components can be missed by that.
4. Each pair is verified once, on its texts: a suffix filter bounds the overlap first, then it is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import scan
from .components import components
from .frames import BINARY, BOOL, INT, LONG, column, field, map_batches, remove, shared_folder, written

WIDTH = 5
PERCENT = 80
#: Counters of the sketch, a power of two. They order n-grams, nothing else: any order gives the same links.
COUNTERS = 1 << 20
_PART = 1 << 12


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * shared >= percent * joint."""

    width: int = WIDTH
    percent: int = PERCENT

    def least(self, size):
        """Shared n-grams that a set of this size needs at least, with any partner."""
        return -(-self.percent * size // 100)

    def prefix(self, size):
        return size - self.least(size) + 1

    def needed(self, a, b):
        """Shared n-grams that sets of these sizes need."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram keys of every text of a block; one key for a text with fewer words, none without words."""
    found = scan.words(data, offsets, scan.FOLDED)
    runs, out = scan.windows(found.key, width), []
    for low, high in zip(found.ptr[:-1], found.ptr[1:], strict=True):
        if high - low >= width:
            out.append(np.unique(runs[low : high - width + 1]))
        else:
            out.append(scan.windows(found.key[low:high], high - low) if high > low else np.zeros(0, np.uint64))
    return out


def _all_sets(texts: pa.Array, width: int):
    for _, data, offsets in scan.blocks(texts):
        yield from sets_of(data, offsets, width)


def profiles(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One pass over all texts with two kinds of rows.

    (id, n_shingles, k1, k2) has the size of a document's set and a 128-bit key that equal sets share. (part, counts) is
    a part of a task's sketch: counts of n-grams by the low bits of their keys, in a fixed number of counters.
    """
    salt = np.uint64(0xA0761D6478BD642F)
    schema = T.StructType(
        [
            T.StructField("id", documents.schema[id_col].dataType), field("n_shingles", LONG), field("k1", LONG), field("k2", LONG),
            field("part", INT), field("counts", BINARY),
        ]
    )
    kind = to_arrow_schema(schema).field("id").type

    def run(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, first, second = [], [], []
            for _, data, offsets in scan.blocks(batch.column(1)):
                sets = sets_of(data, offsets, width)
                for keys in sets:
                    sizes.append(len(keys))
                    first.append(int(scan.mix(keys).sum(dtype=np.uint64).view(np.int64)) if len(keys) else 0)
                    second.append(int(scan.mix(keys ^ salt).sum(dtype=np.uint64).view(np.int64)) if len(keys) else 0)
                at = (np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64)
                if len(at) < 50_000:
                    np.add.at(seen, at, 1)
                else:
                    seen += np.bincount(at, minlength=COUNTERS)
            none = len(sizes)
            yield [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
        parts = [p.tobytes() for p in seen.reshape(-1, _PART)]
        none = len(parts)
        yield [pa.nulls(none, kind), *[pa.nulls(none, pa.int64())] * 3, pa.array(np.arange(none)), pa.array(parts, pa.binary())]

    return map_batches(documents.select(column(id_col), column(text_col).cast("string")), schema, run)


def sketch(profiled: DataFrame) -> np.ndarray:
    """The tasks' sketches added up. 8 MB, whatever the data; no task holds more than its parts of the sum."""
    schema = T.StructType([field("part", INT), field("counts", BINARY)])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(raw.as_buffer(), np.int64)
                total[part] = total[part] + counts if part in total else counts
        if total:
            yield [pa.array(list(total)), pa.array([c.tobytes() for c in total.values()], pa.binary())]

    counted = profiled.filter("part IS NOT NULL").select("part", "counts")
    summed = map_batches(counted.repartition(COUNTERS // _PART // 4, "part"), schema, add)
    out = np.zeros((COUNTERS // _PART, _PART), np.int64)
    for row in summed.collect():
        out[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def prefixes(documents: DataFrame, id_col: str, text_col: str, counts: np.ndarray, rule: Rule) -> DataFrame:
    """(key, id, n, at): the n-grams in each document's prefix, rare ones first, with the size of its set."""
    shared = documents.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))
    schema = T.StructType([field("key", LONG), T.StructField("id", documents.schema[id_col].dataType), field("n", INT), field("at", INT)])
    source = documents.select(column(id_col), column(text_col).cast("string")).filter(column(id_col).isNotNull())

    def run(batches):
        counts = shared.value
        for batch in batches:
            owner, keys, sizes, places = [], [], [], []

            def flushed():
                owners = batch.column(0).take(pa.array(np.concatenate(owner)))
                rows = [pa.array(np.concatenate(keys).view(np.int64)), owners, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))]
                for part in (owner, keys, sizes, places):
                    part.clear()
                return rows

            held = 0
            for i, mine in enumerate(_all_sets(batch.column(1), rule.width)):
                if not len(mine):
                    continue
                order = np.argsort(counts[mine & np.uint64(COUNTERS - 1)], kind="stable")
                head = mine[order[: rule.prefix(len(mine))]]
                owner.append(np.full(len(head), i)), keys.append(head)
                sizes.append(np.full(len(head), len(mine), np.int32)), places.append(np.arange(len(head), dtype=np.int32))
                held += len(head)
                if held > 100_000:
                    yield flushed()
                    held = 0
            if held:
                yield flushed()

    return map_batches(source, schema, run)


def overlap_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """Greatest possible overlap of two sorted sets, from the sizes of the parts that common pivots cut them into."""
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    return overlap_bound(a[:i], b[:j], depth - 1) + overlap_bound(a[i:], b[j:], depth - 1)


def _linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    needed = rule.needed(len(a), len(b))
    if not len(a) or not len(b) or min(len(a), len(b)) < needed or overlap_bound(a, b) < needed:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) with whether they link, from their texts."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], field("linked", BOOL)])
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out, ids = [], part.column(1).to_pylist()
                right = part.column(3)
                for i, left in enumerate(_all_sets(part.column(2), rule.width)):
                    if ids[i] != last[0]:
                        last = (ids[i], next(_all_sets(right.slice(i, 1), rule.width)))
                    out.append(_linked(left, last[1], rule))
                yield [part.column(0), part.column(1), pa.array(out, pa.bool_())]

    return map_batches(both.select("a", "b", "text_a", "text_b"), schema, run)


def _passes(rule: Rule, n, at, m, by):
    """Whether sets of sizes n and m that share the n-grams at these places can still reach the similarity."""
    rest = 1 + F.least(n - at - 1, m - by - 1)
    p = rule.percent
    return (100 * F.least(n, m) >= p * F.greatest(n, m)) & ((100 + p) * rest >= p * (n + m))


_BAND = 1.05


def _band(n) -> F.Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(_BAND))).cast("int")


def star_pairs(heads: DataFrame, rule: Rule) -> DataFrame:
    """Every set with the smallest id of each of its shared n-grams, where the filters allow it."""
    centre = F.col("centre")
    rows = heads.filter(F.col("id") != centre["id"]).filter(_passes(rule, F.col("n"), F.col("at"), centre["n"], centre["at"]))
    return rows.select(F.col("id").alias("a"), centre["id"].alias("b")).distinct()


def cross_pairs(heads: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of sets of different components that share a prefix n-gram and pass the filters.

    An n-gram matters only if sets of several components have it. A set asks for partners that are not larger, and only in the
    bands of length that its place of the n-gram leaves open.
    """
    several = heads.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    some = heads.join(several, "key", "left_semi").select("key", "id", "n", "at", "component")
    p = rule.percent
    low = F.ceil(F.col("n") * p / 100.0)
    high = F.least(F.col("n").cast("double"), ((100 + p) * (F.col("n") - F.col("at")) / float(p)) - F.col("n"))
    asks = some.filter(high >= low).withColumn("band", F.explode(F.sequence(_band(low) - 1, _band(F.greatest(high, low)) + 1)))
    gives = some.select(
        "key", _band(F.col("n")).alias("band"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("at").alias("by"), F.col("component").alias("theirs")
    )
    pairs = asks.join(gives, ["key", "band"]).filter(
        (F.col("component") != F.col("theirs"))
        & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("id"))))
        & _passes(rule, F.col("n"), F.col("at"), F.col("m"), F.col("by"))
    )
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The id, size of its set and component, the smallest id that links reach, of every document.

    Words are runs without white space, A-Z folded; a text with fewer words than an n-gram is one n-gram as a whole.
    Null, empty and blank texts have no n-grams and link with nothing; documents with a null id have no component. Rows
    that repeat an id are one document with the n-grams of each of its texts linking. Other columns are not read. An
    empty table gives an empty result. Links, components and n-grams stay in tables in the shared folder; those that the
    result does not read are removed.
    """
    kind = documents.schema[id_col].dataType
    profiled = written(profiles(documents, id_col, text_col, rule.width), "profiles")
    seen = profiled.filter("part IS NULL").select("id", *_SET)
    filled = seen.filter("n_shingles > 0 AND id IS NOT NULL")
    smallest = written(filled.groupBy(*_SET).agg(F.min("id").alias("set_id")), "sets")

    spread = prefixes(documents, id_col, text_col, sketch(profiled), rule)
    several = spread.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key")
    spark, scratch = documents.sparkSession, shared_folder(documents.sparkSession, "join")
    shared = written(spread.join(several, "key"), "shared-prefixes", f"{scratch}/shared")
    heads = shared.join(smallest.select(F.col("set_id").alias("id")).distinct(), "id", "left_semi")
    centres = heads.groupBy("key").agg(F.min(F.struct("id", "n", "at")).alias("centre"), F.max("id").alias("high"))
    heads = written(heads.join(centres.filter("centre.id <> high").drop("high"), "key"), "prefix-heads", f"{scratch}/heads")
    remove(spark, f"{scratch}/shared")

    some = heads.select("id").distinct()
    texts = documents.select(column(id_col).cast(kind).alias("id"), column(text_col).cast("string").alias("text"))
    texts = written(texts.join(some, "id", "left_semi"), "pair-texts", f"{scratch}/texts")
    first = written(verified(star_pairs(heads, rule), texts, rule), "star-links", f"{scratch}/first")
    near = components(first.filter("linked"), "star-components")

    apart = heads.join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tried = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fresh = cross_pairs(apart, rule).join(tried, ["a", "b"], "left_anti")
    second = written(verified(fresh, texts, rule), "cross-links", f"{scratch}/second")
    links = first.unionByName(second).filter("linked").select("a", "b").unionByName(_same_id(filled, smallest))
    of_sets = components(links).withColumnRenamed("id", "set_id")
    remove(spark, scratch)
    named = smallest.join(of_sets, "set_id", "left")
    named = named.select(*_SET, F.coalesce("component", "set_id").alias("component_id"))
    return seen.join(named, _SET, "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )


_SET = ["n_shingles", "k1", "k2"]


def _same_id(filled: DataFrame, smallest: DataFrame) -> DataFrame:
    """Links between the sets of ids that come with different texts."""
    whole = F.struct(*_SET)
    several = filled.groupBy("id").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).filter("low <> high").select("id")
    sets = filled.join(several, "id", "left_semi").join(smallest, _SET).select("id", "set_id").distinct()
    return sets.join(sets.groupBy("id").agg(F.min("set_id").alias("b")), "id").select(F.col("set_id").alias("a"), "b").filter("a <> b")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The documents without all but one of each group of near-duplicates: the one with the smallest id stays.

    Documents without words and those with a null id stay. All columns are as they were. Rows that repeat an id are documents of
    their own: they go only where their texts are near copies of one that stays, and of equal texts under one id the row with
    the least hash stays.
    """
    names = documents.columns
    counted = documents.groupBy(column(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if counted.filter("n > 1 AND id IS NOT NULL").isEmpty():
        found = near_duplicates(documents, id_col, text_col, rule)
        gone = written(found.filter(column(id_col) != F.col("component_id")).select(column(id_col)).distinct(), "copies")
        return documents.join(gone, id_col, "left_anti").select(*[column(c) for c in names])
    plain = [F.col(f"c{i}") for i in range(len(names))]
    frame = documents.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)])
    own, text = plain[names.index(id_col)], plain[names.index(text_col)].cast("string")
    frame = frame.withColumn("key", F.when(own.isNotNull(), F.struct(own.alias("id"), F.when(own.isNotNull(), F.xxhash64(text)).alias("hash"))))
    found = near_duplicates(frame.select("key", text.alias("text")), "key", "text", rule)
    gone = written(found.filter(F.col("key") != F.col("component_id")).select("key").distinct(), "copies")
    kept = frame.join(gone, "key", "left_anti")
    alone = F.col("key").isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = F.xxhash64(*[c for c, f in zip(plain, documents.schema, strict=True) if not isinstance(f.dataType, T.MapType)])
    single = kept.filter(~alone).groupBy("key").agg(F.min_by(F.struct(*plain), hashed).alias("row")).select("row.*")
    rows = kept.filter(alone).select(*plain).unionByName(single)
    return rows.select(*[c.alias(name) for c, name in zip(plain, names, strict=True)])
