"""Near-duplicates through a Hamming join of b-bit MinHash signatures with a multi-index.

1. Every distinct set of word n-grams gets a signature: for each of 96 hash functions 16 bits of the least value. Sets of similarity J
   differ in a share 1 - J of the positions, so the signature distance of pairs at the threshold is known: at most 31 positions
   but for about 3 pairs in a million at 85 %.
2. A signature is cut into 16 chunks of 6. By the pigeonhole principle a pair within the distance has a chunk with at most one
   differing position. All such errors are enumerated: each chunk gives 6 keys, one without each position, and every pair within
   the distance meets on a key.
3. Sets that meet are compared in two rounds. First each with the set it meets most. Then, between components, with the best
   linked set of each key (the hub), and with those that differ from that hub in enough of the same n-grams. Between the rounds,
   n-grams that occur in one component alone tell how much a set can share with any other; those that cannot reach the
   similarity meet no more. So the many copies of one text that are just too far apart do not pair up. Pairs above the
   distance go; the rest are confirmed on their full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import jaccard, scan
from .components import components
from .frames import BINARY, LONG, column, field, map_batches, remove, shared_folder, written

_SET = ["n_shingles", "k1", "k2"]


@dataclass(frozen=True)
class Index:
    """Sets link when 100 * shared >= percent * joint; signatures have chunks * wide positions of 16 bits."""

    width: int = 5
    percent: int = 85
    chunks: int = 16
    wide: int = 6

    @property
    def positions(self) -> int:
        return self.chunks * self.wide

    @property
    def distance(self) -> int:
        """The greatest distance at which some chunk must have at most one error."""
        return 2 * self.chunks - 1

    @property
    def least(self) -> int:
        """Sets with fewer n-grams link with no other set."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        seeds = scan.mix(np.arange(1, 2 * self.positions + 1, dtype=np.uint64))
        return seeds[: self.positions], seeds[self.positions :] | np.uint64(1)


def signatures(keys: np.ndarray, ptr: np.ndarray, index: Index) -> np.ndarray:
    """One row of 16-bit values for each non-empty set ``keys[ptr[i]:ptr[i + 1]]``."""
    masks, factors = index.hashes()
    out = np.empty((len(ptr) - 1, index.positions), np.uint16)
    for i in range(index.positions):
        least = np.minimum.reduceat((keys ^ masks[i]) * factors[i], ptr[:-1])
        out[:, i] = scan.mix(least) & np.uint64(0xFFFF)
    return out


def chunk_keys(rows: np.ndarray, index: Index) -> np.ndarray:
    """For each signature the keys of its chunks without each of their positions; equal keys mean chunks with at most that one error."""
    place = np.arange(index.positions, dtype=np.uint64)
    spread = scan.mix(rows.astype(np.uint64) | (place << np.uint64(16)))
    whole = spread.reshape(len(rows), index.chunks, index.wide).sum(axis=2, dtype=np.uint64)
    return scan.mix(np.repeat(whole, index.wide, axis=1) - spread + scan.mix(place + np.uint64(1 << 40)))


def profiles(documents: DataFrame, id_col: str, text_col: str, index: Index) -> DataFrame:
    """(id, n_shingles, k1, k2, signature): size of the set, 128 bits that equal sets share, and the signature if the set can link."""
    salt = np.uint64(0xA0761D6478BD642F)
    schema = T.StructType([T.StructField("id", documents.schema[id_col].dataType), *(field(c, LONG) for c in _SET), field("signature", BINARY)])

    def run(batches):
        for batch in batches:
            sizes, first, second, signs = [], [], [], []
            for _, data, offsets in scan.blocks(batch.column(1)):
                sets = jaccard.sets_of(data, offsets, index.width)
                sizes += [len(s) for s in sets]
                first += [int(scan.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                second += [int(scan.mix(s ^ salt).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                able = [s for s in sets if len(s) >= index.least]
                rows = iter(())
                if able:
                    ptr = np.concatenate([[0], np.cumsum([len(s) for s in able])])
                    rows = iter(signatures(np.concatenate(able), ptr, index))
                signs += [next(rows).tobytes() if len(s) >= index.least else None for s in sets]
            yield [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.array(signs, pa.binary())]

    return map_batches(documents.select(column(id_col), column(text_col).cast("string")), schema, run)


def _matrix(signs: pa.Array, index: Index) -> np.ndarray:
    return np.frombuffer(b"".join(signs.to_pylist()), np.uint16).reshape(-1, index.positions)


def meeting_keys(sets: DataFrame, index: Index) -> DataFrame:
    """(key, id, n) for all chunk keys of all sets (id, n, signature)."""
    schema = T.StructType([field("key", LONG), sets.schema["id"], field("n", LONG)])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                keys = chunk_keys(_matrix(part.column(2), index), index)
                owner = pa.array(np.repeat(np.arange(part.num_rows), index.positions))
                yield [pa.array(keys.reshape(-1).view(np.int64)), part.column(0).take(owner), part.column(1).take(owner)]

    return map_batches(sets.select("id", "n", "signature"), schema, run)


def within_distance(pairs: DataFrame, sets: DataFrame, index: Index) -> DataFrame:
    """The pairs (a, b) whose signatures are within the distance."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                apart = (_matrix(batch.column(2), index) != _matrix(batch.column(3), index)).sum(axis=1)
                near = batch.filter(pa.array(apart <= index.distance))
                yield [near.column(0), near.column(1)]

    return map_batches(both, T.StructType([pairs.schema["a"], pairs.schema["b"]]), run).distinct()


def _of_size(index: Index, n, m):
    """Whether sets of these sizes can be as similar as asked."""
    return 100 * F.least(n, m) >= index.percent * F.greatest(n, m)


def most_met(heads: DataFrame, index: Index) -> DataFrame:
    """Each set with the one that leads most of its keys."""
    rows = heads.filter(F.col("id") != F.col("lead.id")).filter(_of_size(index, F.col("n"), F.col("lead.n")))
    met = rows.groupBy("id", F.col("lead.id").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("times")).alias("less"), "b")).alias("best"))
    return best.select(F.col("id").alias("a"), F.col("best.b").alias("b"))


def open_rows(heads: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of keys on which several components still meet, with component and number of links of each set."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rows = heads.select("key", "id", "n").join(near, "id", "left").join(ends, "id", "left")
    rows = rows.select("key", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return rows.join(_several(rows).select("key"), "key")


def _several(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).filter("low <> high")


def supports(rows: DataFrame, texts: DataFrame, index: Index) -> DataFrame:
    """(id, support): how many n-grams of a set occur in another component at all. No partner there can share more."""
    kind = rows.schema["id"].dataType
    schema = T.StructType([field("gram", LONG), T.StructField("id", kind), T.StructField("component", kind)])
    source = texts.join(rows.select("id", "component").distinct(), "id").select("id", "component", "text")

    def run(batches):
        for batch in batches:
            for first, data, offsets in scan.blocks(batch.column(2)):
                sets = jaccard.sets_of(data, offsets, index.width)
                owner = pa.array(first + np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                yield [pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner)]

    grams = map_batches(source, schema, run)
    shared = grams.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gram")
    return grams.join(shared, "gram").groupBy("id").agg(F.count(F.lit(1)).alias("support"))


def _enough(index: Index, shared, joint):
    """Whether so many shared n-grams, of so many in both sets together, can make a link."""
    return (100 + index.percent) * shared >= index.percent * joint


def supported(rows: DataFrame, support: DataFrame, index: Index) -> DataFrame:
    """The rows of sets that can still link with the smallest set on the key, of keys on which several components are left."""
    rows = rows.join(support, "id").join(_several(rows).select("key", "least"), "key")
    rows = rows.filter(_enough(index, F.col("support"), F.col("n") + F.col("least"))).drop("least")
    return rows.join(_several(rows).select("key"), "key")


def hub_pairs(rows: DataFrame, index: Index) -> DataFrame:
    """Each set with the best linked set of each of its keys, where their components differ."""
    hubs = rows.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("less"), "id", "n", "component", "support")).alias("hub"))
    met = rows.join(hubs, "key").filter(F.col("component") != F.col("hub.component")).filter(_of_size(index, F.col("n"), F.col("hub.n")))
    met = met.filter(_enough(index, F.least("support", "hub.support"), F.col("n") + F.col("hub.n")))
    return met.select(F.least("id", "hub.id").alias("b"), F.greatest("id", "hub.id").alias("a")).select("a", "b").distinct()


def spokes(rows: DataFrame, texts: DataFrame, index: Index) -> DataFrame:
    """(hub, id, component, n, size, grams): how each set differs from the best linked set of each of its keys, as the n-grams that only one has."""
    hubs = rows.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("less"), "id")).alias("hub"))
    met = rows.join(hubs, "key").filter(F.col("id") != F.col("hub.id")).select("id", "component", F.col("hub.id").alias("other")).distinct()
    met = met.join(texts.select("id", F.col("text").alias("mine")), "id").join(texts.select(F.col("id").alias("other"), F.col("text").alias("theirs")), "other")
    ends = [rows.schema["id"], T.StructField("component", rows.schema["id"].dataType)]
    schema = T.StructType([field("hub", LONG), *ends, field("n", LONG), field("size", LONG), field("grams", T.ArrayType(LONG))])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sides = [[x for _, data, offsets in scan.blocks(part.column(c)) for x in jaccard.sets_of(data, offsets, index.width)] for c in (2, 3)]
                apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*sides, strict=True)]
                marks = [int(scan.mix(y).sum(dtype=np.uint64).view(np.int64)) for y in sides[1]]
                ends = np.concatenate([[0], np.cumsum([len(d) for d in apart])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(apart)))
                yield [pa.array(marks), part.column(0), part.column(1), pa.array([len(x) for x in sides[0]]), pa.array(np.diff(ends)), grams]

    return map_batches(met.select("id", "component", "mine", "theirs"), schema, run)


def edit_pairs(spoken: DataFrame, index: Index) -> DataFrame:
    """The pairs of different components that differ from one hub in enough of the same n-grams to be as similar as asked.

    With D what a set and the hub do not share, two sets differ in |D| + |E| - 2 * shared n-grams. A pair that could link without a shared
    one would link with the hub, both of them, and so be connected. Hence a pair must share n-grams of D and E; those are ordered from rare
    to frequent, and the first that a pair shares must leave enough behind it on both sides. Copies of one text with edits of their own
    share little of D and E, so they do not pair up.
    """
    p = index.percent
    spoken = spoken.withColumn("mark", F.xxhash64("grams"))
    plain = ["hub", "id", "mark", "component", "n", "size"]
    each = spoken.select(*plain, F.explode("grams").alias("gram"))
    shared = each.groupBy("hub", "gram").agg(F.count(F.lit(1)).alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    common = each.join(shared.filter("low <> high").select("hub", "gram", "many"), ["hub", "gram"])
    common = common.groupBy(*plain).agg(F.array_sort(F.collect_list(F.struct("many", "gram"))).alias("common"))
    placed = common.select(*plain, F.col("size") - F.size("common"), F.posexplode("common").alias("i", "c"))
    placed = placed.toDF(*plain, "alone", "i", "c").select(*plain, F.col("c.gram").alias("gram"), (F.col("alone") + F.col("i")).alias("at"))
    #: The side that differs less from the hub needs to be met on its first n-grams only.
    gives = placed.filter(2 * p * F.col("at") <= (100 - p) * F.col("n"))
    gives = gives.toDF("hub", "other", "mark2", "theirs", "m", "least", "gram", "by")
    joint = F.least(F.col("size") - F.col("at"), F.col("least") - F.col("by"))
    able = (100 + p) * (F.col("size") + F.col("least") - 2 * joint) <= (100 - p) * (F.col("n") + F.col("m"))
    turn = (F.col("least") < F.col("size")) | ((F.col("least") == F.col("size")) & (F.col("other") < F.col("id")))
    pairs = placed.join(gives, ["hub", "gram"]).filter((F.col("component") != F.col("theirs")) & turn & able)
    return pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index = Index()) -> DataFrame:
    """The id, size of its set, component (the smallest id that links reach) and whether the document stays, for every document.

    Words are runs without white space, A-Z folded; a text with fewer words than an n-gram is one n-gram as a whole. Null, empty
    and blank texts have no n-grams and link with nothing. Of each component the document with the smallest id stays; a null id
    has no component and stays. Rows that repeat an id are one document: the n-grams of each of its texts link. An empty
    table gives an empty result. Other columns are not read. Sets, keys, pairs and links stay in tables in the shared folder; those that
    the result does not read are removed.
    """
    spark, scratch = documents.sparkSession, shared_folder(documents.sparkSession, "hamming")
    profiled = written(profiles(documents, id_col, text_col, index), "profiles")
    filled = profiled.filter("n_shingles > 0 AND id IS NOT NULL")
    sets = filled.groupBy(*_SET).agg(F.min("id").alias("set_id"), F.first("signature").alias("signature"))
    sets = written(sets, "distinct-sets")
    able = sets.filter("signature IS NOT NULL").select(F.col("set_id").alias("id"), F.col("n_shingles").alias("n"), "signature")

    spread = meeting_keys(able, index)
    leads = spread.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("high")).filter("lead.id <> high")
    heads = written(spread.join(leads.drop("high"), "key"), "heads", f"{scratch}/heads")
    some = heads.select("id").distinct()
    texts = documents.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    texts = written(texts.join(some, "id", "left_semi"), "texts", f"{scratch}/texts")
    signed = written(able.join(some, "id", "left_semi"), "signed", f"{scratch}/signed")
    rule = jaccard.Rule(index.width, index.percent)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return written(jaccard.verified(within_distance(pairs, signed, index), texts, rule), name, f"{scratch}/{name}")

    first = confirmed(most_met(heads, index), "first")
    links = first.filter("linked").select("a", "b").distinct()
    rows = written(open_rows(heads, components(links, "first-components"), links), "open", f"{scratch}/open")
    support = written(supports(rows, texts, index), "supports", f"{scratch}/supports")
    rows = written(supported(rows, support, index), "supported", f"{scratch}/supported")
    spoken = written(spokes(rows, texts, index), "spokes", f"{scratch}/spokes")
    pairs = hub_pairs(rows, index).unionByName(edit_pairs(spoken, index)).distinct()
    known = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tried = first.unionByName(confirmed(pairs.join(known, ["a", "b"], "left_anti"), "second"))

    links = tried.filter("linked").select("a", "b").unionByName(_same_id(filled, sets)).distinct()
    of_sets = components(links, "set-components").withColumnRenamed("id", "set_id")
    remove(spark, scratch)
    named = sets.join(of_sets, "set_id", "left").select(*_SET, F.coalesce("component", "set_id").alias("component_id"))
    found = profiled.select("id", *_SET).join(named, _SET, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _same_id(filled: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the sets of ids that come with different texts."""
    whole = F.struct(*_SET)
    several = filled.groupBy("id").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).filter("low <> high").select("id")
    mine = filled.join(several, "id", "left_semi").join(sets.drop("signature"), _SET).select("id", "set_id").distinct()
    return mine.join(mine.groupBy("id").agg(F.min("set_id").alias("b")), "id").select(F.col("set_id").alias("a"), "b").filter("a <> b")
