"""Approximate nearest neighbours over mixed features: hash tables of p-stable projections, exact distances of candidates.

The mixed metric is Euclidean once a level is a column of its own, as long as the root of its weight. A projection on a normal
vector needs no such columns: a level's component is a normal number drawn from the level's code. Points that are near
fall into the same cell of several projections more often than others, so each table keys a point by some of them. Targets also
look into the cells next to theirs that they lie closest to (multi-probe), which saves tables, hence copies of the references.

Each cell keeps the nearest of its references for every target by exact distance, in blocks of bounded size; the best of a target's
cells are merged. Pairs that are not kept never become rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ranking import seeded_hash
from ..session import written
from .neighbours import NEIGHBOURS, Blocks, Encoding, _best, _matrix, _nearest, _squared, encode_points, fit_scaling, knn_join, scaled_points


@dataclass(frozen=True)
class Tables:
    """``tables`` keys of ``functions`` projections each; ``probes`` further cells a target looks into in each table.

    Cells are ``width`` wide (None: as wide as ``asked`` points of a bounded sample of ``sample`` references need to find ``aim`` of their
    neighbours in it). A cell with more than ``crowd`` references is split by ``deeper`` more projections.
    """

    tables: int = 3
    functions: int = 5
    probes: int = 2
    aim: float = 0.98
    width: float | None = None
    sample: int = 2000
    asked: int = 300
    crowd: int = 100_000
    deeper: int = 2
    seed: int = 11


@dataclass(frozen=True)
class Projections:
    """Fitted tables: one normal vector and offset for each projection, drawn from the seed."""

    tables: Tables
    axes: int
    categories: int
    width: float

    @property
    def each(self) -> int:
        return self.tables.functions + self.tables.deeper

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.tables.seed)
        n = self.tables.tables * self.each
        return rng.standard_normal((self.axes, n)), rng.random(n)

    def places(self, v: np.ndarray) -> np.ndarray:
        """Where each point lies on each projection, in cells."""
        vectors, offsets = self.vectors()
        total = v[:, : self.axes] @ vectors
        for c in range(self.categories):
            codes, at = np.unique(v[:, self.axes + c], return_inverse=True)
            total += _normals(codes, c, total.shape[1], self.tables.seed)[at] * np.sqrt(v[:, self.axes + self.categories + c])[:, None]
        return total / self.width + offsets


    def keys(self, v: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of each point: in each table its own, then those it lies closest to; and what splits each of them."""
        m, place = self.tables.functions, self.places(v)
        floor = np.floor(place)
        whole, used, keys, subs = floor.astype(np.int64), _steps(m), [], []
        for table in range(self.tables.tables):
            cols = table * self.each + np.arange(m)
            salt = _mix(cols.astype(np.uint64) + np.uint64(77))[None, :]
            mine = whole[:, cols]
            term = lambda h: _mix(h.view(np.uint64) ^ salt)
            here = term(mine)
            base = here.sum(axis=1, dtype=np.uint64) + np.uint64(table)
            sub = np.zeros(len(v), np.uint64)
            for j in range(table * self.each + m, (table + 1) * self.each):
                sub = _mix(sub + whole[:, j].view(np.uint64) + np.uint64(j + 1))
            keys.append(base)
            if probes:
                down = place[:, cols] - floor[:, cols]
                cost = np.stack([down, 1 - down], axis=2).reshape(len(v), 2 * m) ** 2 @ used.T
                best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                delta = np.stack([term(mine - 1) - here, term(mine + 1) - here], axis=2).reshape(len(v), 2 * m)
                keys += [base + (delta * used.astype(np.uint64)[best[:, r]]).sum(axis=1, dtype=np.uint64) for r in range(best.shape[1])]
            subs += [sub] * (len(keys) - len(subs))
        return _mix(np.stack(keys, axis=1)), np.stack(subs, axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _normals(codes: np.ndarray, category: int, n: int, seed: int) -> np.ndarray:
    """A row of n standard normal numbers for each code, the same in every task (Box-Muller on hashed codes)."""
    start = _mix(codes.astype(np.int64).view(np.uint64) + np.uint64((category + 1) << 40) + np.uint64(seed << 50))
    grid = _mix(start[:, None] + np.arange(2 * n, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    even = ((grid >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.sqrt(-2 * np.log(even[:, :n])) * np.cos(2 * np.pi * even[:, n:])


def fit(
    references: DataFrame, targets: DataFrame, axes: int, categories: int, k: int = NEIGHBOURS, tables: Tables = Tables()
) -> Projections | None:
    """The projections for two groups, None if one is empty. What reaches the driver are two bounded samples, for the width alone.

    Cells widen until sampled targets find ``aim`` of their k nearest among sampled references. Neighbours in the whole group are
    nearer than those in the sample, so they are found more often.
    """
    if tables.width is not None:
        return Projections(tables, axes, categories, tables.width)
    sample = lambda df, n: df.orderBy(seeded_hash("id", tables.seed), "id").limit(n).collect()
    v, asked = (np.array([r["v"] for r in sample(*x)]) for x in ((references, tables.sample), (targets, tables.asked)))
    if not len(v) or not len(asked):
        return None
    d, k = np.sqrt(_squared(asked, v, axes, categories)), min(k, len(v))
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(d <= edge)
    width = float(np.median(edge)) or 1.0
    while True:
        projections = Projections(tables, axes, categories, width)
        held, looked = projections.keys(v, 0)[0], projections.keys(asked, tables.probes)[0]
        found = (looked[row][:, :, None] == held[col][:, None, :]).any(axis=(1, 2))
        if found.mean() >= tables.aim:
            return projections
        width *= 1.1


def _steps(m: int) -> np.ndarray:
    """All moves of one or two of m projections by a cell, one a row; columns: the first down, the first up, the second down, ..."""
    single = [(2 * j + up,) for j in range(m) for up in (0, 1)]
    double = [(*a, *b) for a, b in combinations(single, 2) if a[0] // 2 != b[0] // 2]
    used = np.zeros((len(single) + len(double), 2 * m))
    for i, move in enumerate(single + double):
        used[i, list(move)] = 1
    return used


def cells(points: DataFrame, projections: Projections, probe: bool) -> DataFrame:
    """(id, cell, sub): a key for each table and, for targets, for the nearest cells around; ``sub`` splits a crowded cell."""
    width = projections.axes + 2 * projections.categories
    probes = projections.tables.probes if probe else 0

    def keyed(batches):
        for batch in batches:
            if len(batch):
                keys, subs = projections.keys(_matrix(batch["v"], width), probes)
                rows = {"id": np.repeat(batch["id"].to_numpy(), keys.shape[1]), "cell": keys.reshape(-1).view(np.int64), "sub": subs.reshape(-1).view(np.int64)}
                yield pd.DataFrame(rows)

    return points.select("id", "v").mapInPandas(keyed, "id string, cell long, sub long")


def _keyed(targets: DataFrame, references: DataFrame, projections: Projections) -> tuple[DataFrame, DataFrame]:
    """The keys (key, id) of targets and of references. Crowded cells meet by their parts."""
    held = written(cells(references, projections, False), "lsh-references")
    asked = cells(targets, projections, True)
    crowded = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > projections.tables.crowd).select("cell", F.lit(True).alias("many"))
    key = F.when(F.col("many"), F.xxhash64("cell", "sub")).otherwise(F.col("cell")).alias("key")
    return tuple(side.join(crowded, "cell", "left").select(key, "id") for side in (asked, held))


def candidates(targets: DataFrame, references: DataFrame, projections: Projections) -> DataFrame:
    """(id, vecino): the distinct pairs that meet in a cell."""
    asked, held = _keyed(targets, references, projections)
    return asked.join(held.withColumnRenamed("id", "vecino"), "key").select("id", "vecino").distinct()


def ranked(
    targets: DataFrame, references: DataFrame, projections: Projections, k: int, blocks: Blocks = Blocks()
) -> DataFrame:
    """The k nearest of each target's candidates by exact distance, ties by reference id: (id, vecino, distancia, puesto).

    Pairs never become rows: each cell, or each pair of blocks of a large one, keeps the k best of every target, and the best of
    those are the best of all candidates. Small cells share a task's group.
    """
    asked, held = (written(side, f"lsh-{name}-keys") for side, name in zip(_keyed(targets, references, projections), ("target", "reference"), strict=True))
    counted = lambda side, name: side.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    cuts = written(
        counted(asked, "n").join(counted(held, "m"), "key").select(
            "key",
            F.ceil(F.col("n") / blocks.targets).cast("int").alias("ask_cuts"),
            F.ceil(F.col("m") / blocks.references).cast("int").alias("ref_cuts"),
        ),
        "lsh-cuts",
    )
    groups = 1 + (asked.count() // blocks.targets + held.count() // blocks.references)
    cut = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_cuts = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = (F.col("ask_cuts") == 1) & (F.col("ref_cuts") == 1)
    piece = F.xxhash64("key", "a", "r")
    group = F.when(whole, F.pmod("key", F.lit(groups))).otherwise(piece).alias("group")
    vectors = lambda side, points: side.join(points.select("id", "v"), "id")
    left = vectors(asked, targets).join(cuts, "key").withColumns({"a": cut(F.col("ask_cuts")), "r": all_cuts(F.col("ref_cuts"))})
    right = vectors(held, references).join(cuts, "key").withColumns({"r": cut(F.col("ref_cuts")), "a": all_cuts(F.col("ask_cuts"))})
    left, right = (side.select(group, piece.alias("piece"), "id", "v") for side in (left, right))
    axes, categories = projections.axes, projections.categories

    def search(asks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        near = dict(list(refs.groupby("piece")))
        found = [_nearest(part, near[at], k, axes, categories) for at, part in asks.groupby("piece") if at in near]
        return pd.concat(found) if found else _nearest(asks[:0], refs[:0], k, axes, categories)

    best = left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(search, "id string, vecino string, distancia double")
    return _best(best.distinct(), k)


def lsh_join(
    targets: DataFrame, references: DataFrame, axes: int, categories: int, k: int = NEIGHBOURS, tables: Tables = Tables(), complete: bool = True,
    blocks: Blocks = Blocks(),
) -> DataFrame:
    """Nearly always the k nearest references of every target: (id, vecino, distancia, puesto), ties by reference id.

    Inputs are (id, v) as in :func:`knn_join`, whose distances are the same. Equal target points are looked up once and of equal
    reference points the k lowest ids are kept. Targets whose cells hold fewer than k references are joined exactly (``complete``), so every
    target has k neighbours where the exact join has. No references, no rows.
    """
    same_point = Window.partitionBy("v").orderBy("id")
    kept = references.withColumn("_copy", F.row_number().over(same_point)).filter(F.col("_copy") <= k).drop("_copy")
    kept = written(kept, "lsh-points")
    points = written(targets.groupBy("v").agg(F.min("id").alias("id")), "lsh-targets")
    projections = fit(kept, points, axes, categories, k, tables)
    if projections is None:
        return targets.select("id").limit(0).selectExpr("id", "id AS vecino", "0D AS distancia", "1 AS puesto")
    best = written(ranked(points, kept, projections, k, blocks), "lsh-found")
    if complete:
        full = best.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        short = written(points.join(full, "id", "left_anti").select("id", "v"), "lsh-short")
        if short.limit(1).count():
            best = best.join(full, "id", "left_semi").unionByName(knn_join(short, kept, axes, categories, k))
    users = targets.join(points.withColumnRenamed("id", "point"), "v").select("id", "point")
    return users.join(best.withColumnRenamed("id", "point"), "point").select("id", "vecino", "distancia", "puesto")


def approximate_users(
    target: DataFrame, reference: DataFrame, encoding: Encoding = Encoding(), k: int = NEIGHBOURS, tables: Tables = Tables()
) -> DataFrame:
    """Encode, scale on the reference group and join approximately."""
    scaling = fit_scaling(encode_points(reference, encoding), encoding)
    asked, held = (scaled_points(encode_points(x, encoding), scaling) for x in (target, reference))
    return lsh_join(asked, held, len(encoding.axes), len(encoding.nominals), k, tables)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: targets, exact neighbours, those found (or others equally far), and their share."""
    edge = exact.groupBy("id").agg(F.max("distancia").alias("edge"), F.count(F.lit(1)).alias("k"))
    hits = edge.join(found, "id", "left").groupBy("id", "k").agg(F.sum((F.col("distancia") <= F.col("edge")).cast("long")).alias("hits"))
    counts = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("pares"), F.sum(F.least("k", F.coalesce("hits", F.lit(0)))).alias("aciertos"))
    return counts.withColumn("recall", F.col("aciertos") / F.col("pares"))
