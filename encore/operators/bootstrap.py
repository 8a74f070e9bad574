"""Many logistic fits over draws of the same rows, all in one solver.

Every row is written once with the draws it belongs to. A Newton step reads the rows once for all draws: each task adds up, for each
draw, the slope and curvature of the penalised loss at the draw's coefficients; the sums of a draw meet in one small group, which
solves for the step. The number of scans depends on how fast the slowest draw converges, not on how many draws there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.aggregates import as_col
from ..functions.ranking import HASH_DIGITS
from ..session import written

#: Numbers that the curvatures of the draws of one pass may take in a task; more draws go in several passes.
CURVATURE_CELLS = 4_000_000
_SUMS = "muestra int, lote int, suma binary"


def _hash(seed: F.Column, key: F.Column) -> F.Column:
    """The hash that ``seeded_sample`` orders rows by."""
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))


def draw_ends(rows: DataFrame, n: int, size: int, first_seed: int, key: str = "social_id") -> list[tuple[str, str]] | None:
    """For each of ``n`` seeded samples without replacement, hash and key of its last row; None if every row is in.

    Two scans: rows are counted by sample and hash prefix, then only those on the prefix where a sample ends are ordered.
    """
    if rows.count() <= size:
        return None
    seeds = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    each = rows.select(as_col(key).cast("string").alias("key"), seeds.alias("muestra"))
    each = each.withColumn("hash", _hash(F.col("muestra") + first_seed, F.col("key"))).withColumn("prefix", F.substring("hash", 1, HASH_DIGITS))
    before = Window.partitionBy("muestra").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("muestra", "prefix").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.col("before") < size) & (F.col("before") + F.col("n") >= size))
    #: One row per sample.
    edge = each.join(F.broadcast(counts.select("muestra", "prefix", "before")), ["muestra", "prefix"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("muestra").orderBy("hash", "key"))
    ends = edge.withColumn("place", place).filter(F.col("place") == size).select("muestra", "hash", "key").collect()
    return [(r["hash"], r["key"]) for r in sorted(ends)]


def drawn_rows(
    matrix: DataFrame, n: int, size: int | None, replacement: bool = False, first_seed: int = 1000, key: str = "social_id"
) -> DataFrame:
    """(x, label, draws): the rows with, for each draw, how often they are in it. Without replacement: the rows of ``bootstrap_samples``.

    With replacement the counts are Poisson numbers of mean size / rows, drawn from the row's hash. ``size`` None stands for all rows.
    """
    plain = matrix.select(as_col(key).cast("string").alias("key"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    if replacement:
        mean = 1.0 if size is None else min(1.0, size / max(matrix.count(), 1))
        steps, total, term = [], 0.0, float(np.exp(-mean))
        for k in range(1, 16):
            total += term
            steps.append(total)
            term *= mean / k

        def even(i: F.Column) -> F.Column:
            return F.conv(F.substring(_hash(i + first_seed, F.col("key")), 1, 13), 16, 10).cast("double") / float(1 << 52)

        def times(share: F.Column) -> F.Column:
            return sum((F.when(share >= s, 1).otherwise(0) for s in steps), F.lit(0))

        # Two passes over the array, so that the steps share one hash.
        draws = F.transform(F.transform(every, even), times)
    elif size is None:
        draws = F.array_repeat(F.lit(1), n)
    else:
        ends = draw_ends(matrix, n, size, first_seed, key)
        if ends is None:
            draws = F.array_repeat(F.lit(1), n)
        else:
            last = F.array(*[F.struct(F.lit(h).alias("hash"), F.lit(k).alias("key")) for h, k in ends])

            def inside(i: F.Column) -> F.Column:
                own = F.struct(_hash(i + first_seed, F.col("key")).alias("hash"), F.col("key"))
                return F.when(own <= F.element_at(last, i + 1), 1).otherwise(0)

            draws = F.transform(every, inside)
    return plain.select("x", "label", F.transform(draws, lambda t: t.cast("tinyint")).alias("draws"))


def _cells(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, n))


def _step(rows: DataFrame, betas: np.ndarray, active: list[int], c: float) -> dict[int, tuple[np.ndarray, float]]:
    """New coefficients (the intercept last) of the active draws, and the largest change."""
    width = betas.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((betas[active], np.array(active)))

    def add_up(batches):
        beta, mine = shared.value
        slope, curve = np.zeros((len(mine), width)), np.zeros((len(mine), width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([_cells(batch.column(0), width - 1), np.ones(batch.num_rows)])
            y, draws = batch.column(1).to_numpy(), _cells(batch.column(2), 1)[:, mine].astype(float)
            p = 1 / (1 + np.exp(-np.clip(x @ beta.T, -500, 500)))
            slope += ((p - y[:, None]) * draws).T @ x
            weight = p * (1 - p) * draws
            for r in range(len(mine)):
                at = np.flatnonzero(draws[:, r])
                curve[r] += (x[at] * weight[at, r, None]).T @ x[at]
        packed = [np.concatenate([slope[r], curve[r].ravel()]).tobytes() for r in range(len(mine))]
        lot = int(np.random.default_rng().integers(0, 32))
        yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array([lot] * len(mine), pa.int32()), pa.array(packed, pa.binary())], ["muestra", "lote", "suma"])

    def total(table: pa.Table) -> np.ndarray:
        return np.sum([np.frombuffer(b.as_buffer(), np.float64) for chunk in table.column("suma").chunks for b in chunk], axis=0)

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"muestra": table.column("muestra")[:1], "lote": table.column("lote")[:1], "suma": pa.array([total(table).tobytes()], pa.binary())})

    def solve(table: pa.Table) -> pa.Table:
        beta, mine = shared.value
        now = beta[list(mine).index(table.column("muestra")[0].as_py())]
        sums, penalty = total(table), np.append(np.full(width - 1, 1.0 / c), 0.0)
        move = np.linalg.lstsq(sums[width:].reshape(width, width) + np.diag(penalty), sums[:width] + penalty * now, rcond=None)[0]
        largest = float(np.abs(move).max())
        move *= min(1.0, 4.0 / largest) if largest else 1.0
        return pa.table({"muestra": table.column("muestra")[:1], "beta": pa.array([(now - move).tolist()], pa.list_(pa.float64())), "cambio": pa.array([largest])})

    sums = rows.mapInArrow(add_up, _SUMS).groupBy("muestra", "lote").applyInArrow(merge, _SUMS)
    solved = sums.groupBy("muestra").applyInArrow(solve, "muestra int, beta array<double>, cambio double")
    out = {r["muestra"]: (np.array(r["beta"]), r["cambio"]) for r in solved.collect()}
    shared.destroy()
    return out


def fit_draws(rows: DataFrame, n: int, width: int, c: float = 1.0, max_iter: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Coefficients of an L2 logistic regression, the intercept last and free, for each of ``n`` draws of (x, label, draws).

    What reaches the driver is a row of coefficients per draw and step.
    """
    betas = np.zeros((n, width + 1))
    at_once = max(1, CURVATURE_CELLS // (width + 1) ** 2)
    for first in range(0, n, at_once):
        active = list(range(first, min(n, first + at_once)))
        for _ in range(max_iter):
            found = _step(rows, betas, active, c)
            for i, (beta, _) in found.items():
                betas[i] = beta
            active = [i for i in active if i in found and found[i][1] > tol]
            if not active:
                break
    return betas


def bootstrap_fits(
    matrix: DataFrame, names: tuple[str, ...], n: int, size: int | None, replacement: bool = False, first_seed: int = 1000, c: float = 1.0
) -> DataFrame:
    """(muestra, feature, beta) of ``n`` fits over draws of ``size`` rows (None: as many as there are) of (social_id, features, label)."""
    rows = written(drawn_rows(matrix, n, size, replacement, first_seed), "bootstrap-draws")
    betas = fit_draws(rows, n, len(names), c)
    flat = [(i, name, float(beta)) for i in range(n) for name, beta in zip(names, betas[i], strict=False)]
    return matrix.sparkSession.createDataFrame(flat, "muestra int, feature string, beta double")
