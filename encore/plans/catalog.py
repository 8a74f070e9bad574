"""The registered results: name -> callable, inventory id and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..oracle import models_sql as sample
from ..sources.retail import RetailSources
from .stages import Modelling, Stages, TableStore


@dataclass(frozen=True)
class Result:
    name: str
    item: str
    build: Callable[[Stages], DataFrame]
    sql: str | None


#: Settings of the registered results, which run over small sample data.
MODELLING = Modelling(
    rare=sample.RARE, cutoff=sample.CUTOFF, coefficients=sample.COEFFICIENTS, intercept=sample.INTERCEPT,
    trees={"max_depth": 6, "max_iter": 20}, repeats=5,
)

CATALOG: dict[str, Result] = {}
_OPEN: dict[tuple[str, str], Stages] = {}


def stages_for(spark: SparkSession, folder: str) -> Stages:
    """One set of shared tables per application and data folder."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Stages(RetailSources(spark, folder), TableStore(spark), modelling=MODELLING)
    return _OPEN[key]


def forget(spark: SparkSession) -> None:
    """Start the shared tables over; what was written is deleted."""
    for key in [k for k in _OPEN if k[0] == spark.sparkContext.applicationId]:
        _OPEN.pop(key).store.remove()


def result(name: str, item: str, sql: str | None = None):
    def register(build: Callable[[Stages], DataFrame]):
        CATALOG[name] = Result(name, item, build, sql)
        return build

    return register


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Fractional columns rounded, so that summation order does not show in comparisons; no negative zeros."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in fractional}) if fractional else df


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(entry: Result) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: tidy(entry.build(stages_for(spark, folder)))

    return {name: run(entry) for name, entry in CATALOG.items()}
