"""Aggregate expressions whose result does not depend on row order.

All of them combine on the map side, so a key that holds a large share of the rows costs one small
buffer per task and never a whole group in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = " | "


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _packed(value: Column, order: tuple[str | Column, ...]) -> Column:
    keys = [as_col(key).alias(f"k{i}") for i, key in enumerate(order)]
    return F.struct(*keys, value.alias("v"))


def first_by(value: str | Column, *order: str | Column) -> Column:
    """Value of the row that comes first in ``order``, nulls skipped; equal keys fall back to the least value."""
    value = as_col(value)
    return F.min(F.when(value.isNotNull(), _packed(value, order))).getField("v")


def last_by(value: str | Column, *order: str | Column) -> Column:
    """Value of the row that comes last in ``order``, nulls skipped; equal keys fall back to the greatest value."""
    value = as_col(value)
    return F.max(F.when(value.isNotNull(), _packed(value, order))).getField("v")


def latest(value: str | Column, when: str | Column) -> Column:
    """Value on the newest row, null included; rows without a time are ignored."""
    return F.max(F.when(as_col(when).isNotNull(), _packed(as_col(value), (when,)))).getField("v")


def text_list(value: str | Column, where: Column | None = None) -> Column:
    """Sorted distinct values joined with ' | '; null, not '', when there is none."""
    value = as_col(value)
    keep = value.isNotNull() if where is None else where & value.isNotNull()
    joined = F.array_join(F.array_sort(F.collect_set(F.when(keep, value))), SEPARATOR)
    return F.nullif(joined, F.lit(""))


def set_size(value: str | Column) -> Column:
    """Number of distinct values, for groups with few of them: unlike a distinct count it copies no row."""
    return F.size(F.collect_set(as_col(value))).cast("long")


def flag(condition: Column) -> Column:
    """1 if the condition holds on any row, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def rate(condition: Column) -> Column:
    return count_if(condition).cast("double") / F.count(F.lit(1))
