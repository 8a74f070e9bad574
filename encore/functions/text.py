"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .aggregates import SEPARATOR, as_col


def blank_to_null(value: str | Column) -> Column:
    return F.nullif(F.trim(as_col(value)), F.lit(""))


def first_item(value: str | Column) -> Column:
    """First entry of an 'a | b' list."""
    return F.split_part(as_col(value), F.lit(SEPARATOR), F.lit(1))


def whole(value: str | Column) -> Column:
    return as_col(value).try_cast("int")


def real(value: str | Column) -> Column:
    return as_col(value).try_cast("double")
