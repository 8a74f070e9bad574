"""Bucket expressions built from (low, high, label) bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .aggregates import as_col

Band = tuple[float | None, float | None, str]

# Bucket edges and labels.
LEAD_TIME: tuple[Band, ...] = (
    (0, 6, "0-6 dias"),
    (7, 29, "7-29 dias"),
    (30, 59, "30-59 dias"),
    (60, 89, "60-89 dias"),
    (90, None, "90+ dias"),
)
TRIP_LENGTH: tuple[Band, ...] = (
    (0, 0, "Mismo dia"),
    (1, 3, "1-3 dias"),
    (4, 7, "4-7 dias"),
    (8, 14, "8-14 dias"),
    (15, None, "15+ dias"),
)
AGE: tuple[Band, ...] = (
    (0, 17, "<18"),
    (18, 24, "18-24"),
    (25, 34, "25-34"),
    (35, 44, "35-44"),
    (45, 54, "45-54"),
    (55, 64, "55-64"),
    (65, 110, "65+"),
)
REPEAT_SPEED: tuple[Band, ...] = (
    (None, 7, "0-7d"),
    (None, 30, "8-30d"),
    (None, 90, "31-90d"),
    (None, 180, "91-180d"),
    (None, 365, "181-365d"),
    (None, None, ">365d"),
)
ACCOUNT_AGE: tuple[Band, ...] = (
    (0, 0, "0 (mismo día)"),
    (None, 30, "1-30 días"),
    (None, 180, "31-180 días"),
    (None, 365, "181-365 días"),
    (None, 1095, "1-3 años"),
    (None, None, "3+ años"),
)
APP_VISITS: tuple[Band, ...] = (
    (0, 0, "0"),
    (1, 1, "1"),
    (None, 3, "2-3"),
    (None, 7, "4-7"),
    (None, 15, "8-15"),
    (None, None, "16+"),
)
# Upper edges of this one are exclusive.
BOOKINGS: tuple[tuple[float | None, str], ...] = (
    (100, "<100"),
    (250, "100-250"),
    (500, "250-500"),
    (1000, "500-1000"),
    (2500, "1000-2500"),
    (None, "2500+"),
)
INVALID = "Invalido"
INVALID_AGE = "Edad invalida"
NO_DATA = "Sin dato"


def band(value: str | Column, bands: Sequence[Band]) -> Column:
    """Label of the first band that holds the value (both edges inclusive); null if none does."""
    value = as_col(value)
    chain = None
    for low, high, label in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def band_below(value: str | Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first band whose exclusive upper edge is above the value."""
    value = as_col(value)
    chain = None
    for high, label in bands:
        inside = F.lit(True) if high is None else value < high
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def lead_time_bucket(days: str | Column) -> Column:
    return F.when(as_col(days) < 0, INVALID).otherwise(band(days, LEAD_TIME))


def trip_length_bucket(days: str | Column) -> Column:
    return F.when(as_col(days) < 0, INVALID).otherwise(band(days, TRIP_LENGTH))


def age_bucket(age: str | Column) -> Column:
    age = as_col(age)
    return F.when(age.isNull(), NO_DATA).otherwise(F.coalesce(band(age, AGE), F.lit(INVALID_AGE)))


def speed_bucket(days: str | Column) -> Column:
    return band(days, REPEAT_SPEED)


def trip_count_bucket(count: str | Column, labels: Sequence[str] = ("1", "2", "3+")) -> Column:
    count = as_col(count)
    return F.when(count == 1, labels[0]).when(count == 2, labels[1]).otherwise(labels[2])
