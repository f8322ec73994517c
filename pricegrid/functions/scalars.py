"""Scalar rules used by several operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricegrid import values


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_name(col: str | Column) -> Column:
    """Lower case, runs of anything but letters and digits become one blank."""
    return F.trim(F.regexp_replace(F.lower(F.trim(_c(col))), "[^a-z0-9]+", " "))


def parse_number(col: str | Column) -> Column:
    """Text with thousands separators to double; anything unreadable is null."""
    return F.regexp_replace(F.trim(_c(col)), ",", "").try_cast("double")


def parse_date(col: str | Column, formats: Sequence[str]) -> Column:
    """First format that fits wins; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(_c(col), F.lit(f)).cast("date") for f in formats])


def divide(numerator: str | Column, denominator: str | Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(_c(numerator), _c(denominator))


def log_arrivals(col: str | Column) -> Column:
    c = _c(col)
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def mean_of_available(cols: Sequence[str]) -> Column:
    """Mean over the non-null columns of a row."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    count = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return F.try_divide(total, count)


def coverage_band(share: str | Column, bands: Sequence[tuple[str, float]] = values.COVERAGE_BANDS) -> Column:
    c = _c(share)
    expr = F.when(c >= bands[0][1], bands[0][0])
    for label, lower in bands[1:]:
        expr = expr.when(c >= lower, label)
    return expr


def significance_stars(p: str | Column) -> Column:
    c = _c(p)
    return (
        F.when(c.isNull(), "")
        .when(c < 0.001, "***")
        .when(c < 0.01, "**")
        .when(c < 0.05, "*")
        .otherwise("")
    )


def season_flag(crop: str | Column, month: str | Column, season: str,
                seasons: Mapping[str, Mapping[str, Sequence[int]]] = values.SEASON_MONTHS) -> Column:
    hits = [
        (_c(crop) == name) & _c(month).isin(list(table[season]))
        for name, table in seasons.items() if season in table
    ]
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return any_hit.cast("int")


def season_label(crop: str | Column, month: str | Column,
                 seasons: Mapping[str, Mapping[str, Sequence[int]]] = values.SEASON_MONTHS) -> Column:
    expr = None
    for name, table in seasons.items():
        for season, months in table.items():
            condition = (_c(crop) == name) & _c(month).isin(list(months))
            expr = F.when(condition, season) if expr is None else expr.when(condition, season)
    return expr


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * values.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def histogram_bin(value: str | Column, edges: Sequence[float]) -> Column:
    """0-based bin; lower edge included, the last bin also takes its upper edge."""
    c = _c(value)
    expr = F.when(c < edges[0], F.lit(None).cast("int"))
    for i in range(len(edges) - 2):
        expr = expr.when(c < edges[i + 1], F.lit(i))
    return expr.when(c <= edges[-1], F.lit(len(edges) - 2))
