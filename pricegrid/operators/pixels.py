"""Zonal statistics on a pixel table (zone_id, pixel, date, bands, quality)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrid import values


def scene_class_clear(scl: str, classes: Sequence[int] = values.CLEAR_SCENE_CLASSES) -> Column:
    return F.col(scl).isin(list(classes))


def summary_qa_good(qa: str) -> Column:
    return F.col(qa) <= 1


def low_bits_produced(qc: str) -> Column:
    """Lowest two quality bits 0 or 1: produced."""
    return F.col(qc).bitwiseAND(3) < 2


def quality_mask(df: DataFrame, clear: Column, bands: Sequence[str]) -> DataFrame:
    """Bands of unclear pixels become null; the rows stay for pixel counts."""
    return df.withColumns({b: F.when(clear, F.col(b)) for b in bands})


def vegetation_indices(df: DataFrame, nir: str = "nir", red: str = "red", blue: str = "blue") -> DataFrame:
    n, r, b = F.col(nir), F.col(red), F.col(blue)
    return df.withColumns({
        "NDVI": F.try_divide(n - r, n + r),
        "EVI": F.lit(2.5) * F.try_divide(n - r, n + 6 * r - 7.5 * b + 1)})


def kelvin_to_celsius(c: str) -> Column:
    return F.col(c) - 273.15


def vegetation_scale(c: str) -> Column:
    return F.col(c) * 0.0001


def land_temperature(c: str) -> Column:
    return F.col(c) * 0.02 - 273.15


def pentad_to_daily(c: str) -> Column:
    return F.col(c) / 5


def zonal_reduce(df: DataFrame, band: str, threshold: float, keys: Sequence[str] = ("zone_id", "date")) -> DataFrame:
    """Mean, max, sum, share above a threshold, valid share and valid count per zone and period."""
    valid = F.col(band).isNotNull()
    return df.groupBy(*keys).agg(
        F.avg(band).alias("mean"), F.max(band).alias("max"), F.sum(band).alias("sum"),
        F.avg(F.when(valid, (F.col(band) > threshold).cast("int"))).alias("frac_above"),
        F.avg(valid.cast("int")).alias("valid_px_frac"), F.count(band).alias("n_valid_px"))


def half_month_start(date: str) -> Column:
    """First day of the 1-15 or 16-end window."""
    month = F.trunc(date, "month")
    return F.when(F.dayofmonth(date) <= 15, month).otherwise(F.date_add(month, 15))


def half_month_windows(df: DataFrame, bands: Sequence[str], pixel: str = "pixel", zone: str = "zone_id",
                       date: str = "date") -> DataFrame:
    """Per-pixel median over the scenes of a half month, then the zone's mean; empty composites are dropped.

    A median group holds one pixel's scenes of half a month, at most one per day.
    """
    windowed = df.withColumn("date_start", half_month_start(date))
    composite = windowed.groupBy(zone, pixel, "date_start").agg(*[F.median(b).alias(b) for b in bands])
    out = composite.groupBy(zone, "date_start").agg(
        *[F.avg(b).alias(b) for b in bands], F.avg(F.col(bands[0]).isNotNull().cast("int")).alias("valid_px_frac"),
        F.count(F.lit(1)).alias("n_px"))
    return out.where(F.col(bands[0]).isNotNull())
