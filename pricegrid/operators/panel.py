"""Weekly panel build: weighted weekly means, gap-free grid, documented gap filling, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import calendar as cal
from pricegrid.functions.sizes import hashed, small_side

PRICE = "modal_price_weighted"
ARRIVALS = "arrivals_tonnes_week"
KEY = ["crop", "market_id"]


def date_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Inclusive on both ends."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_invalid(df: DataFrame, price: str, quantity: str) -> DataFrame:
    return df.where(F.col(price).isNotNull() & (F.col(quantity) > 0))


def clip_filter_by_group(df: DataFrame, group: str, column: str,
                         bounds: Mapping[str, tuple[float, float]] = values.PRICE_CLIP) -> DataFrame:
    """Drop (never clamp) rows outside their group's window; groups without a window are dropped too."""
    keep = F.lit(False)
    for name, (lo, hi) in bounds.items():
        keep = keep | ((F.col(group) == name) & F.col(column).between(lo, hi))
    return df.where(keep)


def weekly_weighted_mean(df: DataFrame, price: str = "modal_price_rs_per_quintal",
                         quantity: str = "total_arrivals_tonnes", date: str = "arrival_date",
                         keys: Sequence[str] = KEY, rows: int | None = None) -> DataFrame:
    """Arrivals-weighted mean price, total arrivals and distinct trading days per key and week.

    Trading days are bits of a weekday mask, so the distinct count needs no second shuffle and a hot
    market shrinks to seven days a week inside each map task. Tables whose grid needs many tasks are first hashed by key,
    which the grid and all windows over the key then share; ``rows`` is that grid's size, where it is known.
    """
    day_bit = F.expr(f"shiftleft(1, weekday({date}))")
    return (
        hashed(df, keys, grid_rows(df, date, keys) if rows is None else rows).withColumn("week_start", cal.week_start(date))
        .groupBy(*keys, "week_start")
        .agg(
            (F.sum(F.col(price) * F.col(quantity)) / F.sum(quantity)).alias(PRICE),
            F.sum(quantity).alias(ARRIVALS),
            F.bit_count(F.bit_or(day_bit)).cast("int").alias("trading_days"),
        )
    )


def grid_rows(df: DataFrame, date: str, keys: Sequence[str] = KEY) -> int:
    """About how many rows the gap-free weekly grid has at most: keys times weeks, from one pass without a shuffle."""
    seen = df.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("keys"), F.datediff(F.max(date), F.min(date)).alias("days")).first()
    return seen["keys"] * ((seen["days"] or 0) // 7 + 1)


def last_weeks(daily: DataFrame, date: str = "arrival_date", group: str = "crop") -> DataFrame:
    """The last week of each group, from the records themselves: a pass of two columns that combines map-side. Few groups
    are broadcast, which leaves the weekly rows in their partitions."""
    return small_side(daily.groupBy(F.col(group).alias("__group")).agg(F.max(cal.week_start(date)).alias("__end")))


def with_last_week(weekly: DataFrame, group: str, out: str = "__end", ends: DataFrame | None = None) -> DataFrame:
    """Adds the last week of each group; groups may be many or hold most rows. ``ends`` are those weeks, where they are
    known; otherwise adaptive execution picks the join."""
    if ends is None:
        ends = weekly.groupBy(F.col(group).alias("__group")).agg(F.max("week_start").alias("__end"))
    ends = ends.withColumnRenamed("__end", out)
    return weekly.join(ends, weekly[group].eqNullSafe(F.col("__group")), "left").drop("__group")


def complete_grid(weekly: DataFrame, keys: Sequence[str] = KEY, group: str = "crop",
                  grid_start: str | None = None, grid_end: str | None = None, ends: DataFrame | None = None) -> DataFrame:
    """One row per key and week from the key's own first week to its group's last one (``ends``: the ``last_weeks`` of all
    records, for a grid that is not cut at ``grid_end``).

    Each observation is expanded up to the week before the next one, so there is no cross join and no
    join back. Expanded rows keep what gap filling needs: ``gap_position`` (0 on observed rows),
    ``gap_length``, ``prev_price`` and ``next_price``.
    """
    if grid_start is not None:
        weekly = weekly.where(F.col("week_start") >= cal.first_monday_on_or_after(F.lit(grid_start).cast("date")))
    if grid_end is not None:
        weekly = weekly.where(F.col("week_start") <= F.lit(grid_end).cast("date"))
    by_week = Window.partitionBy(*keys).orderBy("week_start")
    other = [c for c in weekly.columns if c not in {*keys, "week_start", PRICE}]
    spans = (
        with_last_week(weekly, group, ends=ends if grid_end is None else None).withColumn("__next", F.lead("week_start").over(by_week))
        .withColumn("next_price", F.lead(PRICE).over(by_week))
        .withColumn("__last", F.coalesce(F.date_sub("__next", 7), "__end"))
    )
    slots = spans.select(
        *keys, "next_price", F.col(PRICE).alias("prev_price"), *other,
        (F.datediff("__last", "week_start") / 7).cast("int").alias("__gap"),
        F.posexplode(cal.week_sequence("week_start", "__last")).alias("gap_position", "week_start"),
    )
    observed = F.col("gap_position") == 0
    return slots.select(
        *keys, "week_start",
        F.when(observed, F.col("prev_price")).alias(PRICE),
        *[F.when(observed, F.col(c)).alias(c) for c in other],
        (~observed).cast("int").alias("imputed"),
        "gap_position",
        F.when(observed, F.lit(0)).otherwise(F.col("__gap")).alias("gap_length"),
        "prev_price", "next_price",
    )


def linear_fill_limited(grid: DataFrame, limit: int = 2, strict_gap: bool = False) -> DataFrame:
    """Fill the first ``limit`` rows of each interior gap on the line between its neighbours.

    ``strict_gap`` fills only gaps that are no longer than ``limit`` (the documented rule).
    """
    inside = F.col("next_price").isNotNull() & F.col("gap_position").between(1, limit)
    if strict_gap:
        inside = inside & (F.col("gap_length") <= limit)
    step = (F.col("next_price") - F.col("prev_price")) / (F.col("gap_length") + 1)
    method = F.when(F.col("imputed") == 0, "observed").when(inside, "linear")
    return grid.withColumn("imputed_method", method).withColumn(
        PRICE, F.when(inside, F.col("prev_price") + step * F.col("gap_position")).otherwise(F.col(PRICE)))


def seasonal_median_fill(grid: DataFrame, keys: Sequence[str] = KEY, shortest: int = 3, longest: int = 8) -> DataFrame:
    """Rows still empty in a gap of 3..8 weeks take the market's observed median of that calendar month.

    The window partition refines the grid's partitioning, so it sorts but does not shuffle.
    """
    same_month = Window.partitionBy(*keys, F.month("week_start"))
    seasonal = F.median(F.when(F.col("imputed") == 0, F.col(PRICE))).over(same_month)
    use = F.col(PRICE).isNull() & F.col("gap_length").between(shortest, longest)
    return (
        grid.withColumn("__seasonal", seasonal)
        .withColumn("imputed_method", F.when(use & F.col("__seasonal").isNotNull(), "seasonal_median")
                    .otherwise(F.col("imputed_method")))
        .withColumn(PRICE, F.when(use, F.col("__seasonal")).otherwise(F.col(PRICE)))
        .drop("__seasonal")
    )


def coverage_filter(panel: DataFrame, threshold: float = values.MIN_REAL_COVERAGE,
                    keys: Sequence[str] = KEY) -> DataFrame:
    """Keep keys whose observed share over their own grid reaches the threshold; adds ``coverage``."""
    share = F.lit(1.0) - F.avg("imputed").over(Window.partitionBy(*keys))
    return panel.withColumn("coverage", share).where(F.col("coverage") >= threshold)


def balanced_panel_filter(weekly: DataFrame, min_years: int = values.MIN_BALANCED_YEARS,
                          keys: Sequence[str] = KEY) -> DataFrame:
    """Keep keys seen in at least ``min_years`` ISO years."""
    years = (
        weekly.groupBy(*keys)
        .agg(F.size(F.collect_set(cal.iso_year("week_start"))).alias("__years"))
        .where(F.col("__years") >= min_years)
    )
    return weekly.join(years, list(keys), "left_semi")


def build_panel(daily: DataFrame, bounds: Mapping[str, tuple[float, float]] = values.PRICE_CLIP,
                price: str = "modal_price_rs_per_quintal", quantity: str = "total_arrivals_tonnes",
                start: str | None = None, end: str | None = None,
                balanced_crops: Sequence[str] = (), min_years: int = values.MIN_BALANCED_YEARS,
                strict_gap: bool = False) -> DataFrame:
    """Daily records to the complete filled grid, before the coverage filter.

    ``balanced_crops`` go through the years filter first (potato in the published build).
    """
    rows = clip_filter_by_group(drop_invalid(daily, price, quantity), "crop", price, bounds)
    if start or end:
        rows = date_window(rows, "arrival_date", start or "0001-01-01", end or "9999-12-31")
    weekly = weekly_weighted_mean(rows, price, quantity)
    ends = None if balanced_crops else last_weeks(rows)
    if balanced_crops:
        in_scope = F.col("crop").isin(list(balanced_crops))
        weekly = weekly.where(~in_scope).unionByName(balanced_panel_filter(weekly.where(in_scope), min_years))
    grid = linear_fill_limited(complete_grid(weekly, grid_start=start, ends=ends), strict_gap=strict_gap)
    panel = seasonal_median_fill(grid)
    return (
        panel.withColumn("iso_year", cal.iso_year("week_start"))
        .withColumn("iso_week", cal.iso_week("week_start"))
    )
