"""Window features on a complete weekly grid, where k rows are k weeks.

Every window partitions by an entity on an already reduced weekly table, so a partition never holds
more rows than the calendar has weeks. Features over the same key share one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import calendar as cal
from pricegrid.functions import ordered
from pricegrid.functions.sizes import hashed
from pricegrid.operators import panel

KEY = ["crop", "market_id"]
WEEK = "week_start"


def by(keys: Sequence[str] = KEY, order: str = WEEK) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lags(df: DataFrame, column: str, prefix: str, steps: Sequence[int] = values.PRICE_LAGS,
         keys: Sequence[str] = KEY, order: str = WEEK) -> DataFrame:
    w = by(keys, order)
    return df.withColumns({f"{prefix}{k}": F.lag(column, k).over(w) for k in steps})


def _rolled(frame: WindowSpec, column: str, how: str, min_values: int) -> Column:
    enough = F.count(column).over(frame) >= min_values
    agg = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[how](column).over(frame)
    return F.when(enough, agg)


def trailing(df: DataFrame, column: str, how: str, windows: Sequence[int], prefix: str,
             keys: Sequence[str] = KEY, order: str = WEEK, min_values: int = 2) -> DataFrame:
    """Statistic over the w rows before the current one; null with fewer than ``min_values`` values."""
    w = by(keys, order)
    return df.withColumns(
        {f"{prefix}{n}": _rolled(w.rowsBetween(-n, -1), column, how, min_values) for n in windows})


def trailing_stats(df: DataFrame, column: str = "log_price", prefix: str = "price",
                   windows: Sequence[int] = values.PRICE_WINDOWS, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean and sample deviation of the rows before the current one."""
    out = trailing(df, column, "mean", windows, f"{prefix}_roll_mean_", keys)
    return trailing(out, column, "std", windows, f"{prefix}_roll_std_", keys)


def trailing_mean_inclusive(df: DataFrame, column: str, out: str, rows: int = 4, keys: Sequence[str] = ("crop",),
                            order: str = WEEK, min_values: int = 2) -> DataFrame:
    """Mean over the last rows including the current one."""
    frame = by(keys, order).rowsBetween(1 - rows, 0)
    return df.withColumn(out, _rolled(frame, column, "mean", min_values))


def lead_target(df: DataFrame, column: str = "log_price", horizons: Sequence[int] = values.HORIZONS,
                prefix: str = "target_", keys: Sequence[str] = KEY) -> DataFrame:
    w = by(keys)
    return df.withColumns({f"{prefix}{h}": F.lead(column, h).over(w) for h in horizons})


def arrival_lags(df: DataFrame, column: str = "log_arr", keys: Sequence[str] = KEY) -> DataFrame:
    out = lags(df, column, "arr_lag_", values.ARRIVAL_LAGS, keys)
    return trailing(out, column, "mean", values.ARRIVAL_WINDOWS, "arr_roll_mean_", keys)


def year_over_year(df: DataFrame, column: str = "log_price", keys: Sequence[str] = KEY) -> DataFrame:
    """Value 52 rows back, and value and % change against the previous row of the same ISO week number."""
    same_week = Window.partitionBy(*keys, cal.iso_week(WEEK)).orderBy(WEEK)
    return df.withColumns({
        "price_yoy": F.lag(column, 52).over(by(keys)),
        "same_week_last_year": F.lag(column, 1).over(same_week),
    }).withColumn("yoy_pct", F.try_divide(F.col(column) - F.col("same_week_last_year"), F.col("same_week_last_year")) * 100)


def trailing_layer_rolls(layer: DataFrame, sums: Mapping[str, Sequence[int]], means: Mapping[str, Sequence[int]],
                         keys: Sequence[str] = ("crop",)) -> DataFrame:
    """Rolling sums (heat, rain) and means (vegetation, land temperature) of a crop-week layer."""
    for column, windows in sums.items():
        layer = trailing(layer, column, "sum", windows, f"{column}_sum_", keys)
    for column, windows in means.items():
        layer = trailing(layer, column, "mean", windows, f"{column}_mean_", keys)
    return layer


def entity_week_grid(df: DataFrame, keys: Sequence[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Every entity on every week of the common calendar, as an expansion per entity."""
    bounds = df.agg(F.struct(F.min(WEEK).alias("a"), F.max(WEEK).alias("b")).alias("s")).scalar()
    first = bounds.getField("a") if start is None else start
    last = bounds.getField("b") if end is None else end
    return df.select(*keys).distinct().select(*keys, F.explode(cal.week_sequence(first, last)).alias(WEEK))


def grid_ffill_limited(df: DataFrame, columns: Sequence[str], limit: int, keys: Sequence[str],
                       start: Column | None = None) -> DataFrame:
    """Reindex to the week grid and carry each value at most ``limit`` rows.

    A union with an empty skeleton replaces the join: one shuffle puts both on the entity.
    """
    grid = entity_week_grid(df, keys, start)
    rows = df.select(*keys, WEEK, *columns).unionByName(grid, allowMissingColumns=True)
    full = hashed(rows, keys, panel.grid_rows(df, WEEK, keys)).groupBy(*keys, WEEK).agg(*[F.max(c).alias(c) for c in columns])
    if start is not None:
        full = full.where(F.col(WEEK) >= start)
    carry = by(keys).rowsBetween(-limit, 0)
    return full.withColumns({c: F.last(c, ignorenulls=True).over(carry) for c in columns})


def walk_forward_climatology(df: DataFrame, column: str, keys: Sequence[str], week: str = WEEK) -> DataFrame:
    """Mean of strictly earlier ISO years at the same ISO week, and the anomaly against it."""
    parts = df.withColumns({"__y": cal.iso_year(week), "__w": cal.iso_week(week)})
    earlier = Window.partitionBy(*keys, "__w").orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)
    yearly = (
        parts.groupBy(*keys, "__w", "__y").agg(F.avg(column).alias("__v"))
        .select(*keys, "__w", "__y", F.avg("__v").over(earlier).alias(f"{column}_norm"))
    )
    return (
        parts.join(yearly, [*keys, "__w", "__y"], "left")
        .withColumn(f"{column}_anom", F.col(column) - F.col(f"{column}_norm"))
        .drop("__w", "__y")
    )


def dimension_ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str = WEEK) -> DataFrame:
    """Carry forward without limit, on the (state, week) table so that ties cannot occur."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def best_per_key(df: DataFrame, keys: Sequence[str], quality: str, date: str) -> DataFrame:
    """Highest quality per key, earliest date on ties; an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(quality), -F.unix_date(F.col(date).cast("date"))))
    return df.where(F.col(quality).isNotNull()).groupBy(*keys).agg(best.alias("__b")).select(
        *keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def tail_n_per_key(df: DataFrame, n: int, keys: Sequence[str] = KEY, order: str = WEEK) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def freshness_flags(panel: DataFrame, price: str = "modal_price_weighted", keys: Sequence[str] = KEY,
                    recent: int = 52, stale_weeks: int = values.STALE_REFERENCE_WEEKS) -> DataFrame:
    """Latest row per market with how far it rests on real trade."""
    observed = F.col("imputed") == 0
    w = by(keys)
    from_end = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(WEEK).desc()))
    rows = panel.withColumns({"__lag1": F.lag(price).over(w), "__end": from_end})
    flags = rows.groupBy(*keys).agg(
        F.max(WEEK).alias(WEEK),
        F.max_by(price, WEEK).alias(price),
        F.max_by("imputed", WEEK).alias("imputed"),
        F.max_by("__lag1", WEEK).isNotNull().alias("sufficient_history"),
        F.max_by(F.when(observed, F.col(price)), F.when(observed, F.col(WEEK))).alias("last_observed_price"),
        F.max(F.when(observed, F.col(WEEK))).alias("last_observed_date"),
        (F.avg(F.when(F.col("__end") <= recent, F.col("imputed"))) * 100).alias("pct_imputed_last_52w"),
    )
    gap = F.datediff(WEEK, "last_observed_date")
    return flags.withColumn("stale_reference", F.col("last_observed_date").isNull() | (gap >= stale_weeks * 7))


def column_staleness(df: DataFrame, columns: Sequence[str], group: str = "crop") -> DataFrame:
    """Per group and column: last week with a value and how many weeks it lags the group's end."""
    ends = df.groupBy(group).agg(
        F.max(WEEK).alias("__end"), *[F.max(F.when(F.col(c).isNotNull(), F.col(WEEK))).alias(c) for c in columns])
    long = ends.unpivot([group, "__end"], list(columns), "feature", "as_of")
    return long.where(F.col("as_of") < F.col("__end")).select(
        group, "feature", "as_of", cal.weeks_between("__end", "as_of").alias("weeks_stale"))


def pct_change_k(df: DataFrame, column: str, steps: Sequence[int], prefix: str, keys: Sequence[str] = ("crop",),
                 order: str | Sequence[str] = WEEK) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
    return df.withColumns({
        f"{prefix}{k}": F.try_divide(F.col(column), F.lag(column, k).over(w)) - 1 for k in steps})


def benchmark_predictors(df: DataFrame, column: str = "log_price", keys: Sequence[str] = KEY) -> DataFrame:
    """Last week's value, last year's value, mean of the last four weeks, all before the current row."""
    out = df.withColumns({"naive": F.lag(column, 1).over(by(keys)), "seasonal_naive": F.lag(column, 52).over(by(keys))})
    return trailing(out, column, "mean", [4], "moving_average_", keys)


def first_difference(df: DataFrame, column: str, out: str, keys: Sequence[str] = KEY) -> DataFrame:
    return df.withColumn(out, F.col(column) - F.lag(column, 1).over(by(keys)))


def relative_to_group_mean(df: DataFrame, column: str, keys: Sequence[str], out: str) -> DataFrame:
    """Row value over its group's mean. The mean is aggregated map-side and joined back, so a hot group
    is split by the adaptive skew join instead of landing in one window task."""
    means = df.groupBy(*keys).agg(F.avg(column).alias("__mean"))
    return df.join(means, list(keys)).withColumn(out, F.try_divide(F.col(column), F.col("__mean"))).drop("__mean")


def interpolate_limited(df: DataFrame, column: str, limit: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Linear fill of the first ``limit`` rows of interior gaps on an existing grid."""
    back = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by(keys).rowsBetween(0, Window.unboundedFollowing)
    week_if = F.when(F.col(column).isNotNull(), F.col(WEEK))
    out = df.withColumns({
        "__pv": F.last(column, ignorenulls=True).over(back), "__pw": F.last(week_if, ignorenulls=True).over(back),
        "__nv": F.first(column, ignorenulls=True).over(ahead), "__nw": F.first(week_if, ignorenulls=True).over(ahead)})
    passed, span = F.datediff(WEEK, "__pw"), F.datediff("__nw", "__pw")
    line = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * passed / span
    filled = F.when(F.col(column).isNotNull(), F.col(column)).when(
        F.col("__nv").isNotNull() & (passed <= 7 * limit), line)
    return out.withColumn(column, filled).drop("__pv", "__pw", "__nv", "__nw")


def complete_series(df: DataFrame, column: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Keep the series that have no null left."""
    nulls = F.count_if(F.col(column).isNull()).over(Window.partitionBy(*keys))
    return df.withColumn("__nulls", nulls).where(F.col("__nulls") == 0).drop("__nulls")


def fill_both_ways(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    back = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by(keys).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in columns})


def rank_within(df: DataFrame, keys: Sequence[str], score: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """Average rank on ties."""
    return ordered.average_rank(df, keys, score, out, descending)


def season_runs(days: DataFrame, keys: Sequence[str], date: str, season: str) -> DataFrame:
    """Runs of consecutive days with the same season as [start, end]."""
    w = Window.partitionBy(*keys).orderBy(date)
    new_run = ~F.col(season).eqNullSafe(F.lag(season).over(w)) | (F.datediff(date, F.lag(date).over(w)) > 1)
    marked = days.withColumn("__new", F.coalesce(new_run, F.lit(True)).cast("int"))
    runs = marked.withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run", season).agg(
        F.min(date).alias("start"), F.max(date).alias("end")).where(F.col(season).isNotNull()).drop("__run")


def lookback_sequence(df: DataFrame, features: Sequence[str], target: str, horizon: int, length: int = 26,
                      keys: Sequence[str] = KEY) -> DataFrame:
    """The last ``length`` weeks of features as an array, zero-padded in front, with the target ahead."""
    row = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    seen = F.collect_list(row).over(by(keys).rowsBetween(1 - length, 0))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(features)), F.lit(length) - F.size("__seen"))
    return (
        df.withColumn("__seen", seen)
        .withColumn("target", F.lead(target, horizon).over(by(keys)))
        .where(F.col("target").isNotNull())
        .withColumn("sequence", F.concat(pad, F.col("__seen")))
        .select(*keys, WEEK, "sequence", "target")
    )


def time_index(df: DataFrame, week: str = WEEK, out: str = "time_idx") -> DataFrame:
    """0-based place of the week among all distinct weeks, which are one calendar and numbered in one task."""
    weeks = df.where(F.col(week).isNotNull()).select(week).distinct()
    return df.join(weeks.withColumn(out, F.row_number().over(Window.orderBy(week)) - 1), week, "left")


def daily_curve(points: DataFrame, knots: Sequence[int], columns: Sequence[str], start: str, band: str,
                keys: Sequence[str] = KEY) -> DataFrame:
    """Monotone cubic through log prices at the knots (days ahead), one row per day, with a band.

    Slopes are the weighted harmonic means of Fritsch and Carlson, with the usual three-point ends.
    """
    h = [float(b - a) for a, b in zip(knots, knots[1:])]
    n = len(knots)
    d = [(F.col(columns[i + 1]) - F.col(columns[i])) / h[i] for i in range(n - 1)]

    def end_slope(h0: float, h1: float, d0: Column, d1: Column) -> Column:
        raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return (
            F.when(F.signum(raw) != F.signum(d0), 0.0)
            .when((F.signum(d0) != F.signum(d1)) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0)
            .otherwise(raw)
        )

    slopes = [end_slope(h[0], h[1], d[0], d[1])]
    for i in range(1, n - 1):
        w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        slopes.append(F.when(d[i - 1] * d[i] > 0, F.try_divide(
            F.lit(w1 + w2), F.try_divide(F.lit(w1), d[i - 1]) + F.try_divide(F.lit(w2), d[i]))).otherwise(0.0))
    slopes.append(end_slope(h[-1], h[-2], d[-1], d[-2]))
    pieces = F.array(*[
        F.struct(F.lit(float(knots[i])).alias("x"), F.lit(h[i]).alias("h"), F.col(columns[i]).alias("y0"),
                 F.col(columns[i + 1]).alias("y1"), slopes[i].alias("m0"), slopes[i + 1].alias("m1"))
        for i in range(n - 1)])
    piece_no = sum((F.when(F.col("day") > k, 1).otherwise(0) for k in knots[1:-1]), F.lit(1))
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    rows = (
        points.where(complete).withColumn("__pieces", pieces)
        .withColumn("day", F.explode(F.sequence(F.lit(knots[0]), F.lit(knots[-1]))))
        .withColumn("__p", F.element_at("__pieces", piece_no))
        .withColumn("__t", (F.col("day") - F.col("__p.x")) / F.col("__p.h"))
    )
    t = F.col("__t")
    curve = (
        (1 + 2 * t) * (1 - t) * (1 - t) * F.col("__p.y0") + t * (1 - t) * (1 - t) * F.col("__p.h") * F.col("__p.m0")
        + t * t * (3 - 2 * t) * F.col("__p.y1") + t * t * (t - 1) * F.col("__p.h") * F.col("__p.m1"))
    return rows.select(
        *keys, F.date_add(start, F.col("day")).alias("date"), "day", F.expm1(curve).alias("trend"),
        (F.expm1(curve) * (1 - F.col(band))).alias("low"), (F.expm1(curve) * (1 + F.col(band))).alias("high"))
