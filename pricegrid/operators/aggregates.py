"""Aggregations. Groups as wide as a crop use additive aggregates or the distributed order statistics;
built-in medians are kept to groups whose size the calendar or the market list bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import calendar as cal
from pricegrid.functions import ordered, scalars
from pricegrid.functions.sizes import small_side

PRICE = "modal_price_weighted"
ARRIVALS = "arrivals_tonnes_week"


def coverage_by_year(panel: DataFrame) -> DataFrame:
    """Observed weeks, markets, states and rows plus imputed rows per crop and ISO year.

    One pass: a market's weeks are bits of a mask, so distinct weeks are the bits of all masks together
    and the only distinct count left runs over one row per market and year.
    """
    real = F.col("imputed") == 0
    week_bit = F.when(real, F.expr("shiftleft(1L, weekofyear(week_start))")).otherwise(F.lit(0).cast("long"))
    per_market = panel.groupBy("crop", "iso_year", "market_id", "state").agg(
        F.count_if(real).alias("__obs"), F.count_if(~real).alias("__imp"), F.bit_or(week_bit).alias("__weeks"))
    seen = F.col("__obs") > 0
    return per_market.groupBy("crop", "iso_year").agg(
        F.bit_count(F.bit_or("__weeks")).cast("long").alias("weeks"), F.count_if(seen).alias("markets"),
        F.count_distinct(F.when(seen, F.col("state"))).alias("states"), F.sum("__obs").alias("obs_rows"),
        F.sum("__imp").alias("imputed_rows"))


def panel_summary_total(panel: DataFrame) -> DataFrame:
    """Rows, markets and states per crop plus a TOTAL row (markets count once per crop)."""
    per_market = panel.groupBy("crop", "market_id", "state").agg(F.count(F.lit(1)).alias("__rows"))
    return per_market.rollup("crop").agg(
        F.grouping("crop").alias("__total"), F.sum("__rows").alias("n_rows"), F.count(F.lit(1)).alias("n_markets"),
        F.count_distinct("state").alias("n_states"),
    ).select(F.when(F.col("__total") == 1, "TOTAL").otherwise(F.col("crop")).alias("crop"), "n_rows", "n_markets", "n_states")


def market_profile(panel: DataFrame, keys: Sequence[str] = ("crop", "market_id")) -> DataFrame:
    """Weeks, years, mean price and arrivals, CV % (0 if the mean is not positive), coverage %."""
    real = F.col("imputed") == 0
    price = F.when(real, F.col(PRICE))
    mean = F.avg(price)
    out = panel.groupBy(*keys).agg(
        F.count_if(real).alias("weeks_present"),
        F.size(F.collect_set(F.when(real, F.year("week_start")))).alias("years_present"),
        mean.alias("mean_price"), F.avg(F.when(real, F.col(ARRIVALS))).alias("mean_arrivals"),
        F.stddev_samp(price).alias("__sd"), ((1 - F.avg("imputed")) * 100).alias("pct_coverage"))
    cv = F.when(F.col("mean_price") > 0, F.col("__sd") / F.col("mean_price") * 100).otherwise(0.0)
    return out.withColumn("cv_price", cv).withColumn("pct_coverage", F.round("pct_coverage", 1)).drop("__sd")


def selection_summary(profile: DataFrame, threshold: float) -> DataFrame:
    """Selected and total markets, states, minimum and exact median coverage, mean price per crop."""
    chosen = F.col("pct_coverage") >= threshold
    base = profile.groupBy("crop").agg(
        F.count_if(chosen).alias("n_selected"), F.count(F.lit(1)).alias("n_total"),
        F.count_distinct(F.when(chosen, F.col("state"))).alias("n_states"),
        F.min(F.when(chosen, F.col("pct_coverage"))).alias("min_coverage"),
        F.avg(F.when(chosen, F.col("mean_price"))).alias("mean_price"))
    median = ordered.exact_percentiles(profile.where(chosen), ["crop"], "pct_coverage", {"median_coverage": 0.5}).drop("n")
    return base.join(median, "crop", "left")


def variety_collapse(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def climate_weekly(daily: DataFrame, keys: Sequence[str] = ("zone_id", "crop")) -> DataFrame:
    """Zone-day temperatures to zone-week means, heat-flag sums and day counts."""
    return daily.withColumn("week_start", cal.week_start("date")).groupBy(*keys, "week_start").agg(
        F.avg("Tmax_C").alias("era5_tmax"), F.avg("Tmin_C").alias("era5_tmin"), F.avg("Tmean_C").alias("era5_tmean"),
        F.avg(F.col("Tmax_C") - F.col("Tmin_C")).alias("era5_dtr"), F.sum("flag_above35").alias("era5_heat_35"),
        F.sum("flag_above38").alias("era5_heat_38"), F.count("date").alias("era5_n_days"))


def rain_weekly(pentads: DataFrame, keys: Sequence[str] = ("zone_id", "crop")) -> DataFrame:
    """Five-day means to week totals, after the union of all files."""
    return pentads.withColumn("week_start", cal.week_start("date")).groupBy(*keys, "week_start").agg(
        F.sum(F.col("rain_mean_mm") * 5).alias("chirps_rain_mm"), F.max("rain_max_mm").alias("chirps_rain_max"),
        F.avg("frac_excess_rain").alias("chirps_excess"), F.count("date").alias("chirps_n_pentad"))


def dim_average(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("crop", "week_start")) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def completeness(df: DataFrame, layers: Mapping[str, Sequence[str]], keys: Sequence[str] = ("crop",)) -> DataFrame:
    """% non-null per column and % of rows with any null per layer, in one pass."""
    share = lambda cond: F.avg(cond.cast("int")) * 100
    aggs, names = [], []
    for layer, columns in layers.items():
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
            aggs.append(share(F.col(c).isNotNull()).alias(f"{c}_pct_filled"))
            names.append(f"{c}_pct_filled")
        aggs.append(share(~whole).alias(f"{layer}_pct_any_null"))
        names.append(f"{layer}_pct_any_null")
    return df.groupBy(*keys).agg(*aggs).unpivot(list(keys), names, "measure", "pct")


def dow_factor(daily: DataFrame, price: str = "modal_price_rs_per_quintal", date: str = "arrival_date",
               market: Sequence[str] = ("crop", "market_id")) -> DataFrame:
    """Weekday factor: price over its market-week mean, as mean, sample deviation and count per weekday.

    Count, sum and square sum per (market, week, weekday) carry all that is needed, so raw rows are
    combined map-side and never sorted.
    """
    keys = [*market, "week_start"]
    cells = (
        daily.withColumns({"week_start": cal.week_start(date), "dow": cal.day_of_week(date)})
        .groupBy(*keys, "dow")
        .agg(F.count(price).alias("n"), F.sum(price).alias("s"), F.sum(F.col(price) * F.col(price)).alias("q"))
    )
    week = Window.partitionBy(*keys)
    mean = F.sum("s").over(week) / F.sum("n").over(week)
    rel = cells.withColumn("__m", mean).groupBy(market[0], "dow").agg(
        F.sum("n").alias("n_obs"), F.sum(F.col("s") / F.col("__m")).alias("__s"),
        F.sum(F.col("q") / (F.col("__m") * F.col("__m"))).alias("__q"))
    var = F.try_divide(F.col("__q") - F.col("__s") * F.col("__s") / F.col("n_obs"), F.col("n_obs") - 1)
    return rel.select(
        market[0], "dow", (F.col("__s") / F.col("n_obs")).alias("factor_mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("factor_std"), "n_obs")


def disaggregation_backtest(daily: DataFrame, price: str = "modal_price_rs_per_quintal", date: str = "arrival_date",
                            market: Sequence[str] = ("crop", "market_id")) -> DataFrame:
    """Flat week mean against weekday-scaled week mean: RMSE, MAPE, N per crop."""
    keys = [*market, "week_start"]
    rows = daily.withColumns({"week_start": cal.week_start(date), "dow": cal.day_of_week(date)}).select(*keys, "dow", price)
    means = rows.groupBy(*keys).agg(F.avg(price).alias("__m"))
    factors = small_side(dow_factor(daily, price, date, market).select(market[0], "dow", "factor_mean"))
    joined = rows.join(means, keys).join(factors, [market[0], "dow"])
    preds = joined.select(market[0], price, F.inline(F.array(
        F.struct(F.lit("flat").alias("method"), F.col("__m").alias("pred")),
        F.struct(F.lit("weekday").alias("method"), (F.col("__m") * F.col("factor_mean")).alias("pred")))))
    err = F.col(price) - F.col("pred")
    return preds.groupBy(market[0], "method").agg(
        F.sqrt(F.avg(err * err)).alias("RMSE"), (F.avg(F.abs(err) / F.col(price)) * 100).alias("MAPE"), F.count(F.lit(1)).alias("N"))


def feature_ranges(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, exact median and maximum of each column in long form."""
    long = df.unpivot(list(keys), list(columns), "feature", "value")
    ends = long.groupBy(*keys, "feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    mid = ordered.exact_percentiles(long, [*keys, "feature"], "value", {"median": 0.5}).drop("n")
    return ends.join(mid, [*keys, "feature"]).select(*keys, "feature", "min", "median", "max")


def response_quantiles(df: DataFrame, value: str = "pct_change",
                       keys: Sequence[str] = ("crop", "scenario", "horizon_weeks")) -> DataFrame:
    return ordered.exact_percentiles(df, keys, value, {"p10": 0.1, "median": 0.5, "p90": 0.9})


def top_k_by_mean(panel: DataFrame, column: str, k: int, min_coverage: float = values.MIN_REAL_COVERAGE,
                  group: str = "crop", ident: str = "market_id") -> DataFrame:
    """Top k ids per group by mean, among those with enough real coverage; the smaller id wins ties."""
    stats = panel.groupBy(group, ident).agg(F.avg(column).alias("mean_value"), (1 - F.avg("imputed")).alias("coverage"))
    w = Window.partitionBy(group).orderBy(F.col("mean_value").desc_nulls_last(), F.col(ident))
    return stats.where(F.col("coverage") >= min_coverage).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coverage_matrix(panel: DataFrame, years: Sequence[int], top: int = 30, group: str = "crop",
                    ident: str = "market_id") -> DataFrame:
    """Top ids by coverage x year: the year's grid weeks as % of the crop's weeks of that year, 0..100."""
    cover = panel.groupBy(group, ident).agg((1 - F.avg("imputed")).alias("coverage"))
    w = Window.partitionBy(group).orderBy(F.col("coverage").desc(), F.col(ident))
    chosen = cover.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= top)
    year = F.year("week_start")
    weeks = panel.select(group, "week_start").distinct().groupBy(group, year.alias("year")).agg(F.count(F.lit(1)).alias("__weeks"))
    counts = panel.join(chosen.select(group, ident), [group, ident], "left_semi").groupBy(group, ident, year.alias("year")).agg(
        F.count(F.lit(1)).alias("__n"))
    share = counts.join(weeks, [group, "year"]).withColumn("pct", F.least(F.col("__n") / F.col("__weeks") * 100, F.lit(100.0)))
    return share.groupBy(group, ident).pivot("year", list(years)).agg(F.max("pct")).na.fill(0.0)


def year_week_pivot(df: DataFrame, column: str, week_numbers: Sequence[int], date: str = "week_start") -> DataFrame:
    """Mean by ISO year (rows) and listed ISO weeks (columns)."""
    keyed = df.select(cal.iso_year(date).alias("iso_year"), cal.iso_week(date).alias("__w"), F.col(column).alias("__v"))
    return keyed.groupBy("iso_year").pivot("__w", list(week_numbers)).agg(F.avg("__v"))


def pairwise_correlation(df: DataFrame, columns: Sequence[str], min_values: int = 50) -> DataFrame:
    """Pearson r of every column pair on pairwise complete rows, one pass; columns with too few values drop out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    stats = df.agg(*[F.count(c).alias(f"__n_{c}") for c in columns],
                   *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r"),
                 F.least(F.col(f"__n_{a}"), F.col(f"__n_{b}")).alias("n_least")) for a, b in pairs])
    return stats.select(F.inline(rows)).where(F.col("n_least") > min_values).select("a", "b", "r")


def histogram_counts(df: DataFrame, column: str, edges: Sequence[float] = values.COVERAGE_BINS, keys: Sequence[str] = ("crop",)) -> DataFrame:
    out = df.withColumn("bin", scalars.histogram_bin(column, edges)).where(F.col("bin").isNotNull())
    return out.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def entity_counts(panel: DataFrame, selected: DataFrame, keys: Sequence[str] = ("crop", "market_id")) -> DataFrame:
    """Market rows per crop and week, all against selected."""
    chosen = small_side(selected.select(*keys).distinct().withColumn("__sel", F.lit(1)))
    flagged = panel.join(chosen, list(keys), "left")
    return flagged.groupBy("crop", "week_start").agg(F.count(F.lit(1)).alias("n_all"), F.count("__sel").alias("n_selected"))


def market_span(weekly: DataFrame, max_weeks: int, keys: Sequence[str] = ("crop", "state", "market_id")) -> DataFrame:
    out = weekly.groupBy(*keys).agg(
        F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"),
        F.count_distinct("week_start").alias("n_weeks"))
    return out.withColumn("coverage_category", scalars.coverage_band(F.col("n_weeks") / max_weeks))


def net_leadership(edges: DataFrame, group: str = "crop") -> DataFrame:
    """Out-rate minus in-rate of significant edges per node; both directions in one aggregate."""
    sig = F.col("significant").cast("int")
    ends = edges.select(group, F.inline(F.array(
        F.struct(F.col("from_id").alias("market_id"), F.lit(1).alias("o"), sig.alias("os"), F.lit(0).alias("i"), F.lit(0).alias("is_")),
        F.struct(F.col("to_id").alias("market_id"), F.lit(0).alias("o"), F.lit(0).alias("os"), F.lit(1).alias("i"), sig.alias("is_")))))
    out = ends.groupBy(group, "market_id").agg(
        F.sum("os").alias("out_sig"), F.sum("o").alias("out_n"), F.sum("is_").alias("in_sig"), F.sum("i").alias("in_n"))
    return out.withColumns({
        "out_rate": F.try_divide("out_sig", "out_n"), "in_rate": F.try_divide("in_sig", "in_n"),
    }).withColumn("net_score", F.col("out_rate") - F.col("in_rate"))


def importance_by_layer(importances: DataFrame, layer_of: Mapping[str, str], keys: Sequence[str] = ("crop", "horizon_weeks")) -> DataFrame:
    """Sum of importance per layer and share of the total; unlisted features count as 'Other'."""
    layer = F.coalesce(*[F.when(F.col("feature") == f, F.lit(name)) for f, name in layer_of.items()], F.lit("Other"))
    out = importances.withColumn("layer", layer).groupBy(*keys, "layer").agg(F.sum("importance").alias("importance"))
    total = F.sum("importance").over(Window.partitionBy(*keys))
    return out.withColumn("pct_of_total", F.coalesce(F.try_divide(100 * F.col("importance"), total), F.lit(0.0)))


def top_features(importances: DataFrame, k: int = 15, keys: Sequence[str] = ("crop", "horizon_weeks")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), F.col("feature"))
    return importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def event_bins(effects: DataFrame, offset: str = "weeks_since", value: str = "effect", role: str = "role",
               episode: str = "episode") -> DataFrame:
    """Half-even rounded week bins, mean per episode, then moments across episodes."""
    per = effects.withColumn("week_bin", F.bround(offset, 0).cast("int")).groupBy(role, "week_bin", episode).agg(F.avg(value).alias("__v"))
    return per.groupBy(role, "week_bin").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.avg("__v").alias("mean_pct"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("__v")).alias("std_pct"), F.min("__v").alias("min_pct"), F.max("__v").alias("max_pct"))


def placebo_rank_p(placebos: DataFrame, real: DataFrame, effect: str = "effect", keys: Sequence[str] = (),
                   two_sided: bool = True) -> DataFrame:
    """Share of placebo effects at least as extreme as the real one; the real unit is not counted.

    ``real`` has one row per key.
    """
    r = real.select(*keys, F.col(effect).alias("__real"))
    if keys:
        joined = placebos.join(r, list(keys))
    else:
        joined = placebos.withColumn("__real", r.select("__real").scalar())
    size = F.abs if two_sided else (lambda c: c)
    extreme = size(F.col(effect)) >= size(F.col("__real"))
    return joined.groupBy(*keys).agg(
        F.max("__real").alias("real_effect"), F.count(F.lit(1)).alias("n_placebo"), F.count_if(extreme).alias("n_as_extreme"),
        F.avg(extreme.cast("int")).alias("p_value"))


def crop_week_series(panel: DataFrame, price: str = "median", arrivals: str = "sum") -> DataFrame:
    """Median (or mean) price and summed (or mean) arrivals per crop-week of real rows.

    A group is one week of one crop's markets, so its distinct prices are bounded by the market list.
    """
    how = {"median": F.median, "mean": F.avg, "sum": F.sum}
    return panel.where(F.col("imputed") == 0).groupBy("crop", "week_start").agg(
        how[price](PRICE).alias("price"), how[arrivals](ARRIVALS).alias("arrivals"), F.count(F.lit(1)).alias("n_markets"))


def provenance_counts(df: DataFrame, entity: str = "state", source: str = "source") -> DataFrame:
    return df.where(F.col(source) != "direct").groupBy(entity, source).agg(F.count(F.lit(1)).alias("n_months"))


def name_conflicts(df: DataFrame, ident: str, name: str) -> DataFrame:
    """Ids that stand for more than one name."""
    pairs = df.select(ident, name).distinct()
    return pairs.groupBy(ident).agg(F.count(F.lit(1)).alias("n_names")).where(F.col("n_names") > 1)

