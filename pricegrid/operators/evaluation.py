"""Rolling-origin evaluation: splits, closed-form predictors, error tables and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import ordered
from pricegrid.functions.sizes import small_side
from pricegrid.operators import windows as W
from pricegrid.session import written

Fold = tuple[int, str, str, str, str, str]
CELL = ["variant", "crop", "fold", "horizon_weeks"]


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def split_of(fold: Fold, embargo: Column | int = 0, train_floor: str | None = None) -> Column:
    """The row's split in one fold, null outside. Train runs to its end date, validation starts strictly
    after ``val_start``, test is inclusive.

    ``embargo`` in weeks keeps targets of train and validation from reaching into the next split; the
    published evaluation has none.
    """
    _, train_end, val_start, val_end, test_start, test_end = fold
    week = F.col("week_start")
    reach = F.date_add(week, (embargo if isinstance(embargo, Column) else F.lit(embargo)) * 7)
    floor = week >= _day(train_floor) if train_floor else F.lit(True)
    return (
        F.when((reach <= _day(train_end)) & floor, "train")
        .when((week > _day(val_start)) & (reach <= _day(val_end)), "validation")
        .when(week.between(_day(test_start), _day(test_end)), "test"))


def rolling_origin_splits(df: DataFrame, folds: Sequence[Fold] = values.FOLDS, embargo: Column | int = 0,
                          train_floor: str | None = None) -> DataFrame:
    """One row per (row, fold) the row belongs to, with ``fold`` and ``split``. Folds are a fixed list, so
    they travel as literals and nothing joins."""
    entries = [F.struct(F.lit(f[0]).alias("fold"), split_of(f, embargo, train_floor).alias("split")) for f in folds]
    return df.select("*", F.inline(F.array(*entries))).where(F.col("split").isNotNull())


def fold_sizes(rows: DataFrame, keys: Sequence[str], min_train: int = 100, min_test: int = 10) -> DataFrame:
    """Rows per split, and whether the fold is large enough to be used."""
    sizes = rows.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "validation").alias("n_val"),
        F.count_if(F.col("split") == "test").alias("n_test"))
    return sizes.withColumn("usable", (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def three_way_time_split(df: DataFrame, train_end: str, val_end: str, week: str = "week_start") -> DataFrame:
    return df.withColumn("split", F.when(F.col(week) <= _day(train_end), "train").when(
        F.col(week) <= _day(val_end), "validation").otherwise("test"))


def with_targets(df: DataFrame, horizons: Sequence[int] = values.HORIZONS, column: str = "log_price",
                 keys: Sequence[str] = W.KEY) -> DataFrame:
    """One row per horizon with its target; origins without a target or a price lag of one week go."""
    return target_rows(target_columns(df, horizons, column, keys), horizons)


def target_columns(df: DataFrame, horizons: Sequence[int] = values.HORIZONS, column: str = "log_price",
                   keys: Sequence[str] = W.KEY) -> DataFrame:
    """The targets of all horizons side by side, one row per origin; origins without a price lag of one week go."""
    w = W.by(keys)
    wide = df.withColumns({
        **{f"__t{h}": F.lead(column, h).over(w) for h in horizons}, "price_lag_1": F.lag(column, 1).over(w)})
    return wide.where(F.col("price_lag_1").isNotNull())


def target_rows(wide: DataFrame, horizons: Sequence[int] = values.HORIZONS) -> DataFrame:
    """``target_columns`` turned into one row per horizon that has a target."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon_weeks"), F.col(f"__t{h}").alias("target")) for h in horizons])
    long = wide.select("*", F.inline(pairs)).drop(*[f"__t{h}" for h in horizons])
    return long.where(F.col("target").isNotNull())


def _price_rows(rows: DataFrame, named: Sequence[tuple[str, Column]]) -> DataFrame:
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("__p")) for n, c in named])
    long = rows.select("crop", "fold", "horizon_weeks", "market_id", "week_start", "target", F.inline(variants))
    return long.where(F.col("__p").isNotNull()).select(
        "variant", "crop", "fold", "horizon_weeks", "market_id", "week_start",
        F.expm1("target").alias("y_true"), F.expm1("__p").alias("y_pred"))


def naive_persistence(logs: DataFrame, folds: Sequence[Fold] = values.FOLDS,
                      horizons: Sequence[int] = values.HORIZONS) -> DataFrame:
    """Current value repeated h weeks ahead on every fold's test rows."""
    rows = rolling_origin_splits(with_targets(logs, horizons), folds).where(F.col("split") == "test")
    return _price_rows(rows, [("B1", F.col("log_price"))])


def benchmark_predictions(logs: DataFrame, folds: Sequence[Fold] = values.FOLDS,
                          horizons: Sequence[int] = values.HORIZONS) -> DataFrame:
    """Naive, seasonal naive and 4-week mean on the same test rows."""
    rows = with_targets(W.benchmark_predictors(logs), horizons)
    tested = rolling_origin_splits(rows, folds).where(F.col("split") == "test")
    return _price_rows(tested, [
        ("B1", F.col("log_price")), ("B2", F.col("seasonal_naive")), ("B3", F.col("moving_average_4"))])


def forecast_metrics(preds: DataFrame, keys: Sequence[str] = CELL, rounded: bool = True) -> DataFrame:
    """RMSE, MAE, MAPE %, R2 and N in price units, from sums that combine map-side."""
    ok = (F.col("y_true") > 0) & F.col("y_pred").isNotNull() & ~F.isnan("y_pred") & (F.abs("y_pred") != float("inf")) & (
        F.col("y_true") != float("inf"))
    e = F.col("y_true") - F.col("y_pred")
    sums = preds.where(ok).groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"),
        (F.avg(F.abs(e / F.col("y_true"))) * 100).alias("MAPE"), F.sum(e * e).alias("__sse"),
        (F.var_pop("y_true") * F.count(F.lit(1))).alias("__sst"), F.count(F.lit(1)).alias("N"))
    out = sums.withColumn("R2", F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst"))).drop("__sse", "__sst")
    if rounded:
        out = out.withColumns({c: F.round(c, d) for c, d in [("RMSE", 1), ("MAE", 1), ("MAPE", 2), ("R2", 4)]})
    return out.select(*keys, "RMSE", "MAE", "MAPE", "R2", "N")


def fold_mean_summary(metrics: DataFrame, keys: Sequence[str] = ("variant", "crop", "horizon_weeks"),
                      rounded: bool = True) -> DataFrame:
    out = metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2")])
    if rounded:
        out = out.withColumns({c: F.round(c, d) for c, d in [("RMSE", 1), ("MAE", 1), ("MAPE", 2), ("R2", 4)]})
    return out


def mase(summary: DataFrame, naive: str = "B1", keys: Sequence[str] = ("crop", "horizon_weeks")) -> DataFrame:
    """A variant's MAE over the naive MAE of the same cell."""
    base = F.max(F.when(F.col("variant") == naive, F.col("MAE"))).over(Window.partitionBy(*keys))
    return summary.withColumn("naive_MAE", base).withColumn("MASE", F.try_divide("MAE", "naive_MAE"))


def skill_vs_naive(summary: DataFrame, naive: str = "B1", keys: Sequence[str] = ("crop", "horizon_weeks")) -> DataFrame:
    """(naive MAPE - MAPE) / naive MAPE in %."""
    base = F.max(F.when(F.col("variant") == naive, F.col("MAPE"))).over(Window.partitionBy(*keys))
    return summary.withColumn("skill_pct", F.try_divide(base - F.col("MAPE"), base) * 100)


def skill_pivot(mase_rows: DataFrame, variants: Sequence[str], keys: Sequence[str] = ("crop", "horizon_weeks")) -> DataFrame:
    return mase_rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("variant") == v, (1 - F.col("MASE")) * 100)).alias(v) for v in variants])


def crossover_horizon(mase_rows: DataFrame, variant: str) -> DataFrame:
    """Smallest horizon at which the variant beats the naive, else null."""
    mine = mase_rows.where(F.col("variant") == variant)
    return mine.groupBy("crop").agg(F.min(F.when(F.col("MASE") < 1, F.col("horizon_weeks"))).alias("crossover_horizon_weeks"))


def weekly_mean_predictions(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*CELL, "week_start").agg(
        F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), F.count(F.lit(1)).alias("n_markets"))


def spike_label(panel: DataFrame, train_end: str, price: str = "modal_price_weighted", group: str = "crop",
                q: float = 0.9) -> DataFrame:
    """1 when next week's price exceeds the training rows' 90th percentile of the crop."""
    threshold = small_side(ordered.exact_percentiles(
        panel.where(F.col("week_start") <= _day(train_end)), [group], price, {"threshold": q}).drop("n"))
    ahead = panel.withColumn("next_price", F.lead(price, 1).over(W.by()))
    return ahead.where(F.col("next_price").isNotNull()).join(threshold, group).withColumn(
        "spike", (F.col("next_price") > F.col("threshold")).cast("int"))


def spike_rate(labelled: DataFrame, group: str = "crop") -> DataFrame:
    return labelled.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.max("threshold").alias("threshold"), F.avg("spike").alias("spike_rate"))


def error_lookup(metrics: DataFrame, variant: str) -> DataFrame:
    """Mean RMSE and MAPE per (crop, horizon), keyed 'crop_hw'."""
    mine = metrics.where(F.col("variant") == variant)
    return mine.groupBy("crop", "horizon_weeks").agg(F.avg("RMSE").alias("rmse"), F.avg("MAPE").alias("mape")).select(
        F.concat("crop", F.lit("_"), F.col("horizon_weeks").cast("string"), F.lit("w")).alias("key"), "crop",
        "horizon_weeks", "rmse", "mape")


def forecast_band(points: DataFrame, errors: DataFrame, forecast: str = "forecast",
                  last_price: str = "last_price") -> DataFrame:
    """Forecast +- the validated RMSE of its (crop, horizon); horizon 0 is the last price without width."""
    joined = points.join(errors.select("crop", "horizon_weeks", "rmse"), ["crop", "horizon_weeks"], "left")
    start = F.col("horizon_weeks") == 0
    mid = F.when(start, F.col(last_price)).otherwise(F.col(forecast))
    width = F.when(start, F.lit(0.0)).otherwise(F.col("rmse"))
    return joined.withColumns({"mid": mid, "low": mid - width, "high": mid + width})


def episode_errors(preds: DataFrame, episodes: DataFrame, model: str, naive: str) -> DataFrame:
    """Errors of model and naive over an episode's core weeks; at least two weeks.

    ``preds`` are crop-week means, ``episodes`` (name, crop, core_start, core_end).
    """
    from pricegrid.operators.policy import event_window_join

    wide = preds.groupBy("crop", "horizon_weeks", "week_start").agg(
        F.min_by(F.when(F.col("variant") == model, F.col("y_true")), F.when(F.col("variant") == model, F.col("fold"))).alias("y"),
        F.min_by(F.when(F.col("variant") == model, F.col("y_pred")), F.when(F.col("variant") == model, F.col("fold"))).alias("m"),
        F.min_by(F.when(F.col("variant") == naive, F.col("y_pred")), F.when(F.col("variant") == naive, F.col("fold"))).alias("b"))
    inside = event_window_join(
        wide.where(F.col("m").isNotNull() & F.col("b").isNotNull()), episodes, "week_start", start="core_start", end="core_end")
    err = lambda c: F.abs(F.col("y") - F.col(c))
    out = inside.groupBy("name", "crop", "horizon_weeks").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.avg(err("m")).alias("model_mae"), F.avg(err("b")).alias("naive_mae"),
        (F.avg(err("m") / F.col("y")) * 100).alias("model_mape"), (F.avg(err("b") / F.col("y")) * 100).alias("naive_mape"))
    return out.where(F.col("n_weeks") >= 2).withColumn("model_wins", F.col("model_mae") < F.col("naive_mae"))


def validation_errors(joined: DataFrame, forecast: str = "forecast", naive: str = "naive", actual: str = "actual_price") -> DataFrame:
    return joined.withColumns({
        "ape_model": F.abs(F.col(forecast) - F.col(actual)) / F.col(actual) * 100,
        "ape_naive": F.abs(F.col(naive) - F.col(actual)) / F.col(actual) * 100})


def _with_sums(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The rows with ``keys`` and ``keep``, and among them, for each batch and key, a row of the number of its rows ``__n``
    and of each measure's sum and count. ``__n`` is null in the former."""
    sums = [f"__{what}_{m}" for m in measures for what in ("sum", "count")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*keys, *keep)), pa.nulls(n, pa.int64()),
                 *(pa.nulls(n, pa.int64() if "count" in c else pa.float64()) for c in sums)], names=names)
            found = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate(
                [([], "count_all"), *[(m, what) for m in measures for what in ("sum", "count")]])
            columns = [*(found.column(c) for c in keys), *[pa.nulls(len(found), pa.float64())] * len(keep), found.column("count_all"),
                       *(found.column(f"{m}_{what}") for m in measures for what in ("sum", "count"))]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    names = [*keys, *keep, "__n", *sums]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, *keep).schema), "__n long",
                        *(f"`{c}` {'long' if 'count' in c else 'double'}" for c in sums)])
    return rows.mapInArrow(run, schema)


def validation_summary(errors: DataFrame, keys: Sequence[str], clean: Column | None = None) -> DataFrame:
    """Mean and exact median APE of both, share of rows the model wins, national means; all and clean rows."""
    measures = ["ape_model", "ape_naive", "better", "forecast", "actual_price"]
    rows = errors.select(*keys, (F.lit(False) if clean is None else clean).alias("__clean"), *[F.col(c).cast("double").alias(c) for c in measures[:2]],
                         (F.col("ape_model") < F.col("ape_naive")).cast("double").alias("better"), *[F.col(c).cast("double").alias(c) for c in measures[3:]])
    # the errors are computed once; what is written of them is what the medians need, and sums for the means
    known = written(_with_sums(rows, [*keys, "__clean"], measures, measures[:2]))
    keys = [*keys, "subset"]
    subsets = F.array(F.lit("all"), F.when(F.col("__clean"), F.lit("clean")))
    rows = known.withColumn("subset", F.explode(F.array_compact(subsets)))
    mean = lambda c: F.try_divide(F.sum(f"__sum_{c}"), F.sum(f"__count_{c}"))
    means = rows.where("__n IS NOT NULL").groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), mean("ape_model").alias("mean_ape_model"), mean("ape_naive").alias("mean_ape_naive"),
        mean("better").alias("share_model_better"), mean("forecast").alias("mean_forecast"), mean("actual_price").alias("mean_actual"))
    rows = rows.where("__n IS NULL").select(*keys, *measures[:2])
    # both medians in one pass: the measure is one more key
    long = rows.unpivot(keys, ["ape_model", "ape_naive"], "__measure", "__ape")
    medians = ordered.exact_percentiles(long, [*keys, "__measure"], "__ape", {"m": 0.5})
    pick = lambda c: F.max(F.when(F.col("__measure") == c, F.col("m"))).alias(f"median_{c}")
    return means.join(medians.groupBy(*keys).agg(pick("ape_model"), pick("ape_naive")), keys)


def standardise_by_train(df: DataFrame, features: Sequence[str], is_train: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / std with moments of the training rows only; a std below 1e-6 counts as 1."""
    aggs = []
    for f in features:
        x = F.when(is_train, F.col(f))
        aggs += [F.avg(x).alias(f"__m_{f}"), F.stddev_pop(x).alias(f"__s_{f}")]
    if keys:
        out = df.join(small_side(df.groupBy(*keys).agg(*aggs)), list(keys))
        stat = lambda name: F.col(name)
    else:
        moments = df.agg(F.struct(*aggs)).scalar()
        out = df
        stat = lambda name: moments.getField(name)
    scaled = {
        f: (F.col(f) - stat(f"__m_{f}")) / F.when(stat(f"__s_{f}") < 1e-6, 1.0).otherwise(stat(f"__s_{f}"))
        for f in features}
    return out.withColumns(scaled).drop(*[f"__{k}_{f}" for f in features for k in "ms"])
