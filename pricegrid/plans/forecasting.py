"""Model training, scoring and scenarios: boosting over all cells at once, MLlib for episode classifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import ordered
from pricegrid.functions.sizes import spread
from pricegrid.operators import evaluation as E
from pricegrid.operators import inference as I
from pricegrid.operators.cleaning import feature_fill_zero
from pricegrid.operators.joins import oof_residual_join
from pricegrid.plans import boosting
from pricegrid.session import materialise, written

ID = ["crop", "market_id", "week_start", "horizon_weeks"]
#: settings of MLlib's GBTClassifier; boosting ends at the first rise of the validation error
SPIKE = boosting.Boosting(rate=0.1, depth=5, min_leaf=1, l1=0.0, l2=0.0, rows=1.0, features=1.0, patience=0, logistic=True)
SPIKE_BINS = 32


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Missing features count as 0, then one vector column."""
    filled = feature_fill_zero(df.withColumns({f: F.col(f).cast("double") for f in features}), features)
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(filled)


def random_forest(trees: int = 50, depth: int = 8, seed: int = 42, label: str = "target") -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def _each(items: Sequence, work: Callable, threads: int = 3) -> list:
    """Independent fits run side by side; the work itself is Spark's."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, items))


def monotone_signs(features: Sequence[str], levers: Sequence[str] = values.MONOTONE_DOWN_LEVERS) -> list[int]:
    """-1 for the levers that cannot raise the price, 0 for every other feature."""
    return [-1 if f in levers else 0 for f in features]


def _row_id() -> Column:
    return F.xxhash64(*ID).alias("rid")


@dataclass(frozen=True)
class TrainingSet:
    """Features binned and written once, not once per fold, as a table partitioned by crop and horizon; ``cells`` are the
    (slot, crop, horizon, fold) large enough to fit. A fold is a filter on the rows."""

    rows: DataFrame
    columns: list[str]
    folds: list[E.Fold]
    cells: list[tuple[int, str, int, int]]
    embargo: bool
    train_floor: str | None

    def splits(self) -> DataFrame:
        """A row for each cell and split that a row of the table belongs to."""
        spark = self.rows.sparkSession
        # one row a cell
        cells = F.broadcast(spark.createDataFrame(self.cells, "slot int, crop string, horizon_weeks int, fold int"))
        rows = E.rolling_origin_splits(self.rows, self.folds, F.col("horizon_weeks") if self.embargo else 0, self.train_floor)
        return rows.join(cells, ["crop", "horizon_weeks", "fold"])

    def at(self, features: Sequence[str]) -> list[int]:
        return [self.columns.index(f) for f in features]


def training_rows(features_df: DataFrame, features: Sequence[str], horizons: Sequence[int], folds: Sequence[E.Fold],
                  train_floor: str | None = None, embargo: bool = False) -> TrainingSet:
    """Rows with targets and binned features, and the (crop, horizon, fold) cells large enough to fit. A row is binned once
    for all horizons."""
    wide = E.target_columns(features_df, horizons)
    edges = boosting.bin_edges(features_df, features)
    kept = ["crop", "market_id", "week_start", "log_price", *[f"__t{h}" for h in horizons]]
    rows = E.target_rows(boosting.binned(wide, features, edges, kept), horizons).select(*ID, "target", "log_price", "bins")
    rows = written(rows.withColumn("rid", _row_id()), "crop", "horizon_weeks")
    return with_floor(TrainingSet(rows, list(features), list(folds), [], embargo, None), train_floor)


def with_floor(data: TrainingSet, train_floor: str | None) -> TrainingSet:
    """The same written rows with training from ``train_floor`` on, and the cells large enough to fit then."""
    splits = E.rolling_origin_splits(data.rows, data.folds, F.col("horizon_weeks") if data.embargo else 0, train_floor)
    sizes = E.fold_sizes(splits, ["crop", "horizon_weeks", "fold"]).where("usable").collect()
    cells = [(i, *c) for i, c in enumerate(sorted((r.crop, r.horizon_weeks, r.fold) for r in sizes))]
    return replace(data, cells=cells, train_floor=train_floor)


def fit_cells(data: TrainingSet, p: boosting.Boosting | boosting.Forest, features: Sequence[str] | None = None) -> DataFrame:
    """One ensemble a cell from its train rows, stopped on its validation rows; levers are monotone."""
    features = features or data.columns
    known = data.splits().where(F.col("split") != "test").select(
        "slot", "rid", F.col("target").alias("y"), (F.col("split") == "train").alias("training"), "bins")
    return boosting.fit(known, len(data.columns), p, data.at(features), monotone_signs(features))


def _predictions(scored: DataFrame, variant: str) -> DataFrame:
    return scored.select(F.lit(variant).alias("variant"), "crop", "fold", "horizon_weeks", "market_id", "week_start",
                         F.expm1("target").alias("y_true"), F.expm1("prediction").alias("y_pred"))


def train_eval(data: TrainingSet, p: boosting.Boosting | boosting.Forest, variant: str, features: Sequence[str] | None = None) -> DataFrame:
    """Fit per (crop, horizon, fold) on train and validation rows, predict the test rows in price units.

    Forests are grown cell by cell in a task; the cells too large for one are left to MLlib, on the same binned values.
    """
    large: list[int] = []
    if isinstance(p, boosting.Forest):
        sizes = data.splits().where(F.col("split") != "test").groupBy("slot").count().collect()
        large = [r["slot"] for r in sizes if r["count"] * len(features or data.columns) > boosting.CELL_BYTES]
    small = replace(data, cells=[c for c in data.cells if c[0] not in large]) if large else data
    tests = small.splits().where(F.col("split") == "test").drop("split")
    out = _predictions(boosting.score(tests, fit_cells(small, p, features), len(data.columns)), variant)
    for slot in large:
        mine = data.splits().where(F.col("slot") == slot).withColumn("features", _vector(data.at(features or data.columns)))
        model = random_forest(p.trees, p.depth, p.seed).setMinInstancesPerNode(p.min_leaf).setMaxBins(boosting.BINS).fit(mine.where("split = 'train'"))
        out = out.unionByName(_predictions(model.transform(mine.where("split = 'test'")), variant))
    return out


def _vector(columns: Sequence[int]) -> Column:
    """Packed codes, all below 128, as an MLlib vector."""
    return array_to_vector(F.transform(F.array(*map(F.lit, columns)), lambda i: F.ascii(F.substring("bins", i + 1, F.lit(1)).cast("string")).cast("double")))


def model_family_compare(data: TrainingSet, families: dict[str, boosting.Boosting | boosting.Forest]) -> DataFrame:
    preds = [train_eval(data, p, name) for name, p in families.items()]
    return E.fold_mean_summary(E.forecast_metrics(reduce(DataFrame.unionByName, preds)))


def spike_classifier(labelled: DataFrame, features: Sequence[str], folds: Sequence[E.Fold], iterations: int = 10) -> DataFrame:
    """Classifier on spike labels per crop and fold, stopped early on the validation rows: (crop, fold, n, auc,
    avg_precision). All cells are grown side by side, with MLlib's settings of a GBTClassifier; bins are those of a cell's
    training rows."""
    spark, width = labelled.sparkSession, len(features)
    # three passes read the labelled rows; a fold is a filter on them
    rows = E.rolling_origin_splits(written(labelled.select("crop", "week_start", "spike", *features)), folds)
    # a crop without both classes in training cannot be fitted
    mixed = rows.where(F.col("split") == "train").groupBy("crop", "fold").agg(
        F.min("spike").alias("a"), F.max("spike").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("a") != F.col("b"))
    found = mixed.orderBy("crop", "fold").collect()
    # one row a cell
    cells = F.broadcast(spark.createDataFrame([(i, r.crop, r.fold) for i, r in enumerate(found)], "slot int, crop string, fold int"))
    known = rows.join(cells, ["crop", "fold"])
    edges = boosting.sampled_edges(known.where(F.col("split") == "train"), features, SPIKE_BINS, "slot", {i: r.n for i, r in enumerate(found)})
    table = written(boosting.binned(known, features, edges, ["crop", "fold", "slot", "split", "spike", "week_start"], "slot"))
    models = boosting.fit(
        table.where(F.col("split") != "test").select(
            "slot", F.xxhash64("week_start", "bins").alias("rid"), F.col("spike").alias("y"), (F.col("split") == "train").alias("training"), "bins"),
        width, replace(SPIKE, trees=iterations))
    tests = boosting.score(table.where(F.col("split") == "test"), models, width)
    scored = materialise(tests.select("crop", "fold", "spike", (1 / (1 + F.exp(-2 * F.col("prediction")))).alias("score")))
    return I.rank_metrics(scored, ["crop", "fold"], "spike", "score")


def fit_final(rows: DataFrame, features: Sequence[str], p: boosting.Boosting, holdout_weeks: int = 26) -> DataFrame:
    """One model per crop and horizon: tree count from early stopping on its last weeks, then a refit on everything.

    ``rows``: ID, target and features. Returns crop, horizon_weeks, slot, n_trees, model, and the features with the cuts
    they were binned by. Levers are monotone.
    """
    spark, width = rows.sparkSession, len(features)
    edges = boosting.bin_edges(rows, features)
    table = written(boosting.binned(rows, features, edges, [*ID, "target"]).withColumn("rid", _row_id()), "crop", "horizon_weeks")
    found = table.groupBy("crop", "horizon_weeks").agg(F.max("week_start").alias("last")).orderBy("crop", "horizon_weeks").collect()
    cells = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "slot int, crop string, horizon_weeks int, last date")
    # one row a cell
    known = table.join(F.broadcast(cells), ["crop", "horizon_weeks"]).select(
        "slot", "rid", F.col("target").alias("y"), (F.col("week_start") <= F.date_sub("last", 7 * holdout_weeks)).alias("training"), "bins")
    signs = monotone_signs(features)
    probe = boosting.fit(known, width, p, signs=signs)
    trees = {r["slot"]: max(1, r["n_trees"]) for r in probe.select("slot", "n_trees").collect()}
    models = boosting.fit(known.withColumn("training", F.lit(True)), width, p, signs=signs, most_trees=trees)
    cuts = spark.createDataFrame(
        [(crop, list(features), [c.tolist() for c in of]) for crop, of in edges.items()], "crop string, features array<string>, cuts array<array<double>>")
    return models.join(F.broadcast(cells), "slot").join(F.broadcast(cuts), "crop").select(
        "crop", "horizon_weeks", "slot", "n_trees", "model", "features", "cuts")


def fit_final_and_persist(rows: DataFrame, features: Sequence[str], path: str, p: boosting.Boosting) -> DataFrame:
    """The models of all crops and horizons, written as one table and read back."""
    fit_final(rows, features, p).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def batch_score(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Score every row with its crop's model at every horizon; prices, not logs. One scan for all models: each row is
    binned once, copied once a horizon, and finds its model by its slot."""
    cells = models.select("crop", "horizon_weeks", "slot")
    first = models.groupBy("crop").agg(F.first("features").alias("features"), F.first("cuts").alias("cuts")).collect()
    features = list(first[0]["features"])
    edges = {r["crop"]: [np.array(c) for c in r["cuts"]] for r in first}
    coded = boosting.binned(rows.select("*", *[F.col(f).alias(f"__f{i}") for i, f in enumerate(features)]),
                            [f"__f{i}" for i in range(len(features))], edges, rows.columns)
    # one row a crop and horizon
    scored = boosting.score(coded.join(F.broadcast(cells), "crop"), models, len(features))
    return scored.withColumn("forecast", F.expm1("prediction")).drop("bins", "slot", "prediction")


Override = tuple[str | None, str, str, str, float]


def scenario_rows(rows: DataFrame, overrides: Sequence[Override], baseline: str = "baseline") -> DataFrame:
    """Each row once per scenario of its crop and once unchanged.

    ``overrides``: (crop or None for all, scenario, column, 'set' or 'scale', value), a fixed list.
    """
    names = F.array(F.lit(baseline), *[
        F.when(F.lit(True) if crop is None else F.col("crop") == crop, F.lit(name))
        for crop, name in dict.fromkeys((o[0], o[1]) for o in overrides)])
    out = rows.withColumn("scenario", F.explode(F.array_compact(names)))
    changed = {}
    for column in dict.fromkeys(o[2] for o in overrides if o[2] in rows.columns):
        expr = F.col(column).cast("double")
        for crop, name, target, op, value in overrides:
            if target == column:
                new = F.lit(float(value)) if op == "set" else F.col(column) * value
                mine = F.col("scenario") == name if crop is None else (F.col("scenario") == name) & (F.col("crop") == crop)
                expr = F.when(mine, new).otherwise(expr)
        changed[column] = expr
    return out.withColumns(changed)


def scenario_effects(scored: DataFrame, keys: Sequence[str], baseline: str = "baseline", clamp: Sequence[str] = ()) -> DataFrame:
    """% change of each scenario against the row's own baseline.

    Scenarios named in ``clamp`` only raise levers that cannot raise the price: their forecast is held at
    the baseline and ``clamped`` says so. (MLlib trees take no monotone constraint.)
    """
    base = F.max(F.when(F.col("scenario") == baseline, F.col("forecast"))).over(Window.partitionBy(*keys))
    rows = scored.withColumn("baseline_forecast", base).where(F.col("scenario") != baseline)
    over = F.col("scenario").isin(list(clamp)) & (F.col("forecast") > F.col("baseline_forecast")) if clamp else F.lit(False)
    rows = rows.withColumn("clamped", over).withColumn(
        "forecast", F.when(F.col("clamped"), F.col("baseline_forecast")).otherwise(F.col("forecast")))
    effect = F.col("forecast") - F.col("baseline_forecast")
    return rows.withColumns({"effect": effect, "pct_change": effect / F.col("baseline_forecast") * 100})


def scenario_score(rows: DataFrame, overrides: Sequence[Override], score: Callable[[DataFrame], DataFrame],
                   keys: Sequence[str] = ("crop", "market_id", "horizon_weeks"), clamp: Sequence[str] = ()) -> DataFrame:
    """Override, score, compare: exact median, p10 and p90 of % change per (crop, scenario, horizon)."""
    scored = score(scenario_rows(rows, overrides))
    effects = materialise(scenario_effects(scored, keys, clamp=clamp).select("crop", "scenario", "horizon_weeks", "pct_change", "clamped"))
    cells = ["crop", "scenario", "horizon_weeks"]
    percentiles = ordered.exact_percentiles(effects, cells, "pct_change", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    share = effects.groupBy(*cells).agg(F.avg(F.col("clamped").cast("int")).alias("clamped_share"))
    return percentiles.join(share, cells)


def scenario_names_of_levers(overrides: Sequence[Override], levers: Sequence[str] = values.MONOTONE_DOWN_LEVERS) -> list[str]:
    """Scenarios that touch nothing but monotone levers."""
    touched: dict[str, set[str]] = {}
    for _, name, column, _, _ in overrides:
        touched.setdefault(name, set()).add(column)
    return [name for name, columns in touched.items() if columns <= set(levers)]


def one_at_a_time(changes: Sequence[tuple[str, str, float]], joint: str = "joint") -> list[Override]:
    """One scenario per changed column plus the joint one. ``changes``: (column, op, value)."""
    single = [(None, column, column, op, value) for column, op, value in changes]
    return single + [(None, joint, column, op, value) for column, op, value in changes]


def interaction_gap(effects: DataFrame, keys: Sequence[str], joint: str = "joint") -> DataFrame:
    """Joint effect in price units, sum of the single effects, and what is left between them."""
    is_joint = F.col("scenario") == joint
    out = effects.groupBy(*keys).agg(
        F.max(F.when(is_joint, F.col("effect"))).alias("joint_effect"),
        F.sum(F.when(~is_joint, F.col("effect"))).alias("sum_of_singles"))
    return out.withColumn("interaction_gap", F.col("joint_effect") - F.col("sum_of_singles"))


def ranked_effects(effects: DataFrame, keys: Sequence[str], joint: str = "joint") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.abs("effect").desc(), "scenario")
    return effects.where(F.col("scenario") != joint).withColumn("rank", F.row_number().over(w))


def leave_one_episode_out(rows: DataFrame, features: Sequence[str], episodes: Sequence[tuple[str, str, str]],
                          lookback_weeks: int = 10, iterations: int = 20) -> DataFrame:
    """One row per episode: (crop, episode, score_type, reason, n_scored, n, n_positive, auc, avg_precision).

    ``rows``: crop, week_start, label, episode and features, one row per crop-week. The positive class is weighted by
    negatives over positives. ``held_out``: a classifier that never saw the episode, tested on its weeks and the quiet
    ones around it; ``n_scored`` also counts the other weeks from three lookbacks before the day to one after it.
    ``in_sample``: the only episode of its crop, fitted and scored on all weeks; that is no test, so it has no metrics.
    ``skipped``: the training labels are of one class, as ``reason`` says.
    """
    vectors = materialise(assemble(rows.dropna(subset=list(features)), features).select(
        "crop", "week_start", "label", "episode", "features"))

    def run(episode) -> tuple[tuple, DataFrame | None]:
        name, crop, day = episode
        alone = sum(o[1] == crop for o in episodes) < 2
        mine = vectors.where(F.col("crop") == crop)
        train = mine if alone else mine.where(F.col("episode") != name)
        n, pos = train.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not pos or pos == n:
            reason = "no training weeks" if not n else f"all training labels are {int(pos > 0)}"
            return (crop, name, "skipped", reason), None
        weighted = train.withColumn("w", F.when(F.col("label") == 1, (n - pos) / pos).otherwise(1.0))
        model = GBTClassifier(labelCol="label", weightCol="w", maxIter=iterations, maxDepth=4, seed=42).fit(weighted)
        day_col = F.lit(day).cast("date")
        week, end = F.col("week_start"), F.date_add(day_col, 7 * lookback_weeks)
        around = week.between(F.date_sub(day_col, 7 * 4 * lookback_weeks), end)
        wide = week.between(F.date_sub(day_col, 7 * 3 * lookback_weeks), end)
        tested = F.lit(False) if alone else (F.col("episode") == name) | (around & (F.col("label") == 0))
        scored = model.transform(mine.withColumn("tested", tested).where(F.lit(alone) | F.col("tested") | wide)).select(
            "crop", F.lit(name).alias("episode"), "tested", "label", vector_to_array("probability")[1].alias("score"))
        return (crop, name, "in_sample" if alone else "held_out", None), scored

    done = _each(episodes, run)
    out = rows.sparkSession.createDataFrame([about for about, _ in done], "crop string, episode string, score_type string, reason string")
    parts = [scored for _, scored in done if scored is not None]
    if not parts:
        return out.selectExpr("*", "0L AS n_scored", "CAST(NULL AS BIGINT) AS n", "CAST(NULL AS BIGINT) AS n_positive",
                              "CAST(NULL AS DOUBLE) AS auc", "CAST(NULL AS DOUBLE) AS avg_precision")
    keys = ["crop", "episode"]
    scores = materialise(reduce(DataFrame.unionByName, parts))
    counts = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scored"))
    metrics = I.rank_metrics(scores.where("tested"), keys, "label", "score")
    return out.join(counts, keys, "left").join(metrics, keys, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))


def oof_then_residual(features_df: DataFrame, base: Sequence[str], rich: Sequence[str], horizons: Sequence[int],
                      folds: Sequence[E.Fold], p: boosting.Boosting) -> DataFrame:
    """Two phases over expanding folds.

    Phase one predicts each fold's test rows out of fold. Phase two learns the residual of those
    predictions, on earlier folds only, and is added to phase one; it has no validation rows, so it grows all trees.
    """
    data = training_rows(features_df, list(dict.fromkeys([*base, *rich])), horizons, folds)
    width = len(data.columns)
    tests = data.splits().where(F.col("split") == "test")
    oof = materialise(boosting.score(tests, fit_cells(data, p, base), width).withColumnRenamed("prediction", "oof_pred").drop("slot", "split"))
    residual = oof_residual_join(oof.drop("oof_pred"), oof.select(*ID, "fold", "oof_pred"), [*ID, "fold"])
    first = min(fold for _, _, _, fold in data.cells)
    later = [(i, c, h, f) for i, (c, h, f) in enumerate(sorted((c, h, f) for _, c, h, f in data.cells if f > first))]
    # one row a cell
    cells = F.broadcast(data.rows.sparkSession.createDataFrame(later, "slot int, crop string, horizon_weeks int, later int"))
    known = residual.join(cells, ["crop", "horizon_weeks"])
    models = boosting.fit(
        known.where(F.col("fold") < F.col("later")).select("slot", "rid", F.col("residual").alias("y"), F.lit(True).alias("training"), "bins"),
        width, p, data.at(rich), monotone_signs(rich))
    scored = boosting.score(known.where(F.col("fold") == F.col("later")).drop("later"), models, width)
    out = scored.withColumn("combined", F.col("oof_pred") + F.col("prediction"))
    pairs = F.array(F.struct(F.lit("phase1").alias("variant"), F.col("oof_pred").alias("p")),
                    F.struct(F.lit("combined").alias("variant"), F.col("combined").alias("p")))
    return out.select("crop", "fold", "horizon_weeks", "market_id", "week_start", "target", F.inline(pairs)).select(
        "variant", "crop", "fold", "horizon_weeks", "market_id", "week_start",
        F.expm1("target").alias("y_true"), F.expm1("p").alias("y_pred"))


def matched_history_compare(features_df: DataFrame, features: Sequence[str], horizons: Sequence[int], folds: Sequence[E.Fold],
                            floor: str, p: boosting.Boosting) -> DataFrame:
    """Same test rows, training from ``floor`` against the whole history; errors side by side and their gap."""
    data = training_rows(features_df, features, horizons, folds)
    preds = [train_eval(with_floor(data, start), p, name) for name, start in (("short", floor), ("long", None))]
    s = E.fold_mean_summary(E.forecast_metrics(reduce(DataFrame.unionByName, preds), rounded=False), rounded=False)
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    wide = s.groupBy("crop", "horizon_weeks").agg(*[
        pick(v, c).alias(f"{c}_{v}") for v in ("short", "long") for c in ("RMSE", "MAPE", "R2")])
    return wide.withColumn("delta_MAPE", F.col("MAPE_long") - F.col("MAPE_short"))


_ARIMA = T.ArrayType(T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType())]))


def _css_arima(series: np.ndarray, steps: int) -> list[tuple[int, float]]:
    """ARIMA(1,1,1) without constant: conditional sum of squares on a (phi, theta) grid, refined once."""
    d = np.diff(series)

    def squares(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        e = np.zeros(phi.shape)
        total = np.zeros(phi.shape)
        for t in range(1, len(d)):
            e = d[t] - phi * d[t - 1] - theta * e
            total += e * e
        return total

    centre, width = (0.0, 0.0), 0.95
    for _ in range(3):
        axis = np.linspace(-width, width, 21)
        phi, theta = np.meshgrid(np.clip(centre[0] + axis, -0.99, 0.99), np.clip(centre[1] + axis, -0.99, 0.99))
        best = np.unravel_index(np.argmin(squares(phi, theta)), phi.shape)
        centre, width = (float(phi[best]), float(theta[best])), width / 10
    phi, theta = centre
    e = 0.0
    for t in range(1, len(d)):
        e = d[t] - phi * d[t - 1] - theta * e
    level, change, out = series[-1], d[-1], []
    for s in range(1, steps + 1):
        change = phi * change + (theta * e if s == 1 else 0.0)
        level = level + change
        out.append((s, float(level)))
    return out


def per_series_arima(arrays: DataFrame, steps: int, min_points: int = 52) -> DataFrame:
    """Forecast per market series (weeks, series of log prices); short series are skipped.

    Grid search on the conditional sum of squares, so coefficients differ slightly from exact likelihood.
    """
    @F.pandas_udf(_ARIMA)
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([
            [{"step": s, "forecast": v} for s, v in _css_arima(np.asarray(x, float), steps)] if len(x) >= min_points else []
            for x in series])

    rest = [c for c in arrays.columns if c not in ("weeks", "series")]
    return spread(arrays).select(*rest, F.element_at("weeks", -1).alias("__last"), F.inline(run("series"))).select(
        *rest, F.date_add(F.date_from_unix_date("__last"), F.col("step") * 7).alias("week_start"), "step", "forecast")


def _with_successor(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the value of the next row of the same keys in the given order; the last row takes the first one's.

    The order is laid out by range partitions. A window sees the rows of one partition, and the first row of each
    partition, one for a key and partition, fills the gap at the end of the one before.
    """
    placed = materialise(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order)
    heads = placed.groupBy(*keys, "__part").agg(F.min_by(value, F.struct(*order)).alias("__head"))
    parts = Window.partitionBy(*keys).orderBy("__part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("__next", F.coalesce(F.lead("__head").over(parts), F.first("__head").over(whole))).drop("__head")
    return placed.withColumn("__lead", F.lead(value).over(inside)).join(heads, [*keys, "__part"]).withColumn(
        out, F.coalesce("__lead", "__next")).drop("__part", "__lead", "__next")


def permutation_importance(rows: DataFrame, model, features: Sequence[str], keys: Sequence[str] = ("crop", "horizon_weeks"),
                           seed: int = 42) -> DataFrame:
    """Rise of the squared error when one feature is shuffled: (keys, feature, importance).

    A row takes the feature of its successor in the order of a seeded hash, whatever the number of rows. All
    features share that one pass and one scoring job.
    """
    ident = F.xxhash64(*[F.col(c) for c in ("crop", "market_id", "week_start")], F.lit(seed))
    mixed = _with_successor(
        rows.withColumns({"__h": ident, "__x": vector_to_array("features")}).select(*keys, "target", "__h", "market_id", "week_start", "__x"),
        keys, ["__h", "market_id", "week_start"], "__x", "__other")

    def swapped(i: int) -> Column:
        return F.transform("__x", lambda v, at: F.when(at == i, F.element_at("__other", i + 1)).otherwise(v))

    variants = F.array(F.struct(F.lit("").alias("feature"), F.col("__x").alias("x")), *[
        F.struct(F.lit(f).alias("feature"), swapped(i).alias("x")) for i, f in enumerate(features)])
    long = mixed.select(*keys, "target", F.inline(variants)).select(*keys, "target", "feature", array_to_vector("x").alias("features"))
    err = F.col("target") - F.col("prediction")
    mse = model.transform(long).groupBy(*keys, "feature").agg(F.avg(err * err).alias("mse"))
    base = F.max(F.when(F.col("feature") == "", F.col("mse"))).over(Window.partitionBy(*keys))
    return mse.withColumn("__base", base).where(F.col("feature") != "").select(
        *keys, "feature", F.greatest(F.col("mse") - F.col("__base"), F.lit(0.0)).alias("importance"))


def cell_importance(data: TrainingSet, models: DataFrame, seed: int = 42) -> DataFrame:
    """(crop, horizon_weeks, fold, feature, importance): rise of the squared error of a cell's test rows when one feature
    is shuffled. A row takes the feature of its successor in the order of a seeded hash, as in
    ``permutation_importance``; only trees that split on the feature are walked again, and no row is copied."""
    tests = data.splits().where(F.col("split") == "test").withColumn(
        "__h", F.xxhash64("crop", "market_id", "week_start", F.lit(seed)))
    mixed = _with_successor(
        tests.select("slot", F.col("target").alias("y"), "__h", "market_id", "week_start", "bins"), ["slot"], ["__h", "market_id", "week_start"], "bins", "other")
    sums = boosting.swap_errors(mixed, models, len(data.columns)).withColumn("mse", F.col("sse") / F.col("n"))
    base = F.max(F.when(F.col("feature") == -1, F.col("mse"))).over(Window.partitionBy("slot"))
    spark = data.rows.sparkSession
    cells = spark.createDataFrame(data.cells, "slot int, crop string, horizon_weeks int, fold int")
    names = spark.createDataFrame(list(enumerate(data.columns)), "feature int, name string")
    return sums.withColumn("base", base).join(F.broadcast(cells), "slot").join(F.broadcast(names), "feature").select(
        "crop", "horizon_weeks", "fold", F.col("name").alias("feature"),
        F.greatest(F.col("mse") - F.col("base"), F.lit(0.0)).alias("importance"))
