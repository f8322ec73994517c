"""Training, scoring and scenarios. Prices here are random, so errors only show that the jobs run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.cleaning import SEASONS
from catalog.joins import FOLDS, master_panel
from catalog.registry import query
from catalog.windows import EPISODES, KEYS, crop_week, roll
from pricegrid import values
from pricegrid.operators import aggregates as A
from pricegrid.operators import early_warning
from pricegrid.operators import evaluation as E
from pricegrid.operators import inference as I
from pricegrid.operators import windows as W
from pricegrid.plans import features as X
from pricegrid.plans import forecasting as H
from pricegrid.plans.boosting import Boosting, Forest
from pricegrid.session import ensure_checkpoint_dir

PRICE = X.PRICE_FEATURES
MORE = PRICE + X.ARRIVAL_FEATURES
LAYERS = {"price": PRICE, "arrivals": X.ARRIVAL_FEATURES, "macro": ["n_orders", "repo", "usdinr", "diesel"], "climate": ["heat", "rain"],
          "satellite": ["ndvi"], "infrastructure": ["wage", "capacity", "n_facilities", "density"], "policy": ["export_banned"]}
EVERY = [c for columns in LAYERS.values() for c in columns]
# published maxima; boosting with validation rows stops 50 trees after the best one
BOOSTING = Boosting(trees=1000)
SPIKE_TREES, EPISODE_TREES = 500, 200
FOREST = Forest(300, 20)


def features(spark, sf):
    panel = fx.panel(spark, sf).join(fx.states(spark, sf), "market_id")
    return X.build_features(panel, fx.LAST_BASE_YEAR, SEASONS)


def layered_features(spark, sf):
    """All features with the columns of every layer."""
    return X.build_features(master_panel(spark, sf), fx.LAST_BASE_YEAR, SEASONS)


def _feature_sql() -> str:
    """Every feature column of the panel, written out over the same frames."""
    over = "OVER (PARTITION BY crop, market_id ORDER BY week_start)"
    month = "month(week_start)"
    columns = {f"price_lag_{k}": f"lag(log_price, {k}) {over}" for k in values.PRICE_LAGS}
    columns |= {f"price_roll_{name}_{n}": roll(fn, "log_price", n)
                for name, fn in (("mean", "avg"), ("std", "stddev_samp")) for n in values.PRICE_WINDOWS}
    columns["price_yoy"] = f"lag(log_price, 52) {over}"
    columns |= {f"{fn}{k}_week": f"{fn}({2 * (k or 1)} * pi() * week(week_start) / 52)" for k in ("", 2) for fn in ("sin", "cos")}
    columns["log_arr"] = "log_arr"
    columns |= {f"arr_lag_{k}": f"lag(log_arr, {k}) {over}" for k in values.ARRIVAL_LAGS}
    columns |= {f"arr_roll_mean_{n}": roll("avg", "log_arr", n) for n in values.ARRIVAL_WINDOWS}
    whole = {"iso_week": "week(week_start)", "year_trend": f"year(week_start) - {fx.LAST_BASE_YEAR}",
             "market_enc": "dense_rank() OVER (PARTITION BY crop ORDER BY market_id) - 1",
             "state_enc": "dense_rank() OVER (PARTITION BY crop ORDER BY state) - 1"}
    for season in sorted({s for table in SEASONS.values() for s in table}):
        months = [f"(crop = '{c}' AND {month} IN ({', '.join(map(str, table[season]))}))" for c, table in SEASONS.items() if season in table]
        whole[f"season_{season}"] = " OR ".join(months)
    shown = [f"rnd({e}, 6) AS {c}" for c, e in columns.items()] + [f"CAST({e} AS INTEGER) AS {c}" for c, e in whole.items()]
    return f"SELECT crop, market_id, week_start, {', '.join(shown)} FROM logs JOIN markets USING (market_id)"


@query("build_features", _feature_sql())
def build_features(spark, sf):
    rows = features(spark, sf)
    kinds = dict(rows.dtypes)
    return rows.select(*KEYS, *[fx.r(c, 6) if kinds[c] == "double" else F.col(c).cast("int").alias(c) for c in MORE])


@query("layered_feature_sets")
def layered_feature_sets(spark, sf):
    rows = layered_features(spark, sf)
    sets = X.layered_feature_sets(LAYERS, rows.columns)
    filled = rows.agg(*[F.count(c).alias(c) for c in sets["M6"]])
    entries = [F.struct(F.lit(m).alias("variant"), F.lit(c).alias("feature"), F.col(c).alias("n_filled")) for m, cols in sets.items() for c in cols]
    return filled.select(F.inline(F.array(*entries)))


@query("train_eval_gbt")
def train_eval_gbt(spark, sf):
    data = H.training_rows(features(spark, sf), MORE, values.HORIZONS, FOLDS)
    return E.forecast_metrics(H.train_eval(data, BOOSTING, "M1"))


@query("model_family_compare")
def model_family_compare(spark, sf):
    data = H.training_rows(features(spark, sf), MORE, values.HORIZONS, FOLDS)
    return H.model_family_compare(data, {"gbt": BOOSTING, "random_forest": FOREST})


@query("spike_classifier")
def spike_classifier(spark, sf):
    labelled = E.spike_label(features(spark, sf), "1997-12-31").select("crop", "week_start", "spike", *MORE)
    return H.spike_classifier(labelled, MORE, FOLDS, SPIKE_TREES)


_SAVED: dict[tuple[str, str], str] = {}


def saved_models(spark, sf):
    """Models of all crops and horizons, fitted once a session and table folder, each time into a folder of its own."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED:
        rows = E.with_targets(features(spark, sf), values.HORIZONS).select(*H.ID, "target", *MORE)
        path = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
        H.fit_final_and_persist(rows, MORE, path, BOOSTING)
        _SAVED[key] = path
    return spark.read.parquet(_SAVED[key])


def reference_rows(spark, sf):
    return W.tail_n_per_key(features(spark, sf), 1).where(F.col("log_price").isNotNull())


@query("fit_final_and_persist")
def fit_final_and_persist(spark, sf):
    return saved_models(spark, sf).select(
        F.concat_ws("_", "crop", F.concat(F.col("horizon_weeks").cast("string"), F.lit("w"))).alias("model"), "n_trees")


@query("batch_score")
def batch_score(spark, sf):
    out = H.batch_score(reference_rows(spark, sf), saved_models(spark, sf))
    return out.select("crop", "market_id", "horizon_weeks", fx.r("forecast"))


OVERRIDES = [(None, "cost_shock", "price_lag_1", "scale", 1.1), ("N", "duty", "price_lag_4", "set", 7.0), ("N", "ban", "price_lag_4", "set", 6.0),
             ("N", "ban", "price_lag_1", "scale", 0.9), ("R", "storage_down", "log_arr", "scale", 0.8)]


@query("scenario_rows", """
WITH b AS (SELECT crop, market_id, week_start, lag(log_price) OVER w AS l1, lag(log_price, 4) OVER w AS l4, log_arr FROM logs WINDOW w AS (PARTITION BY crop, market_id ORDER BY week_start)),
s AS (SELECT *, unnest(CASE crop WHEN 'A' THEN ['baseline', 'cost_shock'] WHEN 'N' THEN ['baseline', 'cost_shock', 'duty', 'ban'] ELSE ['baseline', 'cost_shock', 'storage_down'] END) AS scenario FROM b)
SELECT crop, market_id, week_start, scenario, rnd(CASE scenario WHEN 'cost_shock' THEN l1 * 1.1 WHEN 'ban' THEN l1 * 0.9 ELSE l1 END, 6) AS price_lag_1,
  rnd(CASE scenario WHEN 'duty' THEN 7.0 WHEN 'ban' THEN 6.0 ELSE l4 END, 6) AS price_lag_4, rnd(CASE scenario WHEN 'storage_down' THEN log_arr * 0.8 ELSE log_arr END, 6) AS log_arr FROM s
""")
def scenario_rows(spark, sf):
    rows = W.lags(fx.logs(spark, sf), "log_price", "price_lag_", [1, 4]).select(*KEYS, "price_lag_1", "price_lag_4", "log_arr")
    out = H.scenario_rows(rows, OVERRIDES)
    return out.select(*KEYS, "scenario", fx.r("price_lag_1", 6), fx.r("price_lag_4", 6), fx.r("log_arr", 6))


@query("scenario_score")
def scenario_score(spark, sf):
    models = saved_models(spark, sf)
    return H.scenario_score(reference_rows(spark, sf), OVERRIDES, lambda rows: H.batch_score(rows, models))


def closed_form():
    return F.expm1(F.col("price_lag_1") * 0.7 + F.col("price_lag_4") * 0.3)


@query("monotone_levers", """
WITH b AS (SELECT crop, market_id, week_start, lag(log_price) OVER w AS l1, lag(log_price, 4) OVER w AS l4 FROM logs WINDOW w AS (PARTITION BY crop, market_id ORDER BY week_start)),
f AS (SELECT crop, market_id, week_start, exp(l1 * 0.7 + l4 * 0.3) - 1 AS base, exp(l1 * 0.7 + 7.0 * 0.3) - 1 AS duty FROM b WHERE crop = 'N' AND l1 IS NOT NULL AND l4 IS NOT NULL)
SELECT crop, market_id, week_start, duty > base AS clamped, rnd(least(duty, base), 4) AS forecast FROM f
""")
def monotone_levers(spark, sf):
    rows = W.lags(fx.logs(spark, sf), "log_price", "price_lag_", [1, 4]).where((F.col("crop") == "N") & F.col("price_lag_1").isNotNull() & F.col("price_lag_4").isNotNull())
    overrides = [("N", "duty", "price_lag_4", "set", 7.0)]
    scored = H.scenario_rows(rows.select(*KEYS, "price_lag_1", "price_lag_4"), overrides).withColumn("forecast", closed_form())
    clamp = H.scenario_names_of_levers(overrides, ["price_lag_4"])
    return H.scenario_effects(scored, KEYS, clamp=clamp).select(*KEYS, "clamped", fx.r("forecast"))


@query("one_at_a_time_effects", """
WITH b AS (SELECT crop, market_id, week_start, lag(log_price) OVER w AS l1, lag(log_price, 4) OVER w AS l4 FROM logs WINDOW w AS (PARTITION BY crop, market_id ORDER BY week_start)),
f AS (SELECT *, exp(l1 * 0.7 + l4 * 0.3) - 1 AS base, exp(l1 * 1.01 * 0.7 + l4 * 0.3) - 1 AS a, exp(l1 * 0.7 + 7.0 * 0.3) - 1 AS c, exp(l1 * 1.01 * 0.7 + 7.0 * 0.3) - 1 AS j FROM b WHERE l1 IS NOT NULL AND l4 IS NOT NULL)
SELECT crop, market_id, week_start, rnd(j - base, 4) AS joint_effect, rnd((a - base) + (c - base), 4) AS sum_of_singles, rnd((j - base) - ((a - base) + (c - base)), 4) AS interaction_gap FROM f
""")
def one_at_a_time(spark, sf):
    rows = W.lags(fx.logs(spark, sf), "log_price", "price_lag_", [1, 4]).where(F.col("price_lag_1").isNotNull() & F.col("price_lag_4").isNotNull())
    overrides = H.one_at_a_time([("price_lag_1", "scale", 1.01), ("price_lag_4", "set", 7.0)])
    scored = H.scenario_rows(rows.select(*KEYS, "price_lag_1", "price_lag_4"), overrides).withColumn("forecast", closed_form())
    out = H.interaction_gap(H.scenario_effects(scored, KEYS), KEYS)
    return out.select(*KEYS, fx.r("joint_effect"), fx.r("sum_of_singles"), fx.r("interaction_gap"))


@query("leave_one_episode_out")
def leave_one_episode_out(spark, sf):
    rows = W.walk_forward_climatology(crop_week(spark, sf), "price", ["crop"])
    rows = rows.withColumn("dev", F.col("price") / F.col("price_norm") - 1)
    rows = W.pct_change_k(W.pct_change_k(rows, "price", [4, 8], "price_pct_"), "arrivals", [4], "arrivals_pct_")
    rows = early_warning.episode_labels(rows, EPISODES, "dev", deviation=0.05)
    return H.leave_one_episode_out(rows, ["price_pct_4", "price_pct_8", "arrivals_pct_4", "dev"], EPISODES, iterations=EPISODE_TREES)


@query("oof_then_residual")
def oof_then_residual(spark, sf):
    out = H.oof_then_residual(features(spark, sf), PRICE, MORE, values.HORIZONS, FOLDS, BOOSTING)
    return E.forecast_metrics(out)


@query("matched_history_compare")
def matched_history_compare(spark, sf):
    return H.matched_history_compare(features(spark, sf), MORE, values.HORIZONS, FOLDS, "1996-07-01", BOOSTING)


@query("per_series_arima")
def per_series_arima(spark, sf):
    series = I.series_arrays(fx.logs(spark, sf), ["crop", "market_id"], "log_price")
    return H.per_series_arima(series, 4)


@query("layer_importance")
def layer_importance(spark, sf):
    data = H.training_rows(layered_features(spark, sf), EVERY, values.HORIZONS, FOLDS)
    parts = H.cell_importance(data, H.fit_cells(data, BOOSTING)).drop("fold")
    layer_of = {f: layer for layer, columns in LAYERS.items() for f in columns}
    return A.importance_by_layer(parts, layer_of)
