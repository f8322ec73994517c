"""The registered forecasting queries do the whole backtest."""

import pytest
from pyspark.sql import functions as F

from catalog import forecasting as C
from catalog.joins import FOLDS
from pricegrid.operators import evaluation as E
from pricegrid.operators import windows as W
from pricegrid.plans import features as X
from pricegrid.plans import forecasting as H
from pricegrid.plans.boosting import Boosting, Forest

SF = "/root/testdata/sf0.001"
BACKTESTS = [C.train_eval_gbt, C.model_family_compare, C.oof_then_residual, C.matched_history_compare, C.layer_importance]
ROWS = {"train_eval_gbt": 36, "model_family_compare": 24, "oof_then_residual": 48, "matched_history_compare": 12, "layer_importance": 84}


class Seen(Exception):
    pass


@pytest.mark.parametrize("run", BACKTESTS, ids=lambda f: f.__name__)
def test_backtests_take_every_fold_horizon_and_feature(spark, monkeypatch, run):
    def training_rows(rows, features, horizons, folds, *args):
        assert {*features} >= {*X.PRICE_FEATURES, *X.ARRIVAL_FEATURES} and {*features} <= set(rows.columns)
        assert list(horizons) == [1, 4, 13, 26] and list(folds) == FOLDS
        raise Seen

    monkeypatch.setattr(H, "training_rows", training_rows)
    with pytest.raises(Seen):
        run(spark, SF)
    assert C.BOOSTING == Boosting(trees=1000, patience=50) and (C.FOREST.trees, C.FOREST.depth) == (300, 20)


@pytest.mark.parametrize("run", BACKTESTS, ids=lambda f: f.__name__)
def test_backtests_run_to_the_end(spark, monkeypatch, run):
    # whole backtests; only the ensembles are smaller
    monkeypatch.setattr(C, "BOOSTING", Boosting(trees=30, patience=5, min_leaf=5))
    monkeypatch.setattr(C, "FOREST", Forest(trees=20))
    cells = H.training_rows(C.features(spark, SF), C.MORE, [1, 4, 13, 26], FOLDS).cells
    out = run(spark, SF)
    n = out.count()
    assert len(cells) <= 36 and 0 < n <= ROWS[run.__name__]
    if run is C.train_eval_gbt:
        assert n == len(cells)


def test_models_are_fitted_once_and_score_every_row_at_every_horizon(spark, monkeypatch):
    monkeypatch.setattr(C, "BOOSTING", Boosting(trees=20, patience=5))
    monkeypatch.setattr(C, "_SAVED", {})
    models = C.fit_final_and_persist(spark, SF)
    assert models.count() == 12 and models.where("n_trees < 1").count() == 0
    folder = dict(C._SAVED)
    out = C.batch_score(spark, SF)
    assert out.count() == 4 * C.reference_rows(spark, SF).count() and out.where("forecast IS NULL").count() == 0
    effects = {(r["crop"], r["scenario"], r["horizon_weeks"]): r for r in C.scenario_score(spark, SF).collect()}
    assert len(effects) == 4 * (3 + 2 + 1) and C._SAVED == folder


def test_no_scenario_that_raises_only_a_lever_raises_a_forecast(spark):
    features = [*C.MORE, "export_banned"]
    base = C.features(spark, SF).withColumn("export_banned", (F.col("iso_week") % 3 == 0).cast("double"))
    # in the history the lever comes with high prices
    rows = E.with_targets(base.withColumn("log_price", F.col("log_price") + F.col("export_banned")), [1, 4]).select(*H.ID, "target", *features)
    models = H.fit_final(rows, features, Boosting(trees=25, patience=5, min_leaf=5))
    last = W.tail_n_per_key(base, 1).where("log_price IS NOT NULL").withColumn("export_banned", F.lit(0.0))
    overrides = [(None, "ban", "export_banned", "set", 1.0)]
    clamp = H.scenario_names_of_levers(overrides)
    out = H.scenario_score(last, overrides, lambda r: H.batch_score(r, models), clamp=clamp).collect()
    assert clamp == ["ban"] and len(out) == 6 and all(r["clamped_share"] == 0 and r["p90"] <= 0 for r in out)


def test_every_layer_is_reported(spark):
    rows = C.layered_feature_sets(spark, SF).groupBy("variant").agg(F.collect_set("feature").alias("f"), F.min("n_filled").alias("n")).collect()
    sets = {r.variant: set(r.f) for r in rows}
    assert sorted(sets) == [f"M{i}" for i in range(7)] and sets["M6"] == set(C.EVERY)
    assert sets["M6"] - sets["M5"] == {"export_banned"} and all(r.n > 0 for r in rows)


def test_every_episode_has_a_row(spark):
    import datetime as dt

    first = dt.date(2018, 1, 1)
    episodes = [("a1", "A", "2018-12-31"), ("a2", "A", "2019-12-30"), ("n1", "N", "2018-12-31"), ("r1", "R", "2018-12-31"), ("r2", "R", "2019-12-30")]
    rows = []
    for crop in "ANR":
        for i in range(130):
            week = first + dt.timedelta(weeks=i)
            name = next((e for e, c, day in episodes if c == crop and e != "r2" and 0 < (dt.date.fromisoformat(day) - week).days <= 56), "")
            rows.append((crop, week, int(name != ""), name, float(name != "") + i % 5 / 10))
    df = spark.createDataFrame(rows, "crop string, week_start date, label int, episode string, x double")
    got = {r.episode: r for r in H.leave_one_episode_out(df, ["x"], episodes, iterations=2).collect()}
    assert {e: r.score_type for e, r in got.items()} == {"a1": "held_out", "a2": "held_out", "n1": "in_sample", "r1": "skipped", "r2": "held_out"}
    assert got["r1"].reason == "all training labels are 0" and got["r1"].n_scored == 0
    assert got["a1"].auc == 1 and got["a1"].n_positive == 8 and got["r2"].auc is None
    assert got["n1"].n_scored == 130 and got["n1"].auc is None and got["n1"].reason is None
