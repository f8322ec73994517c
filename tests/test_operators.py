"""Cleaning, joins, policy, quality, windows and sources on hand-made frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid import schemas, values
from pricegrid.functions import calendar as cal
from pricegrid.functions import scalars
from pricegrid.operators import cleaning as C
from pricegrid.operators import early_warning
from pricegrid.operators import evaluation as E
from pricegrid.operators import joins as J
from pricegrid.operators import pixels as X
from pricegrid.operators import policy
from pricegrid.operators import quality as Q
from pricegrid.operators import sets as S
from pricegrid.operators import windows as W
from pricegrid.sources import incremental, readers, reshape, writers

D = dt.date


def weeks(n, start=D(2020, 1, 6)):
    return [start + dt.timedelta(weeks=i) for i in range(n)]


def test_year_boundary(spark):
    row = spark.createDataFrame([(D(2021, 1, 1),)], "d date").select(
        cal.iso_year("d").alias("y"), cal.iso_week("d").alias("w"), cal.week_start("d").alias("m"), cal.day_of_week("d").alias("dow")).first()
    assert tuple(row) == (2020, 53, D(2020, 12, 28), 4)


def test_labels_get_the_state_only_where_names_collide(spark):
    df = spark.createDataFrame([("onion", "Fatehabad", 1, "HR"), ("onion", "Fatehabad", 2, "UP"), ("onion", "Kolar", 3, "KA"), ("potato", "Fatehabad", 2, "UP")],
                               "crop string, market string, market_id long, state string")
    got = {(r.crop, r.market_id): r.label for r in C.disambiguate_labels(df, ["crop"], "market", "market_id", "state").collect()}
    assert got == {("onion", 1): "Fatehabad (HR)", ("onion", 2): "Fatehabad (UP)", ("onion", 3): "Kolar", ("potato", 2): "Fatehabad"}


def test_checked_join_raises_on_a_duplicate_key_and_keeps_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, x int")
    assert sorted((r.k, r.v, r.x) for r in J.checked_left_join(left, right, ["k"]).collect()) == [(1, "a", 10), (2, "b", None), (2, "c", None)]
    twice = right.unionByName(spark.createDataFrame([(1, 11)], "k int, x int"))
    with pytest.raises(Exception, match="wages: duplicate key 1"):
        J.checked_left_join(left, twice, ["k"], "wages").collect()
    # unused layer columns are pruned together with the join, and then nothing can fan out
    assert J.checked_left_join(left, twice, ["k"], "wages").select("v").agg(F.count(F.lit(1))).first()[0] == 3


def test_climatology_uses_earlier_years_only(spark):
    rows = [("z", cal_day, v) for cal_day, v in [(D(2018, 3, 5), 1.0), (D(2019, 3, 4), 3.0), (D(2020, 3, 2), 8.0)]]
    df = spark.createDataFrame(rows, "zone string, week_start date, v double")
    got = [(r.v_norm, r.v_anom) for r in W.walk_forward_climatology(df, "v", ["zone"]).orderBy("week_start").collect()]
    assert got == [(None, None), (1.0, 2.0), (2.0, 6.0)]


def test_trailing_excludes_and_inclusive_includes_the_current_row(spark):
    df = spark.createDataFrame([("c", d, float(i)) for i, d in enumerate(weeks(4))], "crop string, week_start date, x double")
    out = W.trailing_mean_inclusive(W.trailing(df, "x", "mean", [4], "t", ["crop"]), "x", "i").orderBy("week_start").collect()
    assert [r.t4 for r in out] == [None, None, 0.5, 1.0] and [r.i for r in out] == [None, 0.5, 1.0, 1.5]


def test_limited_forward_fill(spark):
    df = spark.createDataFrame([("z", w, 1.0 if i in (0, 6) else None) for i, w in enumerate(weeks(8)) if i in (0, 6, 7)], "zone string, week_start date, v double")
    got = [r.v for r in W.grid_ffill_limited(df, ["v"], 3, ["zone"]).orderBy("week_start").collect()]
    assert got == [1, 1, 1, 1, None, None, 1, 1]


def log(spark, events):
    return spark.createDataFrame(events, "crop string, effective_date date, policy_type string, price_usd_per_mt double, description string")


def test_policy_state_machine(spark):
    events = log(spark, [
        ("onion", D(2017, 12, 31), "minimum_export_price", 850.0, "ended that day"),
        ("onion", D(2019, 9, 13), "minimum_export_price", 850.0, ""), ("onion", D(2019, 9, 29), "export_ban", None, ""),
        ("onion", D(2020, 3, 15), "export_ban_removal", None, ""), ("onion", D(2023, 8, 19), "export_duty", None, ""),
        ("onion", D(2023, 10, 28), "minimum_export_price", 800.0, ""), ("onion", D(2023, 12, 8), "export_ban", None, ""),
        ("onion", D(2024, 5, 4), "export_ban_removal", 550.0, "floor price, duty reiterated"),
        ("onion", D(2024, 9, 13), "minimum_export_price_removal", None, ""), ("onion", D(2025, 4, 1), "export_duty_removal", None, ""),
        ("onion", D(2025, 6, 1), "export_ban", None, "")])
    spans = policy.state_intervals(events, retrospective=F.col("effective_date") == "2017-12-31")
    got = sorted((r.lever, r.start, r.end, r.value) for r in spans.collect())
    assert got == sorted([
        ("export_banned", D(2019, 9, 29), D(2020, 3, 14), 1.0), ("export_banned", D(2023, 12, 8), D(2024, 5, 3), 1.0),
        ("export_banned", D(2025, 6, 1), D(2026, 12, 31), 1.0),
        ("mep_usd_per_tonne", D(2017, 12, 31), D(2017, 12, 31), 850.0), ("mep_usd_per_tonne", D(2019, 9, 13), D(2019, 9, 28), 850.0),
        ("mep_usd_per_tonne", D(2023, 10, 28), D(2023, 12, 7), 800.0), ("mep_usd_per_tonne", D(2024, 5, 4), D(2024, 9, 12), 550.0),
        ("export_duty_pct", D(2023, 8, 19), D(2024, 9, 13), 40.0), ("export_duty_pct", D(2024, 9, 14), D(2025, 3, 31), 20.0)])


def test_policy_weeks_overlap_and_first_interval_wins(spark):
    spans = spark.createDataFrame([("onion", "mep_usd_per_tonne", D(2020, 1, 8), D(2020, 1, 9), 1.0), ("onion", "mep_usd_per_tonne", D(2020, 1, 10), D(2020, 1, 13), 2.0)],
                                  "crop string, lever string, start date, end date, value double")
    grid = spark.createDataFrame([(c, w) for c in ("onion", "potato") for w in weeks(3)], "crop string, week_start date")
    hits = spark.createDataFrame([("potato", D(2020, 1, 15))], "crop string, event_date date")
    out = policy.policy_weekly_features(grid, spans, hits, "2020-01-14").orderBy("crop", "week_start").collect()
    assert [r.mep_usd_per_tonne for r in out] == [1, 2, 0, 0, 0, 0]
    assert [r.market_intervention_flag for r in out] == [0, 0, 0, 0, 1, 0]
    assert [r.operation_greens_active for r in out] == [0, 1, 1, 0, 1, 1]


def test_fallback_keeps_provenance(spark):
    states = spark.createDataFrame([("Goa",), ("Kerala",), ("Telangana",), ("Atlantis",)], "state string")
    series = spark.createDataFrame([("Kerala", 1, 5.0), ("Andhra Pradesh", 1, 6.0), ("India", 1, 7.0)], "state string, month int, wage double")
    proxies = spark.createDataFrame(values.WAGE_PROXIES, "entity string, proxy string, reason string")
    got = {r.state: (r.wage, r.source) for r in J.fallback_join(states, series, proxies, "state", "India").collect()}
    assert got["Kerala"] == (5.0, "direct") and got["Goa"] == (7.0, "India (no regional proxy - All-India fallback)")
    assert got["Telangana"] == (6.0, "Andhra Pradesh (parent-state proxy (split Jun-2014))") and got["Atlantis"][1].startswith("India (UNMAPPED")


def test_new_ids_continue_in_sorted_order(spark):
    known = spark.createDataFrame([("Goa", "Mapusa", 7)], "state string, market string, market_id long")
    rows = spark.createDataFrame([("goa ", "MAPUSA."), ("Goa", "Vasco"), ("Assam", "Tezpur"), ("Goa", "Ponda")], "state string, market string")
    got = {r.market: (r.market_id, r.is_new_id) for r in J.resolve_or_assign_id(rows, known).collect()}
    assert got == {"MAPUSA.": (7, False), "Tezpur": (8, True), "Ponda": (9, True), "Vasco": (10, True)}


def test_nearest_zone_and_first_listed_on_ties(spark):
    zones = [("onion", "far", 0.0, 10.0), ("onion", "a", 0.0, 1.0), ("onion", "b", 0.0, -1.0), ("potato", "here", 0.0, 0.0)]
    row = J.nearest_entity_join(spark.createDataFrame([("onion", 0.0, 0.0)], "crop string, lat double, lon double"), zones).first()
    assert row.zone_id == "a" and row.dist_km == pytest.approx(math.radians(1) * 6371, abs=0.06)


def test_stale_rows_stay_out_of_the_live_validation(spark):
    f = spark.createDataFrame([("onion", 1, D(2020, 1, 6), 1, 5.0, True, False), ("onion", 2, D(2020, 1, 6), 1, 5.0, True, True), ("onion", 3, D(2020, 1, 6), 1, 5.0, False, False)],
                              "crop string, market_id long, week_start date, horizon_weeks int, forecast double, sufficient_history boolean, stale_reference boolean")
    a = spark.createDataFrame([("onion", m, D(2020, 1, 13), 6.0, 0) for m in (1, 2, 3)], "crop string, market_id long, week_start date, modal_price_weighted double, imputed int")
    assert [(r.market_id, r.actual_price) for r in J.forecast_actual_join(f, a).collect()] == [(1, 6.0)]


def test_validation_starts_after_its_first_day_and_embargo_is_optional(spark):
    fold = [(1, "2020-02-03", "2020-02-03", "2020-03-02", "2020-03-03", "2020-04-30")]
    df = spark.createDataFrame([(w,) for w in weeks(12)], "week_start date")
    split = lambda **o: {r.week_start: r.split for r in E.rolling_origin_splits(df, fold, **o).collect()}
    plain = split()
    assert plain[D(2020, 2, 3)] == "train" and plain[D(2020, 2, 10)] == "validation" and plain[D(2020, 3, 9)] == "test"
    held = split(embargo=4)
    assert held[D(2020, 1, 6)] == "train" and D(2020, 1, 13) not in held and held[D(2020, 3, 9)] == "test"


def test_metrics_have_no_r2_without_variation(spark):
    df = spark.createDataFrame([("v", "c", 1, 1, 10.0, 12.0), ("v", "c", 1, 1, 10.0, 8.0), ("v", "c", 1, 1, 0.0, 8.0), ("v", "c", 1, 1, 5.0, float("inf"))],
                               "variant string, crop string, fold int, horizon_weeks int, y_true double, y_pred double")
    row = E.forecast_metrics(df).first()
    assert (row.RMSE, row.MAE, row.MAPE, row.R2, row.N) == (2.0, 2.0, 20.0, None, 2)


def test_placebo_windows_keep_their_distance(spark):
    rows = spark.createDataFrame([("onion", w, 0.2 if i % 2 else 0.0, 1.0) for i, w in enumerate(weeks(130))], "crop string, week_start date, dev double, score double")
    episodes = [("e", "onion", "2020-06-01")]
    out = early_warning.placebo_windows(rows, episodes, "dev", "score").orderBy("end_week").collect()
    assert all(abs((r.end_week - D(2020, 6, 1)).days) >= 280 for r in out) and out[0].intensity == 1.0 and out[0].n_weeks == 10
    labels = early_warning.episode_labels(rows, episodes, "dev")
    assert labels.where("label = 1").agg(F.count(F.lit(1)), F.max("week_start")).first()[0] == 10


def test_snapshots_ignore_order_and_see_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    status = lambda b: Q.snapshot_equal(a, b, "t").first().status
    assert status(a.orderBy(F.desc("i"))) == "PASS" and status(a.distinct()) == "FAIL" and status(a.withColumn("s", F.lit("x"))) == "FAIL"
    assert status(a.select("i")) == "FAIL"


def test_phantom_tail_week_fails_and_sets_the_exit_code(spark):
    rows = [("onion", i, D(2020, 1, 6), 0) for i in range(4)] + [("onion", i, D(2020, 1, 13), 1) for i in range(4)] + [("potato", 1, D(2020, 1, 13), 0)]
    panel = spark.createDataFrame(rows, "crop string, market_id long, week_start date, imputed int")
    report = Q.check_report([Q.tail_week_imputed(panel), Q.freshness_days(panel, "2020-06-01"), Q.required_columns(spark, panel, ["market_id", "stale_reference"])])
    got = {(r.check, r.subject): r.status for r in report.collect()}
    assert got[("tail_week_imputed", "onion")] == "FAIL" and got[("tail_week_imputed", "potato")] == "PASS"
    assert got[("freshness_days", "onion")] == "WARN" and got[("required_columns", "stale_reference")] == "FAIL"
    assert Q.exit_code(report) == 1 and {r.status: r.n for r in Q.report_totals(report).collect()} == {"PASS": 2, "WARN": 2, "FAIL": 2}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    assert [r.x for r in C.null_default(df, {"x": 1.0}).collect()] == [1.0, 1.0, 2.0]


def test_histogram_takes_the_last_edge(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 9.9, 10.0, 90.0, 100.0)], "x double")
    assert [r.b for r in df.select(scalars.histogram_bin("x", values.COVERAGE_BINS).alias("b")).collect()] == [0, 0, 1, 5, 5]


def test_half_even_and_sample_repeat(spark):
    df = spark.range(2000).withColumn("crop", F.lit("onion"))
    draw = lambda frame: sorted(r.id for r in S.seeded_sample(frame, 40, "crop", ["id"], seed=7).collect())
    assert draw(df) == draw(df.repartition(13)) and len(draw(df)) == 40
    assert [r.b for r in spark.createDataFrame([(0.5,), (1.5,), (-0.5,)], "x double").select(F.bround("x", 0).cast("int").alias("b")).collect()] == [0, 2, 0]


def test_daily_curve_passes_knots_and_stays_monotone(spark):
    knots = [0, 7, 28, 91, 182]
    logs = [5.0, 5.1, 5.5, 5.5, 6.0]
    row = spark.createDataFrame([("onion", 1, D(2020, 1, 6), *logs, 0.1)], "crop string, market_id long, week_start date, a double, b double, c double, d double, e double, band double")
    out = W.daily_curve(row, knots, list("abcde"), "week_start", "band").orderBy("day").collect()
    trend = [r.trend for r in out]
    assert len(out) == 183 and out[-1].date == D(2020, 7, 6)
    for k, v in zip(knots, logs):
        assert trend[k] == pytest.approx(math.expm1(v), rel=1e-12)
    assert all(b >= a - 1e-9 for a, b in zip(trend, trend[1:])) and out[9].low == pytest.approx(0.9 * trend[9])


def test_half_month_and_masks(spark):
    df = spark.createDataFrame([(D(2026, 2, 15), 2, 0.1), (D(2026, 2, 16), 4, 0.2)], "date date, qc int, v double")
    out = X.quality_mask(df, X.low_bits_produced("qc"), ["v"]).withColumn("w", X.half_month_start("date")).orderBy("date").collect()
    assert [(r.w, r.v) for r in out] == [(D(2026, 2, 1), None), (D(2026, 2, 16), 0.2)]


# sources

def test_read_daily_drops_bad_dates_and_nulls_bad_numbers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("market_id,arrival_date,modal_price_rs_per_quintal\n1,2020-01-06,1200\n2,not a date,5\n3,2020-01-07,n/a\n")
    schema = T.StructType([f for f in schemas.RAW_DAILY.fields if f.name in ("market_id", "arrival_date", "modal_price_rs_per_quintal")])
    got = [tuple(r) for r in readers.read_daily(spark, str(tmp_path), schema).orderBy("market_id").collect()]
    assert got == [(1, D(2020, 1, 6), 1200.0), (3, D(2020, 1, 7), None)]


def test_report_banner_and_thousands(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Daily report,\nState,Price\nGoa,"1,250.5"\nKerala,900\n')
    got = readers.read_report(spark, str(tmp_path / "r.csv"), {"State": "string", "Price": "double"}, "Daily report")
    assert [tuple(r) for r in got.orderBy("State").collect()] == [("Goa", 1250.5), ("Kerala", 900.0)]


def test_missing_folders_are_skipped(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "z1.csv").write_text("zone,x\nT1,1\n")
    got = readers.read_many_union(spark, [str(tmp_path / "a" / "*.csv"), str(tmp_path / "none" / "*.csv")], header=True)
    assert [tuple(r) for r in got.collect()] == [("T1", "1")]
    with pytest.raises(FileNotFoundError):
        readers.read_many_union(spark, [str(tmp_path / "none")])


def test_high_water_mark(spark):
    old = spark.createDataFrame([(1, D(2020, 1, 1)), (2, D(2020, 1, 5))], "i int, d date")
    new = spark.createDataFrame([(9, D(2020, 1, 5)), (3, D(2020, 1, 6))], "i int, d date")
    assert sorted(r.i for r in incremental.append_after_high_water_mark(old, new, "d").collect()) == [1, 2, 3]
    assert incremental.append_after_high_water_mark(old, new.where("i = 9"), "d").count() == 2
    assert incremental.append_after_high_water_mark(old.limit(0), new, "d").count() == 2
    with pytest.raises(ValueError, match="schemas differ"):
        incremental.append_after_high_water_mark(old, new.withColumn("x", F.lit(1)), "d")


def test_outer_join_drops_repeated_columns(spark):
    a = spark.createDataFrame([(2020, 1, 1.0)], "year int, month int, x double")
    b = spark.createDataFrame([(2020, 1, 9.0, 2.0), (2020, 2, 9.0, 3.0)], "year int, month int, x double, y double")
    got = sorted((r.year, r.month, r.x, r.y) for r in reshape.outer_join_on_month([a, b]).collect())
    assert got == [(2020, 1, 1.0, 2.0), (2020, 2, None, 3.0)]


def test_tables_are_written_per_crop(spark, tmp_path):
    df = spark.createDataFrame([("onion", 1, 2.0), ("potato", 2, 3.0)], "crop string, market_id long, x double")
    writers.write_table(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "crop=onion").is_dir() and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_validation_summary_computes_the_errors_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    data = [("a", 1, float(i), 2.0, 10.0, 11.0, i % 2) for i in range(40)]
    errors = spark.createDataFrame(data, "crop string, horizon_weeks int, e double, ape_naive double, forecast double, actual_price double, imputed int")
    errors = errors.withColumn("ape_model", counted("e"))
    out = {r.subset: r for r in E.validation_summary(errors, ["crop", "horizon_weeks"], F.col("imputed") == 0).collect()}
    assert seen.value == 40
    assert (out["all"].n_rows, out["all"].median_ape_model, out["clean"].n_rows, out["clean"].median_ape_model) == (40, 19.5, 20, 19.0)


def test_actuals_meet_forecasts_where_the_panel_lies(spark):
    panel = spark.range(400).selectExpr("CAST(id % 4 AS STRING) AS crop", "id % 20 AS market_id", "date_add(DATE '2020-01-06', CAST(7 * (id div 20) AS INT)) AS week_start",
                                        "0 AS imputed", "CAST(id AS DOUBLE) AS modal_price_weighted").repartition(7, "crop", "market_id")
    forecasts = panel.selectExpr("crop", "market_id", "week_start", "modal_price_weighted AS forecast", "true AS sufficient_history", "false AS stale_reference",
                                 "explode(array(1, 4)) AS horizon_weeks")
    out = J.forecast_actual_join(forecasts, panel)
    assert out.columns == ["crop", "market_id", "target_week", "week_start", "forecast", "sufficient_history", "stale_reference", "horizon_weeks", "actual_price"]
    # only the exchanges that the panel brings
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = out.collect()
    assert len(rows) == 20 * (19 + 16) and all(r.actual_price == r.forecast + 20 * r.horizon_weeks for r in rows)


def test_repeated_actuals_and_missing_keys_meet_as_in_a_join(spark):
    d = "crop string, market_id long, week_start date"
    f = spark.createDataFrame([("a", 1, dt.date(2020, 1, 6)), (None, 1, dt.date(2020, 1, 6)), ("a", 1, None)], d).selectExpr(
        "*", "1 AS horizon_weeks", "true AS sufficient_history", "false AS stale_reference")
    a = spark.createDataFrame([("a", 1, dt.date(2020, 1, 13), p, 0) for p in (5.0, 5.0, 6.0, None)] + [(None, 1, dt.date(2020, 1, 13), 7.0, 0), ("a", 1, None, 8.0, 0)],
                              f"{d}, modal_price_weighted double, imputed int")
    assert sorted((r.crop, r.actual_price) for r in J.forecast_actual_join(f, a).collect()) == [("a", 5.0), ("a", 5.0), ("a", 6.0)]


def test_validation_summary_writes_only_what_medians_need(spark, monkeypatch):
    tables, plain = [], E.written
    monkeypatch.setattr(E, "written", lambda df, *by: tables.append(plain(df, *by)) or tables[-1])
    data = [("a", 1, 3.0, 4.0, 10.0, 2.0, 0), ("a", 1, 5.0, None, None, 4.0, 1), ("a", 2, 2.0, 1.0, 6.0, 8.0, 0)]
    errors = spark.createDataFrame(data, "crop string, horizon_weeks int, ape_model double, ape_naive double, forecast double, actual_price double, imputed int")
    out = {(r.horizon_weeks, r.subset): r for r in E.validation_summary(errors, ["crop", "horizon_weeks"], F.col("imputed") == 0).collect()}
    assert len(tables) == 1 and "forecast" not in tables[0].columns and tables[0].where("__n IS NULL").count() == 3
    r = out[1, "all"]
    assert (r.n_rows, r.mean_ape_model, r.mean_ape_naive, r.share_model_better, r.mean_forecast, r.mean_actual, r.median_ape_model, r.median_ape_naive) == (
        2, 4.0, 4.0, 1.0, 10.0, 3.0, 4.0, 4.0)
    assert (out[1, "clean"].n_rows, out[2, "clean"].share_model_better, len(out)) == (1, 0.0, 4)
    assert E.validation_summary(errors.limit(0), ["crop", "horizon_weeks"]).count() == 0
