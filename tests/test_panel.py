"""Panel build: grid, gap filling, coverage, and the documented quirks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import panel as P
from pricegrid.plans import features as X

MONDAY = dt.date(2020, 1, 6)


def weekly_frame(spark, prices, market=1, crop="onion", start=MONDAY):
    data = [(crop, market, start + dt.timedelta(weeks=i), float(p), 10.0, 1) for i, p in enumerate(prices) if p is not None]
    return spark.createDataFrame(data, "crop string, market_id long, week_start date, modal_price_weighted double, arrivals_tonnes_week double, trading_days int")


def prices_of(df):
    return [r[P.PRICE] for r in df.orderBy("market_id", "week_start").collect()]


GAPS = [1, None, None, None, None, 6, None, 8] + [None] * 10 + [19, None, None]


def with_end(spark, prices):
    # another market of the crop reports in the last week, so trailing gaps belong to the grid
    return weekly_frame(spark, prices).unionByName(weekly_frame(spark, [None] * (len(prices) - 1) + [5], market=2))


def test_first_two_weeks_of_every_interior_gap_are_filled(spark):
    out = P.linear_fill_limited(P.complete_grid(with_end(spark, GAPS))).where("market_id = 1")
    assert prices_of(out) == [1, 2, 3, None, None, 6, 7, 8, 9, 10] + [None] * 8 + [19, None, None]


def test_strict_gap_fills_short_gaps_only(spark):
    out = P.linear_fill_limited(P.complete_grid(with_end(spark, GAPS)), strict_gap=True).where("market_id = 1")
    assert prices_of(out) == [1, None, None, None, None, 6, 7, 8] + [None] * 10 + [19, None, None]


def test_gap_lengths_count_trailing_runs(spark):
    grid = P.complete_grid(with_end(spark, GAPS)).where("market_id = 1").orderBy("week_start")
    assert [r.gap_length for r in grid.collect()] == [0, 4, 4, 4, 4, 0, 1, 0] + [10] * 10 + [0, 2, 2]


def test_seasonal_median_fills_rest_of_medium_gaps_and_trailing_ones(spark):
    # five-week gap inside January/February: two linear rows, then the observed median of the month
    prices = [10, None, None, None, None, None, 40] + [None] * 4
    out = P.seasonal_median_fill(P.linear_fill_limited(P.complete_grid(with_end(spark, prices)))).where("market_id = 1")
    got = [(r[P.PRICE], r.imputed_method) for r in out.orderBy("week_start").collect()]
    assert got[:7] == [(10, "observed"), (15, "linear"), (20, "linear"), (10, "seasonal_median"), (40, "seasonal_median"),
                       (40, "seasonal_median"), (40, "observed")]
    # trailing gap of four weeks: never linear; 24 Feb has February's median, March has none
    assert got[7:] == [(40, "seasonal_median"), (None, None), (None, None), (None, None)]


def test_short_trailing_gap_stays_empty(spark):
    out = P.seasonal_median_fill(P.linear_fill_limited(P.complete_grid(with_end(spark, [10, 11, None, None])))).where("market_id = 1")
    assert prices_of(out) == [10, 11, None, None]


def test_grid_starts_at_own_first_week_and_coverage_uses_that_span(spark):
    early = weekly_frame(spark, [5] * 10, market=1)
    late = weekly_frame(spark, [None] * 6 + [5, None, 5, 5], market=2)
    grid = P.complete_grid(early.unionByName(late))
    assert grid.where("market_id = 2").count() == 4
    kept = P.coverage_filter(grid, 0.75)
    assert kept.where("market_id = 2").select("coverage").first()[0] == pytest.approx(0.75)
    assert P.coverage_filter(grid, 0.76).select("market_id").distinct().count() == 1


def test_grid_skips_a_first_partial_week(spark):
    grid = P.complete_grid(weekly_frame(spark, [1, 2, 3]), grid_start="2020-01-07")
    assert grid.agg(F.min("week_start")).first()[0] == dt.date(2020, 1, 13)


def test_any_number_of_groups_gets_its_last_week(spark):
    rows = spark.range(20_000).selectExpr("concat('c', id) AS crop", "date_add(DATE '2020-01-06', CAST(7 * (id % 9) AS INT)) AS week_start")
    ends = P.with_last_week(rows.unionByName(rows.selectExpr("crop", "date_add(week_start, 7) AS week_start")), "crop")
    assert ends.count() == 40_000 and ends.where("datediff(__end, week_start) NOT IN (0, 7)").count() == 0


def test_weekly_mean_is_weighted_and_counts_days(spark):
    data = [("onion", 1, dt.date(2021, 1, 1), 10.0, 1.0), ("onion", 1, dt.date(2021, 1, 1), 20.0, 1.0), ("onion", 1, dt.date(2021, 1, 2), 40.0, 2.0)]
    daily = spark.createDataFrame(data, "crop string, market_id long, arrival_date date, modal_price_rs_per_quintal double, total_arrivals_tonnes double")
    row = P.weekly_weighted_mean(daily).first()
    assert (row.week_start, row[P.PRICE], row[P.ARRIVALS], row.trading_days) == (dt.date(2020, 12, 28), 27.5, 4.0, 2)


def test_clip_drops_and_never_clamps(spark):
    df = spark.createDataFrame([("onion", 49.0), ("onion", 50.0), ("potato", 3501.0), ("wheat", 100.0)], "crop string, p double")
    assert [tuple(r) for r in P.clip_filter_by_group(df, "crop", "p").collect()] == [("onion", 50.0)]


def test_changing_the_future_changes_no_feature(spark):
    panel = P.seasonal_median_fill(P.linear_fill_limited(P.complete_grid(weekly_frame(spark, list(range(100, 170))))))
    panel = panel.withColumn("iso_week", F.weekofyear("week_start"))
    cut = dt.date(2021, 1, 4)
    changed = panel.withColumn(P.PRICE, F.when(F.col("week_start") > F.lit(cut), F.col(P.PRICE) * 3).otherwise(F.col(P.PRICE)))
    cols = ["week_start", *[c for c in X.PRICE_FEATURES + X.ARRIVAL_FEATURES if c != "state_enc"]]
    seen = lambda df: X.build_features(df).where(F.col("week_start") <= F.lit(cut)).select(*cols).orderBy("week_start").collect()
    assert seen(panel) == seen(changed)


def test_features_of_same_named_markets_do_not_mix(spark):
    both = weekly_frame(spark, [1, 2, 3], market=1).unionByName(weekly_frame(spark, [100, 200, 300], market=2))
    from pricegrid.operators import windows as W

    out = W.lags(both, P.PRICE, "lag_", [1]).orderBy("market_id", "week_start")
    assert [r.lag_1 for r in out.collect()] == [None, 1, 2, None, 100, 200]


def test_a_large_grid_gets_tasks_by_its_rows(spark, monkeypatch):
    from pricegrid.functions import sizes

    days = spark.range(2000).selectExpr("IF(id % 3 = 0, 'onion', 'potato') AS crop", "id % 20 AS market_id", "date_add(DATE '2020-01-06', CAST(id % 700 AS INT)) AS arrival_date",
                                        "CAST(100 + id % 9 AS DOUBLE) AS modal_price_rs_per_quintal", "1.0D AS total_arrivals_tonnes")
    bounds = {"onion": (1.0, 1000.0), "potato": (1.0, 1000.0)}
    key = ("crop", "market_id", "week_start")
    small = P.build_panel(days, bounds).orderBy(*key).collect()
    monkeypatch.setattr(sizes, "ROWS_PER_TASK", 100)
    large = P.build_panel(days, bounds)
    # 40 keys of 100 weeks; nothing after that shuffles the grid anew
    assert large.rdd.getNumPartitions() >= 36
    assert large.orderBy(*key).collect() == small


def test_last_weeks_of_the_records_end_the_grid(spark):
    days = spark.createDataFrame([("a", 1, "2020-01-07"), ("a", 2, "2020-01-29"), (None, 3, "2020-02-05"), (None, 4, "2020-02-20")],
                                 "crop string, market_id long, day string").select(
        "crop", "market_id", F.to_date("day").alias("arrival_date"), F.lit(5.0).alias("modal_price_rs_per_quintal"), F.lit(1.0).alias("total_arrivals_tonnes"))
    weekly = P.weekly_weighted_mean(days)
    order = ("market_id", "week_start")
    given = P.complete_grid(weekly, ends=P.last_weeks(days)).orderBy(*order).collect()
    assert given == P.complete_grid(weekly).orderBy(*order).collect()
    assert len(given) == 4 + 1 + 3 + 1


def test_set_difference_in_named_tasks_keeps_duplicates_and_nulls(spark, monkeypatch):
    from pricegrid.functions import sizes
    from pricegrid.operators import sets as S

    left = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, None)], "a int, b string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "a int, b string")
    plain = sorted(map(str, S.set_difference(left, right).collect()))
    monkeypatch.setattr(sizes, "ROWS_PER_TASK", 1)
    out = S.set_difference(left, right, 30)
    assert out.rdd.getNumPartitions() == 30 and sorted(map(str, out.collect())) == plain and len(plain) == 4


def test_features_stay_in_the_tasks_of_the_grid(spark, monkeypatch):
    from catalog import forecasting
    from pricegrid.functions import sizes

    monkeypatch.setattr(sizes, "ROWS_PER_TASK", 500)
    # estimates of joined tables grow with both of them, so only measured sides are broadcast
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = forecasting.fx.panel(spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
        assert grid > 8
        for rows in (forecasting.features, forecasting.layered_features):
            assert rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == grid
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
