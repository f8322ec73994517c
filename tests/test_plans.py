"""Model plans, streaming refresh, and the registered queries as a whole."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricegrid.operators import inference as I
from pricegrid.operators import panel as P
from pricegrid.plans import features as X
from pricegrid.plans import forecasting as H
from pricegrid.streaming import incremental as S


def test_layer_sets_grow_and_skip_absent_columns():
    sets = X.layered_feature_sets({"price": ["a", "b"], "arrivals": ["c"], "macro": ["missing", "d"]}, ["a", "b", "c", "d"])
    assert sets == {"M0": ["a", "b"], "M1": ["a", "b", "c"], "M2": ["a", "b", "c", "d"]}


def test_scenarios_override_only_their_crop(spark):
    rows = spark.createDataFrame([("onion", 1, 2.0, 0.0), ("potato", 2, 4.0, 0.0)], "crop string, market_id long, diesel double, ban double")
    out = H.scenario_rows(rows, [(None, "shock", "diesel", "scale", 1.5), ("onion", "ban", "ban", "set", 1.0), ("onion", "ban", "not_there", "set", 1.0)])
    got = {(r.crop, r.scenario): (r.diesel, r.ban) for r in out.collect()}
    assert got == {("onion", "baseline"): (2, 0), ("onion", "shock"): (3, 0), ("onion", "ban"): (2, 1), ("potato", "baseline"): (4, 0), ("potato", "shock"): (6, 0)}


def test_levers_cannot_raise_the_price(spark):
    rows = [("m", "baseline", 100.0), ("m", "ban", 120.0), ("m", "shock", 130.0)]
    out = {r.scenario: r for r in H.scenario_effects(spark.createDataFrame(rows, "id string, scenario string, forecast double"), ["id"], clamp=["ban"]).collect()}
    assert (out["ban"].pct_change, out["ban"].clamped) == (0.0, True) and out["shock"].pct_change == pytest.approx(30)


def test_lever_scenarios_are_recognised():
    o = [("onion", "ban", "export_banned", "set", 1), ("onion", "mixed", "export_banned", "set", 1), ("onion", "mixed", "diesel", "scale", 2)]
    assert H.scenario_names_of_levers(o) == ["ban"]


def test_interaction_gap(spark):
    rows = [("m", "a", 2.0), ("m", "b", 3.0), ("m", "joint", 7.0)]
    row = H.interaction_gap(spark.createDataFrame(rows, "id string, scenario string, effect double"), ["id"]).first()
    assert (row.joint_effect, row.sum_of_singles, row.interaction_gap) == (7.0, 5.0, 2.0)


def test_arima_follows_a_known_process(spark):
    rng = np.random.default_rng(0)
    d = np.zeros(400)
    for t in range(1, 400):
        d[t] = 0.7 * d[t - 1] + rng.normal(0, 0.1)
    series = np.cumsum(d)
    frame = spark.createDataFrame([("onion", 1, dt.date(2018, 1, 1) + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(series)]
                                  + [("onion", 2, dt.date(2018, 1, 1), 1.0)], "crop string, market_id long, week_start date, x double")
    out = H.per_series_arima(I.series_arrays(frame, ["crop", "market_id"], "x"), 2).orderBy("step").collect()
    assert [(r.market_id, r.step) for r in out] == [(1, 1), (1, 2)] and out[0].week_start == dt.date(2018, 1, 1) + dt.timedelta(weeks=400)
    assert out[0].forecast - series[-1] == pytest.approx(0.7 * d[-1], abs=0.05)


def test_only_the_used_feature_is_important(spark):
    class Linear:
        def transform(self, df):
            from pyspark.ml.functions import vector_to_array

            return df.withColumn("prediction", vector_to_array("features")[0] * 2)

    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(500).select(
        F.lit("onion").alias("crop"), F.lit(1).alias("horizon_weeks"), F.col("id").alias("market_id"), F.lit("2020-01-06").cast("date").alias("week_start"),
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("target", F.col("a") * 2)
    out = H.permutation_importance(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows), Linear(), ["a", "b"])
    got = {r.feature: r.importance for r in out.collect()}
    assert got["a"] > 1 and got["b"] == 0


def test_stream_appends_only_newer_rows_and_repeats_are_harmless(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "i int, d date"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 5))])
    stream = lambda: S.read_daily_stream(spark, source, spark.createDataFrame([], schema).schema)
    S.append_newer(table, str(tmp_path / "c1"), stream(), "d").awaitTermination()
    put([(9, dt.date(2020, 1, 4)), (3, dt.date(2020, 1, 6))])
    S.append_newer(table, str(tmp_path / "c1"), stream(), "d").awaitTermination()
    S.append_newer(table, str(tmp_path / "c2"), stream(), "d").awaitTermination()
    assert sorted(r.i for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_streamed_weeks_equal_the_batch(spark, tmp_path):
    rows = [("onion", 1, dt.datetime(2021, 1, 1) + dt.timedelta(days=i), 10.0 + i, 1.0 + i % 3) for i in range(60)]
    schema = "crop string, market_id long, arrival_time timestamp, modal_price_rs_per_quintal double, total_arrivals_tonnes double"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    out = S.weekly_stream(S.read_daily_stream(spark, str(tmp_path / "in"), df.schema))
    query = out.writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = P.weekly_weighted_mean(df.withColumn("arrival_date", F.col("arrival_time").cast("date")))
    key = lambda frame: sorted((r.week_start, round(r[P.PRICE], 9), r[P.ARRIVALS], r.trading_days) for r in frame.collect())
    assert key(spark.table("weekly")) == key(batch)


def test_every_oracle_has_a_query_and_expands():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert not any("rnd(" in sql for sql in oracles.values())


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["crop", "state"] and out.where(F.col("imputed_method") == "linear").limit(1).count() == 1
