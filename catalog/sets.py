"""Set operations, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.joins import predictions
from catalog.registry import query
from catalog.windows import KEYS
from pricegrid.operators import inference as I
from pricegrid.operators import panel as P
from pricegrid.operators import sets as S


@query("union_all", """
SELECT crop, market_id, week_start, arrivals_tonnes_week FROM weekly WHERE crop = 'A' UNION ALL SELECT crop, market_id, week_start, NULL FROM weekly WHERE crop <> 'A'
""")
def union_all(spark, sf):
    w = fx.weekly(spark, sf)
    return S.union_all([w.where(F.col("crop") == "A").select(*KEYS, P.ARRIVALS), w.where(F.col("crop") != "A").select(*KEYS)])


@query("dedupe_keys", """
SELECT market_id, arrival_date, crop, variety, total_arrivals_tonnes AS q FROM clean
QUALIFY row_number() OVER (PARTITION BY market_id, arrival_date ORDER BY total_arrivals_tonnes, crop, variety) = 1
""")
def dedupe_keys(spark, sf):
    c = fx.clean(spark, sf).select("market_id", "arrival_date", "crop", "variety", F.col("total_arrivals_tonnes").alias("q"))
    return S.dedupe_keys(c, ["market_id", "arrival_date"], ["q", "crop", "variety"])


@query("common_weeks", """
SELECT crop, CAST(horizon_weeks AS INTEGER) AS horizon_weeks, week_start FROM (SELECT crop, horizon_weeks, week_start FROM preds GROUP BY ALL HAVING count(DISTINCT variant) = 3)
""")
def common_weeks(spark, sf):
    return I.common_weeks(predictions(spark, sf))


@query("set_difference", """
SELECT crop, market_id, week_start FROM grid EXCEPT ALL SELECT crop, market_id, week_start FROM weekly
""")
def set_difference(spark, sf):
    return S.set_difference(fx.grid(spark, sf).select(*KEYS), fx.weekly(spark, sf), P.grid_rows(fx.clean(spark, sf), "arrival_date"))


@query("index_intersection", """
WITH m AS (SELECT CAST(min(week_start)::DATE + CAST(floor(datediff('day', min(week_start), max(week_start)) / 2) AS INTEGER) AS DATE) AS mid FROM weekly),
a AS (SELECT crop, market_id, avg(arrivals_tonnes_week) AS full_score FROM weekly GROUP BY ALL), b AS (SELECT crop, market_id, avg(arrivals_tonnes_week) AS early FROM weekly WHERE week_start < (SELECT mid FROM m) GROUP BY ALL),
c AS (SELECT crop, market_id, avg(arrivals_tonnes_week) AS late FROM weekly WHERE week_start >= (SELECT mid FROM m) GROUP BY ALL)
SELECT crop, market_id, rnd(full_score, 6) AS full_score, rnd(early, 6) AS early, rnd(late, 6) AS late FROM a JOIN b USING (crop, market_id) JOIN c USING (crop, market_id)
""")
def index_intersection(spark, sf):
    w = fx.weekly(spark, sf)
    score = lambda rows, name: rows.groupBy("crop", "market_id").agg(F.avg(P.ARRIVALS).alias(name))
    first, last = F.min("week_start"), F.max("week_start")
    middle = w.agg(F.date_add(first, F.floor(F.datediff(last, first) / 2).cast("int"))).scalar()
    out = S.index_intersection([score(w, "full_score"), score(w.where(F.col("week_start") < middle), "early"),
                                score(w.where(F.col("week_start") >= middle), "late")], ["crop", "market_id"])
    return out.select("crop", "market_id", fx.r("full_score", 6), fx.r("early", 6), fx.r("late", 6))


@query("top_k", """
WITH e AS (SELECT crop, market_id, week_start, modal_price_weighted AS p FROM panel WHERE imputed = 0) SELECT crop, market_id, week_start, rnd(p, 4) AS price FROM e ORDER BY p DESC, crop, market_id, week_start LIMIT 10
""")
def top_k(spark, sf):
    p = fx.panel(spark, sf).where(F.col("imputed") == 0).select(*KEYS, F.col(P.PRICE).alias("price"))
    return S.top_k(p, 10, [F.col("price").desc(), *[F.col(k) for k in KEYS]]).withColumn("price", fx.rnd("price"))


@query("worst_k", """
SELECT crop, market_id, CAST(horizon_weeks AS INTEGER) AS horizon_weeks, week_start, fold, rnd(abs(y_true - y_pred), 4) AS abs_error FROM preds WHERE variant = 'B1' ORDER BY abs(y_true - y_pred) DESC, crop, market_id, week_start, horizon_weeks LIMIT 10
""")
def worst_k(spark, sf):
    e = predictions(spark, sf).where(F.col("variant") == "B1").withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred")))
    out = S.top_k(e, 10, [F.col("abs_error").desc(), *[F.col(k) for k in KEYS], F.col("horizon_weeks")])
    return out.select("crop", "market_id", "horizon_weeks", "week_start", "fold", fx.r("abs_error"))


@query("sort_output", "SELECT crop, market_id, week_start, arrivals_tonnes_week, trading_days FROM weekly ORDER BY ALL")
def sort_output(spark, sf):
    return S.sort_output(fx.weekly(spark, sf).select(*KEYS, P.ARRIVALS, "trading_days"), KEYS)


@query("seeded_sample", """
SELECT crop, market_id, week_start, arrivals_tonnes_week FROM weekly
QUALIFY row_number() OVER (PARTITION BY crop ORDER BY md5(concat_ws('|', market_id, week_start, 42)), market_id, week_start) <= 500
""")
def seeded_sample(spark, sf):
    return S.seeded_sample(fx.weekly(spark, sf).select(*KEYS, P.ARRIVALS), 500, "crop", ["market_id", "week_start"])


@query("compare_series", """
WITH b AS (SELECT market_id FROM weekly GROUP BY market_id ORDER BY count(*) DESC, market_id LIMIT 15),
t AS (SELECT crop, market_id, week_start, modal_price_weighted AS p FROM panel WHERE market_id IN (SELECT market_id FROM b) QUALIFY row_number() OVER (PARTITION BY crop, market_id ORDER BY week_start DESC) <= 104)
SELECT crop, market_id, week_start, rnd(p, 4) AS price, count(p) OVER (PARTITION BY crop, market_id) > 0 AS has_value FROM t
""")
def compare_series(spark, sf):
    busiest = S.top_k(fx.weekly(spark, sf).groupBy("market_id").agg(F.count(F.lit(1)).alias("n")), 15, [F.col("n").desc(), F.col("market_id")])
    ids = [row.market_id for row in busiest.collect()]
    out = S.compare_series(fx.panel(spark, sf), ids, P.PRICE)
    return out.select(*KEYS, fx.rnd(P.PRICE).alias("price"), "has_value")
