"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import CTES, query
from pricegrid.operators import panel as P
from pricegrid.operators import quality as Q

CTES["q_tail"] = """
SELECT 'tail_week_imputed' AS "check", crop AS subject, CASE WHEN pct >= 95 THEN 'FAIL' WHEN pct >= 50 THEN 'WARN' ELSE 'PASS' END AS status, pct AS measured
FROM (SELECT crop, avg(imputed) * 100 AS pct FROM (SELECT crop, imputed, week_start = max(week_start) OVER (PARTITION BY crop) AS last FROM panel) WHERE last GROUP BY crop)"""
CTES["q_fresh"] = """
SELECT 'freshness_days' AS "check", crop AS subject, CASE WHEN DATE '2001-12-31' - max(week_start) > 60 THEN 'WARN' ELSE 'PASS' END AS status, CAST(DATE '2001-12-31' - max(week_start) AS DOUBLE) AS measured FROM panel GROUP BY crop"""
OUT = 'SELECT "check", subject, status, rnd(measured, 6) AS measured FROM '


def out(df):
    return df.withColumn("measured", fx.rnd("measured", 6))


@query("tail_week_imputed", OUT + "q_tail")
def tail_week_imputed(spark, sf):
    return out(Q.tail_week_imputed(fx.panel(spark, sf)))


@query("freshness_days", OUT + "q_fresh")
def freshness_days(spark, sf):
    return out(Q.freshness_days(fx.panel(spark, sf), "2001-12-31"))


@query("reference_vs_panel_week_gap", OUT + """(SELECT 'reference_vs_panel_week_gap' AS "check", crop AS subject, CASE WHEN max(week_start) - max(CASE WHEN arrivals_tonnes_week > 120 THEN week_start END) > 7 THEN 'FAIL' ELSE 'PASS' END AS status,
  CAST(max(week_start) - max(CASE WHEN arrivals_tonnes_week > 120 THEN week_start END) AS DOUBLE) AS measured FROM panel GROUP BY crop)""")
def reference_vs_panel_week_gap(spark, sf):
    p = fx.panel(spark, sf)
    return out(Q.reference_vs_panel_week_gap(p, p.where(F.col(P.ARRIVALS) > 120)))


@query("id_count_match", OUT + """(SELECT 'id_count_match' AS "check", crop AS subject, CASE WHEN count(DISTINCT market_id) <> count(DISTINCT CASE WHEN arrivals_tonnes_week > 110 THEN market_id END) THEN 'FAIL' ELSE 'PASS' END AS status,
  CAST(count(DISTINCT market_id) - count(DISTINCT CASE WHEN arrivals_tonnes_week > 110 THEN market_id END) AS DOUBLE) AS measured FROM weekly GROUP BY crop)""")
def id_count_match(spark, sf):
    w = fx.weekly(spark, sf)
    return out(Q.id_count_match(w, w.where(F.col(P.ARRIVALS) > 110)))


@query("required_columns", """
WITH c AS (SELECT unnest(['market_id', 'week_start', 'imputed', 'sufficient_history']) AS n, unnest([count(market_id), count(week_start), count(imputed), 0]) AS v FROM panel)
SELECT 'required_columns' AS "check", n AS subject, CASE WHEN v > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS DOUBLE) AS measured FROM c
""")
def required_columns(spark, sf):
    return Q.required_columns(spark, fx.panel(spark, sf), ["market_id", "week_start", "imputed", "sufficient_history"])


@query("no_nulls_in_groups", OUT + """(WITH n AS (SELECT count_if(modal_price_weighted IS NULL) AS p, count_if(arrivals_tonnes_week IS NULL) AS a, count_if(imputed_method IS NULL) AS m FROM panel)
SELECT 'no_nulls_in_groups' AS "check", 'price/modal_price_weighted' AS subject, 'FAIL' AS status, CAST(p AS DOUBLE) AS measured FROM n UNION ALL SELECT 'no_nulls_in_groups', 'price/imputed_method', 'FAIL', m FROM n
UNION ALL SELECT 'no_nulls_in_groups', 'volume/arrivals_tonnes_week', 'FAIL', a FROM n UNION ALL SELECT 'no_nulls_in_groups', 'calendar', 'PASS', 0 FROM n)""")
def no_nulls_in_groups(spark, sf):
    return out(Q.no_nulls_in_groups(fx.panel(spark, sf), {"price": [P.PRICE, "imputed_method"], "volume": [P.ARRIVALS], "calendar": ["iso_year", "iso_week"]}))


@query("flag_share", OUT + """(WITH s AS (SELECT crop, avg(imputed) * 100 AS a, avg(CAST(coalesce(imputed_method, '') = 'linear' AS INTEGER)) * 100 AS b FROM panel GROUP BY crop)
SELECT 'flag_share' AS "check", crop || '/is_imputed' AS subject, CASE WHEN a > 50 THEN 'WARN' ELSE 'PASS' END AS status, a AS measured FROM s UNION ALL SELECT 'flag_share', crop || '/is_linear', CASE WHEN b > 50 THEN 'WARN' ELSE 'PASS' END, b FROM s)""")
def flag_share(spark, sf):
    p = fx.panel(spark, sf).withColumns({"is_imputed": F.col("imputed") == 1, "is_linear": F.coalesce(F.col("imputed_method") == "linear", F.lit(False))})
    return out(Q.flag_share(p, {"is_imputed": True, "is_linear": True}))


@query("assertions", OUT + """(WITH n AS (SELECT count_if(total_arrivals_tonnes <= 0) AS a, count_if(arrival_date < DATE '1995-06-01') AS b, count_if(variety <> 'F') AS c FROM daily)
SELECT 'assertions' AS "check", 'positive' AS subject, CASE WHEN a > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(a AS DOUBLE) AS measured FROM n UNION ALL SELECT 'assertions', 'window', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b FROM n
UNION ALL SELECT 'assertions', 'unit', CASE WHEN c > 0 THEN 'FAIL' ELSE 'PASS' END, c FROM n
UNION ALL SELECT 'one_to_one', 'market_id->market', 'PASS', 0 UNION ALL SELECT 'one_to_one', 'market->market_id', 'PASS', 0)""")
def assertions(spark, sf):
    d = fx.daily_core(spark, sf)
    rules = {"positive": F.col("total_arrivals_tonnes") > 0, "window": F.col("arrival_date") >= "1995-06-01", "unit": F.col("variety") == "F"}
    return out(Q.assertions(d, rules).unionByName(Q.one_to_one(fx.markets(spark, sf), "market_id", "market")))


@query("snapshot_equal", OUT + """(SELECT 'snapshot_equal' AS "check", 'same' AS subject, 'PASS' AS status, 0.0 AS measured FROM (SELECT count(*) FROM weekly) UNION ALL SELECT 'snapshot_equal', 'changed', 'FAIL', 0.0
UNION ALL SELECT 'snapshot_equal', 'shorter', 'FAIL', CAST(count_if(trading_days = 1) AS DOUBLE) FROM weekly)""")
def snapshot_equal(spark, sf):
    w = fx.weekly(spark, sf).drop(P.PRICE)
    shuffled = w.repartition(3, "week_start").select(*reversed(w.columns))
    changed = w.withColumn("trading_days", F.when(F.col("trading_days") == 2, 3).otherwise(F.col("trading_days")))
    checks = [Q.snapshot_equal(w, shuffled, "same"), Q.snapshot_equal(w, changed, "changed"),
              Q.snapshot_equal(w, w.where(F.col("trading_days") > 1), "shorter")]
    return out(Q.check_report(checks))


@query("check_report", OUT + "(SELECT * FROM q_tail UNION ALL SELECT * FROM q_fresh)")
def check_report(spark, sf):
    p = fx.panel(spark, sf)
    return out(Q.check_report([Q.tail_week_imputed(p), Q.freshness_days(p, "2001-12-31")]))


@query("report_totals", """
WITH c AS (SELECT status FROM q_tail UNION ALL SELECT status FROM q_fresh) SELECT s AS status, count(c.status) AS n FROM (VALUES ('PASS'), ('WARN'), ('FAIL')) t(s) LEFT JOIN c ON c.status = s GROUP BY s
""")
def report_totals(spark, sf):
    return Q.report_totals(check_report(spark, sf))
