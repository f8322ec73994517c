"""Panel build and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog import fixtures as fx
from catalog.registry import CTES, query
from pricegrid.functions import scalars
from pricegrid.operators import early_warning, policy
from pricegrid.operators import panel as P
from pricegrid.operators import windows as W


@query("market_panel", """
SELECT crop, market_id, market, state, district, week_start, iso_year, iso_week,
       rnd(modal_price_weighted, 4) AS modal_price_weighted, arrivals_tonnes_week, trading_days, imputed, imputed_method
FROM panel JOIN markets USING (market_id)
WHERE (crop, market_id) IN (SELECT (crop, market_id) FROM panel GROUP BY crop, market_id HAVING 1 - avg(imputed) >= 0.43)
""")
def market_panel(spark, sf):
    return fx.flagship(spark, sf).withColumn(P.PRICE, fx.rnd(P.PRICE))


KEYS = ["crop", "market_id", "week_start"]


def rounded(df, columns, digits=6, keys=KEYS):
    return df.select(*keys, *[fx.r(c, digits) for c in columns])


OVER = "OVER (PARTITION BY crop, market_id ORDER BY week_start)"


def roll(fn, col, n, least=2, keys="crop, market_id", last="1 PRECEDING"):
    over = f"OVER (PARTITION BY {keys} ORDER BY week_start ROWS BETWEEN {n} PRECEDING AND {last})"
    return f"CASE WHEN count({col}) {over} >= {least} THEN {fn}({col}) {over} END"


@query("lags", "SELECT crop, market_id, week_start, " + ", ".join(
    f"rnd(lag(log_price, {k}) {OVER}, 6) AS price_lag_{k}" for k in (1, 2, 3, 4, 8, 13, 26, 52)) + " FROM logs")
def lags(spark, sf):
    out = W.lags(fx.logs(spark, sf), "log_price", "price_lag_")
    return rounded(out, [f"price_lag_{k}" for k in (1, 2, 3, 4, 8, 13, 26, 52)])


@query("trailing_stats", "SELECT crop, market_id, week_start, " + ", ".join(
    f"rnd({roll('avg', 'log_price', n)}, 6) AS price_roll_mean_{n}, rnd({roll('stddev_samp', 'log_price', n)}, 6) AS price_roll_std_{n}"
    for n in (4, 8, 13)) + " FROM logs")
def trailing_stats(spark, sf):
    out = W.trailing_stats(fx.logs(spark, sf))
    return rounded(out, [c for c in out.columns if "_roll_" in c])


@query("lead_target", "SELECT crop, market_id, week_start, " + ", ".join(
    f"rnd(lead(log_price, {h}) {OVER}, 6) AS target_{h}" for h in (1, 4, 13, 26)) + " FROM logs")
def lead_target(spark, sf):
    return rounded(W.lead_target(fx.logs(spark, sf)), [f"target_{h}" for h in (1, 4, 13, 26)])


@query("arrival_lags", "SELECT crop, market_id, week_start, " + ", ".join(
    [f"rnd(lag(log_arr, {k}) {OVER}, 6) AS arr_lag_{k}" for k in (1, 2, 4)]
    + [f"rnd({roll('avg', 'log_arr', n)}, 6) AS arr_roll_mean_{n}" for n in (4, 8)]) + " FROM logs")
def arrival_lags(spark, sf):
    out = W.arrival_lags(fx.logs(spark, sf))
    return rounded(out, [c for c in out.columns if c.startswith(("arr_lag", "arr_roll"))])


@query("year_over_year", f"""
WITH y AS (SELECT crop, market_id, week_start, log_price, lag(log_price, 52) {OVER} AS price_yoy,
  lag(log_price) OVER (PARTITION BY crop, market_id, iso_week ORDER BY week_start) AS prev FROM logs)
SELECT crop, market_id, week_start, rnd(price_yoy, 6) AS price_yoy, rnd(prev, 6) AS same_week_last_year, rnd((log_price - prev) / prev * 100, 6) AS yoy_pct FROM y
""")
def year_over_year(spark, sf):
    return rounded(W.year_over_year(fx.logs(spark, sf)), ["price_yoy", "same_week_last_year", "yoy_pct"])


CTES["layer"] = """
SELECT l_returnflag AS crop, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, avg(l_discount) AS heat, avg(l_tax) AS rain, avg(l_quantity) AS ndvi
FROM lineitem GROUP BY ALL"""


def layer(spark, sf):
    """Crop-week layer, one row per crop and week."""
    li = fx.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("crop"), F.trunc("l_shipdate", "week").alias("week_start")).agg(
        F.avg("l_discount").alias("heat"), F.avg("l_tax").alias("rain"), F.avg("l_quantity").alias("ndvi"))


@query("trailing_layer_rolls", f"""
SELECT crop, week_start, rnd({roll('sum', 'heat', 4, keys='crop')}, 6) AS heat_sum_4, rnd({roll('sum', 'heat', 8, keys='crop')}, 6) AS heat_sum_8,
  rnd({roll('sum', 'rain', 4, keys='crop')}, 6) AS rain_sum_4, rnd({roll('avg', 'ndvi', 4, keys='crop')}, 6) AS ndvi_mean_4 FROM layer
""")
def trailing_layer_rolls(spark, sf):
    out = W.trailing_layer_rolls(layer(spark, sf), {"heat": [4, 8], "rain": [4]}, {"ndvi": [4]})
    return rounded(out, ["heat_sum_4", "heat_sum_8", "rain_sum_4", "ndvi_mean_4"], keys=["crop", "week_start"])


@query("trailing_mean_inclusive", f"""
SELECT crop, week_start, rnd({roll('avg', 'heat', 3, keys='crop', last='CURRENT ROW')}, 6) AS heat_roll4 FROM layer
""")
def trailing_mean_inclusive(spark, sf):
    out = W.trailing_mean_inclusive(layer(spark, sf), "heat", "heat_roll4")
    return rounded(out, ["heat_roll4"], keys=["crop", "week_start"])


@query("gap_length", "SELECT crop, market_id, week_start, gap_length FROM gapfill")
def gap_length(spark, sf):
    return fx.grid(spark, sf).select(*KEYS, "gap_length")


@query("linear_fill_limited", "SELECT crop, market_id, week_start, imputed, rnd(linear_price, 4) AS price FROM gapfill")
def linear_fill_limited(spark, sf):
    return P.linear_fill_limited(fx.grid(spark, sf)).select(*KEYS, "imputed", fx.rnd(P.PRICE).alias("price"))


@query("seasonal_median_fill", "SELECT crop, market_id, week_start, imputed_method, rnd(modal_price_weighted, 4) AS price FROM panel")
def seasonal_median_fill(spark, sf):
    filled = P.seasonal_median_fill(P.linear_fill_limited(fx.grid(spark, sf)))
    return filled.select(*KEYS, "imputed_method", fx.rnd(P.PRICE).alias("price"))


@query("grid_ffill_limited", """
WITH cal AS (SELECT min(week_start) AS a, max(week_start) AS b FROM weekly),
g AS (SELECT crop, market_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start
      FROM (SELECT DISTINCT crop, market_id FROM weekly), cal)
SELECT crop, market_id, week_start, last_value(arrivals_tonnes_week IGNORE NULLS) OVER (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS arrivals
FROM g LEFT JOIN weekly USING (crop, market_id, week_start)
""")
def grid_ffill_limited(spark, sf):
    rows = fx.weekly(spark, sf).select(*KEYS, F.col(P.ARRIVALS).alias("arrivals"))
    return W.grid_ffill_limited(rows, ["arrivals"], 3, ["crop", "market_id"])


@query("walk_forward_climatology", """
WITH y AS (SELECT crop, isoyear(week_start) AS y, week(week_start) AS w, avg(heat) AS v FROM layer GROUP BY ALL),
n AS (SELECT a.crop, a.y, a.w, avg(b.v) AS norm FROM y a LEFT JOIN y b ON b.crop = a.crop AND b.w = a.w AND b.y < a.y GROUP BY ALL)
SELECT l.crop, week_start, rnd(norm, 6) AS heat_norm, rnd(heat - norm, 6) AS heat_anom FROM layer l JOIN n ON n.crop = l.crop AND n.y = isoyear(week_start) AND n.w = week(week_start)
""")
def walk_forward_climatology(spark, sf):
    out = W.walk_forward_climatology(layer(spark, sf), "heat", ["crop"])
    return rounded(out, ["heat_norm", "heat_anom"], keys=["crop", "week_start"])


CTES["nation_week"] = """
SELECT s_nationkey AS nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, max(CASE WHEN l_quantity > 45 THEN l_extendedprice END) AS wage
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


def nation_week(spark, sf):
    li = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("s_nationkey").alias("nationkey"), F.trunc("l_shipdate", "week").alias("week_start")).agg(
        F.max(F.when(F.col("l_quantity") > 45, F.col("l_extendedprice"))).alias("wage"))


@query("dimension_ffill", """
SELECT nationkey, week_start, last_value(wage IGNORE NULLS) OVER (PARTITION BY nationkey ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wage FROM nation_week
""")
def dimension_ffill(spark, sf):
    return W.dimension_ffill(nation_week(spark, sf), ["wage"], ["nationkey"])


@query("fill_both_ways", """
SELECT nationkey, week_start, coalesce(last_value(wage IGNORE NULLS) OVER (PARTITION BY nationkey ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(wage IGNORE NULLS) OVER (PARTITION BY nationkey ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS wage FROM nation_week
""")
def fill_both_ways(spark, sf):
    return W.fill_both_ways(nation_week(spark, sf), ["wage"], ["nationkey"])


@query("best_per_key", """
SELECT market_id, week_start, arrival_date, q, rnd(price, 4) AS price FROM (
  SELECT market_id, week_start, arrival_date, total_arrivals_tonnes AS q, modal_price_rs_per_quintal AS price,
    row_number() OVER (PARTITION BY market_id, week_start ORDER BY total_arrivals_tonnes DESC, arrival_date, modal_price_rs_per_quintal) AS rn FROM clean) WHERE rn = 1
""")
def best_per_key(spark, sf):
    day = fx.clean(spark, sf).groupBy("market_id", F.trunc("arrival_date", "week").alias("week_start"), "arrival_date",
                                      F.col("total_arrivals_tonnes").alias("q")).agg(F.min("modal_price_rs_per_quintal").alias("price"))
    return W.best_per_key(day, ["market_id", "week_start"], "q", "arrival_date").withColumn("price", fx.rnd("price"))


@query("tail_n_per_key", """
SELECT crop, market_id, week_start, imputed, rnd(modal_price_weighted, 4) AS price FROM panel
QUALIFY row_number() OVER (PARTITION BY crop, market_id ORDER BY week_start DESC) <= 104
""")
def tail_n_per_key(spark, sf):
    return W.tail_n_per_key(fx.panel(spark, sf), 104).select(*KEYS, "imputed", fx.rnd(P.PRICE).alias("price"))


@query("freshness_flags", f"""
WITH f AS (SELECT crop, market_id, week_start, imputed, modal_price_weighted AS p, lag(modal_price_weighted) {OVER} AS lag1,
  row_number() OVER (PARTITION BY crop, market_id ORDER BY week_start DESC) AS rn FROM panel),
l AS (SELECT crop, market_id, arg_max(p, week_start) AS lp, max(week_start) AS ld FROM f WHERE imputed = 0 GROUP BY ALL),
s AS (SELECT crop, market_id, avg(imputed) * 100 AS pct FROM f WHERE rn <= 52 GROUP BY ALL)
SELECT crop, market_id, week_start, imputed, lag1 IS NOT NULL AS sufficient_history, rnd(lp, 4) AS last_observed_price, ld AS last_observed_date,
  rnd(pct, 4) AS pct_imputed_last_52w, ld IS NULL OR week_start - ld >= 21 AS stale_reference
FROM f LEFT JOIN l USING (crop, market_id) LEFT JOIN s USING (crop, market_id) WHERE rn = 1
""")
def freshness_flags(spark, sf):
    out = W.freshness_flags(fx.panel(spark, sf))
    return out.select(*KEYS, "imputed", "sufficient_history", fx.r("last_observed_price"), "last_observed_date",
                      fx.r("pct_imputed_last_52w"), "stale_reference")


@query("column_staleness", """
WITH d AS (SELECT *, max(week_start) OVER (PARTITION BY crop) AS e FROM panel),
u AS (SELECT crop, 'linear' AS feature, max(e) AS e, max(week_start) FILTER (imputed_method = 'linear') AS as_of FROM d GROUP BY crop
      UNION ALL SELECT crop, 'big', max(e), max(week_start) FILTER (arrivals_tonnes_week > 120) FROM d GROUP BY crop)
SELECT crop, feature, as_of, CAST((e - as_of) // 7 AS INTEGER) AS weeks_stale FROM u WHERE as_of < e
""")
def column_staleness(spark, sf):
    p = fx.panel(spark, sf).withColumns({
        "linear": F.when(F.col("imputed_method") == "linear", 1), "big": F.when(F.col(P.ARRIVALS) > 120, 1)})
    return W.column_staleness(p, ["linear", "big"])


CTES["crop_week"] = """
SELECT crop, week_start, avg(modal_price_weighted) AS price, avg(arrivals_tonnes_week) AS arrivals FROM panel GROUP BY ALL"""


def crop_week(spark, sf):
    return fx.panel(spark, sf).groupBy("crop", "week_start").agg(F.avg(P.PRICE).alias("price"), F.avg(P.ARRIVALS).alias("arrivals"))


@query("pct_change_k", """
SELECT crop, week_start, rnd(price / lag(price, 4) OVER w - 1, 6) AS price_pct_4, rnd(price / lag(price, 8) OVER w - 1, 6) AS price_pct_8,
  rnd(max(price / p12 - 1) OVER (PARTITION BY crop), 6) AS largest_12
FROM (SELECT *, lag(price, 12) OVER (PARTITION BY crop ORDER BY week_start) AS p12 FROM crop_week) WINDOW w AS (PARTITION BY crop ORDER BY week_start)
""")
def pct_change_k(spark, sf):
    out = W.pct_change_k(crop_week(spark, sf), "price", [4, 8, 12], "price_pct_")
    out = out.withColumn("largest_12", F.max("price_pct_12").over(Window.partitionBy("crop")))
    return rounded(out, ["price_pct_4", "price_pct_8", "largest_12"], keys=["crop", "week_start"])


@query("benchmark_predictors", f"""
SELECT crop, market_id, week_start, rnd(lag(log_price, 1) {OVER}, 6) AS naive, rnd(lag(log_price, 52) {OVER}, 6) AS seasonal_naive, rnd({roll('avg', 'log_price', 4)}, 6) AS moving_average_4 FROM logs
""")
def benchmark_predictors(spark, sf):
    return rounded(W.benchmark_predictors(fx.logs(spark, sf)), ["naive", "seasonal_naive", "moving_average_4"])


@query("first_difference", f"SELECT crop, market_id, week_start, rnd(log_price - lag(log_price) {OVER}, 6) AS d_log_price FROM logs")
def first_difference(spark, sf):
    return rounded(W.first_difference(fx.logs(spark, sf), "log_price", "d_log_price"), ["d_log_price"])


@query("relative_to_group_mean", """
SELECT crop, market_id, arrival_date, rnd(modal_price_rs_per_quintal / avg(modal_price_rs_per_quintal) OVER (PARTITION BY crop, market_id, week_start), 6) AS factor FROM clean
""")
def relative_to_group_mean(spark, sf):
    rows = fx.clean(spark, sf).withColumn("week_start", F.trunc("arrival_date", "week"))
    out = W.relative_to_group_mean(rows, "modal_price_rs_per_quintal", KEYS, "factor")
    return out.select("crop", "market_id", "arrival_date", fx.r("factor", 6))


CTES["policy_log"] = """
SELECT user_id AS crop, effective_date, event_type AS policy_type, CASE WHEN event_type IN ('minimum_export_price', 'export_ban_removal') AND v > 5 THEN v END AS price_usd_per_mt,
  CASE WHEN k < 60 THEN 'with Duty note' ELSE 'plain' END AS description
FROM (SELECT user_id::VARCHAR AS user_id, CAST(ts AS DATE) AS effective_date,
        CASE event_type WHEN 'error' THEN 'export_ban' WHEN 'click' THEN 'export_ban_removal' WHEN 'view' THEN 'minimum_export_price' WHEN 'purchase' THEN 'export_duty' ELSE
          CASE WHEN value < 10 THEN 'minimum_export_price_removal' ELSE 'export_duty_removal' END END AS event_type, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) WHERE rn = 1"""


def policy_log(spark, sf):
    """Event stream read as a policy log: one event per entity and day."""
    kind = (
        F.when(F.col("event_type") == "error", "export_ban").when(F.col("event_type") == "click", "export_ban_removal")
        .when(F.col("event_type") == "view", "minimum_export_price").when(F.col("event_type") == "purchase", "export_duty")
        .when(F.col("value") < 10, "minimum_export_price_removal").otherwise("export_duty_removal"))
    e = fx.table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("crop"), F.col("ts").cast("date").alias("effective_date")).agg(
        F.min_by(F.struct("event_type", "value", "props"), "event_id").alias("e")).select("crop", "effective_date", "e.*")
    priced = kind.isin("minimum_export_price", "export_ban_removal") & (F.col("value") > 5)
    return e.select("crop", "effective_date", kind.alias("policy_type"), F.when(priced, F.col("value")).alias("price_usd_per_mt"),
                    F.when(F.get_json_object("props", "$.k").cast("int") < 60, "with Duty note").otherwise("plain").alias("description"))


CTES["intervals"] = """
WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY effective_date) AS i FROM policy_log),
st AS (
  SELECT crop, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS ban, CAST(NULL AS DATE) AS mep, CAST(NULL AS DOUBLE) AS mepv, CAST(NULL AS DATE) AS duty,
    CAST(NULL AS VARCHAR) AS l1, CAST(NULL AS DATE) AS s1, CAST(NULL AS DATE) AS e1, CAST(NULL AS DOUBLE) AS v1, FALSE AS closes
  FROM (SELECT DISTINCT crop FROM policy_log)
  UNION ALL
  SELECT st.crop, q.i,
    CASE WHEN policy_type = 'export_ban' THEN effective_date WHEN policy_type = 'export_ban_removal' THEN NULL ELSE ban END,
    CASE WHEN policy_type IN ('export_ban', 'minimum_export_price_removal') THEN NULL WHEN policy_type = 'minimum_export_price' THEN effective_date
         WHEN policy_type = 'export_ban_removal' AND price_usd_per_mt IS NOT NULL THEN effective_date ELSE mep END,
    CASE WHEN policy_type = 'minimum_export_price' OR (policy_type = 'export_ban_removal' AND price_usd_per_mt IS NOT NULL) THEN price_usd_per_mt ELSE mepv END,
    CASE WHEN policy_type = 'export_duty' THEN effective_date WHEN policy_type = 'export_duty_removal' THEN NULL
         WHEN policy_type = 'export_ban_removal' AND description LIKE '%Duty%' AND duty IS NULL THEN effective_date ELSE duty END,
    CASE WHEN policy_type = 'export_ban_removal' AND ban IS NOT NULL THEN 'export_banned'
         WHEN policy_type IN ('export_ban', 'minimum_export_price', 'minimum_export_price_removal') AND mep IS NOT NULL THEN 'mep_usd_per_tonne'
         WHEN policy_type IN ('export_duty', 'export_duty_removal') AND duty IS NOT NULL THEN 'export_duty_pct' END,
    CASE WHEN policy_type = 'export_ban_removal' THEN ban WHEN policy_type LIKE 'export_duty%' THEN duty ELSE mep END, effective_date - 1,
    CASE WHEN policy_type = 'export_ban_removal' THEN 1.0 WHEN policy_type LIKE 'export_duty%' THEN 40.0 ELSE mepv END, policy_type = 'export_duty_removal'
  FROM st JOIN seq q ON q.crop = st.crop AND q.i = st.i + 1),
tail AS (SELECT * FROM st WHERE (crop, i) IN (SELECT (crop, max(i)) FROM st GROUP BY crop)),
spans AS (
  SELECT crop, l1 AS lever, s1 AS s, e1 AS e, v1 AS v, closes FROM st WHERE l1 IS NOT NULL
  UNION ALL SELECT crop, 'export_banned', ban, DATE '2024-01-31', 1.0, FALSE FROM tail WHERE ban IS NOT NULL
  UNION ALL SELECT crop, 'mep_usd_per_tonne', mep, DATE '2024-01-31', mepv, FALSE FROM tail WHERE mep IS NOT NULL
  UNION ALL SELECT crop, 'export_duty_pct', duty, DATE '2024-01-31', 40.0, TRUE FROM tail WHERE duty IS NOT NULL),
cut AS (
  SELECT *, lever = 'export_duty_pct' AND closes AND s < DATE '2024-01-16' AND e >= DATE '2024-01-16' AS sp FROM spans)
SELECT crop, lever, s AS start_day, CASE WHEN sp THEN DATE '2024-01-15' ELSE e END AS end_day, v AS value FROM cut
UNION ALL SELECT crop, lever, DATE '2024-01-16', e, 20.0 FROM cut WHERE sp"""


def policy_intervals(spark, sf):
    return policy.state_intervals(policy_log(spark, sf), "2024-01-31", "2024-01-16")


@query("state_intervals", "SELECT crop, lever, start_day, end_day, value FROM intervals")
def state_intervals(spark, sf):
    return policy_intervals(spark, sf).withColumnsRenamed({"start": "start_day", "end": "end_day"})


@query("interval_overlap_join", """
WITH w AS (SELECT crop, unnest([DATE '2024-01-01', DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22', DATE '2024-01-29', DATE '2024-02-05']) AS week_start
           FROM (SELECT DISTINCT crop FROM policy_log)),
m AS (SELECT w.crop, w.week_start, lever, arg_min_null(value, start_day) AS v FROM w JOIN intervals i ON i.crop = w.crop AND start_day <= week_start + 6 AND end_day >= week_start
      WHERE end_day >= start_day GROUP BY ALL)
SELECT crop, week_start, CASE WHEN count(*) FILTER (lever = 'export_banned') = 0 THEN 0 ELSE max(v) FILTER (lever = 'export_banned') END AS export_banned,
  CASE WHEN count(*) FILTER (lever = 'mep_usd_per_tonne') = 0 THEN 0 ELSE max(v) FILTER (lever = 'mep_usd_per_tonne') END AS mep_usd_per_tonne,
  CASE WHEN count(*) FILTER (lever = 'export_duty_pct') = 0 THEN 0 ELSE max(v) FILTER (lever = 'export_duty_pct') END AS export_duty_pct FROM w LEFT JOIN m USING (crop, week_start) GROUP BY ALL
""")
def interval_overlap_join(spark, sf):
    log = policy_log(spark, sf)
    weeks = log.select("crop").distinct().withColumn(
        "week_start", F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-05', interval 7 days)")))
    spans = policy_intervals(spark, sf)
    return policy.interval_overlap_join(weeks, spans.where(F.col("end") >= F.col("start")))


EPISODES = [("e1", "A", "1997-06-15"), ("e2", "A", "1999-03-01"), ("e3", "N", "1998-09-20"), ("e4", "R", "1996-08-11"), ("e5", "R", "2000-05-07")]
CTES["episodes"] = "SELECT name, crop, CAST(d AS DATE) AS first_action FROM (VALUES " + ", ".join(map(str, EPISODES)) + ") t(name, crop, d)"
CTES["warning"] = """
SELECT crop, week_start, price, price / norm - 1 AS dev FROM (
  SELECT a.crop, a.week_start, a.price, avg(b.price) AS norm FROM crop_week a LEFT JOIN crop_week b
    ON b.crop = a.crop AND week(b.week_start) = week(a.week_start) AND isoyear(b.week_start) < isoyear(a.week_start) GROUP BY ALL)"""


def warning(spark, sf):
    """Crop-week series with its deviation from the walk-forward seasonal norm."""
    rows = W.walk_forward_climatology(crop_week(spark, sf), "price", ["crop"])
    return rows.select("crop", "week_start", "price", (F.col("price") / F.col("price_norm") - 1).alias("dev"))


@query("episode_labels", """
SELECT w.crop, week_start, CAST(count(name) > 0 AS INTEGER) AS label, coalesce(max(name), '') AS episode
FROM warning w LEFT JOIN episodes e ON e.crop = w.crop AND week_start >= first_action - 140 AND week_start < first_action AND dev >= 0.05 GROUP BY w.crop, week_start
""")
def episode_labels(spark, sf):
    return early_warning.episode_labels(warning(spark, sf), EPISODES, "dev", deviation=0.05).select("crop", "week_start", "label", "episode")


@query("placebo_windows", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY week_start) - 1 AS i FROM warning),
c AS (SELECT crop, week_start AS end_week FROM n WHERE i > 0 AND i % 20 = 0
      AND NOT EXISTS (SELECT 1 FROM episodes e WHERE e.crop = n.crop AND abs(n.week_start - e.first_action) < 280))
SELECT c.crop, end_week, rnd(coalesce(avg(dev) FILTER (dev >= 0.05), 0), 6) AS intensity, coalesce(count_if(dev >= 0.05), 0) AS n_weeks
FROM c LEFT JOIN warning w ON w.crop = c.crop AND w.week_start >= end_week - 140 AND w.week_start < end_week GROUP BY ALL
""")
def placebo_windows(spark, sf):
    rows = warning(spark, sf).withColumn("score", F.col("dev"))
    out = early_warning.placebo_windows(rows, EPISODES, "dev", "score", deviation=0.05)
    return out.select("crop", "end_week", fx.r("intensity", 6), "n_weeks")


@query("arrivals_interpolate", """
SELECT crop, market_id, week_start, rnd(CASE WHEN arrivals_tonnes_week IS NOT NULL THEN arrivals_tonnes_week
  WHEN n_w IS NOT NULL AND week_start - prev_week <= 28 THEN p_a + (n_a - p_a) * (week_start - prev_week) / (n_w - prev_week) END, 6) AS arrivals
FROM (SELECT g.*, next_week AS n_w, last_value(arrivals_tonnes_week IGNORE NULLS) OVER past AS p_a, first_value(arrivals_tonnes_week IGNORE NULLS) OVER future AS n_a FROM gaps g
WINDOW past AS (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       future AS (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""")
def interpolate_limited(spark, sf):
    out = W.interpolate_limited(fx.panel(spark, sf), P.ARRIVALS, 4)
    return out.select(*KEYS, fx.rnd(P.ARRIVALS, 6).alias("arrivals"))


@query("complete_series", """
WITH f AS (SELECT crop, market_id, week_start, modal_price_weighted AS p FROM panel)
SELECT crop, market_id, count(*) AS n_weeks, rnd(avg(p), 4) AS mean_price FROM f GROUP BY ALL HAVING count(p) = count(*)
""")
def complete_series(spark, sf):
    out = W.complete_series(fx.panel(spark, sf), P.PRICE)
    return out.groupBy("crop", "market_id").agg(F.count(F.lit(1)).alias("n_weeks"), fx.rnd(F.avg(P.PRICE)).alias("mean_price"))


@query("rank_within", """
WITH m AS (SELECT crop, market_id, count(*) AS n_weeks FROM weekly GROUP BY ALL)
SELECT crop, market_id, n_weeks, rank() OVER (PARTITION BY crop ORDER BY n_weeks DESC) + (count(*) OVER (PARTITION BY crop, n_weeks) - 1) / 2.0 AS rank FROM m
""")
def rank_within(spark, sf):
    n = fx.weekly(spark, sf).groupBy("crop", "market_id").agg(F.count(F.lit(1)).alias("n_weeks"))
    return W.rank_within(n, ["crop"], "n_weeks")


@query("season_runs", """
WITH d AS (SELECT DISTINCT l_returnflag AS crop, CAST(l_shipdate AS DATE) AS d FROM lineitem),
s AS (SELECT crop, d, CASE WHEN month(d) IN (2,3,4) THEN 'harvest' WHEN month(d) BETWEEN 5 AND 9 THEN 'storage' WHEN month(d) IN (10,11) THEN 'lean' END AS season FROM d),
c AS (SELECT *, CASE WHEN season IS NOT DISTINCT FROM lag(season) OVER w AND d - lag(d) OVER w = 1 THEN 0 ELSE 1 END AS chg FROM s WINDOW w AS (PARTITION BY crop ORDER BY d)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY crop ORDER BY d) AS run FROM c)
SELECT crop, season, min(d) AS "start", max(d) AS "end" FROM r WHERE season IS NOT NULL GROUP BY crop, run, season
""")
def season_runs(spark, sf):
    days = fx.daily_core(spark, sf).select("crop", "arrival_date").distinct()
    label = scalars.season_label(F.lit("potato"), F.month("arrival_date"))
    return W.season_runs(days.withColumn("season", label), ["crop"], "arrival_date", "season")


@query("lookback_sequence", """
WITH f AS (SELECT crop, market_id, week_start, coalesce(log_price, 0) AS a, coalesce(log_arr, 0) AS b, log_price,
  row_number() OVER (PARTITION BY crop, market_id ORDER BY week_start) AS i FROM logs)
SELECT crop, market_id, week_start, CAST(26 AS INTEGER) AS n_steps, rnd(sum(a) OVER w, 4) AS sum_price, rnd(sum(b) OVER w, 4) AS sum_arr,
  CAST(greatest(26 - i, 0) AS INTEGER) AS n_pad, rnd(target, 6) AS target
FROM (SELECT *, lead(log_price, 4) OVER (PARTITION BY crop, market_id ORDER BY week_start) AS target FROM f)
WINDOW w AS (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)
QUALIFY target IS NOT NULL
""")
def lookback_sequence(spark, sf):
    rows = fx.logs(spark, sf).withColumn("one", F.lit(1.0))
    seq = W.lookback_sequence(rows, ["log_price", "log_arr", "one"], "log_price", 4)
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda acc, step: acc + step[i])
    return seq.select(*KEYS, F.size("sequence").alias("n_steps"), fx.rnd(total(0)).alias("sum_price"), fx.rnd(total(1)).alias("sum_arr"),
                      (26 - total(2)).cast("int").alias("n_pad"), fx.r("target", 6))


@query("time_index", """
SELECT crop, market_id, week_start, CAST(dense_rank() OVER (ORDER BY week_start) - 1 AS INTEGER) AS time_idx FROM weekly
""")
def time_index(spark, sf):
    return W.time_index(fx.weekly(spark, sf).select(*KEYS))


@query("daily_curve")
def daily_curve(spark, sf):
    lagged = W.lags(fx.logs(spark, sf), "log_price", "k", [1, 4, 13, 26])
    last = W.tail_n_per_key(lagged, 1).withColumn("band", F.lit(0.1))
    out = W.daily_curve(last, [0, 7, 28, 91, 182], ["log_price", "k1", "k4", "k13", "k26"], "week_start", "band")
    return out.select("crop", "market_id", "date", "day", fx.r("trend"), fx.r("low"), fx.r("high"))
