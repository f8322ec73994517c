"""Aggregation and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.joins import FOLDS, entities, leaders, predictions, state_month
from catalog.registry import CTES, query
from catalog.windows import KEYS, crop_week, layer
from pricegrid import values
from pricegrid.operators import aggregates as A
from pricegrid.operators import evaluation as E
from pricegrid.operators import joins as J
from pricegrid.operators import panel as P
from pricegrid.operators import windows as W

PQ = "modal_price_rs_per_quintal"


def named_panel(spark, sf):
    return fx.panel(spark, sf).join(fx.states(spark, sf), "market_id")


@query("weekly_weighted_mean", """
SELECT crop, market_id, week_start, rnd(modal_price_weighted, 4) AS modal_price_weighted, arrivals_tonnes_week, trading_days FROM weekly
""")
def weekly_weighted_mean(spark, sf):
    return fx.weekly(spark, sf).withColumn(P.PRICE, fx.rnd(P.PRICE))


@query("balanced_panel_filter", """
SELECT crop, market_id, week_start, arrivals_tonnes_week FROM weekly
WHERE (crop, market_id) IN (SELECT (crop, market_id) FROM weekly GROUP BY crop, market_id HAVING count(DISTINCT isoyear(week_start)) >= 7)
""")
def balanced_panel_filter(spark, sf):
    return P.balanced_panel_filter(fx.weekly(spark, sf), 7).select(*KEYS, P.ARRIVALS)


@query("coverage_filter", """
WITH c AS (SELECT *, 1 - avg(imputed) OVER (PARTITION BY crop, market_id) AS coverage FROM panel)
SELECT crop, market_id, week_start, imputed, rnd(coverage, 6) AS coverage FROM c WHERE coverage >= 0.43
""")
def coverage_filter(spark, sf):
    return P.coverage_filter(fx.panel(spark, sf), fx.COVERAGE).select(*KEYS, "imputed", fx.r("coverage", 6))


@query("coverage_by_year", """
SELECT crop, iso_year, count(DISTINCT week_start) FILTER (imputed = 0) AS weeks, count(DISTINCT market_id) FILTER (imputed = 0) AS markets, count(DISTINCT state) FILTER (imputed = 0) AS states,
  count(*) FILTER (imputed = 0) AS obs_rows, count(*) FILTER (imputed = 1) AS imputed_rows FROM panel JOIN markets USING (market_id) GROUP BY crop, iso_year
""")
def coverage_by_year(spark, sf):
    return A.coverage_by_year(named_panel(spark, sf))


@query("panel_summary_total", """
WITH p AS (SELECT crop, market_id, state FROM panel JOIN markets USING (market_id))
SELECT crop, count(*) AS n_rows, count(DISTINCT market_id) AS n_markets, count(DISTINCT state) AS n_states FROM p GROUP BY crop
UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT (crop, market_id)), count(DISTINCT state) FROM p
""")
def panel_summary_total(spark, sf):
    return A.panel_summary_total(named_panel(spark, sf))


CTES["profile"] = """
SELECT crop, market_id, count(*) FILTER (imputed = 0) AS weeks_present, CAST(count(DISTINCT year(week_start)) FILTER (imputed = 0) AS INTEGER) AS years_present,
  avg(modal_price_weighted) FILTER (imputed = 0) AS mean_price, avg(arrivals_tonnes_week) FILTER (imputed = 0) AS mean_arrivals,
  stddev_samp(modal_price_weighted) FILTER (imputed = 0) / avg(modal_price_weighted) FILTER (imputed = 0) * 100 AS cv_price, round((1 - avg(imputed)) * 100, 1) AS pct_coverage FROM panel GROUP BY ALL"""


@query("market_profile", """
SELECT crop, market_id, weeks_present, years_present, rnd(mean_price, 4) AS mean_price, rnd(mean_arrivals, 4) AS mean_arrivals, rnd(cv_price, 4) AS cv_price, pct_coverage FROM profile
""")
def market_profile(spark, sf):
    out = A.market_profile(fx.panel(spark, sf))
    return out.select("crop", "market_id", "weeks_present", "years_present", fx.r("mean_price"), fx.r("mean_arrivals"), fx.r("cv_price"), "pct_coverage")


@query("selection_summary", """
SELECT crop, count_if(pct_coverage >= 39) AS n_selected, count(*) AS n_total, count(DISTINCT state) FILTER (pct_coverage >= 39) AS n_states, min(pct_coverage) FILTER (pct_coverage >= 39) AS min_coverage,
  rnd(median(pct_coverage) FILTER (pct_coverage >= 39), 4) AS median_coverage, rnd(avg(mean_price) FILTER (pct_coverage >= 39), 4) AS mean_price FROM profile JOIN markets USING (market_id) GROUP BY crop
""")
def selection_summary(spark, sf):
    profile = A.market_profile(fx.panel(spark, sf)).join(fx.markets(spark, sf).select("market_id", "state"), "market_id")
    return A.selection_summary(profile, 39).withColumns({"median_coverage": fx.rnd("median_coverage"), "mean_price": fx.rnd("mean_price")})


@query("variety_collapse", """
WITH v AS (SELECT market_id, arrival_date, variety, avg(modal_price_rs_per_quintal) AS p, min(modal_price_rs_per_quintal) AS lo, max(modal_price_rs_per_quintal) AS hi FROM clean GROUP BY ALL)
SELECT market_id, arrival_date, rnd(avg(p), 4) AS modal, rnd(avg(lo), 4) AS min_price, rnd(avg(hi), 4) AS max_price FROM v GROUP BY ALL
""")
def variety_collapse(spark, sf):
    v = fx.clean(spark, sf).groupBy("market_id", "arrival_date", "variety").agg(
        F.avg(PQ).alias("modal"), F.min(PQ).alias("min_price"), F.max(PQ).alias("max_price"))
    out = A.variety_collapse(v, ["market_id", "arrival_date"], ["modal", "min_price", "max_price"])
    return out.select("market_id", "arrival_date", fx.r("modal"), fx.r("min_price"), fx.r("max_price"))


CTES["zone_day"] = """
SELECT s_nationkey AS zone_id, l_returnflag AS crop, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS tmax, avg(l_discount * 100) AS tmin, avg(l_tax * 100) AS tmean,
  avg(CAST(l_quantity > 35 AS INTEGER)) AS f35, avg(CAST(l_quantity > 38 AS INTEGER)) AS f38 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


def zone_day(spark, sf):
    li = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("s_nationkey").alias("zone_id"), F.col("l_returnflag").alias("crop"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.avg("l_quantity").alias("Tmax_C"), F.avg(F.col("l_discount") * 100).alias("Tmin_C"), F.avg(F.col("l_tax") * 100).alias("Tmean_C"),
        F.avg((F.col("l_quantity") > 35).cast("int")).alias("flag_above35"), F.avg((F.col("l_quantity") > 38).cast("int")).alias("flag_above38"))


CTES["climate"] = """
SELECT zone_id, crop, CAST(date_trunc('week', date) AS DATE) AS week_start, avg(tmax) AS era5_tmax, avg(tmin) AS era5_tmin, avg(tmean) AS era5_tmean, avg(tmax - tmin) AS era5_dtr,
  sum(f35) AS era5_heat_35, sum(f38) AS era5_heat_38, count(*) AS era5_n_days FROM zone_day GROUP BY ALL"""
CLIMATE = ["era5_tmax", "era5_tmin", "era5_tmean", "era5_dtr", "era5_heat_35", "era5_heat_38"]


@query("climate_weekly", "SELECT zone_id, crop, week_start, era5_n_days, " + ", ".join(f"rnd({c}, 6) AS {c}" for c in CLIMATE) + " FROM climate")
def climate_weekly(spark, sf):
    out = A.climate_weekly(zone_day(spark, sf))
    return out.select("zone_id", "crop", "week_start", "era5_n_days", *[fx.r(c, 6) for c in CLIMATE])


@query("rain_weekly", """
SELECT zone_id, crop, CAST(date_trunc('week', date) AS DATE) AS week_start, rnd(sum(tmax * 5), 6) AS chirps_rain_mm, rnd(max(tmean), 6) AS chirps_rain_max, rnd(avg(f35), 6) AS chirps_excess, count(*) AS chirps_n_pentad FROM zone_day GROUP BY ALL
""")
def rain_weekly(spark, sf):
    p = zone_day(spark, sf).withColumnsRenamed({"Tmax_C": "rain_mean_mm", "Tmean_C": "rain_max_mm", "flag_above35": "frac_excess_rain"})
    out = A.rain_weekly(p)
    return out.select("zone_id", "crop", "week_start", fx.r("chirps_rain_mm", 6), fx.r("chirps_rain_max", 6), fx.r("chirps_excess", 6), "chirps_n_pentad")


@query("dim_average", "SELECT crop, week_start, " + ", ".join(f"rnd(avg({c}), 6) AS {c}" for c in CLIMATE) + " FROM climate GROUP BY ALL")
def dim_average(spark, sf):
    out = A.dim_average(A.climate_weekly(zone_day(spark, sf)), CLIMATE)
    return out.select("crop", "week_start", *[fx.r(c, 6) for c in CLIMATE])


@query("completeness", """
WITH p AS (SELECT *, CASE WHEN iso_year < 1998 THEN 'before' ELSE 'after' END AS part FROM panel), l AS (
SELECT crop, part, avg(CAST(modal_price_weighted IS NOT NULL AS INTEGER)) * 100 AS a, avg(CAST(arrivals_tonnes_week IS NOT NULL AS INTEGER)) * 100 AS b,
  avg(CAST(modal_price_weighted IS NULL OR arrivals_tonnes_week IS NULL AS INTEGER)) * 100 AS c, avg(CAST(imputed_method IS NOT NULL AS INTEGER)) * 100 AS d, avg(CAST(imputed_method IS NULL AS INTEGER)) * 100 AS e FROM p GROUP BY ALL)
SELECT crop, part, 'modal_price_weighted_pct_filled' AS measure, rnd(a, 6) AS pct FROM l UNION ALL SELECT crop, part, 'arrivals_tonnes_week_pct_filled', rnd(b, 6) FROM l
UNION ALL SELECT crop, part, 'market_pct_any_null', rnd(c, 6) FROM l UNION ALL SELECT crop, part, 'imputed_method_pct_filled', rnd(d, 6) FROM l UNION ALL SELECT crop, part, 'method_pct_any_null', rnd(e, 6) FROM l
""")
def completeness(spark, sf):
    p = fx.panel(spark, sf).withColumn("part", F.when(F.col("iso_year") < 1998, "before").otherwise("after"))
    out = A.completeness(p, {"market": [P.PRICE, P.ARRIVALS], "method": ["imputed_method"]}, ["crop", "part"])
    return out.withColumn("pct", fx.rnd("pct", 6))


CTES["rel_price"] = """
SELECT crop, market_id, week_start, CAST(isodow(arrival_date) - 1 AS INTEGER) AS dow, modal_price_rs_per_quintal AS p, avg(modal_price_rs_per_quintal) OVER (PARTITION BY crop, market_id, week_start) AS m FROM clean"""


@query("dow_factor", "SELECT crop, dow, rnd(avg(p / m), 6) AS factor_mean, rnd(stddev_samp(p / m), 6) AS factor_std, count(*) AS n_obs FROM rel_price GROUP BY ALL")
def dow_factor(spark, sf):
    out = A.dow_factor(fx.clean(spark, sf))
    return out.select("crop", "dow", fx.r("factor_mean", 6), fx.r("factor_std", 6), "n_obs")


@query("disaggregation_backtest", """
WITH f AS (SELECT crop, dow, avg(p / m) AS f FROM rel_price GROUP BY ALL)
SELECT crop, 'flat' AS method, rnd(sqrt(avg((p - m) * (p - m))), 4) AS "RMSE", rnd(avg(abs(p - m) / p) * 100, 4) AS "MAPE", count(*) AS "N" FROM rel_price GROUP BY crop
UNION ALL SELECT crop, 'weekday', rnd(sqrt(avg((p - m * f) * (p - m * f))), 4), rnd(avg(abs(p - m * f) / p) * 100, 4), count(*) FROM rel_price JOIN f USING (crop, dow) GROUP BY crop
""")
def disaggregation_backtest(spark, sf):
    out = A.disaggregation_backtest(fx.clean(spark, sf))
    return out.select("crop", "method", fx.r("RMSE"), fx.r("MAPE"), "N")


@query("feature_ranges", """
SELECT crop, 'price' AS feature, rnd(min(modal_price_rs_per_quintal), 4) AS min, rnd(median(modal_price_rs_per_quintal), 4) AS median, rnd(max(modal_price_rs_per_quintal), 4) AS max FROM clean GROUP BY crop
UNION ALL SELECT crop, 'arrivals', min(total_arrivals_tonnes), median(total_arrivals_tonnes), max(total_arrivals_tonnes) FROM clean GROUP BY crop
""")
def feature_ranges(spark, sf):
    c = fx.clean(spark, sf).select("crop", F.col(PQ).alias("price"), F.col("total_arrivals_tonnes").alias("arrivals"))
    return A.feature_ranges(c, ["price", "arrivals"], ["crop"]).select("crop", "feature", fx.r("min"), fx.r("median"), fx.r("max"))


@query("response_quantiles", """
WITH c AS (SELECT crop, market_id, modal_price_weighted / lag(modal_price_weighted) OVER (PARTITION BY crop, market_id ORDER BY week_start) * 100 - 100 AS x FROM panel)
SELECT crop, count(x) AS n, rnd(quantile_cont(x, 0.1), 4) AS p10, rnd(quantile_cont(x, 0.5), 4) AS median, rnd(quantile_cont(x, 0.9), 4) AS p90 FROM c GROUP BY crop
""")
def response_quantiles(spark, sf):
    c = fx.panel(spark, sf).withColumn("pct_change", F.col(P.PRICE) / F.lag(P.PRICE).over(W.by()) * 100 - 100)
    return A.response_quantiles(c, keys=["crop"]).select("crop", "n", fx.r("p10"), fx.r("median"), fx.r("p90"))


@query("top_k_by_mean", """
SELECT crop, market_id, rnd(v, 6) AS mean_value, CAST(rank AS INTEGER) AS rank FROM (SELECT crop, market_id, v, row_number() OVER (PARTITION BY crop ORDER BY v DESC, market_id) AS rank
 FROM (SELECT crop, market_id, avg(arrivals_tonnes_week) AS v, 1 - avg(imputed) AS cov FROM panel GROUP BY ALL) WHERE cov >= 0.36) WHERE rank <= 5
""")
def top_k_by_mean(spark, sf):
    return leaders(spark, sf).select("crop", "market_id", fx.r("mean_value", 6), "rank")


YEARS = list(range(1995, 2002))


@query("coverage_matrix", """
WITH c AS (SELECT crop, market_id FROM panel GROUP BY crop, market_id QUALIFY row_number() OVER (PARTITION BY crop ORDER BY 1 - avg(imputed) DESC, market_id) <= 30),
w AS (SELECT crop, year(week_start) AS y, count(DISTINCT week_start) AS w FROM panel GROUP BY ALL), n AS (SELECT crop, market_id, year(week_start) AS y, count(*) AS n FROM panel JOIN c USING (crop, market_id) GROUP BY ALL)
SELECT crop, market_id, """ + ", ".join(f"rnd(coalesce(max(least(n / w * 100, 100)) FILTER (y = {y}), 0), 4) AS y{y}" for y in YEARS) + " FROM n JOIN w USING (crop, y) GROUP BY ALL")
def coverage_matrix(spark, sf):
    out = A.coverage_matrix(fx.panel(spark, sf), YEARS)
    return out.select("crop", "market_id", *[fx.rnd(F.col(str(y))).alias(f"y{y}") for y in YEARS])


@query("year_week_pivot", "SELECT CAST(isoyear(week_start) AS INTEGER) AS iso_year, " + ", ".join(
    f"rnd(avg(rain) FILTER (week(week_start) = {w}), 6) AS w{w}" for w in range(1, 54)) + " FROM layer GROUP BY ALL")
def year_week_pivot(spark, sf):
    out = A.year_week_pivot(layer(spark, sf), "rain", list(range(1, 54)))
    return out.select("iso_year", *[fx.rnd(F.col(str(w)), 6).alias(f"w{w}") for w in range(1, 54)])


@query("pairwise_correlation", """
WITH p AS (SELECT modal_price_weighted AS a, arrivals_tonnes_week AS b, trading_days AS c FROM panel)
SELECT 'a' AS a, 'a' AS b, rnd(corr(a, a), 6) AS r FROM p UNION ALL SELECT 'a', 'b', rnd(corr(a, b), 6) FROM p UNION ALL SELECT 'a', 'c', rnd(corr(a, c), 6) FROM p
UNION ALL SELECT 'b', 'b', rnd(corr(b, b), 6) FROM p UNION ALL SELECT 'b', 'c', rnd(corr(b, c), 6) FROM p UNION ALL SELECT 'c', 'c', rnd(corr(c, c), 6) FROM p
""")
def pairwise_correlation(spark, sf):
    p = fx.panel(spark, sf).select(F.col(P.PRICE).alias("a"), F.col(P.ARRIVALS).alias("b"), F.col("trading_days").alias("c"))
    return A.pairwise_correlation(p, ["a", "b", "c"]).withColumn("r", fx.rnd("r", 6))


@query("histogram_counts", """
SELECT crop, CAST(CASE WHEN c < 10 THEN 0 WHEN c < 25 THEN 1 WHEN c < 50 THEN 2 WHEN c < 75 THEN 3 WHEN c < 90 THEN 4 ELSE 5 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT crop, pct_coverage AS c FROM profile) GROUP BY ALL
""")
def histogram_counts(spark, sf):
    return A.histogram_counts(A.market_profile(fx.panel(spark, sf)), "pct_coverage")


@query("entity_counts", """
WITH s AS (SELECT crop, market_id, 1 AS sel FROM profile WHERE pct_coverage >= 39) SELECT crop, week_start, count(*) AS n_all, count(sel) AS n_selected FROM panel LEFT JOIN s USING (crop, market_id) GROUP BY ALL
""")
def entity_counts(spark, sf):
    p = fx.panel(spark, sf)
    return A.entity_counts(p, A.market_profile(p).where(F.col("pct_coverage") >= 39))


@query("market_span", """
SELECT crop, state, market_id, min(week_start) AS first_week, max(week_start) AS last_week, count(*) AS n_weeks, CASE WHEN count(*) / 200 >= 0.871 THEN 'Full (7yr+)' WHEN count(*) / 200 >= 0.558 THEN 'Good (4.5-7yr)'
  WHEN count(*) / 200 >= 0.248 THEN 'Moderate (2-4.5yr)' WHEN count(*) / 200 >= 0.124 THEN 'Short (1-2yr)' ELSE 'Thin (<1yr)' END AS coverage_category FROM weekly JOIN markets USING (market_id) GROUP BY ALL
""")
def market_span(spark, sf):
    return A.market_span(fx.weekly(spark, sf).join(fx.markets(spark, sf).select("market_id", "state"), "market_id"), 200)


CTES["edges"] = """
SELECT a.crop, a.market_id AS from_id, b.market_id AS to_id, corr(a.modal_price_weighted, b.modal_price_weighted) > 0.05 AS significant
FROM (SELECT * FROM panel JOIN leaders USING (crop, market_id) WHERE imputed = 0) a JOIN (SELECT * FROM panel JOIN leaders USING (crop, market_id) WHERE imputed = 0) b
ON a.crop = b.crop AND a.market_id <> b.market_id AND b.week_start = a.week_start + 7 GROUP BY ALL"""


@query("net_leadership", """
WITH o AS (SELECT crop, from_id AS market_id, count_if(significant) AS out_sig, count(*) AS out_n FROM edges GROUP BY ALL), i AS (SELECT crop, to_id AS market_id, count_if(significant) AS in_sig, count(*) AS in_n FROM edges GROUP BY ALL)
SELECT crop, market_id, out_sig, out_n, in_sig, in_n, rnd(out_sig / out_n - in_sig / in_n, 6) AS net_score FROM o FULL JOIN i USING (crop, market_id)
""")
def net_leadership(spark, sf):
    p = fx.panel(spark, sf).where(F.col("imputed") == 0).join(leaders(spark, sf).select("crop", "market_id"), ["crop", "market_id"])
    lagged = p.withColumn("week_start", F.date_sub("week_start", 7)).select("crop", "week_start", F.col("market_id").alias("to_id"), F.col(P.PRICE).alias("y"))
    pairs = p.select("crop", "week_start", F.col("market_id").alias("from_id"), F.col(P.PRICE).alias("x")).join(lagged, ["crop", "week_start"]).where(F.col("from_id") != F.col("to_id"))
    edges = pairs.groupBy("crop", "from_id", "to_id").agg((F.corr("x", "y") > 0.05).alias("significant"))
    return A.net_leadership(edges).select("crop", "market_id", "out_sig", "out_n", "in_sig", "in_n", fx.r("net_score", 6))


LAYERS = {"BUILDING": "price", "HOUSEHOLD": "arrivals", "MACHINERY": "macro"}


@query("importance_by_layer", """
WITH i AS (SELECT n_name AS crop, CASE c_mktsegment WHEN 'BUILDING' THEN 'price' WHEN 'HOUSEHOLD' THEN 'arrivals' WHEN 'MACHINERY' THEN 'macro' ELSE 'Other' END AS layer, sum(o_totalprice) / 1000 AS importance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT crop, layer, rnd(importance, 4) AS importance, rnd(importance / sum(importance) OVER (PARTITION BY crop) * 100, 6) AS pct_of_total FROM i
""")
def importance_by_layer(spark, sf):
    out = A.importance_by_layer(importances(spark, sf), LAYERS, ["crop"])
    return out.select("crop", "layer", fx.r("importance"), fx.r("pct_of_total", 6))


def importances(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("feature"))
    return state_month(spark, sf).join(c, "c_custkey").groupBy(F.col("state").alias("crop"), "feature").agg((F.sum("price") / 1000).alias("importance"))


@query("top_features", """
SELECT n_name AS crop, c_mktsegment AS feature, rnd(sum(o_totalprice) / 1000, 4) AS importance, CAST(row_number() OVER (PARTITION BY n_name ORDER BY sum(o_totalprice) DESC) AS INTEGER) AS rank
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment QUALIFY rank <= 3
""")
def top_features(spark, sf):
    return A.top_features(importances(spark, sf), 3, ["crop"]).select("crop", "feature", fx.r("importance"), "rank")


CTES["offsets"] = """
SELECT c.crop AS role, name AS episode, (c.week_start - first_action) / 7.0 AS weeks_since, price / avg(price) OVER (PARTITION BY c.crop) * 100 - 100 AS effect
FROM crop_week c JOIN episodes e ON c.crop = e.crop"""


@query("event_bins", """
WITH p AS (SELECT role, CAST(round_even(weeks_since, 0) AS INTEGER) AS week_bin, episode, avg(effect) AS v FROM offsets WHERE weeks_since BETWEEN -20 AND 30 GROUP BY ALL)
SELECT role, week_bin, count(*) AS n_episodes, rnd(avg(v), 4) AS mean_pct, rnd(stddev_samp(v), 4) AS std_pct, rnd(min(v), 4) AS min_pct, rnd(max(v), 4) AS max_pct FROM p GROUP BY ALL
""")
def event_bins(spark, sf):
    from pyspark.sql.window import Window

    from catalog.windows import EPISODES

    cw = crop_week(spark, sf).withColumn("effect", F.col("price") / F.avg("price").over(Window.partitionBy("crop")) * 100 - 100)
    eps = spark.createDataFrame(EPISODES, "episode string, crop string, day string")
    offs = cw.join(eps, "crop").select(F.col("crop").alias("role"), "episode", (F.datediff("week_start", F.col("day").cast("date")) / 7).alias("weeks_since"), "effect")
    out = A.event_bins(offs.where(F.col("weeks_since").between(-20, 30)))
    return out.select("role", "week_bin", "n_episodes", fx.r("mean_pct"), fx.r("std_pct"), fx.r("min_pct"), fx.r("max_pct"))


CTES["effects"] = """
SELECT crop, market_id, district, avg(log_price) FILTER (week_start >= DATE '1998-06-01') - avg(log_price) FILTER (week_start < DATE '1998-06-01') AS effect
FROM logs JOIN markets USING (market_id) GROUP BY ALL"""


@query("placebo_rank_p", """
WITH r AS (SELECT crop, avg(effect) AS real FROM effects WHERE district = 'ASIA' GROUP BY crop)
SELECT crop, rnd(max(real), 6) AS real_effect, count(*) AS n_placebo, count_if(abs(effect) >= abs(real)) AS n_as_extreme, rnd(count_if(abs(effect) >= abs(real)) / count(*), 6) AS p_value
FROM effects JOIN r USING (crop) WHERE district <> 'ASIA' GROUP BY crop
""")
def placebo_rank_p(spark, sf):
    late = F.col("week_start") >= "1998-06-01"
    e = fx.logs(spark, sf).join(fx.markets(spark, sf), "market_id").groupBy("crop", "market_id", "district").agg(
        (F.avg(F.when(late, F.col("log_price"))) - F.avg(F.when(~late, F.col("log_price")))).alias("effect"))
    real = e.where(F.col("district") == "ASIA").groupBy("crop").agg(F.avg("effect").alias("effect"))
    out = A.placebo_rank_p(e.where(F.col("district") != "ASIA"), real, keys=["crop"])
    return out.select("crop", fx.r("real_effect", 6), "n_placebo", "n_as_extreme", fx.r("p_value", 6))


@query("crop_week_series", """
SELECT crop, week_start, rnd(median(modal_price_weighted), 4) AS price, sum(arrivals_tonnes_week) AS arrivals, count(*) AS n_markets FROM panel WHERE imputed = 0 GROUP BY ALL
""")
def crop_week_series(spark, sf):
    return A.crop_week_series(fx.panel(spark, sf)).withColumn("price", fx.rnd("price"))


@query("provenance_counts", """
SELECT state, 'proxy of ' || crop AS source, count(*) AS n_months FROM (SELECT DISTINCT state, crop, year(arrival_date), month(arrival_date) FROM daily WHERE crop <> 'A') GROUP BY ALL
""")
def provenance_counts(spark, sf):
    m = fx.daily(spark, sf).select("state", "crop", F.year("arrival_date"), F.month("arrival_date")).distinct()
    src = F.when(F.col("crop") == "A", "direct").otherwise(F.concat(F.lit("proxy of "), "crop"))
    return A.provenance_counts(m.withColumn("source", src))


@query("name_conflicts", """
SELECT state, count(DISTINCT market) AS n_names FROM entities GROUP BY state HAVING count(DISTINCT market) > 1
""")
def name_conflicts(spark, sf):
    return A.name_conflicts(entities(spark, sf), "state", "market")


# evaluation

@query("rolling_origin_splits", """
WITH r AS (SELECT crop, fold, CASE WHEN week_start <= train_end THEN 'train' WHEN week_start > val_start AND week_start <= val_end THEN 'validation' WHEN week_start BETWEEN test_start AND test_end THEN 'test' END AS split FROM panel, folds)
SELECT crop, fold, count_if(split = 'train') AS n_train, count_if(split = 'validation') AS n_val, count_if(split = 'test') AS n_test, count_if(split = 'train') >= 100 AND count_if(split = 'test') >= 10 AS usable FROM r GROUP BY ALL
""")
def rolling_origin_splits(spark, sf):
    return E.fold_sizes(E.rolling_origin_splits(fx.panel(spark, sf), FOLDS), ["crop", "fold"])


@query("three_way_time_split", """
SELECT crop, market_id, week_start, CASE WHEN week_start <= DATE '1998-12-31' THEN 'train' WHEN week_start <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS split FROM weekly
""")
def three_way_time_split(spark, sf):
    return E.three_way_time_split(fx.weekly(spark, sf).select(*KEYS), "1998-12-31", "1999-12-31")


PRED = "variant, crop, fold, horizon_weeks, market_id, week_start, rnd(y_true, 4) AS y_true, rnd(y_pred, 4) AS y_pred"


@query("naive_persistence", f"SELECT {PRED} FROM preds WHERE variant = 'B1'")
def naive_persistence(spark, sf):
    out = E.naive_persistence(fx.logs(spark, sf), FOLDS)
    return out.withColumns({"y_true": fx.rnd("y_true"), "y_pred": fx.rnd("y_pred")})


@query("benchmarks", f"SELECT {PRED} FROM preds WHERE variant <> 'B1'")
def benchmarks(spark, sf):
    out = predictions(spark, sf).where(F.col("variant") != "B1")
    return out.withColumns({"y_true": fx.rnd("y_true"), "y_pred": fx.rnd("y_pred")})


CTES["metrics"] = """
SELECT variant, crop, fold, horizon_weeks, sqrt(avg(pow(y_true - y_pred, 2))) AS "RMSE", avg(abs(y_true - y_pred)) AS "MAE", avg(abs(y_true - y_pred) / y_true) * 100 AS "MAPE",
  1 - sum(pow(y_true - y_pred, 2)) / sum(pow(y_true - my, 2)) AS "R2", count(*) AS "N" FROM (SELECT *, avg(y_true) OVER (PARTITION BY variant, crop, fold, horizon_weeks) AS my FROM preds WHERE y_true > 0) GROUP BY ALL"""
CTES["summary"] = 'SELECT variant, crop, horizon_weeks, avg("RMSE") AS "RMSE", avg("MAE") AS "MAE", avg("MAPE") AS "MAPE", avg("R2") AS "R2" FROM metrics GROUP BY ALL'
CTES["mase_rows"] = """SELECT s.*, n."MAE" AS naive_mae, s."MAE" / n."MAE" AS mase, (n."MAPE" - s."MAPE") / n."MAPE" * 100 AS skill FROM summary s JOIN summary n ON n.variant = 'B1' AND n.crop = s.crop AND n.horizon_weeks = s.horizon_weeks"""
ERRORS = ["RMSE", "MAE", "MAPE", "R2"]
ERR_SQL = ", ".join(f'rnd("{c}", 4) AS "{c}"' for c in ERRORS)


def metrics(spark, sf):
    return E.forecast_metrics(predictions(spark, sf), rounded=False)


def summary(spark, sf):
    return E.fold_mean_summary(metrics(spark, sf), rounded=False)


@query("forecast_metrics", f'SELECT variant, crop, fold, horizon_weeks, {ERR_SQL}, "N" FROM metrics')
def forecast_metrics(spark, sf):
    return metrics(spark, sf).select(*E.CELL, *[fx.r(c) for c in ERRORS], "N")


@query("fold_mean_summary", f"SELECT variant, crop, horizon_weeks, {ERR_SQL} FROM summary")
def fold_mean_summary(spark, sf):
    return summary(spark, sf).select("variant", "crop", "horizon_weeks", *[fx.r(c) for c in ERRORS])


@query("mase", 'SELECT variant, crop, horizon_weeks, rnd("MAE", 4) AS "MAE", rnd(mase, 6) AS "MASE", rnd(skill, 4) AS skill_pct FROM mase_rows')
def mase(spark, sf):
    out = E.skill_vs_naive(E.mase(summary(spark, sf)))
    return out.select("variant", "crop", "horizon_weeks", fx.r("MAE"), fx.r("MASE", 6), fx.r("skill_pct"))


@query("skill_pivot", """SELECT crop, horizon_weeks, rnd(max((1 - mase) * 100) FILTER (variant = 'B2'), 4) AS "B2", rnd(max((1 - mase) * 100) FILTER (variant = 'B3'), 4) AS "B3" FROM mase_rows GROUP BY ALL""")
def skill_pivot(spark, sf):
    return E.skill_pivot(E.mase(summary(spark, sf)), ["B2", "B3"]).select("crop", "horizon_weeks", fx.r("B2"), fx.r("B3"))


@query("crossover_horizon", "SELECT crop, CAST(min(horizon_weeks) FILTER (mase < 1) AS INTEGER) AS crossover_horizon_weeks FROM mase_rows WHERE variant = 'B3' GROUP BY crop")
def crossover_horizon(spark, sf):
    return E.crossover_horizon(E.mase(summary(spark, sf)), "B3")


CTES["week_preds"] = "SELECT variant, crop, fold, horizon_weeks, week_start, avg(y_true) AS y_true, avg(y_pred) AS y_pred, count(*) AS n_markets FROM preds GROUP BY ALL"


@query("weekly_mean_predictions", "SELECT variant, crop, fold, horizon_weeks, week_start, rnd(y_true, 4) AS y_true, rnd(y_pred, 4) AS y_pred, n_markets FROM week_preds")
def weekly_mean_predictions(spark, sf):
    return E.weekly_mean_predictions(predictions(spark, sf)).withColumns({"y_true": fx.rnd("y_true"), "y_pred": fx.rnd("y_pred")})


CTES["spikes"] = """
SELECT p.crop, p.market_id, p.week_start, modal_price_weighted, threshold, lead(modal_price_weighted) OVER (PARTITION BY p.crop, p.market_id ORDER BY p.week_start) AS nxt
FROM panel p JOIN (SELECT crop, quantile_cont(modal_price_weighted, 0.9) AS threshold FROM panel WHERE week_start <= DATE '1998-12-31' GROUP BY crop) USING (crop)"""


@query("spike_label", "SELECT crop, market_id, week_start, CAST(nxt > threshold AS INTEGER) AS spike FROM spikes WHERE nxt IS NOT NULL")
def spike_label(spark, sf):
    return E.spike_label(fx.panel(spark, sf), "1998-12-31").select(*KEYS, "spike")


@query("spike_rate", "SELECT crop, count(*) AS n, rnd(max(threshold), 4) AS threshold, rnd(avg(CAST(nxt > threshold AS INTEGER)), 6) AS spike_rate FROM spikes WHERE nxt IS NOT NULL GROUP BY crop")
def spike_rate(spark, sf):
    out = E.spike_rate(E.spike_label(fx.panel(spark, sf), "1998-12-31"))
    return out.select("crop", "n", fx.r("threshold"), fx.r("spike_rate", 6))


@query("error_lookup", """SELECT crop || '_' || horizon_weeks || 'w' AS key, rnd("RMSE", 4) AS rmse, rnd("MAPE", 4) AS mape FROM summary WHERE variant = 'B3'""")
def error_lookup(spark, sf):
    return E.error_lookup(metrics(spark, sf), "B3").select("key", fx.r("rmse"), fx.r("mape"))


@query("forecast_band", """
WITH l AS (SELECT crop, market_id, exp(log_price) - 1 AS last_price, exp(ma4) - 1 AS f FROM bench QUALIFY row_number() OVER (PARTITION BY crop, market_id ORDER BY week_start DESC) = 1),
h AS (SELECT *, unnest([0, 1, 4, 13, 26]) AS h FROM l WHERE f IS NOT NULL AND last_price IS NOT NULL)
SELECT h.crop, market_id, CAST(h AS INTEGER) AS horizon_weeks, rnd(CASE h WHEN 0 THEN last_price ELSE f END, 4) AS mid, rnd(CASE h WHEN 0 THEN last_price ELSE f - "RMSE" END, 4) AS low, rnd(CASE h WHEN 0 THEN last_price ELSE f + "RMSE" END, 4) AS high
FROM h LEFT JOIN summary s ON s.variant = 'B3' AND s.crop = h.crop AND s.horizon_weeks = h
""")
def forecast_band(spark, sf):
    last = W.tail_n_per_key(W.benchmark_predictors(fx.logs(spark, sf)), 1)
    points = last.select("crop", "market_id", F.expm1("log_price").alias("last_price"), F.expm1("moving_average_4").alias("forecast")).where(
        F.col("forecast").isNotNull() & F.col("last_price").isNotNull()).withColumn("horizon_weeks", F.explode(F.array(*[F.lit(h) for h in (0, 1, 4, 13, 26)])))
    out = E.forecast_band(points, E.error_lookup(metrics(spark, sf), "B3"))
    return out.select("crop", "market_id", "horizon_weeks", fx.r("mid"), fx.r("low"), fx.r("high"))


@query("episode_errors", """
WITH w AS (SELECT crop, horizon_weeks, week_start, arg_min(y_true, fold) FILTER (variant = 'B3') AS y, arg_min(y_pred, fold) FILTER (variant = 'B3') AS m, arg_min(y_pred, fold) FILTER (variant = 'B1') AS b FROM week_preds GROUP BY ALL)
SELECT name, w.crop, horizon_weeks, count(*) AS n_weeks, rnd(avg(abs(y - m)), 4) AS model_mae, rnd(avg(abs(y - b)), 4) AS naive_mae, rnd(avg(abs(y - m) / y) * 100, 4) AS model_mape, rnd(avg(abs(y - b) / y) * 100, 4) AS naive_mape, avg(abs(y - m)) < avg(abs(y - b)) AS model_wins
FROM w JOIN episodes e ON e.crop = w.crop AND week_start BETWEEN first_action - 60 AND first_action + 60 WHERE m IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 2
""")
def episode_errors(spark, sf):
    from catalog.windows import EPISODES

    eps = spark.createDataFrame(EPISODES, "name string, crop string, day string").select(
        "name", "crop", F.date_sub(F.col("day").cast("date"), 60).alias("core_start"), F.date_add(F.col("day").cast("date"), 60).alias("core_end"))
    out = E.episode_errors(E.weekly_mean_predictions(predictions(spark, sf)), eps, "B3", "B1")
    return out.select("name", "crop", "horizon_weeks", "n_weeks", *[fx.r(c) for c in ("model_mae", "naive_mae", "model_mape", "naive_mape")], "model_wins")


CTES["live"] = """
SELECT o.crop, h AS horizon_weeks, f, nv, a.observed_price AS y, o.imputed FROM (SELECT *, unnest([1, 4, 13, 26]) AS h FROM (SELECT crop, market_id, week_start, imputed, exp(ma4) - 1 AS f, exp(log_price) - 1 AS nv FROM bench
  WHERE ma4 IS NOT NULL AND log_price IS NOT NULL)) o JOIN gapfill a ON a.crop = o.crop AND a.market_id = o.market_id AND a.week_start = o.week_start + 7 * h AND a.imputed = 0"""


def live_errors(spark, sf):
    rows = W.benchmark_predictors(fx.logs(spark, sf))
    rows = rows.where(F.col("moving_average_4").isNotNull() & F.col("log_price").isNotNull())
    forecasts = rows.select(*KEYS, F.col("imputed").alias("origin_imputed"), F.expm1("moving_average_4").alias("forecast"), F.expm1("log_price").alias("naive"),
                            F.lit(True).alias("sufficient_history"), F.lit(False).alias("stale_reference"), F.explode(F.array(*map(F.lit, values.HORIZONS))).alias("horizon_weeks"))
    return E.validation_errors(J.forecast_actual_join(forecasts, fx.panel(spark, sf)))


@query("validation_summary", """
WITH e AS (SELECT *, abs(f - y) / y * 100 AS am, abs(nv - y) / y * 100 AS an FROM live), s AS (SELECT *, 'all' AS subset FROM e UNION ALL SELECT *, 'clean' FROM e WHERE imputed = 0)
SELECT crop, CAST(horizon_weeks AS INTEGER) AS horizon_weeks, subset, count(*) AS n_rows, rnd(avg(am), 4) AS mean_ape_model, rnd(avg(an), 4) AS mean_ape_naive, rnd(avg(CAST(am < an AS INTEGER)), 6) AS share_model_better, rnd(avg(f), 4) AS mean_forecast, rnd(avg(y), 4) AS mean_actual,
  rnd(median(am), 4) AS median_ape_model, rnd(median(an), 4) AS median_ape_naive FROM s GROUP BY ALL
""")
def validation_summary(spark, sf):
    out = E.validation_summary(live_errors(spark, sf), ["crop", "horizon_weeks"], F.col("origin_imputed") == 0)
    num = ["mean_ape_model", "mean_ape_naive", "mean_forecast", "mean_actual", "median_ape_model", "median_ape_naive"]
    return out.select("crop", "horizon_weeks", "subset", "n_rows", fx.r("share_model_better", 6), *[fx.r(c) for c in num])


@query("standardise_by_train", """
WITH s AS (SELECT *, avg(log_price) FILTER (week_start <= DATE '1998-12-31') OVER (PARTITION BY crop) AS m, stddev_pop(log_price) FILTER (week_start <= DATE '1998-12-31') OVER (PARTITION BY crop) AS sd FROM logs)
SELECT crop, market_id, week_start, rnd((log_price - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END, 6) AS log_price FROM s
""")
def standardise_by_train(spark, sf):
    out = E.standardise_by_train(fx.logs(spark, sf).select(*KEYS, "log_price"), ["log_price"], F.col("week_start") <= "1998-12-31", ["crop"])
    return out.select(*KEYS, fx.r("log_price", 6))
