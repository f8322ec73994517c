"""Projections, filters and label repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from catalog.reshape import orders
from pricegrid.functions import scalars
from pricegrid.operators import cleaning as C
from pricegrid.operators import panel as P

SEASONS = {
    "A": {"peak_arrival": [11, 12, 1, 2], "lean": [5, 6, 7], "kharif": [8, 9, 10]},
    "N": {"rabi_arrival": [2, 3, 4, 5], "lean": [9, 10, 11], "kharif": [8, 9]},
    "R": {"harvest": [2, 3, 4], "storage": [5, 6, 7, 8, 9], "lean": [10, 11]},
}


@query("date_window", """
SELECT crop, market_id, arrival_date, total_arrivals_tonnes FROM daily
WHERE arrival_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'
""")
def date_window(spark, sf):
    rows = P.date_window(fx.daily_core(spark, sf), "arrival_date", "1996-01-01", "1998-06-30")
    return rows.select("crop", "market_id", "arrival_date", "total_arrivals_tonnes")


@query("drop_invalid", """
SELECT market_id, q, p FROM (
  SELECT market_id, total_arrivals_tonnes - 3 AS q, CASE WHEN variety = 'F' AND total_arrivals_tonnes < 10 THEN NULL ELSE total_arrivals_tonnes END AS p FROM daily)
WHERE p IS NOT NULL AND q > 0
""")
def drop_invalid(spark, sf):
    q = F.col("total_arrivals_tonnes")
    rows = fx.daily_core(spark, sf).select(
        "market_id", (q - 3).alias("q"), F.when(~((F.col("variety") == "F") & (q < 10)), q).alias("p"))
    return P.drop_invalid(rows, "p", "q")


@query("clip_filter_by_group", """
SELECT crop, market_id, arrival_date, rnd(modal_price_rs_per_quintal, 4) AS price FROM clean
""")
def clip_filter_by_group(spark, sf):
    return fx.clean(spark, sf).select("crop", "market_id", "arrival_date", fx.rnd("modal_price_rs_per_quintal").alias("price"))


@query("normalise_name", """
SELECT p_partkey, trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', ' ', 'g')) AS name
FROM (SELECT p_partkey, '  ' || p_name || ' -- (' || p_type || ')/' || p_brand || '. ' AS raw FROM part)
""")
def normalise_name(spark, sf):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" -- ("), "p_type", F.lit(")/"), "p_brand", F.lit(". "))
    return fx.table(spark, sf, "part").select("p_partkey", scalars.normalise_name(raw).alias("name"))


@query("relabel_map", """
SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS segment FROM customer
""")
def relabel_map(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return C.relabel_map(c, "segment", {"HOUSEHOLD": "Home", "MACHINERY": "Machines"})


@query("split_combined_entity", """
WITH s AS (SELECT year, status AS entity, count(*) AS n, sum(price) AS value FROM monthly_orders GROUP BY ALL)
SELECT year, entity, n, rnd(value, 2) AS value FROM s WHERE entity <> 'O'
UNION ALL SELECT year, 'O minus F', CAST(sum(CASE entity WHEN 'O' THEN n WHEN 'F' THEN -n END) AS BIGINT), rnd(sum(CASE entity WHEN 'O' THEN value WHEN 'F' THEN -value END), 2)
FROM s WHERE entity IN ('O', 'F') GROUP BY year
""")
def split_combined_entity(spark, sf):
    s = orders(spark, sf).groupBy("year", F.col("status").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("value"))
    return C.split_combined_entity(s, "entity", "O", "F", "O minus F", ["n", "value"], ["year"]).withColumn("value", fx.rnd("value", 2))


@query("disambiguate_labels", """
WITH c AS (SELECT c_mktsegment AS crop, right(c_name, 3) AS market, c_custkey AS market_id, n_name AS state
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT crop, market_id, CASE WHEN count(DISTINCT market_id) OVER (PARTITION BY crop, market) > 1 THEN market || ' (' || state || ')' ELSE market END AS label FROM c
""")
def disambiguate_labels(spark, sf):
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_mktsegment").alias("crop"), F.right("c_name", F.lit(3)).alias("market"),
                    F.col("c_custkey").alias("market_id"), F.col("n_name").alias("state"))
    return C.disambiguate_labels(rows, ["crop"], "market", "market_id", "state").select("crop", "market_id", "label")


@query("categorical_codes", """
SELECT c_custkey, crop, CAST(CASE WHEN state IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY crop ORDER BY state NULLS LAST) - 1 END AS INTEGER) AS code
FROM (SELECT c_custkey, c_mktsegment AS crop, CASE WHEN c_acctbal < 0 THEN NULL ELSE n_name END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def categorical_codes(spark, sf):
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.col("c_mktsegment").alias("crop"), F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("state"))
    return C.categorical_codes(rows, "crop", {"state": "code"}).select("c_custkey", "crop", "code")


@query("coverage_band", """
SELECT crop, market_id, count(*) AS n_weeks,
       CASE WHEN count(*) / 357.0 >= 0.871 THEN 'Full (7yr+)' WHEN count(*) / 357.0 >= 0.558 THEN 'Good (4.5-7yr)' WHEN count(*) / 357.0 >= 0.248 THEN 'Moderate (2-4.5yr)'
            WHEN count(*) / 357.0 >= 0.124 THEN 'Short (1-2yr)' ELSE 'Thin (<1yr)' END AS band
FROM weekly GROUP BY crop, market_id
""")
def coverage_band(spark, sf):
    n = fx.weekly(spark, sf).groupBy("crop", "market_id").agg(F.count(F.lit(1)).alias("n_weeks"))
    return n.withColumn("band", scalars.coverage_band(F.col("n_weeks") / 357.0))


@query("season_flags", """
SELECT crop, market_id, week_start,
  CAST(crop = 'A' AND month(week_start) IN (11,12,1,2) AS INTEGER) AS season_peak_arrival,
  CAST((crop = 'A' AND month(week_start) IN (5,6,7)) OR (crop = 'N' AND month(week_start) IN (9,10,11)) OR (crop = 'R' AND month(week_start) IN (10,11)) AS INTEGER) AS season_lean,
  CAST((crop = 'A' AND month(week_start) IN (8,9,10)) OR (crop = 'N' AND month(week_start) IN (8,9)) AS INTEGER) AS season_kharif,
  CAST(crop = 'N' AND month(week_start) BETWEEN 2 AND 5 AS INTEGER) AS season_rabi_arrival,
  CAST(crop = 'R' AND month(week_start) BETWEEN 2 AND 4 AS INTEGER) AS season_harvest,
  CAST(crop = 'R' AND month(week_start) BETWEEN 5 AND 9 AS INTEGER) AS season_storage
FROM weekly
""")
def season_flags(spark, sf):
    rows = fx.weekly(spark, sf).select("crop", "market_id", "week_start")
    return C.season_flags(rows, seasons=SEASONS)


@query("season_label", """
SELECT crop, market_id, week_start,
  CASE WHEN crop = 'A' THEN CASE WHEN m IN (11,12,1,2) THEN 'peak_arrival' WHEN m IN (5,6,7) THEN 'lean' WHEN m IN (8,9,10) THEN 'kharif' END
       WHEN crop = 'N' THEN CASE WHEN m IN (2,3,4,5) THEN 'rabi_arrival' WHEN m IN (9,10,11) THEN 'lean' WHEN m = 8 THEN 'kharif' END
       ELSE CASE WHEN m IN (2,3,4) THEN 'harvest' WHEN m IN (5,6,7,8,9) THEN 'storage' WHEN m IN (10,11) THEN 'lean' END END AS season
FROM (SELECT *, month(week_start) AS m FROM weekly)
""")
def season_label(spark, sf):
    return fx.weekly(spark, sf).select("crop", "market_id", "week_start",
                                       scalars.season_label("crop", F.month("week_start"), SEASONS).alias("season"))


@query("calendar_parts", """
SELECT l_orderkey, l_linenumber, CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(week(d) AS INTEGER) AS iso_week,
       CAST(year(date_trunc('week', d)) AS INTEGER) AS year, CAST(month(date_trunc('week', d)) AS INTEGER) AS month, CAST(isodow(d) - 1 AS INTEGER) AS dow,
       CAST(year(date_trunc('week', d)) - 1995 AS INTEGER) AS year_trend
FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem)
""")
def calendar_parts(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"))
    return C.calendar_parts(rows, "d", fx.LAST_BASE_YEAR).drop("d")


@query("cyclic_features", """
SELECT market_id, crop, week_start, rnd(sin(2 * pi() * w / 52), 6) AS sin_week, rnd(cos(2 * pi() * w / 52), 6) AS cos_week, rnd(sin(4 * pi() * w / 52), 6) AS sin2_week,
       rnd(cos(4 * pi() * w / 52), 6) AS cos2_week, rnd(sin(2 * pi() * m / 12), 6) AS sin_month, rnd(cos(2 * pi() * m / 12), 6) AS cos_month
FROM (SELECT *, week(week_start) AS w, month(week_start) AS m FROM weekly)
""")
def cyclic_features(spark, sf):
    rows = fx.weekly(spark, sf).select("market_id", "crop", "week_start", F.weekofyear("week_start").alias("w"), F.month("week_start").alias("m"))
    out = C.cyclic_features(rows, "w", "m").drop("w", "m")
    return out.select("market_id", "crop", "week_start", *[fx.r(c, 6) for c in out.columns[3:]])


@query("log_transforms", """
SELECT crop, market_id, week_start, rnd(ln(1 + modal_price_weighted), 6) AS log_price, rnd(ln(1 + arrivals_tonnes_week), 6) AS log_arr,
       rnd(ln(greatest(arrivals_tonnes_week, 1)), 6) AS log_arr_clip1, rnd(modal_price_weighted, 4) AS price_back FROM panel
""")
def log_transforms(spark, sf):
    out = C.log_transforms(fx.panel(spark, sf))
    return out.select("crop", "market_id", "week_start", fx.r("log_price", 6), fx.r("log_arr", 6), fx.r("log_arr_clip1", 6), fx.r("price_back"))


@query("derived_range", """
SELECT crop, market_id, week_start, rnd(max(modal_price_rs_per_quintal) - min(modal_price_rs_per_quintal), 4) AS dtr FROM clean GROUP BY ALL
""")
def derived_range(spark, sf):
    w = fx.clean(spark, sf).withColumn("week_start", F.trunc("arrival_date", "week")).groupBy("crop", "market_id", "week_start").agg(
        F.max("modal_price_rs_per_quintal").alias("hi"), F.min("modal_price_rs_per_quintal").alias("lo"))
    return C.derived_range(w, "hi", "lo", "dtr").select("crop", "market_id", "week_start", fx.r("dtr"))


@query("null_safe_changed", """
SELECT crop, market_id, week_start,
  CASE WHEN modal_price_weighted IS DISTINCT FROM observed_price THEN 'price,' ELSE '' END || CASE WHEN trading_days IS DISTINCT FROM 1 THEN 'days' ELSE '' END AS changed
FROM panel JOIN gapfill USING (crop, market_id, week_start, trading_days)
UNION ALL SELECT p.crop, p.market_id, p.week_start,
  CASE WHEN modal_price_weighted IS DISTINCT FROM observed_price THEN 'price,' ELSE '' END || 'days' FROM panel p JOIN gapfill g USING (crop, market_id, week_start) WHERE p.trading_days IS NULL
""")
def null_safe_changed(spark, sf):
    p = fx.panel(spark, sf).withColumns({"observed": F.when(F.col("imputed") == 0, F.col(P.PRICE)), "one": F.lit(1)})
    out = C.null_safe_changed(p, {"price,": (P.PRICE, "observed"), "days": ("trading_days", "one")})
    return out.select("crop", "market_id", "week_start", F.concat_ws("", "changed").alias("changed"))


@query("null_default", """
SELECT crop, market_id, week_start, coalesce(arrivals_tonnes_week, 0.0) AS arrivals_tonnes_week, coalesce(imputed_method, 'none') AS imputed_method, coalesce(trading_days, 0) AS trading_days FROM panel
""")
def null_default(spark, sf):
    p = fx.panel(spark, sf).select("crop", "market_id", "week_start", P.ARRIVALS, "imputed_method", "trading_days")
    return C.null_default(p, {P.ARRIVALS: 0.0, "imputed_method": "none", "trading_days": 0})


@query("feature_fill_zero", """
SELECT crop, market_id, week_start, rnd(coalesce(log_price, 0), 6) AS log_price, rnd(coalesce(log_arr, 0), 6) AS log_arr FROM logs
""")
def feature_fill_zero(spark, sf):
    out = C.feature_fill_zero(fx.logs(spark, sf), ["log_price", "log_arr"])
    return out.select("crop", "market_id", "week_start", fx.r("log_price", 6), fx.r("log_arr", 6))


@query("facet_filter_page", """
SELECT crop, market_id, market, state, n_weeks FROM (SELECT crop, market_id, count(*) AS n_weeks FROM weekly GROUP BY ALL) JOIN markets USING (market_id)
WHERE crop IN ('A', 'N') AND lower(market) LIKE '%supplier#00%' ORDER BY n_weeks DESC, crop, market_id LIMIT 25 OFFSET 25
""")
def facet_filter_page(spark, sf):
    n = fx.weekly(spark, sf).groupBy("crop", "market_id").agg(F.count(F.lit(1)).alias("n_weeks")).join(
        fx.markets(spark, sf), "market_id").select("crop", "market_id", "market", "state", "n_weeks")
    return C.facet_filter_page(n, {"crop": ["A", "N"], "state": []}, "SUPPLIER#00", ["market"],
                               [F.col("n_weeks").desc(), F.col("crop"), F.col("market_id")], 1, 25)


@query("contains_flag", """
SELECT p_partkey, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') AS is_hit FROM part
""")
def contains_flag(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey", "p_name")
    out = C.contains_flag(C.contains_flag(p, "p_name", "RING", "a"), "p_name", "red", "b")
    return out.select("p_partkey", (F.col("a") | F.col("b")).alias("is_hit"))


@query("metadata_first", """
SELECT market_id, crop, variety, arrival_date FROM (
  SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY arrival_date, crop, variety) AS rn FROM daily) WHERE rn = 1
""")
def metadata_first(spark, sf):
    return C.metadata_first(fx.daily_core(spark, sf), ["market_id"], [], ["arrival_date", "crop", "variety"])


@query("significance_stars", """
SELECT o_orderkey, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1000000.0 END AS p FROM orders)
""")
def significance_stars(spark, sf):
    p = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000000.0)
    return fx.table(spark, sf, "orders").select("o_orderkey", scalars.significance_stars(p).alias("stars"))
