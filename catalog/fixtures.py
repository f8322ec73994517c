"""Driver-table stand-ins for the market data, once in Spark and once as oracle CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import CTES
from pricegrid.functions.sizes import small_side
from pricegrid.operators import panel as P
from pricegrid.plans import panel_build

BOUNDS = {"A": (100.0, 20000.0), "N": (500.0, 12000.0), "R": (400.0, 35000.0)}
COVERAGE = 0.43
LAST_BASE_YEAR = 1995

CTES["bounds"] = "SELECT * FROM (VALUES ('A',100.0,20000.0),('N',500.0,12000.0),('R',400.0,35000.0)) t(crop,lo,hi)"
CTES["daily"] = """
SELECT l_returnflag AS crop, l_suppkey AS market_id, s_name AS market, n_name AS state, r_name AS district,
       CAST(l_shipdate AS DATE) AS arrival_date, l_linestatus AS variety, l_quantity AS total_arrivals_tonnes,
       l_extendedprice / l_quantity AS modal_price_rs_per_quintal
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""
CTES["markets"] = """
SELECT s_suppkey AS market_id, s_name AS market, n_name AS state, r_name AS district
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTES["clean"] = """
SELECT l_returnflag AS crop, l_suppkey AS market_id, CAST(l_shipdate AS DATE) AS arrival_date,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, l_linestatus AS variety,
       l_quantity AS total_arrivals_tonnes, l_extendedprice / l_quantity AS modal_price_rs_per_quintal
FROM lineitem JOIN bounds ON crop = l_returnflag
WHERE l_quantity > 0 AND l_extendedprice / l_quantity BETWEEN lo AND hi"""
CTES["weekly"] = """
SELECT crop, market_id, week_start,
       sum(modal_price_rs_per_quintal * total_arrivals_tonnes) / sum(total_arrivals_tonnes) AS modal_price_weighted,
       sum(total_arrivals_tonnes) AS arrivals_tonnes_week,
       CAST(count(DISTINCT arrival_date) AS INTEGER) AS trading_days
FROM clean GROUP BY crop, market_id, week_start"""
CTES["grid"] = """
SELECT crop, market_id,
       CAST(unnest(generate_series(CAST(first_week AS TIMESTAMP), CAST(last_week AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE)
         AS week_start
FROM (SELECT crop, market_id, min(week_start) AS first_week FROM weekly GROUP BY crop, market_id)
JOIN (SELECT crop, max(week_start) AS last_week FROM weekly GROUP BY crop) USING (crop)"""
CTES["gaps"] = """
SELECT *, row_number() OVER w AS t,
       last_value(CASE WHEN modal_price_weighted IS NOT NULL THEN week_start END IGNORE NULLS) OVER past AS prev_week,
       first_value(CASE WHEN modal_price_weighted IS NOT NULL THEN week_start END IGNORE NULLS) OVER future AS next_week,
       last_value(modal_price_weighted IGNORE NULLS) OVER past AS prev_price,
       first_value(modal_price_weighted IGNORE NULLS) OVER future AS next_price,
       max(week_start) OVER (PARTITION BY crop, market_id) AS end_week
FROM grid LEFT JOIN weekly USING (crop, market_id, week_start)
WINDOW w AS (PARTITION BY crop, market_id ORDER BY week_start),
       past AS (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       future AS (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
CTES["gapfill"] = """
SELECT crop, market_id, week_start, modal_price_weighted AS observed_price, arrivals_tonnes_week, trading_days,
       CAST(CASE WHEN modal_price_weighted IS NULL THEN 1 ELSE 0 END AS INTEGER) AS imputed,
       CAST(CASE WHEN modal_price_weighted IS NOT NULL THEN 0
                 WHEN next_week IS NULL THEN date_diff('day', prev_week, end_week) // 7
                 ELSE date_diff('day', prev_week, next_week) // 7 - 1 END AS INTEGER) AS gap_length,
       CASE WHEN modal_price_weighted IS NOT NULL THEN modal_price_weighted
            WHEN next_week IS NOT NULL AND date_diff('day', prev_week, week_start) <= 14
            THEN prev_price + (next_price - prev_price) * date_diff('day', prev_week, week_start)
                 / date_diff('day', prev_week, next_week) END AS linear_price
FROM gaps"""
CTES["season_med"] = """
SELECT crop, market_id, month(week_start) AS m, median(observed_price) AS smed
FROM gapfill WHERE imputed = 0 GROUP BY ALL"""
CTES["panel"] = """
SELECT g.crop, g.market_id, g.week_start, CAST(isoyear(g.week_start) AS INTEGER) AS iso_year,
       CAST(week(g.week_start) AS INTEGER) AS iso_week,
       CASE WHEN linear_price IS NOT NULL THEN linear_price
            WHEN gap_length BETWEEN 3 AND 8 THEN smed END AS modal_price_weighted,
       arrivals_tonnes_week, trading_days, imputed,
       CASE WHEN imputed = 0 THEN 'observed' WHEN linear_price IS NOT NULL THEN 'linear'
            WHEN gap_length BETWEEN 3 AND 8 AND smed IS NOT NULL THEN 'seasonal_median' END AS imputed_method
FROM gapfill g LEFT JOIN season_med s
  ON s.crop = g.crop AND s.market_id = g.market_id AND s.m = month(g.week_start)"""
CTES["logs"] = """
SELECT *, ln(1 + modal_price_weighted) AS log_price, ln(1 + arrivals_tonnes_week) AS log_arr FROM panel"""

PANEL_COLUMNS = [
    "crop", "market_id", "week_start", "iso_year", "iso_week", P.PRICE, P.ARRIVALS,
    "trading_days", "imputed", "imputed_method",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def markets(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("s_suppkey").alias("market_id"), F.col("s_name").alias("market"),
                F.col("n_name").alias("state"), F.col("r_name").alias("district"))
    )


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Market and state; measured and broadcast, so that a panel they are joined to stays in the grid's partitions."""
    return small_side(markets(spark, sf).select("market_id", "state"))


def daily_core(spark: SparkSession, sf: str) -> DataFrame:
    """Fact columns only; names are joined after aggregation."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("crop"), F.col("l_suppkey").alias("market_id"),
        F.col("l_shipdate").cast("date").alias("arrival_date"), F.col("l_linestatus").alias("variety"),
        F.col("l_quantity").alias("total_arrivals_tonnes"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("modal_price_rs_per_quintal"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_core(spark, sf).join(markets(spark, sf), "market_id")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.drop_invalid(daily_core(spark, sf), "modal_price_rs_per_quintal", "total_arrivals_tonnes")
    return P.clip_filter_by_group(rows, "crop", "modal_price_rs_per_quintal", BOUNDS)


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return P.weekly_weighted_mean(clean(spark, sf))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return P.complete_grid(weekly(spark, sf), ends=P.last_weeks(clean(spark, sf)))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.build_panel(daily_core(spark, sf), BOUNDS).select(*PANEL_COLUMNS)


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).withColumn("log_price", F.log1p(P.PRICE)).withColumn("log_arr", F.log1p(P.ARRIVALS))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return panel_build.market_panel(daily_core(spark, sf), markets(spark, sf), BOUNDS, COVERAGE)


def rnd(expr, digits: int = 4) -> F.Column:
    """Output rounding, nudged off exact halves; the oracles' ``rnd`` does the same."""
    return F.round((F.col(expr) if isinstance(expr, str) else expr) + 1e-9, digits)


def r(column: str, digits: int = 4) -> F.Column:
    return rnd(column, digits).alias(column)
