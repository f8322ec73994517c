"""Sources, sinks and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as fx
from catalog.registry import CTES, query
from pricegrid.operators import panel as P
from pricegrid.session import ensure_checkpoint_dir
from pricegrid.sources import incremental, readers, reshape, writers

CTES["monthly_orders"] = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, o_orderkey,
       CAST(o_orderdate AS DATE) AS order_date
FROM orders"""


def orders(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"), "o_orderkey", "o_custkey",
        F.col("o_orderdate").cast("date").alias("order_date"))


@query("read_daily", """
SELECT market_id, CASE WHEN total_arrivals_tonnes = 13 THEN NULL ELSE total_arrivals_tonnes END AS total_arrivals_tonnes,
       arrival_date, variety
FROM (SELECT l_suppkey AS market_id, l_quantity AS total_arrivals_tonnes, CAST(l_shipdate AS DATE) AS arrival_date,
             l_linestatus AS variety FROM lineitem)
WHERE NOT (dayofmonth(arrival_date) = 31 AND month(arrival_date) = 12)
""")
def read_daily(spark, sf):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    text = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("market_id"),
        F.when(F.col("l_quantity") == 13, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("total_arrivals_tonnes"),
        F.when(day.endswith("-12-31"), "31st of December").otherwise(day).alias("arrival_date"),
        F.col("l_linestatus").alias("variety"))
    schema = T.StructType([
        T.StructField("market_id", T.LongType()), T.StructField("total_arrivals_tonnes", T.DoubleType()),
        T.StructField("arrival_date", T.DateType()), T.StructField("variety", T.StringType())])
    return readers.coerce(text, schema, required=["arrival_date"])


@query("read_many_union", """
SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region UNION ALL BY NAME SELECT * FROM supplier
""")
def read_many_union(spark, sf):
    names = ["nation", "region", "no_such_zone", "supplier"]
    return readers.read_many_union(spark, [f"{sf}/{n}.parquet" for n in names], fmt="parquet")


@query("parse_thousands", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def parse_thousands(spark, sf):
    text = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit(" "), F.format_number("o_totalprice", 2)).alias("price"))
    return readers.parse_thousands(text, ["price"])


@query("column_pruned_read", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def column_pruned_read(spark, sf):
    return readers.column_pruned_read(spark, f"{sf}/customer.parquet", ["c_nationkey", "c_mktsegment"]).distinct()


@query("write_table", """
SELECT crop, count(*) AS n_rows, count(DISTINCT market_id) AS n_markets, rnd(sum(arrivals_tonnes_week), 2) AS arrivals
FROM weekly GROUP BY crop
""")
def write_table(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/write_table_{sf.rstrip('/').rsplit('/', 1)[-1]}"
    writers.write_table(fx.weekly(spark, sf), path)
    return spark.read.parquet(path).groupBy("crop").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("market_id").alias("n_markets"),
        fx.rnd(F.sum(P.ARRIVALS), 2).alias("arrivals"))


@query("write_json_meta", """
SELECT crop || '_' || market_id AS key,
       json_object('n_weeks', count(*), 'first_week', min(week_start)::VARCHAR, 'last_week', max(week_start)::VARCHAR)::VARCHAR AS json
FROM weekly GROUP BY crop, market_id
""")
def write_json_meta(spark, sf):
    spans = fx.weekly(spark, sf).groupBy("crop", "market_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("week_start").alias("a"), F.max("week_start").alias("b"))
    return writers.json_meta(spans, F.concat_ws("_", "crop", "market_id"), n_weeks="n", first_week="a", last_week="b")


@query("append_after_high_water_mark", """
SELECT event_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20'
UNION ALL
SELECT event_id, CAST(ts AS DATE) AS day, event_type FROM events
WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20')
""")
def append_after_high_water_mark(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"), "event_type")
    return incremental.append_after_high_water_mark(
        e.where(F.col("day") < "2024-01-20"), e.where(F.col("day") >= "2024-01-15"), "day")


@query("replace_tail", """
SELECT o_orderkey, order_date, CASE WHEN order_date >= DATE '1998-01-01' THEN price * 2 ELSE price END AS price FROM monthly_orders
""")
def replace_tail(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "order_date", "price")
    newer = o.where(F.col("order_date") >= "1998-01-01").withColumn("price", F.col("price") * 2)
    return incremental.replace_tail(o, newer, "order_date", "1998-01-01")


def wide_by_status(spark, sf):
    return orders(spark, sf).groupBy("year", "month").pivot("status", ["F", "O", "P"]).agg(F.count(F.lit(1)))


@query("melt_wide_to_long", """
SELECT year, month, status AS state, count(*) AS n_orders FROM monthly_orders GROUP BY ALL
""")
def melt_wide_to_long(spark, sf):
    long = reshape.melt_wide_to_long(wide_by_status(spark, sf), ["year", "month"], ["F", "O", "P"], "state", "n_orders")
    return long.where(F.col("n_orders").isNotNull())


@query("coalesce_split_series", "SELECT year, month, count(*) AS india, count_if(status = 'P') AS goa FROM monthly_orders GROUP BY ALL")
def coalesce_split_series(spark, sf):
    early = F.col("year") < 1998
    m = orders(spark, sf).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("status") == "P").alias("p"))
    split = m.select("year", "month",
                     F.when(early, F.col("all")).alias("i1"), F.when(~early, F.col("all")).alias("i2"),
                     F.when(early, F.col("p")).alias("g1"), F.when(~early, F.col("p")).alias("g2"))
    return reshape.coalesce_split_series(split, {"india": ["i1", "i2"], "goa": ["g1", "g2"]}, ["year", "month"])


@query("fiscal_wide_to_calendar", """
SELECT CAST(make_date(year, month, 1) AS DATE) AS date, year, month, count(*) AS value FROM monthly_orders GROUP BY ALL
""")
def fiscal_wide_to_calendar(spark, sf):
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    number = {n: i + 1 for i, n in enumerate(names)}
    fiscal = orders(spark, sf).withColumn("fy", F.col("year") - (F.col("month") < 4).cast("int"))
    wide = fiscal.groupBy("fy").agg(*[
        F.nullif(F.count_if(F.col("month") == i), F.lit(0)).alias(n) for n, i in number.items()])
    return reshape.fiscal_wide_to_calendar(wide, "fy", number, "value")


@query("parse_dates_multiformat", """
SELECT o_orderkey, CASE WHEN priority LIKE '5%' THEN CAST(date_trunc('month', order_date) AS DATE) ELSE order_date END AS parsed FROM monthly_orders
""")
def parse_dates_multiformat(spark, sf):
    styles = {"1": "yyyy-MM-dd", "2": "dd-MM-yyyy", "3": "dd-MMM-yyyy", "4": "yyyyMMdd"}
    text = F.date_format("order_date", "yyyyMM")
    for first, style in styles.items():
        text = F.when(F.col("priority").startswith(first), F.date_format("order_date", style)).otherwise(text)
    df = orders(spark, sf).select("o_orderkey", text.alias("raw"))
    return readers.parse_dates_multiformat(df, "raw", "parsed").drop("raw")


@query("month_start_dedupe", """
SELECT status, CAST(date_trunc('month', order_date) AS DATE) AS order_date, o_orderkey, price FROM monthly_orders
QUALIFY row_number() OVER (PARTITION BY status, year, month ORDER BY monthly_orders.order_date, o_orderkey) = 1
""")
def month_start_dedupe(spark, sf):
    o = orders(spark, sf).select("status", "order_date", "o_orderkey", "price")
    return reshape.month_start_dedupe(o, "order_date", ["order_date", "o_orderkey"], ["status"])


@query("tagged_row_filter", """
SELECT o_orderkey, year, month FROM monthly_orders WHERE status = 'F'
""")
def tagged_row_filter(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "status", F.date_format("order_date", "yyyyMMdd").cast("int").alias("d"))
    return reshape.tagged_row_filter(o, "status", "F", "d").select("o_orderkey", "year", "month")


@query("extend_series", """
SELECT year, month, rnd(avg(price) FILTER (status = 'F'), 4) AS repo, rnd(avg(price) FILTER (status = 'O'), 4) AS fx_rate,
       count(*) FILTER (status = 'P') AS n_p
FROM monthly_orders GROUP BY ALL
""")
def extend_series(spark, sf):
    o = orders(spark, sf)
    part = lambda s, agg: o.where(F.col("status") == s).groupBy("year", "month").agg(agg)
    parts = [part("F", fx.rnd(F.avg("price"), 4).alias("repo")), part("O", fx.rnd(F.avg("price"), 4).alias("fx_rate")),
             part("P", F.count(F.lit(1)).alias("n_p"))]
    stored = reshape.outer_join_on_month(parts).where(F.col("year") < 1998)
    return reshape.extend_series(stored, parts).withColumn("n_p", F.coalesce("n_p", F.lit(0)))


CTES["segment_month"] = """
SELECT c_nationkey AS nationkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, c_mktsegment AS seg, avg(o_totalprice) AS p
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("mean_of_available", "SELECT nationkey, year, month, rnd(avg(p), 4) AS mean_price FROM segment_month GROUP BY ALL")
def mean_of_available(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    wide = (
        orders(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nationkey"), "year", "month")
        .agg(*[F.avg(F.when(F.col("c_mktsegment") == s, F.col("price"))).alias(s) for s in SEGMENTS]))
    return reshape.mean_of_available(wide, SEGMENTS, "mean_price").select("nationkey", "year", "month", fx.r("mean_price", 4))


@query("vintage_overlap_check", """
WITH m AS (SELECT year, month, avg(price) AS a, count(*) AS n FROM monthly_orders GROUP BY ALL),
     p AS (SELECT 'price' AS "column", a, CASE WHEN month = 3 THEN a * 1.03 WHEN month = 6 THEN a * 1.01 ELSE a END AS b FROM m WHERE year >= 1996
           UNION ALL SELECT 'n', n, n FROM m WHERE year >= 1996)
SELECT "column", count(*) AS n_overlap, count_if(abs(a - b) / abs(a) > 0.02) AS n_mismatch, rnd(max(abs(a - b)), 4) AS max_gap, FALSE AS blocking
FROM p GROUP BY "column"
""")
def vintage_overlap_check(spark, sf):
    m = orders(spark, sf).groupBy("year", "month").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("n"))
    factor = F.when(F.col("month") == 3, 1.03).when(F.col("month") == 6, 1.01).otherwise(1.0)
    newer = m.where(F.col("year") >= 1996).withColumn("price", F.col("price") * factor)
    return reshape.vintage_overlap_check(m, newer, ["year", "month"], ["price", "n"]).withColumn("max_gap", fx.rnd("max_gap", 4))
