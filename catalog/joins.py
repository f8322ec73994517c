"""Join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import CTES, query
from catalog.reshape import orders
from catalog.windows import EPISODES, KEYS, layer
from pricegrid import values
from pricegrid.operators import aggregates as A
from pricegrid.operators import evaluation as E
from pricegrid.operators import joins as J
from pricegrid.operators import panel as P
from pricegrid.operators import policy
from pricegrid.plans import master_join
from pricegrid.sources import reshape

CTES["macro"] = """
SELECT year, month, avg(price) FILTER (status = 'F') AS repo, count(*) AS n_orders, avg(price) FILTER (status = 'O') AS usdinr, avg(price) FILTER (status = 'P') AS diesel
FROM monthly_orders GROUP BY ALL"""


def macro_parts(spark, sf):
    o = orders(spark, sf)
    total = o.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_orders"))
    part = lambda s, name: o.where(F.col("status") == s).groupBy("year", "month").agg(F.avg("price").alias(name))
    # the second table repeats a column of the first; the third misses some months
    return [total.join(part("F", "repo"), ["year", "month"], "left"),
            part("O", "usdinr").withColumn("n_orders", F.lit(-1).cast("long")),
            part("P", "diesel")]


def state_month(spark, sf):
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders(spark, sf).join(c.select("c_custkey", F.col("n_name").alias("state")), F.col("o_custkey") == F.col("c_custkey"))


CTES["state_month"] = """
SELECT n_name AS state, m.year, m.month, m.price FROM (SELECT *, o_custkey FROM monthly_orders JOIN (SELECT o_orderkey, o_custkey FROM orders) USING (o_orderkey)) m
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
CTES["wages"] = "SELECT state, year, month, avg(price) AS wage FROM state_month GROUP BY ALL"
CTES["storage"] = "SELECT n_name AS state, sum(c_acctbal) AS capacity, count(*) AS n_facilities FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"
CTES["roads"] = "SELECT state, year, count(*) AS density FROM state_month GROUP BY ALL"


def storage(spark, sf):
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("state")).agg(F.sum("c_acctbal").alias("capacity"), F.count(F.lit(1)).alias("n_facilities"))


@query("checked_left_join", """
SELECT o_orderkey, state, rnd(capacity, 2) AS capacity, n_facilities FROM (SELECT o_orderkey, n_name AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
LEFT JOIN storage USING (state)
""")
def checked_left_join(spark, sf):
    left = state_month(spark, sf).select("o_orderkey", "state")
    return J.checked_left_join(left, storage(spark, sf), ["state"]).withColumn("capacity", fx.rnd("capacity", 2))


@query("outer_macro_join", "SELECT year, month, n_orders, rnd(repo, 4) AS repo, rnd(usdinr, 4) AS usdinr, rnd(diesel, 4) AS diesel FROM macro")
def outer_macro_join(spark, sf):
    out = reshape.outer_join_on_month(macro_parts(spark, sf))
    return out.select("year", "month", "n_orders", fx.r("repo"), fx.r("usdinr"), fx.r("diesel"))


@query("layer_joins", """
SELECT p.crop, p.market_id, p.week_start, n_orders, rnd(repo, 4) AS repo, rnd(heat, 6) AS heat, rnd(wage, 4) AS wage, n_facilities, density,
       CAST(coalesce(banned, 0) AS INTEGER) AS export_banned
FROM panel p JOIN markets USING (market_id)
LEFT JOIN macro m ON m.year = year(p.week_start) AND m.month = month(p.week_start)
LEFT JOIN layer l ON l.crop = p.crop AND l.week_start = p.week_start
LEFT JOIN wages w ON w.state = markets.state AND w.year = year(p.week_start) AND w.month = month(p.week_start)
LEFT JOIN storage s ON s.state = markets.state
LEFT JOIN roads r ON r.state = markets.state AND r.year = year(p.week_start)
LEFT JOIN (SELECT l.crop, l.week_start, 1 AS banned FROM layer l WHERE heat > 0.05) b ON b.crop = p.crop AND b.week_start = p.week_start
""")
def layer_joins(spark, sf):
    out = master_panel(spark, sf)
    return out.select(*KEYS, "n_orders", fx.r("repo"), fx.r("heat", 6), fx.r("wage"), "n_facilities", "density", "export_banned")


def master_panel(spark, sf):
    """The panel with every layer's columns."""
    panel = fx.panel(spark, sf).join(fx.states(spark, sf), "market_id")
    sm = state_month(spark, sf)
    crop_layer = layer(spark, sf)
    out = master_join.layer_joins(
        panel, reshape.outer_join_on_month(macro_parts(spark, sf)), crop_layer,
        sm.groupBy("state", "year", "month").agg(F.avg("price").alias("wage")), storage(spark, sf),
        sm.groupBy("state", "year").agg(F.count(F.lit(1)).alias("density")),
        crop_layer.select("crop", "week_start", (F.col("heat") > 0.05).cast("int").alias("export_banned")))
    return out.withColumn("export_banned", F.coalesce("export_banned", F.lit(0)))


@query("price_arrival_inner", """
WITH p AS (SELECT crop, market_id, arrival_date, avg(modal_price_rs_per_quintal) AS price FROM clean WHERE variety = 'F' GROUP BY ALL),
a AS (SELECT crop, market_id, arrival_date, sum(total_arrivals_tonnes) AS q FROM clean WHERE variety = 'O' GROUP BY ALL)
SELECT crop, market_id, arrival_date, rnd(price, 4) AS price, q AS arrivals FROM p JOIN a USING (crop, market_id, arrival_date)
""")
def price_arrival_inner(spark, sf):
    c = fx.clean(spark, sf).withColumnsRenamed({"modal_price_rs_per_quintal": "price", "total_arrivals_tonnes": "arrivals"})
    out = J.price_arrival_inner(c.where(F.col("variety") == "F"), c.where(F.col("variety") == "O"),
                                ["crop", "market_id", "arrival_date"], ["price"], "arrivals")
    return out.withColumn("price", fx.rnd("price"))


CTES["entities"] = """
SELECT c_custkey, n_name AS state, ' ' || upper(c_mktsegment) || '--' || right(c_name, 2) || ' ' AS market, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def entities(spark, sf):
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.col("n_name").alias("state"),
                    F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("--"), F.right("c_name", F.lit(2)), F.lit(" ")).alias("market"), "c_acctbal")


@query("resolve_or_assign_id", """
WITH e AS (SELECT *, trim(regexp_replace(lower(trim(state)), '[^a-z0-9]+', ' ', 'g')) AS ns, trim(regexp_replace(lower(trim(market)), '[^a-z0-9]+', ' ', 'g')) AS nm FROM entities),
k AS (SELECT ns, nm, min(c_custkey) AS id FROM e WHERE c_acctbal > 3000 GROUP BY ALL),
u AS (SELECT ns, nm, (SELECT max(c_custkey) FROM e WHERE c_acctbal > 3000) + row_number() OVER (ORDER BY ns, nm) AS id FROM (SELECT DISTINCT ns, nm FROM e ANTI JOIN k USING (ns, nm)))
SELECT c_custkey, coalesce(k.id, u.id) AS market_id, k.id IS NULL AS is_new_id FROM e LEFT JOIN k USING (ns, nm) LEFT JOIN u USING (ns, nm)
""")
def resolve_or_assign_id(spark, sf):
    e = entities(spark, sf)
    known = e.where(F.col("c_acctbal") > 3000).select("state", F.lower("market").alias("market"), F.col("c_custkey").alias("market_id"))
    return J.resolve_or_assign_id(e, known).select("c_custkey", "market_id", "is_new_id")


PROXIES = [("NATION_3", "NATION_1", "parent-state proxy"), ("NATION_7", "NATION_0", "neighbour"), ("NATION_9", "India", "no regional proxy")]


@query("fallback_join", """
WITH s AS (SELECT CASE WHEN state IN ('NATION_3', 'NATION_7', 'NATION_9', 'NATION_11') THEN 'India' ELSE state END AS state, year, month, price FROM state_month),
m AS (SELECT state, year, month, avg(price) AS wage FROM s GROUP BY ALL),
c AS (SELECT n_name AS state, CASE n_name WHEN 'NATION_3' THEN 'NATION_1' WHEN 'NATION_7' THEN 'NATION_0' WHEN 'NATION_9' THEN 'India' WHEN 'NATION_11' THEN 'India' ELSE n_name END AS src,
  CASE n_name WHEN 'NATION_3' THEN 'NATION_1 (parent-state proxy)' WHEN 'NATION_7' THEN 'NATION_0 (neighbour)' WHEN 'NATION_9' THEN 'India (no regional proxy)' WHEN 'NATION_11' THEN 'India (unmapped)' ELSE 'direct' END AS source FROM nation)
SELECT c.state, source, year, month, rnd(wage, 4) AS wage FROM c JOIN m ON m.state = c.src
""")
def fallback_join(spark, sf):
    missing = ["NATION_3", "NATION_7", "NATION_9", "NATION_11"]
    s = state_month(spark, sf).withColumn("state", F.when(F.col("state").isin(missing), "India").otherwise(F.col("state")))
    series = s.groupBy("state", "year", "month").agg(F.avg("price").alias("wage"))
    states = fx.table(spark, sf, "nation").select(F.col("n_name").alias("state"))
    proxies = spark.createDataFrame(PROXIES, "entity string, proxy string, reason string")
    out = J.fallback_join(states, series, proxies, "state", "India", unmapped="unmapped")
    return out.select("state", "source", "year", "month", fx.r("wage"))


@query("grid_cross_join", "SELECT crop, market_id, week_start, CAST(modal_price_weighted IS NULL AS INTEGER) AS imputed, arrivals_tonnes_week FROM gaps")
def complete_grid(spark, sf):
    return fx.grid(spark, sf).select(*KEYS, "imputed", P.ARRIVALS)


@query("semi_join_keep", """
SELECT crop, market_id, week_start, arrivals_tonnes_week FROM weekly WHERE (crop, market_id) IN (SELECT (crop, market_id) FROM weekly GROUP BY crop, market_id HAVING count(*) >= 140)
""")
def semi_join_keep(spark, sf):
    w = fx.weekly(spark, sf)
    chosen = w.groupBy("crop", "market_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 140)
    return J.semi_join_keep(w, chosen, ["crop", "market_id"]).select(*KEYS, P.ARRIVALS)


@query("anti_join_unmatched", """
SELECT crop, market_id, week_start FROM grid g WHERE NOT EXISTS (SELECT 1 FROM weekly w WHERE w.crop = g.crop AND w.market_id = g.market_id AND w.week_start = g.week_start)
""")
def anti_join_unmatched(spark, sf):
    return J.anti_join_unmatched(fx.grid(spark, sf).select(*KEYS), fx.weekly(spark, sf), KEYS)


@query("event_window_join", """
SELECT name, d.crop, market_id, arrival_date, count(*) AS n_rows FROM clean d JOIN episodes e ON e.crop = d.crop AND arrival_date BETWEEN first_action - 45 AND first_action + 30 GROUP BY ALL
""")
def event_window_join(spark, sf):
    windows = spark.createDataFrame(EPISODES, "name string, crop string, day string").select(
        "name", "crop", F.date_sub(F.col("day").cast("date"), 45).alias("start"), F.date_add(F.col("day").cast("date"), 30).alias("end"))
    hits = policy.event_window_join(fx.clean(spark, sf), windows, "arrival_date")
    return hits.groupBy("name", "crop", "market_id", "arrival_date").agg(F.count(F.lit(1)).alias("n_rows"))


CTES["leaders"] = """
SELECT crop, market_id FROM (SELECT crop, market_id, avg(arrivals_tonnes_week) AS v, 1 - avg(imputed) AS cov FROM panel GROUP BY ALL) WHERE cov >= 0.36
QUALIFY row_number() OVER (PARTITION BY crop ORDER BY v DESC, market_id) <= 5"""


def leaders(spark, sf, k=5):
    return A.top_k_by_mean(fx.panel(spark, sf), P.ARRIVALS, k, min_coverage=0.36)


@query("ordered_pairs_self_join", """
WITH s AS (SELECT crop, market_id, week_start, modal_price_weighted AS x FROM panel JOIN leaders USING (crop, market_id) WHERE imputed = 0)
SELECT a.crop, a.week_start, a.market_id AS from_id, b.market_id AS to_id, rnd(a.x, 4) AS x_from, rnd(b.x, 4) AS x_to FROM s a JOIN s b ON a.crop = b.crop AND a.week_start = b.week_start AND a.market_id <> b.market_id
""")
def ordered_pairs_self_join(spark, sf):
    panel = fx.panel(spark, sf).where(F.col("imputed") == 0)
    chosen = panel.join(leaders(spark, sf).select("crop", "market_id"), ["crop", "market_id"])
    out = J.ordered_pairs_self_join(chosen, P.PRICE)
    return out.select("crop", "week_start", "from_id", "to_id", fx.r("x_from"), fx.r("x_to"))


ZONE_VALUES = ", ".join(f"('{c}', {i}, '{z}', {la}, {lo})" for i, (c, z, la, lo, _, _) in enumerate(values.ZONES))
CTES["zones"] = f"SELECT * FROM (VALUES {ZONE_VALUES}) t(crop, ord, zone_id, zlat, zlon)"
CTES["located"] = """
SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'tomato' WHEN s_suppkey % 3 = 1 THEN 'onion' ELSE 'potato' END AS crop, s_suppkey AS market_id,
  8.0 + s_nationkey + (s_acctbal / 10000.0) AS lat, 68.0 + s_nationkey * 0.8 + (s_acctbal / 8000.0) AS lon FROM supplier"""


def located(spark, sf):
    crop = F.when(F.col("s_suppkey") % 3 == 0, "tomato").when(F.col("s_suppkey") % 3 == 1, "onion").otherwise("potato")
    return fx.table(spark, sf, "supplier").select(
        crop.alias("crop"), F.col("s_suppkey").alias("market_id"),
        (8.0 + F.col("s_nationkey") + F.col("s_acctbal") / 10000.0).alias("lat"),
        (68.0 + F.col("s_nationkey") * 0.8 + F.col("s_acctbal") / 8000.0).alias("lon"))


CTES["assigned"] = """
SELECT crop, market_id, zone_id, round(dist, 1) AS dist_km FROM (SELECT l.crop, market_id, zone_id, ord,
  2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS dist FROM (SELECT l.*, z.zone_id, z.ord, pow(sin(radians(zlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(zlat)) * pow(sin(radians(zlon - lon) / 2), 2) AS a
  FROM located l JOIN zones z USING (crop)) l) QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY dist, ord) = 1"""


@query("nearest_entity_join", "SELECT crop, market_id, zone_id, dist_km FROM assigned")
def nearest_entity_join(spark, sf):
    return J.nearest_entity_join(located(spark, sf), values.ZONES).select("crop", "market_id", "zone_id", "dist_km")


@query("expand_dim_to_members", """
WITH z AS (SELECT zone_id, week_start, avg(arrivals_tonnes_week) AS f FROM weekly w JOIN assigned a ON a.market_id = w.market_id GROUP BY ALL)
SELECT a.market_id, zone_id, week_start, rnd(f, 4) AS feature FROM assigned a JOIN z USING (zone_id)
""")
def expand_dim_to_members(spark, sf):
    zones = J.nearest_entity_join(located(spark, sf), values.ZONES).select("market_id", "zone_id")
    f = fx.weekly(spark, sf).join(zones, "market_id").groupBy("zone_id", "week_start").agg(F.avg(P.ARRIVALS).alias("feature"))
    return J.expand_dim_to_members(f, zones).select("market_id", "zone_id", "week_start", fx.r("feature"))


@query("forecast_actual_join", """
WITH f AS (SELECT crop, market_id, week_start, log_price, imputed, lag(log_price) OVER (PARTITION BY crop, market_id ORDER BY week_start) IS NOT NULL AS ok,
  max(CASE WHEN imputed = 0 THEN week_start END) OVER (PARTITION BY crop, market_id ORDER BY week_start) AS seen FROM logs),
o AS (SELECT *, unnest([1, 4, 13, 26]) AS h FROM f WHERE ok AND week_start - seen < 21)
SELECT o.crop, o.market_id, o.week_start, CAST(h AS INTEGER) AS horizon_weeks, CAST(o.week_start + 7 * h AS DATE) AS target_week, rnd(exp(log_price) - 1, 4) AS forecast, rnd(a.observed_price, 4) AS actual_price
FROM o JOIN gapfill a ON a.crop = o.crop AND a.market_id = o.market_id AND a.week_start = o.week_start + 7 * h AND a.imputed = 0
""")
def forecast_actual_join(spark, sf):
    return live_forecasts(spark, sf).select(*KEYS, "horizon_weeks", "target_week", fx.r("forecast"), fx.r("actual_price"))


def live_forecasts(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("crop", "market_id").orderBy("week_start")
    logs = fx.logs(spark, sf)
    seen = F.max(F.when(F.col("imputed") == 0, F.col("week_start"))).over(w)
    origins = logs.select(
        *KEYS, F.expm1("log_price").alias("forecast"), F.lag("log_price").over(w).isNotNull().alias("sufficient_history"),
        (F.datediff("week_start", seen) >= 21).alias("stale_reference"))
    forecasts = origins.withColumn("horizon_weeks", F.explode(F.array(*map(F.lit, values.HORIZONS))))
    return J.forecast_actual_join(forecasts, fx.panel(spark, sf))


@query("variant_align", """
SELECT crop, horizon_weeks, market_id, week_start, rnd(arg_min(y_true, fold), 4) AS y_true, rnd(arg_min(y_pred, fold) FILTER (variant = 'B1'), 4) AS pred_baseline,
  rnd(arg_min(y_pred, fold) FILTER (variant = 'B3'), 4) AS pred_richer FROM preds GROUP BY ALL HAVING count(y_pred) FILTER (variant = 'B1') > 0 AND count(y_pred) FILTER (variant = 'B3') > 0
""")
def variant_align(spark, sf):
    out = J.variant_align(predictions(spark, sf), "B1", "B3", ["crop", "horizon_weeks", "market_id"])
    return out.select("crop", "horizon_weeks", "market_id", "week_start", fx.r("y_true"), fx.r("pred_baseline"), fx.r("pred_richer"))


FOLDS = [(1, "1997-06-30", "1997-07-01", "1997-12-31", "1998-01-01", "1998-12-31"),
         (2, "1998-06-30", "1998-07-01", "1998-12-31", "1999-01-01", "1999-12-31"),
         (3, "1999-06-30", "1999-07-01", "1999-12-31", "2000-01-01", "2000-12-31")]
CTES["folds"] = ("SELECT CAST(fold AS INTEGER) AS fold, CAST(a AS DATE) AS train_end, CAST(b AS DATE) AS val_start, CAST(c AS DATE) AS val_end, CAST(d AS DATE) AS test_start, CAST(e AS DATE) AS test_end FROM (VALUES "
                 + ", ".join(map(str, FOLDS)) + ") t(fold, a, b, c, d, e)")
CTES["bench"] = """
SELECT *, lag(log_price) OVER w AS lag1, lag(log_price, 52) OVER w AS lag52, CASE WHEN count(log_price) OVER r4 >= 2 THEN avg(log_price) OVER r4 END AS ma4,
  lead(log_price, 1) OVER w AS t1, lead(log_price, 4) OVER w AS t4, lead(log_price, 13) OVER w AS t13, lead(log_price, 26) OVER w AS t26
FROM logs WINDOW w AS (PARTITION BY crop, market_id ORDER BY week_start), r4 AS (PARTITION BY crop, market_id ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""
CTES["origins"] = """
SELECT crop, market_id, week_start, 1 AS horizon_weeks, log_price, lag1, lag52, ma4, t1 AS target FROM bench UNION ALL SELECT crop, market_id, week_start, 4, log_price, lag1, lag52, ma4, t4 FROM bench
UNION ALL SELECT crop, market_id, week_start, 13, log_price, lag1, lag52, ma4, t13 FROM bench UNION ALL SELECT crop, market_id, week_start, 26, log_price, lag1, lag52, ma4, t26 FROM bench"""
CTES["preds"] = """
SELECT variant, crop, fold, horizon_weeks, market_id, week_start, exp(target) - 1 AS y_true, exp(p) - 1 AS y_pred
FROM (SELECT 'B1' AS variant, log_price AS p, * FROM origins UNION ALL SELECT 'B2', lag52, * FROM origins UNION ALL SELECT 'B3', ma4, * FROM origins)
JOIN folds ON week_start BETWEEN test_start AND test_end WHERE target IS NOT NULL AND lag1 IS NOT NULL AND p IS NOT NULL"""


def predictions(spark, sf):
    """Test-window predictions of three closed-form models: current value, last year's value, 4-week mean."""
    return E.benchmark_predictions(fx.logs(spark, sf), FOLDS)


@query("as_of_last_observed", """
SELECT crop, market_id, rnd(arg_max(modal_price_weighted, week_start), 4) AS last_observed_price, max(week_start) AS last_observed_date FROM panel WHERE imputed = 0 GROUP BY ALL
""")
def as_of_last_observed(spark, sf):
    return J.as_of_last_observed(fx.panel(spark, sf)).withColumn("last_observed_price", fx.rnd("last_observed_price"))


@query("carry_last_year_forward", """
WITH m AS (SELECT state, year, count(*) AS density FROM state_month WHERE year <= 1999 GROUP BY ALL HAVING count(*) >= 80),
l AS (SELECT state, arg_max(density, year) AS last FROM m GROUP BY state)
SELECT l.state, CAST(y AS INTEGER) AS year, coalesce(density, last) AS density, density IS NULL AS is_forward_filled FROM l, unnest(range(1995, 2003)) g(y) LEFT JOIN m ON m.state = l.state AND m.year = y
""")
def carry_last_year_forward(spark, sf):
    m = state_month(spark, sf).where(F.col("year") <= 1999).groupBy("state", "year").agg(F.count(F.lit(1)).alias("density")).where(F.col("density") >= 80)
    return J.carry_last_year_forward(m, "state", "density", 1995, 2002)


@query("oof_residual_join", """
WITH a AS MATERIALIZED (SELECT *, unnest([1, 4, 13, 26]) AS horizon_weeks, unnest([t1, t4, t13, t26]) AS target FROM bench)
SELECT crop, market_id, week_start, horizon_weeks, rnd(target - ma4, 6) AS residual FROM a JOIN folds ON week_start BETWEEN test_start AND test_end WHERE ma4 IS NOT NULL AND target IS NOT NULL AND lag1 IS NOT NULL
""")
def oof_residual_join(spark, sf):
    rows = E.with_targets(E.W.benchmark_predictors(fx.logs(spark, sf)))
    tested = E.rolling_origin_splits(rows, FOLDS).where(F.col("split") == "test")
    oof = tested.where(F.col("moving_average_4").isNotNull()).select(*KEYS, "horizon_weeks", F.col("moving_average_4").alias("oof_pred"))
    keys = [*KEYS, "horizon_weeks"]
    return J.oof_residual_join(rows.select(*keys, "target"), oof, keys).select(*keys, fx.r("residual", 6))
