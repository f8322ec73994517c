"""Joins. A side is broadcast only after its size was measured: by adaptive execution, or by
``size_checked_broadcast`` where the large side should not even be shuffled. Beyond the bound both fall
back to a sort-merge join with skew splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import scalars
from pricegrid.functions.sizes import size_checked_broadcast
from pricegrid.operators.sets import leading_entities


def unique_on(right: DataFrame, on: Sequence[str], name: str = "right side") -> DataFrame:
    """The same rows, but the job fails when a key occurs twice. Lazy: no extra pass over the data."""
    rest = [c for c in right.columns if c not in on]
    message = F.concat(F.lit(f"{name}: duplicate key "), F.concat_ws("/", *[F.col(k).cast("string") for k in on]))
    one = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__x"), *rest)).alias("__row"))
    # the error sits inside the row itself, so no later projection can prune it away
    safe = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
        F.raise_error(message).cast(one.schema["__row"].dataType))
    kept = one.select(*on, safe.alias("__row")).where(F.col("__row").isNotNull())
    return kept.select(*on, *[F.col("__row")[c].alias(c) for c in rest])


def checked_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "right side",
                      broadcast_rows: int = 0) -> DataFrame:
    """Left join whose right key must be unique, so the row count cannot grow.

    ``broadcast_rows`` > 0 measures the right side and broadcasts it up to that many rows.
    """
    unique = unique_on(right, on, name)
    if broadcast_rows:
        unique = size_checked_broadcast(unique, broadcast_rows)
    return left.join(unique, list(on), "left")


def price_arrival_inner(prices: DataFrame, arrivals: DataFrame, keys: Sequence[str],
                        price_cols: Sequence[str], quantity: str) -> DataFrame:
    """Daily price report (varieties averaged) with the daily arrival report (varieties added)."""
    p = prices.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in price_cols])
    a = arrivals.groupBy(*keys).agg(F.sum(quantity).alias(quantity))
    return p.join(a, list(keys), "inner")


def resolve_or_assign_id(rows: DataFrame, known: DataFrame, state: str = "state", market: str = "market",
                         ident: str = "market_id") -> DataFrame:
    """Match on normalised (state, market); unmatched keys get max_id + 1, + 2, ... in sorted order.

    New ids are numbered inside each state on top of the counts of the states before it, so the whole
    list is never sorted in one task.
    """
    s, m = scalars.normalise_name(state), scalars.normalise_name(market)
    lookup = known.groupBy(s.alias("__s"), m.alias("__m")).agg(F.min(ident).alias("__known"))
    keyed = rows.withColumns({"__s": s, "__m": m})
    matched = keyed.join(lookup, ["__s", "__m"], "left")
    unmatched = matched.where(F.col("__known").isNull()).select("__s", "__m").distinct()
    by_state = unmatched.groupBy("__s").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_state.select("__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    top = known.agg(F.coalesce(F.max(ident), F.lit(0))).scalar()
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__m"))
    fresh = unmatched.join(offsets, "__s").select(
        "__s", "__m", (top + F.col("__off") + place).cast("long").alias("__new"))
    return (
        matched.join(fresh, ["__s", "__m"], "left")
        .withColumn(ident, F.coalesce("__known", "__new"))
        .withColumn("is_new_id", F.col("__known").isNull())
        .drop("__s", "__m", "__known", "__new")
    )


def fallback_join(entities: DataFrame, series: DataFrame, proxies: DataFrame, entity: str, national: str,
                  provenance: str = "source", unmapped: str = values.UNMAPPED_WAGE_NOTE) -> DataFrame:
    """Own series, else the named proxy's, else the national one, with where it came from.

    ``proxies``: (entity, proxy, reason). The source entity is settled first, then one join follows.
    """
    own = series.select(entity).distinct().withColumn("__own", F.lit(True))
    named = proxies.select(F.col("entity").alias(entity), "proxy", "reason")
    chosen = (
        entities.select(entity).distinct().join(own, entity, "left").join(named, entity, "left")
        .select(
            F.col(entity),
            F.when(F.col("__own"), F.col(entity)).otherwise(F.coalesce("proxy", F.lit(national))).alias("__from"),
            F.when(F.col("__own"), "direct").otherwise(F.concat(
                F.coalesce("proxy", F.lit(national)), F.lit(" ("), F.coalesce("reason", F.lit(unmapped)), F.lit(")"))).alias(provenance))
    )
    return chosen.join(series.withColumnRenamed(entity, "__from"), "__from").drop("__from")


def semi_join_keep(df: DataFrame, selected: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(selected, list(on), "left_semi")


def anti_join_unmatched(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(known, list(on), "left_anti")


def ordered_pairs_self_join(series: DataFrame, value: str, group: str = "crop", ident: str = "market_id",
                            time: str = "week_start", k: int = 20) -> DataFrame:
    """All ordered pairs of a group's ``k`` entities with most rows, aligned on time: k (k - 1) pairs at most."""
    chosen = leading_entities(series, group, ident, k)
    left = chosen.select(group, time, F.col(ident).alias("from_id"), F.col(value).alias("x_from"))
    right = chosen.select(group, time, F.col(ident).alias("to_id"), F.col(value).alias("x_to"))
    return left.join(right, [group, time]).where(F.col("from_id") != F.col("to_id"))


def nearest_entity_join(points: DataFrame, zones: Sequence[tuple], group: str = "crop", lat: str = "lat",
                        lon: str = "lon") -> DataFrame:
    """Nearest same-group zone by great-circle distance; the first listed zone wins ties.

    The zone list is a fixed dimension, so it travels as a literal array and no row is multiplied.
    ``zones``: (group, zone_id, lat, lon, ...).
    """
    listed = F.array(*[
        F.struct(F.lit(z[0]).alias("g"), F.lit(i).alias("order"), F.lit(z[1]).alias("zone_id"),
                 F.lit(float(z[2])).alias("lat"), F.lit(float(z[3])).alias("lon"))
        for i, z in enumerate(zones)])
    candidates = F.transform(
        F.filter(listed, lambda z: z["g"] == F.col(group)),
        lambda z: F.struct(
            scalars.haversine_km(F.col(lat), F.col(lon), z["lat"], z["lon"]).alias("dist"), z["order"].alias("order"),
            z["zone_id"].alias("zone_id")))
    return points.withColumn("__best", F.array_min(candidates)).withColumns({
        "zone_id": F.col("__best.zone_id"), "dist_km": F.round("__best.dist", 1)}).drop("__best")


def expand_dim_to_members(features: DataFrame, assignment: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Zone features copied to each assigned market."""
    return assignment.join(features, zone, "inner")


def forecast_actual_join(forecasts: DataFrame, actuals: DataFrame, horizon: str = "horizon_weeks",
                         ident: Sequence[str] = ("crop", "market_id"), price: str = "modal_price_weighted") -> DataFrame:
    """Forecast rows with the realised week; insufficient or stale origins and imputed weeks stay out.

    Forecasts and actuals meet in a window over identity and week, not in a join: rows that are already together by identity,
    as those of one panel are, stay in their partitions, whatever the number of horizons.
    """
    keys = [*ident, "target_week"]
    usable = forecasts.where(F.col("sufficient_history") & ~F.col("stale_reference")).withColumn(
        "target_week", F.expr(f"date_add(week_start, 7 * {horizon})"))
    realised = actuals.where((F.col("imputed") == 0) & F.col(price).isNotNull()).select(
        *ident, F.col("week_start").alias("target_week"), F.col(price).alias("__actual"))
    rest = [c for c in usable.columns if c not in keys]
    both = usable.withColumn("__forecast", F.lit(True)).unionByName(realised, allowMissingColumns=True).dropna(subset=keys)
    met = both.withColumn("__actuals", F.collect_list("__actual").over(Window.partitionBy(*keys)))
    return met.where("__forecast").select(*keys, *rest, F.explode("__actuals").alias("actual_price"))


def variant_align(preds: DataFrame, baseline: str, richer: str, keys: Sequence[str], week: str = "week_start") -> DataFrame:
    """Baseline and richer predictions side by side. Of several folds for a week the first is used; one
    aggregate replaces the self join."""
    def pick(variant: str, column: str) -> Column:
        mine = F.col("variant") == variant
        return F.min_by(F.when(mine, F.col(column)), F.when(mine, F.col("fold")))

    wide = preds.where(F.col("variant").isin(baseline, richer)).groupBy(*keys, week).agg(
        pick(baseline, "y_true").alias("y_true"), pick(baseline, "y_pred").alias("pred_baseline"),
        pick(richer, "y_pred").alias("pred_richer"))
    return wide.where(F.col("pred_baseline").isNotNull() & F.col("pred_richer").isNotNull())


def as_of_last_observed(panel: DataFrame, price: str = "modal_price_weighted",
                        keys: Sequence[str] = ("crop", "market_id")) -> DataFrame:
    return panel.where(F.col("imputed") == 0).groupBy(*keys).agg(
        F.max_by(price, "week_start").alias("last_observed_price"), F.max("week_start").alias("last_observed_date"))


def carry_last_year_forward(measured: DataFrame, entity: str, value: str, first_year: int, last_year: int,
                            flag: str = "is_forward_filled") -> DataFrame:
    """Exact year where measured, else the latest measured year's value with a flag."""
    known = measured.where(F.col(value).isNotNull())
    latest = known.groupBy(entity).agg(F.max_by(value, "year").alias("__latest"))
    grid = latest.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    joined = grid.join(known.select(entity, "year", F.col(value).alias("__exact")), [entity, "year"], "left")
    return joined.select(
        entity, "year", F.coalesce("__exact", "__latest").alias(value), F.col("__exact").isNull().alias(flag))


def oof_residual_join(features: DataFrame, oof: DataFrame, keys: Sequence[str], target: str = "target",
                      prediction: str = "oof_pred", out: str = "residual") -> DataFrame:
    """Out-of-fold predictions joined to the features; the residual becomes the next target."""
    return features.join(oof, list(keys), "inner").withColumn(out, F.col(target) - F.col(prediction))

