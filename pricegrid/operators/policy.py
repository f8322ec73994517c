"""Policy events: from a log to state intervals, and from intervals to weekly features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import calendar as cal
from pricegrid.functions.sizes import size_checked_broadcast

BAN, FLOOR, DUTY = "export_banned", "mep_usd_per_tonne", "export_duty_pct"


def state_intervals(events: DataFrame, panel_end: str = values.POLICY_PANEL_END,
                    reduction_date: str = values.DUTY_REDUCTION_DATE,
                    retrospective: Column | None = None) -> DataFrame:
    """Ordered events to inclusive [start, end] intervals per crop and lever.

    ``events``: crop, effective_date, policy_type, price_usd_per_mt, description, one per crop and day.
    A ban closes a floor price, a ban's removal may start one and may restate a duty that is not in
    force, the duty steps down on ``reduction_date``, and an open tail runs to ``panel_end``.
    ``retrospective`` marks floor prices whose date is the end of the measure: they become that day only.
    """
    kind = F.col("policy_type")
    is_retro = F.lit(False) if retrospective is None else F.coalesce(retrospective, F.lit(False))
    dated = events.where(F.col("effective_date").isNotNull()).withColumn("__retro", is_retro)
    price = F.col("price_usd_per_mt")
    lifts = kind == "export_ban_removal"
    action = lambda lever, act, value=None: F.struct(
        F.lit(lever).alias("lever"), F.lit(act).alias("act"),
        (F.lit(None) if value is None else value).cast("double").alias("value"))
    effects = F.array_compact(F.array(
        F.when(kind == "export_ban", action(BAN, "set", F.lit(1.0))),
        F.when(lifts, action(BAN, "clear")),
        F.when(kind == "export_ban", action(FLOOR, "clear")),
        F.when(lifts & price.isNotNull(), action(FLOOR, "restart", price)),
        F.when(kind == "minimum_export_price", action(FLOOR, "set", price)),
        F.when(kind == "minimum_export_price_removal", action(FLOOR, "clear")),
        F.when(kind == "export_duty", action(DUTY, "set", F.lit(values.DUTY_INITIAL_PCT))),
        F.when(lifts & F.lower("description").contains("duty"), action(DUTY, "restate", F.lit(values.DUTY_INITIAL_PCT))),
        F.when(kind == "export_duty_removal", action(DUTY, "clear")),
    ))
    w = Window.partitionBy("crop", "lever").orderBy("effective_date")
    steps = (
        dated.where(~F.col("__retro"))
        .select("crop", "effective_date", F.inline(effects))
        .withColumn("__prev", F.lag("act").over(w))
        .where(~((F.col("act") == "restate") & F.coalesce(F.col("__prev").isin("set", "restate"), F.lit(False))))
        .withColumn("__next_act", F.lead("act").over(w))
        .withColumn("__next", F.lead("effective_date").over(w))
        .where(F.col("act") != "clear")
    )
    # a second ban or a restart replaces the running interval instead of closing it
    replaced = (F.col("lever") == BAN) & (F.col("__next_act") == "set") | (F.col("__next_act") == "restart")
    spans = steps.where(~F.coalesce(replaced, F.lit(False))).select(
        "crop", "lever", F.col("effective_date").alias("start"),
        F.coalesce(F.date_sub("__next", 1), F.lit(panel_end).cast("date")).alias("end"),
        "value",
        (F.col("__next_act").isNull() | (F.col("__next_act") == "clear")).alias("__closes"))
    cut = F.lit(reduction_date).cast("date")
    split = (
        (F.col("lever") == DUTY) & F.col("__closes") & (F.col("start") < cut) & (cut <= F.col("end")))
    part = lambda a, b, v: F.struct(a.alias("start"), b.alias("end"), v.alias("value"))
    whole = F.array(part(F.col("start"), F.col("end"), F.col("value")))
    halves = F.array(
        part(F.col("start"), F.date_sub(cut, 1), F.col("value")),
        part(cut, F.col("end"), F.lit(values.DUTY_REDUCED_PCT)))
    spans = spans.select("crop", "lever", F.inline(F.when(split, halves).otherwise(whole)))
    day_only = dated.where("__retro").select(
        "crop", F.lit(FLOOR).alias("lever"), F.col("effective_date").alias("start"),
        F.col("effective_date").alias("end"), price.alias("value"))
    return spans.unionByName(day_only)


def interval_weeks(intervals: DataFrame, keys: Sequence[str] = ("crop", "lever")) -> DataFrame:
    """Value per key and week that overlaps an interval; of several, the one that starts first.

    [w, w+6] overlaps [start, end] exactly when w lies between their Mondays, so each interval is
    expanded to its weeks and the range join becomes an equi join on the week.
    """
    valid = intervals.where(cal.week_start("end") >= cal.week_start("start"))
    return (
        valid.select(*keys, "start", "value",
                     F.explode(cal.week_sequence(cal.week_start("start"), cal.week_start("end"))).alias("week_start"))
        .groupBy(*keys, "week_start").agg(F.min_by("value", "start").alias("value"))
    )


def interval_overlap_join(weeks: DataFrame, intervals: DataFrame, group: str = "crop",
                          levers: Sequence[str] = (BAN, FLOOR, DUTY)) -> DataFrame:
    """Weekly lever columns for every (group, week) row; 0 when no interval overlaps."""
    mine = lambda lever, value: F.max(F.when(F.col("lever") == lever, value))
    wide = interval_weeks(intervals, [group, "lever"]).groupBy(group, "week_start").agg(
        *[mine(lever, F.col("value")).alias(lever) for lever in levers],
        *[mine(lever, F.lit(True)).alias(f"__in_{lever}") for lever in levers])
    joined = weeks.join(wide, [group, "week_start"], "left")
    # an interval whose value is unknown stays null; no interval at all is 0
    return joined.withColumns({
        lever: F.when(F.col(f"__in_{lever}").isNull(), 0.0).otherwise(F.col(lever)) for lever in levers
    }).drop(*[f"__in_{lever}" for lever in levers])


def policy_weekly_features(weeks: DataFrame, intervals: DataFrame, interventions: DataFrame,
                           scheme_start: str = values.OPERATION_GREENS_START) -> DataFrame:
    """All five weekly policy columns. ``interventions``: crop, event_date."""
    hit = interventions.select("crop", cal.week_start("event_date").alias("week_start")).distinct().withColumn(
        "market_intervention_flag", F.lit(1))
    out = interval_overlap_join(weeks, intervals).join(hit, ["crop", "week_start"], "left")
    return out.withColumns({
        BAN: F.col(BAN).cast("int"),
        "market_intervention_flag": F.coalesce("market_intervention_flag", F.lit(0)),
        "operation_greens_active": (F.col("week_start") >= cal.week_start(F.lit(scheme_start).cast("date"))).cast("int"),
    })


def event_window_join(rows: DataFrame, windows: DataFrame, date: str, group: str = "crop",
                      start: str = "start", end: str = "end") -> DataFrame:
    """Rows that fall inside their group's windows, one per (row, window).

    Windows are cut into weeks and joined on (group, week); the day test follows, so no row meets a
    window it is more than a week away from.
    """
    cells = size_checked_broadcast(windows.withColumn(
        "__week", F.explode(cal.week_sequence(cal.week_start(start), cal.week_start(end)))))
    keyed = rows.withColumn("__week", cal.week_start(date))
    return keyed.join(cells, [group, "__week"]).where(F.col(date).between(F.col(start), F.col(end))).drop("__week")
