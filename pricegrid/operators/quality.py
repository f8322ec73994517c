"""Data-quality checks. Each returns (check, subject, status, measured) rows, so a report is their union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values


def _row(check: str, subject: Column, status: Column, measured: Column) -> list[Column]:
    return [F.lit(check).alias("check"), subject.cast("string").alias("subject"), status.alias("status"),
            measured.cast("double").alias("measured")]


def _band(value: Column, fail: Column | None = None, warn: Column | None = None) -> Column:
    expr = F.lit("PASS")
    if warn is not None:
        expr = F.when(warn, "WARN").otherwise(expr)
    if fail is not None:
        expr = F.when(fail, "FAIL").otherwise(expr)
    return expr


def tail_week_imputed(panel: DataFrame, group: str = "crop") -> DataFrame:
    """Share of imputed rows in each group's latest week, from one aggregate over the weeks."""
    per_week = panel.groupBy(group, "week_start").agg(F.avg((F.col("imputed") != 0).cast("int")).alias("__share"))
    latest = per_week.groupBy(group).agg((F.max_by("__share", "week_start") * 100).alias("pct"))
    pct = F.col("pct")
    return latest.select(*_row("tail_week_imputed", F.col(group), _band(
        pct, pct >= values.TAIL_IMPUTED_FAIL_PCT, pct >= values.TAIL_IMPUTED_WARN_PCT), pct))


def freshness_days(panel: DataFrame, today: str, group: str = "crop", limit: int = values.FRESHNESS_WARN_DAYS) -> DataFrame:
    days = F.datediff(F.lit(today).cast("date"), F.col("__last"))
    return panel.groupBy(group).agg(F.max("week_start").alias("__last")).select(
        *_row("freshness_days", F.col(group), _band(days, warn=days > limit), days))


def reference_vs_panel_week_gap(panel: DataFrame, reference: DataFrame, group: str = "crop",
                                limit: int = values.REFERENCE_GAP_FAIL_DAYS) -> DataFrame:
    p = panel.groupBy(group).agg(F.max("week_start").alias("__p"))
    r = reference.groupBy(group).agg(F.max("week_start").alias("__r"))
    gap = F.datediff("__p", "__r")
    return p.join(r, group).select(*_row("reference_vs_panel_week_gap", F.col(group), _band(gap, gap > limit), gap))


def id_count_match(panel: DataFrame, derived: DataFrame, group: str = "crop", ident: str = "market_id") -> DataFrame:
    """Distinct ids on both sides; measured is the difference."""
    count = lambda df, name: df.select(group, ident).distinct().groupBy(group).agg(F.count(F.lit(1)).alias(name))
    both = count(panel, "__p").join(count(derived, "__d"), group, "left")
    diff = F.col("__p") - F.coalesce("__d", F.lit(0))
    return both.select(*_row("id_count_match", F.col(group), _band(diff, diff != 0), diff))


def required_columns(spark: SparkSession, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per required column: it is there and holds a value; ``measured`` counts its values."""
    there = [n for n in names if n in df.columns]
    counted = df.agg(F.lit(0).alias("__none"), *[F.count(n).alias(n) for n in there])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit("required_columns").alias("check"), F.lit(n).alias("subject"),
                 F.when(value > 0, "PASS").otherwise("FAIL").alias("status"), value.cast("double").alias("measured"))
        for n in names for value in [F.col(n) if n in there else F.col("__none")]])))


def no_nulls_in_groups(df: DataFrame, groups: Mapping[str, Sequence[str]], worst: int = 5) -> DataFrame:
    """Null counts of each group's columns, worst five per group; a group without nulls passes once."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for g in groups.values() for c in g])
    long = counted.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("g"), F.lit(c).alias("c"), F.col(c).alias("n")) for g, cols in groups.items() for c in cols])))
    w = Window.partitionBy("g").orderBy(F.col("n").desc(), "c")
    ranked = long.withColumn("__rn", F.row_number().over(w)).where(
        (F.col("__rn") <= worst) & ((F.col("n") > 0) | (F.col("__rn") == 1)))
    subject = F.when(F.col("n") > 0, F.concat("g", F.lit("/"), "c")).otherwise(F.col("g"))
    return ranked.select(*_row("no_nulls_in_groups", subject, _band(F.col("n"), F.col("n") > 0), F.col("n")))


def flag_share(df: DataFrame, flags: Mapping[str, bool], group: str = "crop", majority: float = 50.0) -> DataFrame:
    """% of rows where the flag has the flagged value; a majority warns."""
    shares = df.groupBy(group).agg(*[
        (F.avg((F.col(f) == F.lit(bad)).cast("int")) * 100).alias(f) for f, bad in flags.items()])
    long = shares.unpivot([group], list(flags), "flag", "pct")
    return long.select(*_row("flag_share", F.concat(F.col(group), F.lit("/"), F.col("flag")), _band(
        F.col("pct"), warn=F.col("pct") > majority), F.col("pct")))


def assertions(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows that violate each condition, in one pass; null counts as a violation."""
    names = list(conditions)
    counted = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).alias(n) for n, cond in conditions.items()])
    long = counted.unpivot([], names, "name", "n")
    return long.select(*_row("assertions", F.col("name"), _band(F.col("n"), F.col("n") > 0), F.col("n")))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of either column that pair with more than one of the other."""
    pairs = df.select(a, b).distinct()
    many = lambda x, y: pairs.groupBy(x).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).agg(
        F.count(F.lit(1)).alias("n")).select(*_row(
            "one_to_one", F.lit(f"{x}->{y}"), _band(F.col("n"), F.col("n") > 0), F.col("n")))
    return many(a, b).unionByName(many(b, a))


def snapshot_equal(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Row count and order-free content hash of two copies; measured is the difference in rows.

    Two differently seeded hashes are added up as exact decimals, so neither order nor overflow matters.
    """
    columns = sorted(left.columns)

    def digest(df: DataFrame, tag: str) -> DataFrame:
        text = [F.col(c) for c in columns]
        part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *text).cast("decimal(38,0)"))
        return df.agg(F.count(F.lit(1)).alias(f"n_{tag}"), part(1).alias(f"a_{tag}"), part(2).alias(f"b_{tag}"))

    if columns != sorted(right.columns):
        return digest(left, "l").select(*_row("snapshot_equal", F.lit(name), F.lit("FAIL"), F.lit(None)))
    sides = digest(left, "l").unionByName(digest(right, "r"), allowMissingColumns=True)
    both = sides.agg(*[F.max(c).alias(c) for c in sides.columns])
    same = (F.col("n_l") == F.col("n_r")) & F.col("a_l").eqNullSafe(F.col("a_r")) & F.col("b_l").eqNullSafe(F.col("b_r"))
    return both.select(*_row("snapshot_equal", F.lit(name), _band(same, ~same), F.col("n_l") - F.col("n_r")))


def check_report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def report_totals(report: DataFrame) -> DataFrame:
    """PASS, WARN and FAIL counts, one row each, zero included."""
    counts = report.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("PASS", "WARN", "FAIL")])
    return counts.unpivot([], ["PASS", "WARN", "FAIL"], "status", "n")


def exit_code(report: DataFrame) -> int:
    """1 when any check failed; stops at the first failing row."""
    return int(bool(report.where(F.col("status") == "FAIL").take(1)))
