"""Row-wise projections, filters and label repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values
from pricegrid.functions import calendar as cal
from pricegrid.functions import ordered, scalars
from pricegrid.functions.sizes import small_side
from pricegrid.session import materialise


def relabel_map(df: DataFrame, column: str, spellings: Mapping[str, str] = values.STATE_SPELLINGS) -> DataFrame:
    """Old spelling to new; labels that are not listed stay."""
    expr = F.col(column)
    fixed = F.coalesce(*[F.when(expr == old, F.lit(new)) for old, new in spellings.items()], expr)
    return df.withColumn(column, fixed)


def split_combined_entity(df: DataFrame, entity: str, combined: str, part: str, rest: str,
                          measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """value(rest) = value(combined) - value(part); the combined row is replaced by the new one."""
    pick = lambda name, m: F.sum(F.when(F.col(entity) == name, F.col(m)))
    derived = (
        df.where(F.col(entity).isin(combined, part)).groupBy(*keys)
        .agg(F.count_if(F.col(entity) == combined).alias("__n"),
             *[(pick(combined, m) - pick(part, m)).alias(m) for m in measures])
        .where(F.col("__n") > 0)
        .select(*keys, F.lit(rest).alias(entity), *measures)
    )
    return df.where(F.col(entity) != combined).select(*keys, entity, *measures).unionByName(derived)


def disambiguate_labels(df: DataFrame, group: Sequence[str], name: str, ident: str, qualifier: str,
                        out: str = "label") -> DataFrame:
    """Append ' (qualifier)' to names that stand for more than one id in their group."""
    shared = (
        df.groupBy(*group, name).agg((F.min(ident) != F.max(ident)).alias("__shared"))
        .where("__shared")
    )
    label = F.when(F.col("__shared"), F.concat(F.col(name), F.lit(" ("), F.col(qualifier), F.lit(")")))
    return (
        df.join(shared, [*group, name], "left")
        .withColumn(out, F.coalesce(label, F.col(name))).drop("__shared")
    )


def categorical_codes(df: DataFrame, group: str, columns: Mapping[str, str], domain: DataFrame | None = None) -> DataFrame:
    """Place of each value among the group's sorted distinct values, missing -> -1. ``columns``: column -> code.

    Only the distinct combinations are ranked, so a crop with most of the rows is not sorted as a whole.
    ``domain`` is a smaller frame with the same combinations, to save a pass over ``df``. Each column's codes are joined on
    their own: narrow rows are broadcast up to MAX_BYTES, which leaves ``df`` in its partitions.
    """
    names = list(columns)
    combos = materialise((df if domain is None else domain).select(group, *names).distinct())
    for c, out in columns.items():
        codes = combos.select(group, c).distinct().withColumn(out, F.when(F.col(c).isNull(), F.lit(-1)).otherwise(
            F.dense_rank().over(Window.partitionBy(group).orderBy(F.col(c).asc_nulls_last())) - 1))
        df = ordered._null_safe_join(df, small_side(codes, 2_000_000), [group, c])
    return df


def season_flags(df: DataFrame, crop: str = "crop", month: Column | None = None,
                 seasons: Mapping[str, Mapping[str, Sequence[int]]] = values.SEASON_MONTHS) -> DataFrame:
    month = F.month("week_start") if month is None else month
    names = sorted({season for table in seasons.values() for season in table})
    return df.withColumns({f"season_{s}": scalars.season_flag(crop, month, s, seasons) for s in names})


def calendar_parts(df: DataFrame, date: str, base_year: int = values.BASE_YEAR) -> DataFrame:
    return df.withColumns({
        "week_start": cal.week_start(date),
        "iso_year": cal.iso_year(date),
        "iso_week": cal.iso_week(date),
        "year": F.year(cal.week_start(date)),
        "month": F.month(cal.week_start(date)),
        "dow": cal.day_of_week(date),
        "year_trend": F.year(cal.week_start(date)) - base_year,
    })


def cyclic_features(df: DataFrame, week: str = "iso_week", month: str | None = None) -> DataFrame:
    sin1, cos1 = cal.cyclic(week, 52)
    sin2, cos2 = cal.cyclic(week, 52, 2)
    out = {"sin_week": sin1, "cos_week": cos1, "sin2_week": sin2, "cos2_week": cos2}
    if month:
        out["sin_month"], out["cos_month"] = cal.cyclic(month, 12)
    return df.withColumns(out)


def log_transforms(df: DataFrame, price: str = "modal_price_weighted", arrivals: str = "arrivals_tonnes_week") -> DataFrame:
    return df.withColumns({
        "log_price": F.log1p(price),
        "log_arr": scalars.log_arrivals(arrivals),
        "log_arr_clip1": F.log(F.greatest(F.col(arrivals), F.lit(1.0))),
    }).withColumn("price_back", F.expm1("log_price"))


def derived_range(df: DataFrame, high: str, low: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(high) - F.col(low))


def null_safe_changed(df: DataFrame, pairs: Mapping[str, tuple[str, str]], out: str = "changed") -> DataFrame:
    """Array of the names whose two columns differ; null equals null."""
    names = [F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(name)) for name, (a, b) in pairs.items()]
    return df.withColumn(out, F.array_compact(F.array(*names)))


def null_default(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Default for missing values; NaN counts as missing."""
    out = {}
    kinds = dict(df.dtypes)
    for column, default in defaults.items():
        c = F.col(column)
        if kinds[column] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        out[column] = F.coalesce(c, F.lit(default))
    return df.withColumns(out)


def feature_fill_zero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return null_default(df, {f: 0.0 for f in features})


def facet_filter_page(df: DataFrame, equals: Mapping[str, Sequence[str]], search: str | None,
                      search_in: Sequence[str], order_by: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of the filtered list. ``order_by`` should end in a unique column."""
    for column, allowed in equals.items():
        if allowed:
            df = df.where(F.col(column).isin(list(allowed)))
    if search:
        hit = F.lit(False)
        for column in search_in:
            hit = hit | F.lower(column).contains(search.lower())
        df = df.where(hit)
    return df.orderBy(*order_by).offset(page * size).limit(size)


def contains_flag(df: DataFrame, column: str, needle: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.lower(column).contains(needle.lower()), F.lit(False)))


def metadata_first(df: DataFrame, ident: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """First-seen metadata per id under a stated order, as one map-side combined aggregate."""
    first = F.min(F.struct(*order, *fields)).alias("__first")
    return df.groupBy(*ident).agg(first).select(*ident, *[F.col(f"__first.{f}").alias(f) for f in fields])
