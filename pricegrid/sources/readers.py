"""Readers: everything arrives as text or Parquet and is coerced explicitly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid import schemas
from pricegrid.functions import scalars

DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MMM-yyyy", "yyyyMM"]


def coerce(df: DataFrame, schema: T.StructType, date_formats: Sequence[str] = ("yyyy-MM-dd",),
           required: Sequence[str] = ()) -> DataFrame:
    """Cast text columns to the schema; unreadable values become null, rows without a required value go."""
    def cast(field: T.StructField):
        if isinstance(field.dataType, T.DateType):
            return scalars.parse_date(field.name, date_formats).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        return F.trim(F.col(field.name)).try_cast(field.dataType).alias(field.name)

    typed = df.select(*[cast(f) for f in schema.fields if f.name in df.columns])
    return typed.dropna(subset=list(required)) if required else typed


def as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def read_daily(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_DAILY,
               date_formats: Sequence[str] = ("yyyy-MM-dd",)) -> DataFrame:
    """Daily market records from CSV. Rows whose arrival date cannot be read are dropped."""
    raw = spark.read.csv(path, header=True, schema=as_text(schema), mode="PERMISSIVE")
    return coerce(raw, schema, date_formats, required=["arrival_date"])


def existing_paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The patterns that match something, on whatever file system they name."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        matches = path.getFileSystem(conf).globStatus(path)
        if matches is not None and len(matches) > 0:
            found.append(pattern)
    return found


def read_many_union(spark: SparkSession, patterns: Sequence[str], fmt: str = "csv",
                    **options) -> DataFrame:
    """Union of all folders or globs that exist; columns are matched by name, missing ones are null."""
    paths = existing_paths(spark, patterns)
    if not paths:
        raise FileNotFoundError(f"nothing matches {list(patterns)}")
    frames = [spark.read.format(fmt).options(**options).load(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_report(spark: SparkSession, path: str, columns: Mapping[str, str], banner: str) -> DataFrame:
    """Portal report: a banner line before the header, numbers with thousands separators.

    ``columns`` maps header names to Spark types. Banner and header lines are recognised by content, so
    files stay splittable.
    """
    names = list(columns)
    raw = spark.read.csv(path, header=False, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    rows = raw.where(~F.coalesce(F.col(names[0]).startswith(banner), F.lit(False)) & (F.col(names[0]) != names[0]))
    return parse_thousands(rows, [n for n, kind in columns.items() if kind == "double"])


def parse_thousands(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: scalars.parse_number(c) for c in columns})


def column_pruned_read(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.format(fmt).load(path).select(*columns)


def parse_dates_multiformat(df: DataFrame, column: str, out: str,
                            formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    return df.withColumn(out, scalars.parse_date(F.trim(F.col(column)), formats))
