"""Exact deduplication by sorting the content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import normal_space, query, read
from pricegrid.session import materialise

#: code points of a text that take part in the range partitioning; the sort and the comparison use the whole text
SPLIT_PREFIX = 64


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (text, id, digest) in, (id, digest, part, at, lead) out: ``lead`` is the place of the first row of the
    run of equal texts that the row stands in. Only the last text of a batch is carried over."""
    part = TaskContext.get().partitionId()
    at, last, lead = 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(0)
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = text[0].as_buffer()
        new[0] = last is None or not first.equals(last)
        places = np.arange(at, at + n, dtype=np.int64)
        leads = np.maximum.accumulate(np.where(new, places, lead))
        # a copy: the batch's memory is not held for one text
        last, lead, at = pa.py_buffer(text[n - 1].as_buffer().to_pybytes()), int(leads[-1]), at + n
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(np.full(n, part, dtype=np.int64)), pa.array(places),
             pa.array(leads)], names=["id", "digest", "part", "at", "lead"])


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after each run of white space became one space; null counts as empty. Of equal
    texts the row with the smallest id stays (a null id only when the group has no other); of rows that repeat the
    same id and text exactly one is kept. An empty table gives no rows; other columns are not looked at, whatever
    their names.

    Method: the rows are range-partitioned by sampled splitters on (first characters, hash of the text, hash of the
    id) and sorted by the whole text within a partition, where Spark spills to disk. Equal texts are neighbours there;
    each is compared in full with the one before. The last part of the key lets splitters fall inside a group of
    copies, so a text that holds a third of all rows fills several partitions. Runs are then summed up: one row for
    each run and partition goes on, pieces of a run in several partitions meet under the SHA-256 of their text, and
    only groups of two or more rows are joined back, a join whose skewed side adaptive execution splits.
    """
    rows = docs.select(F.col(doc_id).alias("__id"), normal_space(F.col(text)).alias("__t")).select(
        F.col("__t").cast("binary").alias("__b"), "__id", F.unhex(F.sha2("__t", 256)).alias("__sha"),
        F.substring("__t", 1, SPLIT_PREFIX).alias("__prefix"))
    kind = docs.schema[doc_id].dataType.simpleString()
    marked = materialise(
        rows.repartitionByRange("__prefix", F.xxhash64("__sha"), F.xxhash64("__id"))
        .sortWithinPartitions("__b", F.col("__id").asc_nulls_last())
        .select("__b", "__id", "__sha")
        .mapInArrow(_mark_runs, f"id {kind}, digest binary, part long, at long, lead long"))
    pieces = marked.groupBy("part", "lead", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(_first("id", "part", "at")).alias("first"))
    groups = pieces.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    joined = marked.join(groups, "digest", "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | ((F.col("first.part") == F.col("part")) & (F.col("first.at") == F.col("at")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def _first(doc_id: str, part: str, at: str):
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(part).alias("part"),
                    F.col(at).alias("at"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. A row is found again by its id and its normalised text;
    rows that repeat both are interchangeable, one of them stays."""
    kept = exact_dedup(docs, doc_id, text).where("kept").select(
        F.col("doc_id").alias("keep"), F.col("text_sha256").alias("keep_sha"))
    named = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.sha2(normal_space(F.col(text)), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("keep_sha"))
    left = named.join(kept, same, "left_semi").dropDuplicates(["id", "sha"])
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(read(spark, sf, "documents"))
