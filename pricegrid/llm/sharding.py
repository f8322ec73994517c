"""Sharding: the minimax contiguous partition of ordered, atomic groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import numbered, query, read

#: groups of equal texts are ordered by a 64-bit hash of the text; this many leading bits name an atomic cell of the
#: order. The driver holds one number for each cell, whatever the size of the table.
CELL_BITS = 17


def _least_capacity(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest possible largest sum of ``shards`` contiguous parts, and the ends of the parts of a greedy filling.

    Binary search on the capacity; a capacity is checked by filling greedily, each fill a search in the running sums.
    """
    ends = np.cumsum(sizes)
    total, largest = int(ends[-1]), int(sizes.max())

    def fill(capacity: int) -> list[int]:
        cuts, done = [], 0
        while done < total and len(cuts) < shards:
            at = int(np.searchsorted(ends, done + capacity, side="right"))
            done = int(ends[at - 1])
            cuts.append(at)
        return cuts if done == total else []

    low, high = max(largest, -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle) else (middle + 1, high)
    return low, fill(low)


def minimax_cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """First index of every shard but the first, for a contiguous partition of ``sizes`` into at most ``shards``
    parts whose largest sum is smallest. A shard that gets nothing starts at ``len(sizes)``.

    A size that is itself the capacity stands alone, and the other shards are shared out to both sides of it so that
    the larger capacity of the two is smallest, and so on within them. Shards still left over halve the heaviest parts.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return [0] * (shards - 1)
    capacity, cuts = _least_capacity(sizes, shards)
    at, total = int(sizes.argmax()), int(sizes.sum())
    if shards > 1 and capacity == sizes[at] < total:
        left, right, rest = sizes[:at], sizes[at + 1:], shards - 1
        if not left.any():
            mine = 0
        elif not right.any():
            mine = rest
        else:
            mine = min(range(1, rest), key=lambda k: max(_least_capacity(left, k)[0], _least_capacity(right, rest - k)[0]))
        before = minimax_cuts(left, mine) + [at] if mine else []
        after = [at + 1] + [at + 1 + c for c in minimax_cuts(right, rest - mine)] if mine < rest else []
        return before + after
    bounds = [0, *cuts]
    while 1 < len(bounds) <= shards:
        parts = [(int(sizes[a:b].sum()), a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if np.count_nonzero(sizes[a:b]) > 1]
        if not parts:
            break
        _, a, b = max(parts)
        bounds = sorted([*bounds, a + _least_capacity(sizes[a:b], 2)[1][0]])
    return (bounds[1:] + [len(sizes)] * shards)[: shards - 1]


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    A row's size is the UTF-8 bytes of its text plus 8 (null counts as empty). Rows with equal texts stay together:
    they share a cell of the hashed order, cells are atomic, and the cells are cut into ``shards`` contiguous runs
    whose largest byte sum is the smallest possible. A cell holds about 1 / 2**17 of the texts, so shards differ by
    well under 0.1 % unless one group of copies is itself larger than a shard. Slots number a shard's rows from 0 by
    (hash, id, crc); repeated rows get a slot each. Empty tables give no rows, other columns are not looked at.

    The sizes are summed by cell before and after a shuffle; the sums of all cells (2**17 at most) go to the driver,
    which searches the capacity. Slots come from a range partitioning that can split a group of copies over tasks.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(value) + 8).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"), F.xxhash64(value).alias("__hash"))
    rows = rows.withColumn("__cell", F.shiftright("__hash", 64 - CELL_BITS) + F.lit(1 << (CELL_BITS - 1)))
    sums = rows.groupBy("__cell").agg(F.sum("size").alias("size")).toPandas()
    sizes = np.zeros(1 << CELL_BITS, dtype=np.int64)
    sizes[sums["__cell"].to_numpy(dtype=np.int64)] = sums["size"].to_numpy(dtype=np.int64)
    cuts = minimax_cuts(sizes, shards)
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col("__cell") >= F.lit(cut)).cast("int")
    ordered = numbered(rows.withColumn("shard", place),
                       [F.col("shard"), F.col("__hash"), F.col("doc_id"), F.col("text_crc32")], "__index")
    first = ordered.groupBy("shard").agg(F.min("__index").alias("__first"))
    return (
        ordered.join(F.broadcast(first), "shard")  # one row a shard
        .select("doc_id", "size", "text_crc32", "shard", (F.col("__index") - F.col("__first")).cast("long").alias("slot")))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard(read(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
