"""Exact Jaccard self-join of word n-gram sets with set-relation skipping.

Two kinds of skipping keep the join small. In the index, the entries of a list stand in blocks by size and position,
and a block whose positions leave too little of the sets is skipped as a whole. Among answers, a set that is highly
similar to another one (its leader) does not compute its own: its overlap with a third set is the leader's overlap,
corrected by the few shingles in which the two differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.components import connected_components
from pricegrid.llm.common import query, read
from pricegrid.llm.shingles import mix, shingle_sets
from pricegrid.session import materialise

#: shingle counts are kept in this many hashed cells, a table of fixed size; they only decide the order of shingles
CELL_BITS = 20
#: cells of one row while the table is put together
SEGMENT = 4096
#: pairs of min-hashes under which highly similar sets are looked for; they only save work
KEYS = 8
#: entries of a list that are compared as one block
BLOCK = 256
#: lists of shingles whose cell counts this many times the mean or more are also cut by set size
LONG_LIST = 64
#: leading bits of a token: its rarity; the others are a hash of the shingle
RANK_BITS = 8
#: ids up to this number are broadcast (8 bytes each) to pick out the texts that are compared
MOST_IDS = 1_000_000

_U = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Two sets are linked when ``down`` * intersection >= ``up`` * union."""

    up: int
    down: int

    def overlap(self, a, b):
        """Smallest intersection of linked sets of these sizes; works on numbers, arrays and columns."""
        total = self.up + self.down
        if isinstance(a, Column):
            return F.floor((a + b) * F.lit(self.up) / F.lit(total) + F.lit(1 - 0.5 / total)).cast("long")
        return -(-(a + b) * self.up // total)

    def prefix(self, n: int) -> int:
        """Two linked sets share one of their first so many tokens."""
        return n - -(-n * self.up // self.down) + 1


def _count_cells(width: int):
    """Counts of shingles by cell, one row for each segment of the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            for found in _chunks(shingle_sets(batch.column(0), width)):
                counts += np.bincount((found >> _U(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        parts = counts.reshape(-1, SEGMENT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts))), pa.array([_packed(p) for p in parts], pa.binary())], names=["segment", "counts"])

    return run


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, dtype=f"u{len(counts) // SEGMENT}")


def _sum_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each segment as they stream by, and turns the sums into ranks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total = sums.setdefault(segment, np.zeros(SEGMENT, dtype=np.int64))
            total += _unpacked(counts.as_buffer().to_pybytes())
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([_rank(c).tobytes() for c in sums.values()], pa.binary()),
             pa.array([int(c.sum()) for c in sums.values()], pa.int64())], names=["segment", "ranks", "n"])


def _chunks(sets: Iterator[np.ndarray], most: int = 2_000_000) -> Iterator[np.ndarray]:
    held, size = [], 0
    for found in sets:
        held.append(found)
        size += len(found)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _rank(count):
    """Rarity of a cell as 0 to 255: eight steps for each doubling of the count."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def _describe(width: int, threshold: Threshold, ranks):
    """Rows of sets: id, size, two hashes of the set, keys of min-hashes, and the prefix in order of rarity."""
    seeds = mix(np.arange(1, 2 * KEYS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks.value, dtype=np.uint8)
        for batch in batches:
            n, h1, h2, keys, prefixes = [], [], [], [], []
            for found in shingle_sets(batch.column(1), width):
                n.append(len(found))
                if not len(found):
                    h1.append(0), h2.append(0), keys.append(np.zeros(0, np.int64)), prefixes.append(np.zeros(0, np.int64))
                    continue
                mixed = mix(found)
                h1.append(int(mixed.sum().astype(np.int64)))
                h2.append(int(mix(found ^ seeds[0]).sum().astype(np.int64)))
                lows = np.array([mix(found ^ s).min() for s in seeds])
                keys.append(mix(lows[0::2] * seeds[0] + lows[1::2]).astype(np.int64))
                tokens = rank[(found >> _U(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
                tokens = tokens << _U(64 - RANK_BITS) | mixed >> _U(RANK_BITS)
                p = threshold.prefix(len(found))
                if p < len(tokens):
                    tokens = np.partition(tokens, p)[:p]
                prefixes.append(np.sort(tokens).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["id", "n", "h1", "h2", "keys", "prefix"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, short, size = [], [], [], 0
            for row, found in enumerate(shingle_sets(batch.column(1), width)):
                rows.append(row)
                held.append(found.astype(np.int64))
                short.append(np.unique(found.astype(np.uint16)).astype(np.int16))
                size += len(found)
                if size >= 500_000 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(short, pa.list_(pa.int16())),
                         pa.array(held, pa.list_(pa.int64()))], names=["id", "short", "set"])
                    rows, held, short, size = [], [], [], 0

    return run


def _list_pairs(threshold: Threshold, node, group, n, at) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one index list: different groups, sizes and positions that allow the threshold.

    A pair is judged as if this were its first common token, which it is in one list: then at most the smaller rest
    of the two sets can be shared besides.
    """
    order = np.lexsort((at, n))
    node, group, n, rest = node[order], group[order], n[order], (n - at)[order]
    for i in range(0, len(n), BLOCK):
        big = slice(i, min(i + BLOCK, len(n)))
        low = int(np.searchsorted(n, -(-n[i] * threshold.up // threshold.down)))
        for j in range(low // BLOCK * BLOCK, i + 1, BLOCK):
            small = slice(j, min(j + BLOCK, len(n)))
            if min(rest[big].max(), rest[small].max()) < threshold.overlap(n[i], n[j]):
                continue  # the whole block stands too late in its sets
            if group[big].min() == group[big].max() == group[small].min() == group[small].max():
                continue  # all known to be connected
            fits = np.minimum(rest[big][:, None], rest[small][None, :]) >= threshold.overlap(
                n[big][:, None], n[small][None, :])
            fits &= group[big][:, None] != group[small][None, :]
            if i == j:
                fits &= np.tri(fits.shape[0], fits.shape[1], -1, dtype=bool)
            a, b = np.nonzero(fits)
            if len(a):
                yield node[big][a], node[small][b]


def _candidates(threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        pairs, size = [], 0

        def distinct() -> np.ndarray:
            joined = np.concatenate(pairs)
            return np.unique(np.sort(joined, axis=1), axis=0)

        def lists(columns: tuple[np.ndarray, ...], last: bool):
            """Lists that are complete; the one at the end may go on in the next batch."""
            token, part = columns[0], columns[1]
            if not len(token):
                return columns
            cut = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.append(cut, len(token))
            upto = len(starts) if last else len(starts) - 1
            for k in np.flatnonzero(ends[:upto] - starts[:upto] > 1).tolist():
                s = slice(starts[k], ends[k])
                for a, b in _list_pairs(threshold, *(c[s] for c in columns[2:])):
                    pairs.append(np.stack([a, b], axis=1))
            return tuple(c[starts[-1]:] for c in columns) if not last else None

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            token, part = held[-1][0], held[-1][1]
            if token[0] == token[-1] and part[0] == part[-1]:
                continue
            joined = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held = [lists(joined, False)]
            size = sum(map(len, pairs))
            if size > 1_000_000:
                yield _pair_batch(distinct())
                pairs = []
        if held:
            lists(tuple(np.concatenate(c) for c in zip(*held, strict=True)), True)
        if pairs:
            yield _pair_batch(distinct())

    return run


def _pair_batch(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "z"])


def _wanted(*ids: DataFrame) -> DataFrame:
    """The distinct ids, with a broadcast hint when there are at most MOST_IDS."""
    wanted = ids[0]
    for more in ids[1:]:
        wanted = wanted.unionByName(more)
    wanted = materialise(wanted.distinct())
    return F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted


class _Texts:
    """Shingle sets of chosen documents, computed from their texts again instead of being kept for all."""

    def __init__(self, rows: DataFrame, width: int) -> None:
        self.rows, self.width = rows, width

    def of(self, *ids: DataFrame) -> DataFrame:
        return materialise(
            self.rows.join(_wanted(*ids), "id", "left_semi").select("id", "__text").mapInArrow(
                _sets(self.width), "id long, short array<short>, set array<long>"))


def _with_set(pairs: DataFrame, sets: DataFrame, column: str, name: str) -> DataFrame:
    return pairs.join(sets.select(F.col("id").alias(column), F.col("set").alias(name)), column)


def _plausible(pairs: DataFrame, sets: DataFrame, a: str, b: str, need: Column) -> DataFrame:
    """Pairs whose overlap may reach ``need`` by the last 16 bits of their shingles, a quarter of the data.

    Every common shingle has common last bits, and shingles of one set with equal last bits number at most ``lost``.
    """
    for column, name in ((a, "a"), (b, "b")):
        pairs = pairs.join(sets.select(
            F.col("id").alias(column), F.col("short").alias(f"short_{name}"),
            (F.size("set") - F.size("short")).alias(f"lost_{name}")), column)
    most = F.size(F.array_intersect("short_a", "short_b")) + F.least("lost_a", "lost_b")
    return pairs.where(most >= need).drop("short_a", "short_b", "lost_a", "lost_b")


def jaccard_classes(docs: DataFrame, width: int = 3, threshold: Threshold = Threshold(90, 100),
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``, the smallest id reachable by links.

    A text's set is its distinct ``width``-word shingles (A-Z lower-cased, words split at ASCII white space); with
    fewer words the whole sequence is one shingle, without words the set is empty and linked with nothing. Null texts
    are empty. Ids are integers; rows with a null id link nothing but get the component of an equal set. Rows that
    repeat an id count as one document with several sets, all of which link. Empty tables give no rows; other columns
    are not looked at. Shingles are 64-bit hashes, so that a chance collision within one pair of sets (about 1 in
    10**13 for sets of a thousand) could count as a common shingle.

    1. Counts of all shingles in hashed cells order the shingles by rarity; equal sets become one class.
    2. Sets that share pairs of min-hashes with the smallest id under them, their leader, are compared with it. This
       makes most links in time proportional to the number of sets, however many copies a text has.
    3. The index holds the rarest tokens of every set. A list yields only pairs of sets that step 2 has not connected,
       so a large group of near copies yields few. No list is cut: very long ones are split by set size.
    4. A quarter of each shingle's bits rules out most candidates. Overlaps with the leader decide the pairs of its
       followers by bounds, or by correction where bounds are open.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("__text"))
    segments = (1 << CELL_BITS) // SEGMENT
    table, total = [bytes(SEGMENT)] * segments, 0
    for row in (  # the driver gets one byte a cell
        rows.select("__text").mapInArrow(_count_cells(width), "segment long, counts binary")
        .repartition("segment").mapInArrow(_sum_segments, "segment long, ranks binary, n long").collect()
    ):
        table[row.segment] = bytes(row.ranks)
        total += row.n
    ranks = spark.sparkContext.broadcast(b"".join(table))
    frequent = int(_rank(np.array([LONG_LIST * max(1.0, total / (1 << CELL_BITS))]))[0])
    described = materialise(rows.mapInArrow(
        _describe(width, threshold, ranks), "id long, n long, h1 long, h2 long, keys array<long>, prefix array<long>"))

    sets = materialise(
        described.where("id IS NOT NULL AND n > 0").groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("id", "keys", "prefix")).alias("s"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("s.id").alias("id"), "n", "h1", "h2", F.col("s.keys").alias("keys"), F.col("s.prefix").alias("prefix")))

    texts = _Texts(rows.where("id IS NOT NULL"), width)
    linked = F.col("common") >= threshold.overlap(F.col("nx"), F.col("nl"))

    # step 2: links with leaders
    keyed = sets.select("id", "n", F.posexplode("keys").alias("k", "key"))
    leaders = keyed.groupBy("k", "key").agg(F.min(F.struct("id", "n")).alias("l"), F.count(F.lit(1)).alias("m")).where(
        "m > 1").select("k", "key", F.col("l.id").alias("l"), F.col("l.n").alias("nl"))
    close = materialise(
        keyed.join(leaders, ["k", "key"])
        .where((F.col("id") != F.col("l")) & (F.lit(threshold.down) * F.least("n", "nl")
                                              >= F.lit(threshold.up) * F.greatest("n", "nl")))
        .select(F.col("id").alias("x"), F.col("n").alias("nx"), "l", "nl").distinct())
    near_sets = texts.of(close.select(F.col("x").alias("id")), close.select(F.col("l").alias("id")))
    likely = materialise(_plausible(close, near_sets, "x", "l", threshold.overlap(F.col("nx"), F.col("nl"))))
    near_sets = near_sets.join(_wanted(*[likely.select(F.col(c).alias("id")) for c in ("x", "l")]), "id", "left_semi")
    followers = materialise(
        _with_set(_with_set(likely, near_sets, "x", "sx"), near_sets, "l", "sl")
        .select("x", "nx", "l", "nl", F.array_except("sx", "sl").alias("added"), F.array_except("sl", "sx").alias("removed"))
        .withColumn("common", F.col("nx") - F.size("added")).where(linked))
    groups = connected_components(followers, "x", "l")
    leader = followers.groupBy("x").agg(F.max_by(F.struct("l", "added", "removed"), F.struct("common", -F.col("l"))).alias("best"))

    # step 3: the index
    token = F.col("token")
    many = F.shiftrightunsigned(token, 64 - RANK_BITS) >= F.lit(frequent)
    step = float(np.log(threshold.down / threshold.up))
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    entries = (
        sets.select("id", "n", "prefix").join(groups, F.col("id") == F.col("node"), "left")
        .select("id", F.coalesce("component", "id").alias("group"), "n", F.posexplode("prefix").alias("at", "token"))
        # linked sizes lie in the same or in neighbouring blocks
        .withColumn("part", F.explode(F.when(many, F.array(block, block + 1)).otherwise(F.array(F.lit(0))))))
    pairs = (
        entries.select("token", "part", "id", "group", "n", F.col("at").cast("long").alias("at"))
        .repartition("token", "part").sortWithinPartitions("token", "part")
        .mapInArrow(_candidates(threshold), "x long, z long"))
    followed = leader.select(F.col("x").alias("id"), F.lit(1).alias("has"))
    sized = sets.select("id", "n")
    pairs = (
        pairs.distinct()
        .join(followed.withColumnsRenamed({"id": "x", "has": "fx"}), "x", "left")
        .join(followed.withColumnsRenamed({"id": "z", "has": "fz"}), "z", "left")
        # the side with a leader is the one whose answer is derived
        .select(F.when(F.col("fx").isNull() & F.col("fz").isNotNull(), F.struct(F.col("z").alias("x"), F.col("x").alias("z")))
                .otherwise(F.struct("x", "z")).alias("p")).select("p.*"))
    pairs = materialise(
        pairs.join(leader.select("x", F.col("best.l").alias("l"), F.size("best.added").alias("plus"),
                                 F.size("best.removed").alias("minus")), "x", "left")
        .join(sized.withColumnsRenamed({"id": "x", "n": "nx"}), "x").join(sized.withColumnsRenamed({"id": "z", "n": "nz"}), "z")
        .select("x", "z", F.coalesce("l", "x").alias("l"), F.coalesce("plus", F.lit(0)).alias("plus"),
                F.coalesce("minus", F.lit(0)).alias("minus"),
                threshold.overlap(F.col("nx"), F.col("nz")).alias("need")))

    # step 4: answers of leaders, then of their followers
    far_sets = texts.of(*[pairs.select(F.col(c).alias("id")) for c in ("x", "z", "l")])
    pairs = materialise(_plausible(pairs, far_sets, "x", "z", F.col("need")))
    far_sets = far_sets.join(_wanted(*[pairs.select(F.col(c).alias("id")) for c in ("z", "l")]), "id", "left_semi")
    answers = _with_set(_with_set(pairs.select("z", "l").distinct(), far_sets, "z", "sz"), far_sets, "l", "sl").select(
        "z", "l", F.size(F.array_intersect("sz", "sl")).alias("answer"))
    bounded = materialise(pairs.join(answers, ["z", "l"]).where(F.col("answer") + F.col("plus") >= F.col("need")))
    sure = F.col("answer") - F.col("minus") >= F.col("need")
    corrected = (
        _with_set(bounded.where(~sure), far_sets, "z", "sz").join(leader, "x")
        .where(F.col("answer") - F.size(F.array_intersect("best.removed", "sz"))
               + F.size(F.array_intersect("best.added", "sz")) >= F.col("need")))
    links = bounded.where(sure).select("x", "z").unionByName(corrected.select("x", "z"))

    classes = connected_components(
        followers.select("x", F.col("l").alias("z")).unionByName(links), "x", "z")
    by_set = sets.join(classes, F.col("id") == F.col("node"), "left").select(
        "h1", "h2", "n", F.coalesce("component", "id").alias("component"))
    done = described.select("id", "n", "h1", "h2").join(by_set, ["h1", "h2", "n"], "left")
    return done.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(80, 100),
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those linked, directly or over others, to a row with a smaller id; all columns
    pass through, whatever their names. Rows with a null id stay unless an equal set has an id. An empty table gives an
    empty one."""
    gone = jaccard_classes(docs, width, threshold, doc_id, text).where("component_id != doc_id").select(
        F.col("doc_id").alias("gone")).distinct()
    # the row as one value: no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"))
    left = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_classes(read(spark, sf, "documents"))
