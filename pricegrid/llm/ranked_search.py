"""Ranked lexical search with range-maximum tables over posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pricegrid.llm.common import query, read
from pricegrid.session import materialise, written

#: a term is a maximal run of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (item, term) pairs that are answered in one pass over the documents; further items take further passes
PASS_PAIRS = 200_000
#: postings that an index holds at once in a task; its tables take some 60 bytes each
BLOCK_POSTINGS = 1 << 20
#: bytes of a text that are cut into terms at once
PIECE = 1 << 21
#: intervals that are split in one step, the best first
STEP = 32

#: for each byte the byte of the lower-cased text, a space where no term goes on
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = len(folded)
        if end - at > PIECE:
            end = folded.rfind(b" ", at, at + PIECE) + 1
            if not end:  # one term fills the piece
                end = folded.find(b" ", at + PIECE) + 1 or len(folded)
        yield folded[at:end].split()
        at = end


def counted(docs: DataFrame, doc_id: str, text: str, vocabulary) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each row: number of its terms, and the numbers of the vocabulary's among them with
    how often they occur. ``vocabulary`` is a broadcast map."""
    listed = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            lengths, sizes, terms, tfs = [], [0], [], []
            for value in batch.column(1):
                raw = value.as_buffer()
                total, found = 0, []
                for some in terms_of(raw.to_pybytes() if raw is not None else b""):
                    total += len(some)
                    found.append(np.array([x for x in map(number.get, some) if x is not None], np.int32))
                known, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                lengths.append(total)
                sizes.append(len(known))
                terms.append(known)
                tfs.append(tf.astype(np.int32))
            offsets = pa.array(np.cumsum(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()),
                 *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))).cast(listed)
                   for x in (terms, tfs))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Index:
    """The posting lists of a run of documents, numbered from 0, in one array by (term, document), with range-maximum
    tables: level k names for each place the posting of the largest impact among the 2^k from there on. A range of a
    list is covered by two entries of a level. Ranges never leave their list, so one table serves all lists."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.n_docs, self.impact = n_docs, impact[order]
        self.keys = term[order].astype(np.int64) * n_docs + doc[order]
        self.starts = np.searchsorted(self.keys, np.arange(n_terms + 1, dtype=np.int64) * n_docs)
        self.docs = doc[order]
        longest = int(np.diff(self.starts).max(initial=0))
        self.levels = [np.arange(len(self.keys), dtype=np.int32)]
        for k in range(1, longest.bit_length()):
            half, below = 1 << (k - 1), self.levels[-1]
            level = below.copy()
            right = below[half:]
            better = self.impact[right] > self.impact[below[:-half]]
            level[:-half][better] = right[better]
            self.levels.append(level)
        self.levels = np.stack(self.levels) if len(self.keys) else np.zeros((1, 0), np.int32)
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i // 2] + 1

    def best(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range [low, high) of places the largest impact, 0 where it is empty, and its document."""
        length = high - low
        filled = length > 0
        k = self.log[length * filled]
        left = self.levels[k, np.where(filled, low, 0)]
        right = self.levels[k, np.where(filled, high - (1 << k), 0)]
        a, b = self.impact[left], self.impact[right]
        return np.where(filled, np.maximum(a, b), 0), self.docs[np.where(a >= b, left, right)]


class Ranking:
    """The best ``most`` documents so far, (score, place), higher scores and then lower places first."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    def least(self) -> int:
        """The score that a document must reach, which earlier places have to exceed when it is reached."""
        return self.rows[-1][0] if len(self.rows) == self.most else 0

    def last(self) -> int:
        return self.rows[-1][1] if len(self.rows) == self.most else 1 << 62

    def add(self, scores: np.ndarray, places: np.ndarray) -> None:
        self.rows = sorted([*self.rows, *((s, p) for s, p in zip(scores.tolist(), places.tolist(), strict=True) if s > 0)],
                           key=lambda r: (-r[0], r[1]))[: self.most]


def search(index: Index, terms: np.ndarray, ranking: Ranking, before: int) -> int:
    """Add the best documents of the index, which stand at ``before`` and the places after, to the ranking; returns how
    many documents were scored.

    An interval of documents is bounded by the sum, over the terms, of the largest impact in its part of their lists.
    The intervals with the highest bounds are taken first, each is split at the document of the largest single impact,
    which is scored exactly, and what cannot reach the ranking any more is let go. It ends when nothing is left.
    """
    terms = terms[index.starts[terms + 1] > index.starts[terms]]
    if not len(terms):
        return 0
    base, scored = terms.astype(np.int64) * index.n_docs, 0

    def bounded(low: np.ndarray, high: np.ndarray, first: np.ndarray):
        most, doc = index.best(low, high)
        return most.sum(axis=1), doc[np.arange(len(low)), most.argmax(axis=1)], low, high, first

    bound, split, low, high, first = bounded(index.starts[terms][None], index.starts[terms + 1][None], np.zeros(1, np.int64))
    while len(bound):
        least = ranking.least()
        open_ = (bound > least) | ((bound == least) & (bound > 0) & (first + before < ranking.last()))
        if not open_.all():
            bound, split, low, high, first = bound[open_], split[open_], low[open_], high[open_], first[open_]
            if not len(bound):
                break
        take = np.argpartition(-bound, STEP - 1)[:STEP] if len(bound) > STEP else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[take] = False
        at, doc, a, b = first[take], split[take], low[take], high[take]
        wanted = base + doc[:, None]
        place = np.searchsorted(index.keys, wanted)
        inside = np.minimum(place, len(index.keys) - 1)
        hit = (place < b) & (index.keys[inside] == wanted)
        ranking.add((index.impact[inside] * hit).sum(axis=1), doc + before)
        scored += len(doc)
        new = bounded(np.concatenate([a, place + hit]), np.concatenate([place, b]), np.concatenate([at, doc + 1]))
        bound, split, low, high, first = (
            np.concatenate([x[rest], y]) for x, y in zip((bound, split, low, high, first), new, strict=True))
    return scored


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Share of a term in a document's score, in whole numbers: w * ((10^9 tf) div (1000 tf + 8 m)) with
    m = 10 + ((90 n N) div L)."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([100 - 90 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 100 - 90 + 90 * n * n_docs // max(1, n_terms)
    tf = tf.astype(np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answers(batches: Iterator[pa.RecordBatch], items: Sequence[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int,
             most: int, kind: pa.DataType, block: int) -> Iterator[pa.RecordBatch]:
    """The best documents of a partition, sorted by id, for each item. Indexes of at most ``block`` postings, or one
    document, follow one another; what an item found before bounds the search in later ones."""
    rankings = [Ranking(most) for _ in items]
    names: dict[int, object] = {}
    before, held, size = 0, [], 0

    def answer() -> None:
        nonlocal before, held, size
        ids = pa.chunked_array([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        counts = np.concatenate([h[2] for h in held])
        term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        doc = np.repeat(np.arange(len(n)), counts)
        index = Index(doc, term, impacts(tf, n[doc], weights[term], n_docs, n_terms), len(n), len(weights))
        for terms, ranking in zip(items, rankings, strict=True):
            search(index, terms, ranking, before)
        kept = {p for r in rankings for _, p in r.rows}
        for p in [p for p in names if p not in kept]:
            del names[p]
        for p in kept - names.keys():
            names[p] = ids[p - before].as_py()
        before, held, size = before + len(n), [], 0

    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy()
        values = [c.values.to_numpy(zero_copy_only=False) for c in (batch.column(2), batch.column(3))]
        n = batch.column(1).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            # as many rows as the block has room for, one at least
            end = int(np.searchsorted(offsets, offsets[at] + max(0, block - size), side="right")) - 1
            end = max(end, at + (not held))
            if end > at:
                a, b = offsets[at], offsets[end]
                held.append((batch.column(0).slice(at, end - at), n[at:end], np.diff(offsets[at:end + 1]), values[0][a:b], values[1][a:b]))
                size += int(b - a)
                at = end
            if at < batch.num_rows:
                answer()
    if held:
        answer()
    rows = [(i, names[p], s) for i, r in enumerate(rankings) for s, p in r.rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())],
        names=["item", "doc_id", "score"])


def _terms(text: Column) -> Column:
    upper, lower = (str().join(map(chr, range(a, a + 26))) for a in (65, 97))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(f"({TERM})"))


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", most: int = 10, pass_pairs: int = PASS_PAIRS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` documents with the highest scores above 0 for each item, equal scores
    by ascending id (null ids last). See ``impacts`` for the score; a term counts once an item however often it occurs.

    Null and empty texts have no terms; an item without terms, or none that a document holds, gives no rows. Rows that share
    an item's id are one item with the terms of all; a null id is an id. Every row of ``docs`` is a document, also where
    ids or texts repeat. Empty tables give no rows; other columns are not looked at, whatever their names. Whole texts count.

    Items are answered in passes of a bounded number of terms. A pass counts their terms in every document and writes the
    counts; then every partition of that table, sorted by id, builds its indexes, a bounded number of postings at a time,
    and searches them for all items. A partition sends ``most`` rows an item on. No list of a term is ever in one task.
    """
    spark = docs.sparkSession
    pairs = materialise(
        items.select(F.col(item_id).alias("item_id"), F.explode(_terms(F.col(item_text))).alias("term")).distinct())
    total = pairs.count()
    passes = max(1, -(-total // pass_pairs))
    pairs = pairs.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    item_type, doc_type = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    done = []
    for k in range(passes if total else 0):
        done.append(_one_pass(spark, docs, pairs.where(F.col("pass") == k), doc_id, text, item_type, most, block_postings))
    if not done:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {doc_type.simpleString()}, score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _one_pass(spark: SparkSession, docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, item_type, most: int,
              block: int) -> DataFrame:
    # at most pass_pairs rows, and the terms of one more item
    by_item: dict[object, list[str]] = {}
    for r in pairs.select("item_id", "term").collect():
        by_item.setdefault(r["item_id"], []).append(r["term"])
    number: dict[bytes, int] = {}
    items = [np.array([number.setdefault(t.encode(), len(number)) for t in terms], np.int64) for terms in by_item.values()]
    vocabulary = spark.sparkContext.broadcast(number)
    table = written(counted(docs, doc_id, text, vocabulary).where("n > 0"))
    sums = table.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]
    weights = np.zeros(max(1, len(number)), np.int64)
    # at most one row a term
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r["t"]] = weight_of(n_docs, r["count"])
    sent = spark.sparkContext.broadcast((items, weights))
    kind = docs.schema[doc_id].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = sent.value
        yield from _answers(batches, wanted, weight, n_docs, n_terms, most, arrow, block)

    found = table.sortWithinPartitions(F.col("doc_id").asc_nulls_last()).mapInArrow(
        run, f"item int, doc_id {kind.simpleString()}, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    names = spark.createDataFrame([(i, name) for i, name in enumerate(by_item)], f"item int, item_id {item_type.simpleString()}")
    # one row an item of the pass
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM x),
b AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT r, doc_id, n, unnest(t) AS term FROM x),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
    FROM b JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
WHERE rank <= 10"""


@query("op13_ranked_search", SQL)
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
