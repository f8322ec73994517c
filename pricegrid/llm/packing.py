"""Tokenise documents and pack the pieces into sequences by hierarchical best fit."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read
from pricegrid.session import materialise

CAPACITY = 2048
#: a bin with this much room or less is nearly full and takes part in no further round
SLACK = 4
#: bins of one partition that meet in one task of the next round
FAN_IN = 8
#: open bins that one task of a round takes on average
TASK_BINS = 200_000


#: the byte alphabet of byte-level tokenizers: printable Latin-1 characters stand for themselves, the other bytes in
#: order for the characters from U+0100 on
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class WordEncoder:
    """Token ids of a text as little-endian bytes, from the ids of its words.

    Strings of the tokenizer's special tokens are found in the text as it stands and are these tokens. The tokenizer
    lower-cases what lies between, and none of its steps looks across white space, so the ids are those of the words in
    order. ASCII letters are lower-cased before a word is looked up, and a full stop or comma that ends a word
    of Latin letters, always a token of its own, is looked up apart. Words of lower-case Latin letters pass the
    tokenizer's first steps unchanged but for the byte alphabet, so its model takes them directly. The cache only
    saves time: it starts anew when it holds ``most`` words, and lives as long as the worker process.
    """

    LATIN = rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF]|\xC9[\x80-\x8F])"
    WORD = re.compile(rb"%b++(?=[.,](?:[\x20\x09-\x0D]|\Z))|[^\x20\x09-\x0D]+" % LATIN)

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # those as written are cut out of the text; what only becomes one by lower-casing is ordinary text
        self.tokenizer.encode_special_tokens = True
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if added else None
        # no word begins with a space
        self.fixed = {b" " + t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.most, self.known = most, dict(self.fixed)

    def words(self, text: bytes) -> list[bytes]:
        if self.special is None or not self.special.search(text):
            return self.WORD.findall(text.lower())
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [b" " + part] if i % 2 else self.WORD.findall(part.lower())
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        words = [self.words(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = dict(self.fixed)
            new = set().union(*words).difference(self.known)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for word in new:
            letters = word.decode()
            if letters.isalpha() and max(letters) < "\u0250" and letters.lower() == letters:
                if not letters.isascii():
                    letters = word.decode("latin-1").translate(BYTE_LETTERS)
                self.known[word] = np.array([t.id for t in tokenize(letters)], dtype="<u4").tobytes()
            else:
                rest.append(word)
        for i in range(0, len(rest), 20_000):
            part = rest[i:i + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(
                    [w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[word] = np.array(found.ids, dtype="<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _grouped(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` text bytes (or one row)."""
    sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], dtype=_offset_type(batch.column(1).type))[
        batch.column(1).offset: batch.column(1).offset + batch.num_rows + 1])
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _offset_type(kind: pa.DataType) -> str:
    return "<i8" if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else "<i4"


def _tokenise(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key = _encoder(path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in _grouped(whole):
                rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                for row, found in enumerate(encoder.ids(texts)):
                    found += b"\0\0\0\0"
                    for piece, start in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[start:start + 4 * capacity]
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start // 4)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, dtype="<i4"))
                n = len(rows)
                columns = [pa.array(np.arange(key, key + n, dtype=np.int64)), batch.column(0).take(pa.array(rows)),
                           pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                           pa.array(crcs, pa.int64())]
                names = ["key", "doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                key += n
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit by decreasing length: (bin of each item, offset of each item, fill of each bin).

    ``room`` is a bit set of the free spaces that some open bin has, so the tightest bin is its lowest bit at or above
    the length.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = room >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = by_room[free].pop()
            if not by_room[free]:
                room ^= 1 << free
        else:
            b = len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += length
        left = capacity - fills[b]
        if left:
            by_room[left].append(b)
            room |= 1 << left
    return where, offset, np.array(fills, dtype=np.int64)


def _pack_round(number: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            lengths.append(batch.column(1).to_numpy())
        if not keys:
            return
        key, length = np.concatenate(keys), np.concatenate(lengths)
        order = np.argsort(key)  # the result does not depend on the order in which rows arrive
        key, length = key[order], length[order]
        where, offset, fills = best_fit(length, capacity)
        base = number << 58 | TaskContext.get().partitionId() << 33
        head = np.zeros(len(key), dtype=bool)
        head[np.unique(where, return_index=True)[1]] = True
        fill = fills[where]
        for i in range(0, len(key), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[s]), pa.array(base + where[s]), pa.array(offset[s]), pa.array(fill[s]),
                 pa.array(head[s] & (capacity - fill[s] > slack))], names=["key", "bin", "offset", "fill", "open"])

    return run


def pack_items(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """(key long, length long) to (key, sequence_id, offset): keys are unique, lengths are 1 to ``capacity``.

    Every partition packs its own items best fit. Bins with more than ``slack`` room become the items of the next
    round, in which one task takes the open bins of FAN_IN partitions, and so on up the tree; a bin is moved as a
    whole, so offsets add up. A level has at least one task for TASK_BINS open bins, so that bins which cannot be
    merged (all just over half full) never meet in one task; the tree ends when its tasks no longer get fewer. Each
    round's placement is materialised, since bin numbers name the task that made them. No items give no rows.
    """
    schema = "key long, bin long, offset long, fill long, open boolean"
    first = materialise(items.select("key", "length").mapInArrow(_pack_round(0, capacity, slack), schema))
    level, moved, number, tasks = first, None, 0, first.rdd.getNumPartitions()
    while tasks > 1:
        opened = level.where("open").select(F.col("bin").alias("key"), F.col("fill").alias("length"))
        wanted = max(-(-tasks // FAN_IN), -(-opened.count() // TASK_BINS))
        if wanted >= tasks:
            break
        number, tasks = number + 1, wanted
        level = materialise(opened.coalesce(tasks).mapInArrow(_pack_round(number, capacity, slack), schema))
        step = level.select(F.col("key").alias("__from"), F.col("bin").alias("__to"), F.col("offset").alias("__by"))
        moved = step if moved is None else moved.join(
            step.withColumnsRenamed({"__from": "__at", "__to": "__next", "__by": "__more"}),
            F.col("__to") == F.col("__at"), "left").select(
                "__from", F.coalesce("__next", "__to").alias("__to"),
                (F.col("__by") + F.coalesce("__more", F.lit(0))).alias("__by"))
    if moved is None:
        return first.select("key", F.col("bin").alias("sequence_id"), "offset")
    return first.join(moved, F.col("bin") == F.col("__from"), "left").select(
        "key", F.coalesce("__to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("__by", F.lit(0))).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its token ids and id 0 at the end; null and empty texts are id 0 alone. Only a document longer than
    ``capacity`` is cut, into pieces of ``capacity``. Repeated rows are packed each, null ids pass through, an empty
    table gives no rows, other columns are not looked at. ``tokenizer`` is the path of a tokenizers file that every
    worker has. Tokenised text is not kept unless ``keep_ids``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"key long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(
        docs.select(F.col(doc_id), F.col(text).cast("binary"))
        .mapInArrow(_tokenise(tokenizer, capacity, keep_ids), schema + (", ids array<int>" if keep_ids else "")))
    return pieces.join(pack_items(pieces, capacity), "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of pieces packed with ``keep_ids``: at most ``capacity`` ids meet in a row."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(read(spark, sf, "documents"), public_tokenizer("word_bpe_49k.json"))
