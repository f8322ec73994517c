"""SentencePiece byte-pair encoding and decoding by suffix-array matching.

A batch of text is indexed by a suffix array, every piece of the vocabulary is searched in it by bisection, and the
ranges found are the edges (start, end, piece) of all possible segmentations. Sorted by position, the edges are
relaxed from left to right: the last piece of the encoding of each prefix is unique, and an edge takes part exactly if
the piece before it and its own piece stay apart when the two are merged alone.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read
from pricegrid.llm.packing import public_tokenizer

SPACE_MARK = "▁"
#: code points of one indexed batch; a longer chunk is indexed alone
BATCH = 400_000
#: chunks whose ids a worker remembers; it only saves time
MOST_CHUNKS = 500_000
#: pairs of pieces whose merging a worker remembers, likewise
MOST_PAIRS = 1_000_000


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of the code points, sorted by their first ``depth`` code points (by prefix doubling)."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    length = 1
    while length < depth:
        step = min(length, depth - length)  # the halves may overlap
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-step] = rank[step:] if step < len(rank) else 0
        _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        length += step
    return np.argsort(rank, kind="stable")


class PieceTable:
    """A vocabulary with byte fallback: pieces, their scores, and a matrix of their code points for the search."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        hidden = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in hidden}
        self.scores = [model.get_score(i) for i in range(size)]
        self.as_bytes = [p.replace(SPACE_MARK, " ").encode() for p in self.pieces]
        for value, i in self.byte_id.items():
            self.as_bytes[i] = bytes([value])
        for i in hidden - set(self.byte_id.values()):
            self.as_bytes[i] = b""
        found = sorted(self.ids)
        self.order = np.array([self.ids[p] for p in found])
        self.lengths = np.array([len(p) for p in found])
        self.width = int(self.lengths.max())
        self.codes = np.zeros((len(found), self.width), dtype=np.int64)
        for row, piece in enumerate(found):
            self.codes[row, : len(piece)] = [ord(c) for c in piece]
        if any("\n" in p for p in found) or any(SPACE_MARK in p.strip(SPACE_MARK) or p != p.rstrip(SPACE_MARK)
                                                 and p.strip(SPACE_MARK) for p in found):
            raise ValueError("pieces may have the space mark in front only, and no line feed")
        self.apart: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of a few symbols: best score first, leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stay_apart(self, pair: int) -> bool:
        """Whether two pieces (left << 20 | right) beside each other are not merged across their border."""
        found = self.apart.get(pair)
        if found is None:
            if len(self.apart) >= MOST_PAIRS:
                self.apart.clear()
            left, right = self.pieces[pair >> 20], self.pieces[pair & 0xFFFFF]
            found = self.apart[pair] = self.merge([*left, *right]) == [left, right]
        return found

    def is_sound(self, piece: int) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        found = self.sound.get(piece)
        if found is None:
            found = self.sound[piece] = self.merge([*self.pieces[piece]]) == [self.pieces[piece]]
        return found

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of every piece in the code points."""
        suffixes = suffix_array(text, self.width)
        padded = np.concatenate([text, np.full(self.width, -1, dtype=np.int64)])
        lower, upper = self._bisect(padded, suffixes, False), self._bisect(padded, suffixes, True)
        count = upper - lower
        which = np.repeat(np.arange(len(count)), count)
        places = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lower[which]
        return suffixes[places], self.lengths[which], self.order[which]

    def _bisect(self, padded: np.ndarray, suffixes: np.ndarray, after: bool) -> np.ndarray:
        """For every piece the number of suffixes below it, or (``after``) below or beginning with it."""
        low = np.zeros(len(self.codes), dtype=np.int64)
        high = np.full(len(self.codes), len(suffixes), dtype=np.int64)
        live = np.arange(len(self.codes))
        while len(live):
            middle = (low[live] + high[live]) // 2
            sign = np.zeros(len(live), dtype=np.int8)  # of suffix against piece
            start = suffixes[middle]
            for k in range(self.width):
                open_ = (sign == 0) & (self.lengths[live] > k)
                if not open_.any():
                    break
                sign[open_] = np.sign(padded[start[open_] + k] - self.codes[live[open_], k])
            below = (sign < 0) | (after & (sign == 0))
            low[live[below]] = middle[below] + 1
            high[live[~below]] = middle[~below]
            live = live[low[live] < high[live]]
        return low

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of every chunk as little-endian 32-bit numbers. Chunks hold no line feed, which separates them here."""
        joined = "\n".join(chunks)
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        ends = np.append(np.flatnonzero(text == 10), len(text))
        begins = np.concatenate([[0], ends[:-1] + 1])
        chunk_of = np.repeat(np.arange(len(chunks)), ends - begins + 1)[: len(text)]
        start, length, piece = self.edges(text)
        kinds, inverse = np.unique(piece, return_inverse=True)
        keep = np.array([self.is_sound(p) for p in kinds.tolist()], dtype=bool)[inverse]
        start, length, piece = start[keep], length[keep], piece[keep]
        # a character that no piece holds is an edge of its own (piece -1)
        known = np.zeros(len(text) + 1, dtype=bool)
        known[start[length == 1]] = True
        lone = np.flatnonzero(~known[:-1] & (text != 10))
        start = np.concatenate([start, lone])
        length = np.concatenate([length, np.ones(len(lone), np.int64)])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        place = start + length - begins[chunk_of[start]]
        order = np.argsort(place, kind="stable")
        start, length, piece, place = start[order], length[order], piece[order], place[order]
        # last[i], first[i]: the last piece of the encoding of what ends before i, and where that piece starts
        last = np.full(len(text) + 1, -2)
        first = np.zeros(len(text) + 1, dtype=np.int64)
        last[begins] = -1
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            before, here = last[start[a:b]], piece[a:b]
            good = before != -2
            ask = np.flatnonzero(good & (before >= 0) & (here >= 0))
            if len(ask):
                pairs, inverse = np.unique(before[ask] << 20 | here[ask], return_inverse=True)
                good[ask] = np.array([self.stay_apart(p) for p in pairs.tolist()], dtype=bool)[inverse]
            # the separator after a chunk keeps its end from the next chunk's start
            end = start[a:b][good] + length[a:b][good]
            last[end], first[end] = here[good], start[a:b][good]
        out = []
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            ids: list[int] = []
            at = end
            while at > begin:
                found, at_first = int(last[at]), int(first[at])
                if found >= 0:
                    ids.append(found)
                else:
                    ids += [self.byte_id[x] for x in reversed(chr(text[at_first]).encode("utf-8", "replace"))]
                at = at_first
            out.append(np.array(ids[::-1], dtype="<u4").tobytes())
        return out


class PieceCoder:
    """Encoding and decoding of texts. No piece crosses from a character to a space mark or touches a line feed, so
    the chunks between them are encoded apart, each distinct chunk of a batch once."""

    CHUNK = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")

    def __init__(self, path: str, most: int = MOST_CHUNKS) -> None:
        self.table, self.most = PieceTable(path), most
        self.known: dict[str, bytes] = {}
        self.line_feed = np.array([self.table.byte_id[10]], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; an empty text has none."""
        split = [self.CHUNK.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, set().union(*split)
        self.known["\n"] = self.line_feed
        new = sorted(new - {"\n"})
        at = 0
        while at < len(new):
            upto, size = at, 0
            while upto < len(new) and (upto == at or size + len(new[upto]) < BATCH):
                size += len(new[upto]) + 1
                upto += 1
            self.known.update(zip(new[at:upto], self.table.encode_chunks(new[at:upto]), strict=True))
            at = upto
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; the space that encoding puts in front is taken away."""
        raw = b"".join(map(self.table.as_bytes.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def _coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _grouped(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int): ids equal to those of the model's own library.

    Null and empty texts have no ids. Rows are encoded alone, so null ids, ties and repeated rows pass through; an
    empty table gives no rows, other columns are not looked at. A batch's distinct chunks are indexed together; the
    index of a very long chunk grows with its length. ``model`` is the path of a model file that every worker has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            at = 0
            for texts in _grouped([t or "" for t in batch.column(1).to_pylist()]):
                found = [np.frombuffer(x, dtype="<i4") for x in coder.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                at += len(texts)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: the inverse of ``encode`` but for the space mark (U+2581), which comes back
    as a space. Null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def coded_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_crc32``: encodes and decodes every text in one pass, without keeping the
    ids. The checksums are of the little-endian 32-bit ids and of the decoded text in UTF-8."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            at = 0
            for texts in _grouped([t or "" for t in batch.column(1).to_pylist()]):
                found = coder.encode(texts)
                back = [coder.decode(np.frombuffer(x, dtype="<i4")) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in found], pa.int64()),
                     pa.array([zlib.crc32(x) for x in found], pa.int64()),
                     pa.array([zlib.crc32(x.encode()) for x in back], pa.int64())],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32"])
                at += len(texts)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_crc32 long")


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return coded_digests(read(spark, sf, "documents"), public_tokenizer("piece_bpe_32k.model"))
