import random
import zlib

import numpy as np

from tokenizers import Tokenizer

from pricegrid.llm import packing, piece_coding, sharding
from tests.llm.helpers import awkward, none

BPE = packing.public_tokenizer("word_bpe_49k.json")
PIECES = packing.public_tokenizer("piece_bpe_32k.model")
ODD = ["", "a", "  a  b ", "a\nb\tc", "▁▁a ▁", "🎉x y", "aaaaaaaaaaaa" * 9, " " * 40 + "x" + " " * 17, "é́ ﬁ ½ 日本語", "\x00\n\n x",
       "it's don't 's.", "end. word, a., É. ÀÉ, x2. ... ,,. x", "İstanbul ß. ŉ", "<|endoftext|> ok", "a b c", "x" * 3000]


#: the tokenizer as its file says, with nothing changed
FRESH = Tokenizer.from_file(BPE)


def test_special_strings_are_special_tokens_as_written_only():
    encoder = packing.WordEncoder(BPE, most=3)
    for text in ("hi <|endoftext|> there", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>.", "<|ENDOFTEXT|> x", "<|endoftext| >"):
        got = np.frombuffer(b"".join(encoder.ids([text.encode()])), "<u4").tolist()
        assert got == FRESH.encode(text, add_special_tokens=False).ids, text


def _texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice(" abcdetno▁.,\n'inéüÉ日2") for _ in range(rnd.randint(0, 60))) for _ in range(800)]


def test_word_ids_equal_the_tokenizer():
    encoder = packing.WordEncoder(BPE, most=500)  # the cache starts anew many times
    texts = _texts()
    found = [b"".join(encoder.ids([t.encode()])) for t in texts]
    for text, ids in zip(texts, found, strict=True):
        want = FRESH.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_best_fit_fills_gaps():
    where, offset, fills = packing.best_fit(np.array([5, 6, 3, 4, 2]), 10)
    assert sorted(fills.tolist()) == [10, 10] and (fills[where] >= offset + np.array([5, 6, 3, 4, 2])).all()


def _check_packed(rows, docs, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in docs.items():
        ids = FRESH.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
    return len(bins)


def test_packing_of_a_table(spark):
    docs = awkward(spark)
    packed = packing.pack(docs, BPE, keep_ids=True)
    rows = packed.collect()
    assert len([r for r in rows if r.doc_id == 2]) == 2  # a repeated row is packed twice
    _check_packed([r for r in rows], {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 2)}, 2048)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids for r in rows)
    assert packing.pack(none(spark), BPE).count() == 0


def test_tree_of_rounds_packs_tightly_and_bounds_tasks(spark, monkeypatch):
    items = spark.range(0, 6000, 1, 40).selectExpr("id AS key", "1 + pmod(xxhash64(id), 300) AS length")
    total = items.selectExpr("sum(length)").first()[0]

    def bins():
        rows = items.join(packing.pack_items(items, 512), "key").collect()
        assert len(rows) == 6000
        own = {}
        for r in rows:
            own.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for v in own.values():
            ends = [a + n for a, n in sorted(v)]
            assert [a for a, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 512
        return len(own)

    assert bins() <= 1.01 * total / 512 + 1
    monkeypatch.setattr(packing, "TASK_BINS", 5)  # never one task for all
    assert bins() <= 1.1 * total / 512 + 1


def test_piece_ids_equal_the_library_and_decode():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    coder = piece_coding.PieceCoder(PIECES, most=300)
    texts = _texts()
    for at in range(0, len(texts), 40):
        part = texts[at:at + 40]
        for text, ids in zip(part, coder.encode(part), strict=True):
            found = np.frombuffer(ids, "<i4")
            assert found.tolist() == model.encode(text), text
            assert coder.decode(found) == text.replace("▁", " ")


def test_suffix_array_sorts_suffixes():
    rnd = random.Random(0)
    text = [rnd.randint(1, 3) for _ in range(200)]
    found = piece_coding.suffix_array(np.array(text), 200).tolist()
    assert found == sorted(range(200), key=lambda i: text[i:])


def test_piece_tables(spark):
    docs = awkward(spark)
    ids = piece_coding.encode(docs, PIECES)
    back = {r.doc_id: r.text for r in piece_coding.decode(ids, PIECES).collect() if r.doc_id is not None}
    assert back == {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    digests = piece_coding.coded_digests(docs, PIECES)
    assert digests.count() == docs.count()
    for r in digests.join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded_crc32 == zlib.crc32((r.text or "").encode())
    assert piece_coding.encode(none(spark), PIECES).count() == 0


def _brute_minimax(sizes, shards):
    best = [[0] + [10**9] * len(sizes)]
    for _ in range(shards):
        row = [0]
        for j in range(1, len(sizes) + 1):
            row.append(min(max(best[-1][i], sum(sizes[i:j])) for i in range(j + 1)))
        best.append(row)
    return best[-1][-1]


def test_cuts_are_minimax():
    rnd = random.Random(6)
    for _ in range(200):
        sizes = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 9))]
        shards = rnd.randint(1, 4)
        cuts = [0, *sharding.minimax_cuts(sizes, shards), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) == shards + 1
        assert max(sum(sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == _brute_minimax(sizes, shards)


def test_other_shards_are_even_beside_an_oversized_group():
    sizes = [1] * 300 + [500] + [1] * 700
    cuts = [0, *sharding.minimax_cuts(sizes, 24), len(sizes)]
    sums = sorted(sum(sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert len(sums) == 24 and sums[-1] == 500 and 40 <= sums[0] and sums[-2] <= 45
    assert sharding.minimax_cuts([3, 3, 3, 3], 3) in ([1, 2], [1, 3], [2, 3])


def test_shards_of_a_table(spark):
    docs = awkward(spark, [(100 + i, f"text {i} " * 20) for i in range(500)] + [(1000 + i, "copy") for i in range(100)])
    rows = sharding.shard(docs, 7).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    home, slots, sizes = {}, {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        if r.doc_id is not None:
            assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
            assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(7)) and sharding.shard(none(spark)).count() == 0
    assert max(sizes.values()) <= max(len(t.encode()) for t in texts.values()) + 8 + sum(sizes.values()) / 7
