"""Columns of a table may be called like the helpers of an operator; very long rows stay linear."""

import time

from pyspark.sql import functions as F

from pricegrid.llm import chat, line_dedup, ngram_join, pii, quality
from tests.llm.helpers import BASE, awkward

NAMES = ["__text", "__ws", "__lines", "__h", "__s", "__pos", "__row", "__body", "__gone", "__of", "gone", "of", "row", "id", "kept", "n_words"]


def clashing(spark):
    docs = awkward(spark, [(20, BASE + " and more words of it")])
    return docs.withColumns({n: F.concat(F.lit(n), F.col("n").cast("string")) for n in NAMES})


def test_rules_pass_every_other_column_through(spark):
    docs = clashing(spark)
    out = quality.apply_rules(docs)
    results = {"n_words", "kept"}
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert all(r[n] == (f"{n}{r['n']}" if r["n"] is not None else None) for n in NAMES if n not in results)
        assert isinstance(r["kept"], bool) and isinstance(r["n_words"], int)
    assert set(quality.keep_good(docs).columns) == set(docs.columns)


def test_filters_keep_clashing_columns(spark):
    docs = clashing(spark)
    plain = awkward(spark, [(20, BASE + " and more words of it")])
    for drop in (ngram_join.drop_near_copies, line_dedup.drop_repeated_lines):
        out = drop(docs)
        assert out.columns == docs.columns
        key = lambda r: (str(r["doc_id"]), str(r["text"]))
        assert sorted(map(key, out.collect())) == sorted(map(key, drop(plain).collect()))
        assert drop(docs.limit(0)).count() == 0


def test_many_addresses_in_a_document_are_labelled_in_no_time():
    text = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(100_000))
    spans = pii.base_spans(text)
    tokens = pii.tokens_of([(0, "no data"), (1, text)])
    began = time.time()
    labels = pii.labels_of(tokens, {0: [], 1: spans})
    assert len(spans) == 100_000 and (labels[tokens.doc == 1] == 1).all() and time.time() - began < 5


def test_labels_equal_a_look_at_every_span():
    text = "a@b.co 10.2.3.4 +1 (555) 123-45-67 4111 1111 1111 1111 x " * 20
    tokens = pii.tokens_of([(0, text), (2, text[:40])])
    spans = {0: pii.base_spans(text), 2: pii.base_spans(text[:40])}
    # spans of different kinds may overlap
    spans[0] = sorted(spans[0] + [(3, int(a), int(a) + 9) for a in range(0, 400, 50)], key=lambda s: (s[0], s[1])) if not any(
        k == 3 for k, _, _ in spans[0]) else spans[0]
    want = []
    for d, a, b in zip(tokens.doc.tolist(), tokens.start.tolist(), tokens.end.tolist()):
        want.append(min((k + 1 for k, x, y in spans.get(d, ()) if x < b and a < y), default=0))
    assert pii.labels_of(tokens, spans).tolist() == want


def test_loss_spans_of_long_conversations(spark):
    n = 3000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    row = chat.format_chats(turns).first()
    assert len(row["loss_spans"]) == n // 2
    for k, s in enumerate(row["loss_spans"]):
        assert row["formatted"][s["start"]:s["start"] + s["n_chars"]] == f"text {2 * k + 1}"
