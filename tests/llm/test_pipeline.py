import re

import corpus_pipeline
from pricegrid.llm import ngram_join, pii, quality
from tests.llm.helpers import BASE, components


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")


def test_pipeline_against_plain_steps(spark, tmp_path):
    from pricegrid.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    clean = [(i, " ".join(f"{w}{'' if k % 3 else chr(97 + (i * 7 + k) % 26)}" for k, w in enumerate(BASE.split())) + f" mail u{i}@h.example.com")
             for i in range(8)]
    near = [(20, clean[3][1] + " more"), (21, clean[3][1] + " words")]
    rows = [*clean, (30, clean[0][1]), (30, clean[0][1]), (31, clean[1][1].replace(" ", "\n", 3)), *near,
            (40, "short"), (41, None), (42, "### $$$ " * 30), (None, clean[5][1]), (50, "a b c d e " * 40)]
    _documents(spark, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in rows])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(docs.collect())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    good, unique, apart, masked, packed = seen
    assert {r.doc_id for r in good} == {None, *range(8), 20, 21, 30, 31} and len(good) == 14
    texts = {re.sub(r"\s+", " ", r.text) for r in good}
    assert len(unique) == len(texts) and {r.doc_id for r in unique} == {*range(8), 20, 21}
    truth = components([(r.doc_id, r.text) for r in unique], 5, 80, 100)
    assert {r.doc_id for r in apart} == {c for _, c in truth.values()} and 20 not in {r.doc_id for r in apart}
    assert all("@" not in r.text and "<EMAIL>" in r.text and r.n_chars == len(r.text) for r in masked)
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_take_an_empty_table_and_clashing_columns(spark, tmp_path):
    row = spark.createDataFrame(
        [(1, BASE, "a", "b", "c", 1)], "doc_id long, text string, kept string, n_words string, row string, n_chars long")
    for docs in (row, row.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            assert stage(spark, docs, str(tmp_path)).count() == docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_stage_parameters():
    assert ngram_join.drop_near_copies.__defaults__[:2] == (5, ngram_join.Threshold(80, 100))
    assert quality.BASE == ("enough_words", "repeated_windows") and pii.KINDS == ("email", "ip", "card", "phone")
