import hashlib
import random
import re

import pytest

from pricegrid.llm import exact_dedup, line_dedup, ngram_join
from pricegrid.llm.components import connected_components
from tests.llm.helpers import awkward, components, near_documents, none


def test_exact_copies_and_awkward_rows(spark):
    docs = awkward(spark)
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(found) == docs.count()
    groups = {}
    for row in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row.text or ""), []).append(row.doc_id)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for row in found:
        ids = by_hash[row.text_sha256]
        known = [i for i in ids if i is not None]
        assert row.group_size == len(ids)
        assert row.keep_id == (min(known) if known else None)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 6, 7, 8, 9, 10]


def test_a_group_of_copies_fills_several_partitions(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    found = exact_dedup.exact_dedup(docs.repartition(7))
    row = found.where("text_sha256 = sha2('the same text', 256)").selectExpr(
        "count(*) AS n", "min(group_size) AS low", "max(keep_id) AS keep", "count_if(kept) AS kept").first()
    assert tuple(row) == (1334, 1334, 0, 1)
    assert found.where("kept").count() == 4000 - 1333


def test_dropping_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = awkward(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"\s+", " ", r.text or "") for r in docs.collect()})
    assert exact_dedup.drop_copies(none(spark)).count() == 0


@pytest.mark.parametrize("width,up,down", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_classes_against_all_pairs(spark, width, up, down):
    docs = near_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id)
             for r in ngram_join.jaccard_classes(frame, width, ngram_join.Threshold(up, down)).collect()}
    assert found == components(docs, width, up, down)


def test_jaccard_without_leaders_or_bounds_gives_the_same(spark, monkeypatch):
    """The index alone finds all links, also when every list is cut by size and comes in small blocks."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "MOST_IDS", 0)
    docs = near_documents(40, 11)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id)
             for r in ngram_join.jaccard_classes(frame, 4, ngram_join.Threshold(70, 100)).collect()}
    assert found == components(docs, 4, 70, 100)


def test_jaccard_awkward_rows(spark):
    docs = awkward(spark)
    found = ngram_join.jaccard_classes(docs).collect()
    assert len(found) == docs.count()
    classes = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert classes[2] == classes[3] == 1 and classes[8] == 7
    assert all(classes[i] == i for i in (4, 5, 6, 10))
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["1", "None"]
    assert ngram_join.jaccard_classes(none(spark)).count() == 0
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns and {4, 5, 6} <= {r.doc_id for r in left.collect()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def _line_truth(docs):
    lines = sorted(((i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower())))
                    for i, t in docs for k, line in enumerate((t or "").split("\n"))), key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    return {x[:2]: not any(5 * len(x[2] & y[2]) >= 4 * len(x[2] | y[2]) for y in lines[:n])
            for n, x in enumerate(lines)}


def test_line_dedup_against_all_pairs(spark):
    docs = [(i, "\n".join(" ".join(t.split()[k:k + 11]) for k in range(0, 60, 11))) for i, t in near_documents(40, 3)]
    docs += [(1000, None), (1001, ""), (1002, "\n \nAlpha beta\nalpha BETA\nbeta alpha gamma delta epsilon"),
             (1003, "alpha beta gamma delta epsilon zeta")]
    found = line_dedup.line_matches(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): r.kept for r in found} == _line_truth(docs)


def test_line_dedup_of_a_large_group_of_near_copies(spark):
    """A family of 300 lines with up to four changed words of 24, and lines that share words with it only."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(24)]
    lines = []
    for i in range(300):
        line = list(words)
        for at in rnd.sample(range(24), i % 5):
            line[at] = f"x{rnd.randrange(40)}"
        lines.append(" ".join(line))
    lines += [" ".join(rnd.sample(words, 12) + [f"z{i}y{k}" for k in range(10)]) for i in range(20)]
    docs = [(i, "\n".join(lines[4 * i:4 * i + 4])) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_matches(frame).collect()}
    assert found == _line_truth(docs)
    _, classes, _ = line_dedup._judge(frame, "doc_id", "text")
    led = line_dedup._verified(frame, "doc_id", "text", line_dedup._leader_pairs(classes))
    nobody = led.where("false")
    every, left = (line_dedup._pairs(classes, gone).count() for gone in (nobody, led))
    assert 0 < led.count() and left < every / 3


def test_line_dedup_of_long_lines_that_share_words_only(spark):
    """64 parity bits cannot tell sets of 150 words apart; candidates must not grow with the pairs of such lines."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(1000)]
    lines = [rnd.sample(words, 150) for _ in range(60)]
    lines += [line[:k] + ["new"] * (k < 150) for line in lines[:5] for k in (78, 140, 149)]
    docs = [(i, " ".join(line)) for i, line in enumerate(lines)]
    docs += [(100, "w1\tw2\x0bw3  w4\rw5\x0c"), (101, "w1 w2 w3 W4 w5"), (102, "\t\x0c \r")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_matches(frame).collect()}
    assert found == _line_truth(docs)
    _, classes, gone = line_dedup._judge(frame, "doc_id", "text")
    assert line_dedup._pairs(classes, gone.where("false")).count() < 40


def test_line_dedup_awkward_rows(spark):
    docs = awkward(spark)
    found = line_dedup.line_matches(docs)
    assert {r.doc_id for r in found.where("kept AND line_no = 0").collect()} == {None, 3, 7, 10}
    assert line_dedup.line_matches(none(spark)).count() == 0
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert left.where("doc_id = 4 AND text IS NULL").count() == 1


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.line_matches(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
