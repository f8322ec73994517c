import math
import random
import re
from collections import Counter

import numpy as np

from pricegrid.llm import ranked_search
from tests.llm.helpers import awkward, none

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=10):
    """Every document scored for every item, straight from the definition."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:most], 1)]
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def corpus(seed, n, words):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked_search.ranked(d, b, **options).collect()), key=key)


def test_equals_scoring_every_document(spark):
    rnd = random.Random(2)
    words = [f"w{int(rnd.expovariate(0.05))}" for _ in range(300)] + ["Éa", "éa", "ÉA", "x1_y2"]
    docs = corpus(1, 400, words) + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3"), (None, None), (500, ""), (501, "  ,;")]
    items = corpus(3, 25, words) + [(3, "w1 again w2"), (None, "w2 W2 w3"), (90, None), (91, ""), (92, "unknown")]
    expected = sorted(brute(docs, items), key=key)
    assert run(spark, docs, items) == expected
    # many small indexes in a partition, and several passes, end in the same rows
    assert run(spark, docs, items, block_postings=37, pass_pairs=40) == expected
    assert run(spark, docs, items, block_postings=1, most=3) == sorted(brute(docs, items, 3), key=key)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)]
    assert [r[2] for r in run(spark, docs, [(1, "words")], block_postings=7)] == list(range(1, 11))


def test_awkward_rows_long_texts_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame([(1, "the quick w3x3 dog", 5), (2, "One only", 6)], "item_id long, text string, score long")
    got = sorted((tuple(r) for r in ranked_search.ranked(docs, items).collect()), key=key)
    assert got == sorted(brute(rows, [(1, "the quick w3x3 dog"), (2, "One only")]), key=key)
    assert ranked_search.ranked(none(spark), items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 11)
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("aB9 .é_~") for _ in range(rnd.randint(0, 80)))
        cut = [t.decode() for some in ranked_search.terms_of(text.encode()) for t in some]
        assert cut == terms(text)


def test_range_maximum_tables_equal_plain_maxima():
    rng = np.random.default_rng(1)
    n_docs, n_terms = 60, 9
    pairs = np.unique(rng.integers(0, n_docs * n_terms, 220))
    doc, term = pairs // n_terms, pairs % n_terms
    impact = rng.integers(1, 50, len(pairs))
    index = ranked_search.Index(doc, term, impact, n_docs, n_terms)
    for t in range(n_terms):
        a, b = index.starts[t], index.starts[t + 1]
        for low in range(a, b + 1):
            for high in range(low, b + 1):
                most, at = index.best(np.array([[low]]), np.array([[high]]))
                assert most[0, 0] == index.impact[low:high].max(initial=0)
                if high > low:
                    assert index.impact[low:high][index.docs[low:high] == at[0, 0]] == most[0, 0]


def test_intervals_that_cannot_matter_are_let_go():
    rng = np.random.default_rng(2)
    n_docs = 4000
    doc = np.repeat(np.arange(n_docs), 3)
    term = rng.integers(0, 40, len(doc))
    pairs = np.unique(doc * 40 + term)
    index = ranked_search.Index(pairs // 40, pairs % 40, rng.integers(1, 1000, len(pairs)), n_docs, 40)
    ranking = ranked_search.Ranking(10)
    scored = ranked_search.search(index, np.array([3, 8]), ranking, 0)
    assert len(ranking.rows) == 10 and scored < 0.5 * len(np.unique(pairs[(pairs % 40 == 3) | (pairs % 40 == 8)] // 40))
