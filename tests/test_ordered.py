"""Distributed order statistics against NumPy, with ties, a hot key and tight brackets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrid.functions import ordered, tails


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    data = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 6000), 1)]
    data += [("small", float(v)) for v in rng.normal(size=7)] + [("one", 4.0)] + [("flat", 2.0)] * 50
    return spark.createDataFrame(data, "k string, v double"), data


@pytest.mark.parametrize("accuracy", [40, 500, 200_000])
def test_percentiles_are_exact_at_any_sketch_accuracy(skewed, accuracy):
    df, data = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in ordered.exact_percentiles(df, ["k"], "v", probs, accuracy).collect()}
    for key in ("hot", "small", "one", "flat"):
        values = np.array([v for k, v in data if k == key])
        assert got[key].n == len(values)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_match_a_full_sort(skewed, descending):
    df, data = skewed
    out = ordered.ordered_cumulative(df, ["k"], "v", {"n": F.lit(1)}, descending, buckets=16)
    got = {(r.k, r.v): r.cum_n for r in out.collect()}
    values = np.array([v for k, v in data if k == "hot"])
    for v in np.unique(values):
        assert got[("hot", v)] == (np.sum(values >= v) if descending else np.sum(values <= v))


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("a", None)], "k string, v double")
    got = sorted((r.v or -1, r.rank) for r in ordered.average_rank(df, ["k"], "v", "rank").collect())
    assert got == [(-1, None), (1, 1), (2, 2.5), (2, 2.5), (5, 4)]


def test_tails_against_tables():
    assert tails.student_t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_upper_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_upper_tail(2.710889837, 5, 20) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_even_upper_tail([9.487729037], [2])[0] == pytest.approx(0.05, abs=1e-9)
    assert tails.mackinnon_p(-2.86) == pytest.approx(0.05, abs=2e-3)


def test_no_keys_means_one_group(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert ordered.exact_percentiles(df, [], "v", {"p25": 0.25}).first().p25 == 2.5
    assert ordered.ordered_cumulative(df, [], "v", {"n": F.lit(1)}).agg(F.max("cum_n")).first()[0] == 11
    assert ordered.average_rank(df, [], "v", "r").agg(F.max("r")).first()[0] == 11
