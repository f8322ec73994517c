"""Small published results, copied as literals: input and expected output of the same operator."""

import pytest

from pricegrid.operators import aggregates as A
from pricegrid.operators import evaluation as E
from pricegrid.operators import inference as I


def test_event_bins_of_the_ban_week(spark):
    # fixed values: dynamic effects around week 0 of three episodes
    effects = [
        ("2019", "treated", 0.1, 68.66), ("2019", "placebo", 0.1, 13.97), ("2019", "placebo", 0.1, 3.0),
        ("2020", "treated", 0.0, -31.69), ("2020", "placebo", 0.0, 32.14), ("2020", "placebo", 0.0, 68.91),
        ("2023", "treated", -0.6, 83.91), ("2023", "treated", 0.4, 62.27), ("2023", "placebo", -0.6, 5.23),
        ("2023", "placebo", 0.4, -2.58), ("2023", "placebo", -0.6, -13.23), ("2023", "placebo", 0.4, -8.33)]
    df = spark.createDataFrame(effects, "episode string, role string, weeks_since double, effect double")
    got = {r.role: r for r in A.event_bins(df).where("week_bin = 0").collect()}
    row = lambda r: (r.n_episodes, round(r.mean_pct, 2), round(r.std_pct, 2), round(r.min_pct, 2), round(r.max_pct, 2))
    assert row(got["treated"]) == (3, 33.08, 56.18, -31.69, 68.66)
    assert got["placebo"].mean_pct == pytest.approx(17.85, abs=0.006) and got["placebo"].max_pct == pytest.approx(50.52, abs=0.006)


def test_crossover_of_one_crop(spark):
    # fixed values: MASE of the full model by horizon
    mase = [("M6", "onion", 1, 1.809797), ("M6", "onion", 4, 1.18452), ("M6", "onion", 13, 0.868939), ("M6", "onion", 26, 0.820371)]
    df = spark.createDataFrame(mase, "variant string, crop string, horizon_weeks int, MASE double")
    assert E.crossover_horizon(df, "M6").first().crossover_horizon_weeks == 13


def test_confidence_set_membership_of_one_cell(spark):
    # fixed values: elimination order and p-values of one crop and horizon
    path = [("M4", 0.01), ("M1", 0.009), ("M5", 0.007), ("M0", 0.007), ("M6", 0.004), ("M3", 0.006), ("M2", 0.003), ("B1_Naive", 1.0)]
    df = spark.createDataFrame([("onion", 1, i + 1, m, p) for i, (m, p) in enumerate(path)],
                               "crop string, horizon_weeks int, elimination_round int, eliminated_model string, p_value double")
    for alpha in (0.10, 0.25):
        inside = {r.model for r in I.mcs_membership(df, alpha).where("in_mcs").collect()}
        assert inside == {"B1_Naive"}


def test_fdr_of_one_crop_network(spark):
    # fixed values: rounded p-values of 40 edges (zeros counted) and some of their adjusted values
    nonzero = {0.0014: 0.002074074074074074, 0.0481: 0.06012499999999999, 0.0211: 0.027225806451612905, 0.8616: 0.8616,
               0.0044: 0.005866666666666667, 0.5822: 0.612842105263158, 0.0008: 0.00128, 0.3493: 0.3992, 0.6586: 0.6754871794871795,
               0.0006: 0.001, 0.0016: 0.002285714285714286, 0.0021: 0.002896551724137931, 0.4955: 0.5356756756756756,
               0.0771: 0.09345454545454546, 0.1337: 0.15729411764705883, 0.0009: 0.0013846153846153845, 0.427: 0.47444444444444445,
               0.0001: 0.00017391304347826088}
    p = [0.0] * (40 - len(nonzero)) + list(nonzero)
    df = spark.createDataFrame([("potato", v) for v in p], "crop string, p_value double")
    for r in I.bh_fdr(df, ["crop"]).collect():
        assert r.p_value_fdr == pytest.approx(nonzero.get(r.p_value, 0.0), abs=1e-15)


def test_in_space_placebo_share(spark):
    # fixed values: 28 of 214 placebo effects at least as large as the real one
    rows = [(0.9 if i < 28 else 0.1 * (-1) ** i,) for i in range(214)]
    out = A.placebo_rank_p(spark.createDataFrame(rows, "effect double"), spark.createDataFrame([(-0.5,)], "effect double")).first()
    assert (out.n_placebo, out.n_as_extreme, round(out.p_value, 3)) == (214, 28, 0.131)
