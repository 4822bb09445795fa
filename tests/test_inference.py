"""Exact null distributions, step-down correction, gates, bootstrap and draws."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.functions import stats
from cyclograin.operators import inference, sampling


def test_rank_sum_of_separated_samples():
    assert stats.rank_sum_p(5, 10, 50.0, 0.0) == pytest.approx(2 / 3003)
    assert stats.rank_sum_counts(5, 10).sum() == 3003


@pytest.mark.parametrize(("m", "n"), [(2, 3), (3, 4), (4, 4)])
def test_rank_sum_counts_against_enumeration(m, n):
    want = np.zeros(m * n + 1)
    for pick in itertools.combinations(range(m + n), m):
        want[sum(pick) - m * (m - 1) // 2] += 1
    np.testing.assert_array_equal(stats.rank_sum_counts(m, n), want)


def test_signed_rank_against_enumeration():
    n, w = 6, 3.0
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    want = min(1.0, 2 * np.mean([s <= w for s in sums]))
    assert stats.signed_rank_p(n, w, 0.0, True) == pytest.approx(want)
    assert stats.signed_rank_p(n, n * (n + 1) / 2 - w, 0.0, True) == pytest.approx(want)


def test_binomial_tail_at_the_boundary():
    assert stats.binomial_tail(1, 1, 0.1) == pytest.approx(0.1)
    assert stats.binomial_tail(0, 5, 0.1) == 1.0
    assert stats.binomial_tail(2, 3, 0.5) == pytest.approx(0.5)


def test_correlation_p_matches_known_value():
    # t = 2.5298 with 8 degrees of freedom for r = 0.6666..., n = 10
    assert stats.correlation_p(2 / 3, 10) == pytest.approx(0.0353, abs=2e-4)
    assert stats.regularised_beta(1.0, 1.0, 0.3) == pytest.approx(0.3)
    assert stats.regularised_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)


def test_paired_test_direction(spark):
    rows = [("m", float(0.9 + 0.001 * i), float(0.8 + 0.001 * i - 0.0001 * i)) for i in range(6)]
    d = spark.createDataFrame(rows, "g string, a double, b double")
    r = inference.paired_wilcoxon(d, ["g"], "a", "b").first()
    assert r["win_rate"] == 1.0 and r["p"] == pytest.approx(2 / 64) and r["mean_diff"] > 0.099
    same = inference.paired_wilcoxon(d.withColumn("b", F.col("a")), ["g"], "a", "b").first()
    assert same["p"] == 1.0


def test_holm_is_monotone_and_capped(spark):
    d = spark.createDataFrame([("f", c, p) for c, p in zip("abcd", [0.01, 0.04, 0.03, 0.6])], "f string, n string, p double")
    got = {r["n"]: r["p_holm"] for r in inference.holm(d, ["f"], "n", "p").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.6})


def calibration(spark, harm):
    rng = np.random.default_rng(1)
    rows = [("g", float(rng.uniform()), bool(harm(i))) for i in range(200)]
    return spark.createDataFrame(rows, "g string, v double, h boolean")


def test_gate_is_closed_when_everything_harms(spark):
    r = inference.gate_calibrate(calibration(spark, lambda i: True), ["g"], "v", "h").first()
    assert r["lam_star"] == float("-inf")


def test_gate_is_open_when_nothing_harms(spark):
    d = calibration(spark, lambda i: False)
    assert inference.gate_calibrate(d, ["g"], "v", "h").first()["lam_star"] == d.agg(F.max("v")).first()[0]


def test_gate_stops_at_the_first_failure(spark):
    d = calibration(spark, lambda i: False).withColumn("h", (F.col("v") > 0.3) & (F.col("v") < 0.6))
    t = inference.gate_trace(d, ["g"], "v", "h").toPandas().sort_values("lam")
    first_bad = np.flatnonzero(~t["accept"])[0]
    assert t["reached"].tolist() == [i < first_bad for i in range(len(t))]


def test_selection_tie_takes_the_default(spark):
    rows = [("u", "a", 0.008, 0.0005), ("u", "b", 0.0081, 0.0005), ("w", "a", 0.008, 0.0001), ("w", "b", 0.02, 0.0001)]
    d = spark.createDataFrame(rows, "u string, c string, est double, se double")
    got = {r["u"]: r["selected"] for r in inference.select_config(d, ["u"], "c", "est", "se", "dflt").collect()}
    assert got == {"u": "dflt", "w": "a"}


@pytest.mark.parametrize("n", [2, 17, 23])
def test_derangements_have_no_fixed_point_and_differ(spark, n):
    d = spark.createDataFrame([("u", i) for i in range(n)], "u string, e long")
    got = sampling.derangements(d, ["u"], "e", 20).toPandas()
    assert (got["e"] != got["ref"]).all()
    maps = got.sort_values(["m", "e"]).groupby("m")["ref"].apply(tuple)
    assert all(sorted(m) == list(range(n)) for m in maps)
    if n > 2:
        assert maps.nunique() == 20


def test_single_entity_has_no_derangement(spark):
    d = spark.createDataFrame([("u", 1)], "u string, e long")
    assert sampling.derangement(d, ["u"], "e", 1).count() == 0


def test_label_noise_is_exact_and_always_another_class(spark):
    d = spark.range(200).withColumn("y", (F.col("id") % 4).cast("int"))
    got = sampling.label_noise(d, ["id"], "y", 4, 0.2, 7).toPandas()
    assert (got["y"] != got["y_noisy"]).sum() == 40
    assert got["y_noisy"].between(0, 3).all()


def test_quota_sample_is_even_and_tops_up(spark):
    d = spark.range(1000).withColumns({"u": F.lit("u"), "g": F.when(F.col("id") < 5, 0).when(F.col("id") < 400, 1).otherwise(2)})
    got = sampling.quota_sample(d, ["u"], ["g"], ["id"], 90).groupBy("g").count().toPandas().set_index("g")["count"]
    assert got[0] == 5 and got.sum() == 90 and got[1] >= 30 and got[2] >= 30


def test_majority_tie_abstains(spark):
    d = spark.createDataFrame([("a", "raw"), ("a", "history"), ("b", "raw"), ("b", "raw"), ("b", "x")], "u string, d string")
    got = {r["u"]: r["final"] for r in inference.majority_vote(d, ["u"], "d").collect()}
    assert got == {"a": "abstain", "b": "raw"}


def test_bootstrap_interval_covers_the_mean(spark):
    d = spark.range(40).select(F.lit("u").alias("u"), F.col("id").alias("e"), (F.col("id") / 40.0 - 2).alias("v"))
    r = inference.bootstrap_decision(d, ["u"], ["e"], "v", 300).first()
    assert r["ci_lo"] < r["mean_diff"] < r["ci_hi"] < 0 and r["decision"] == "history"
