"""Curve reductions with closed-form answers, and the alignment rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.operators import align, curves, filters, joins


def curve(spark, t, i, v=None, q=None):
    n = len(t)
    v, q = v or [0.0] * n, q or [0.0] * n
    pts = [(float(a), None if b is None else float(b), float(c), float(d)) for a, b, c, d in zip(t, i, v, q)]
    return spark.createDataFrame([(pts,)], "pts array<struct<t:double,i:double,v:double,q:double>>")


def one(df, c):
    return df.select(c.alias("r")).first()["r"]


def test_constant_current_hour(spark):
    d = curve(spark, range(0, 3601, 60), [4.0] * 61)
    assert one(d, curves.charge_ah("pts")) == pytest.approx(4.0)
    assert one(curve(spark, [0, 314.94], [4, 4]), curves.charge_ah("pts")) == pytest.approx(0.34993, rel=1e-4)
    assert one(curve(spark, [0], [4]), curves.charge_ah("pts")) is None
    assert one(curve(spark, [0, 1, 2], [None, 3, None]), curves.charge_ah("pts")) is None


def test_two_positive_segments(spark):
    d = curve(spark, range(7), [1, 1, 0, 0, 2, 2, 0])
    d = d.withColumn("pts", filters.to_seconds("pts"))
    assert one(d, curves.positive_segments_ah("pts")) == pytest.approx(0.05)
    d = d.withColumn("pts", F.transform("pts", lambda p: p.withField("i", p["i"] * 1.1)))
    assert one(d, curves.positive_segments_ah("pts")) == pytest.approx(0.055)


@pytest.mark.parametrize(("i", "want"), [([0, 0, -1], None), ([1, 0, 1], 0.0), ([5], None), ([0, 1, 1], 1 / 3600)])
def test_positive_segment_edges(spark, i, want):
    got = one(curve(spark, range(len(i)), i), curves.positive_segments_ah("pts"))
    assert got == (want if want is None else pytest.approx(want))


def test_longest_run_and_ties(spark):
    d = curve(spark, range(11), [0, 1, 1, 1, 0, -1, -1, 0, 1, 1, 0])
    up = one(d, curves.longest_run(F.transform("pts", lambda p: p["i"] > 0)))
    down = one(d, curves.longest_run(F.transform("pts", lambda p: p["i"] < 0)))
    assert (up["start"], up["stop"]) == (1, 4) and (down["start"], down["stop"]) == (5, 7)
    tie = one(curve(spark, range(5), [1, 1, 0, 1, 1]), curves.longest_run(F.transform("pts", lambda p: p["i"] > 0)))
    assert (tie["start"], tie["stop"]) == (0, 2)
    none = one(d, curves.longest_run(F.transform("pts", lambda p: p["i"] > 9)))
    assert (none["start"], none["stop"]) == (0, 0)


def test_low_current_window(spark):
    i = [4.0] * 50 + [0.5 - 0.4 * k / 49 for k in range(50)]
    w = one(curve(spark, range(0, 6000, 60), i), curves.low_current_window("pts"))
    assert w["s"] == pytest.approx(2940) and w["i_mean"] == pytest.approx(0.3)


def test_masked_duration(spark):
    d = curve(spark, [0, 10, 25, 30], [1, 1, 0, 1])
    assert one(d, curves.masked_duration("pts", lambda p: p["i"] > 0)) == 30
    assert one(curve(spark, [0, 10], [1, 0]), curves.masked_duration("pts", lambda p: p["i"] > 0)) is None


def test_window_masks_include_the_boundary(spark):
    v = [4.199, 4.1995, 4.2, 3.9]
    d = curve(spark, range(4), [3.9] * 4, v)
    mask = one(d, F.transform("pts", lambda p: (p["v"] <= 4.199) & (p["i"] >= 3.9)))
    assert mask == [True, False, False, True]


def test_resampling_rules(spark):
    v = [3.0 + 0.1 * k for k in range(12)][::-1]
    d = curve(spark, range(12), [0] * 12, [*v[:-1], v[-2]], list(range(12)))
    g = curves.resample(d, "pts", [2.0, 3.1, 3.15, 9.0]).first()
    assert g["grid"][0] is None and g["grid"][3] is None and g["grid_share"] == 0.5
    assert g["grid"][1] == pytest.approx(10.0) and g["grid"][2] == pytest.approx(9.5)
    few = curves.resample(curve(spark, range(5), [0] * 5, [1, 2, 3, 4, 5]), "pts", [2.0]).first()
    assert few["grid"] is None and few["grid_share"] == 0.0


def test_interpolation_edges_and_statistics(spark):
    d = curve(spark, [10, 20, 30], [1, 3, 5])
    assert one(d, curves.interpolate_at("pts", "i", [0, 15, 30, 31])) == [1.0, 2.0, 5.0, None]
    s = one(d, curves.early_stats("pts", "i"))
    assert (s["mean"], s["slope"]) == (3.0, pytest.approx(0.2)) and s["std"] == pytest.approx(np.std([1, 3, 5]))
    flat = one(curve(spark, [5, 5], [1, 3]), curves.early_stats("pts", "i"))
    assert flat["slope"] == 0.0
    assert one(curve(spark, [5], [1]), curves.early_stats("pts", "i")) is None


def series(spark, raw, proc):
    a = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate(raw)], "e string, r long, value double")
    b = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate(proc)], "e string, p long, value double")
    return align.align(a, b, ["e"], "r", "p", "value")


def test_alignment_finds_deleted_rows(spark):
    raw = [1 + 0.01 * k for k in range(80)]
    keep = [k for k in range(80) if k % 9]
    m = series(spark, raw, [raw[k] for k in keep])
    assert [r["raw_row"] for r in m.orderBy("proc_row").collect()] == keep
    v = joins.release_gate(align.verdict(m, ["e"])).first()
    assert (v["status"], v["gate"], v["exact_subsequence"]) == ("pass", "row_level", True)


def test_alignment_of_foreign_and_scaled_series(spark):
    rng = np.random.default_rng(0)
    raw = 1 + rng.uniform(size=60)
    foreign = align.verdict(series(spark, raw, 50 + raw), ["e"]).first()
    assert (foreign["status"], foreign["matched"]) == ("unverifiable", 0)
    zeros = align.verdict(series(spark, raw, [0.0] * 5), ["e"]).first()
    assert zeros["matched"] == 0


def test_pointer_stays_on_a_miss():
    got = align.greedy_match(np.array([1.0, 2.0, 3.0]), np.array([9.0, 1.0, 0.0, 3.0]), 1e-6)
    assert got.tolist() == [-1, 0, -1, 2]
    far = np.concatenate([np.zeros(300) + 5.0, [1.0]])
    assert align.greedy_match(far, np.array([1.0]), 1e-6).tolist() == [-1]


def test_slices_equal_one_pass(spark):
    rng = np.random.default_rng(5)
    frames = []
    for e, gain in (("long", 1.0), ("scaled", 1.3), ("short", 1.0)):
        n = 300 if e == "short" else 5000
        raw = 1 + rng.uniform(size=n)
        keep = np.flatnonzero(rng.uniform(size=n) > 0.2)
        frames.append((e, raw, gain * raw[keep] * (1 + 2e-5 * rng.normal(size=len(keep)))))
    a = spark.createDataFrame([(e, i, float(v)) for e, r, _ in frames for i, v in enumerate(r)], "e string, r long, value double")
    b = spark.createDataFrame([(e, i, float(v)) for e, _, p in frames for i, v in enumerate(p)], "e string, p long, value double")
    want = align.align(a, b, ["e"], "r", "p", "value").toPandas().sort_values(["e", "proc_row"])
    got = align.align(a, b, ["e"], "r", "p", "value", max_rows=1024).toPandas().sort_values(["e", "proc_row"])
    for c in ("e", "proc_row", "raw_row", "tol", "n_raw"):
        assert want[c].fillna(-1).tolist() == got[c].fillna(-1).tolist(), c
    assert [list(x) for x in want["rungs"]] == [list(x) for x in got["rungs"]]


def test_gaps_in_stored_curves_become_null(spark, tmp_path):
    from cyclograin import sources

    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, [(0.0, 4.0, 3.0, 0.0), (1.0, nan, inf, 1.0), (2.0, 4.0, 3.2, 2.0)]), ("b", 1, None)]
    spark.createDataFrame(rows, sources.CURVES).write.parquet(str(tmp_path / "curves"))
    got = {r["entity"]: r["pts"] for r in sources.read_curves(spark, str(tmp_path / "curves")).collect()}
    assert got["b"] is None and [tuple(p) for p in got["a"]][1] == (1.0, None, None, 1.0)
