"""History features: only the past matters, first-row rules, known values, row order."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.operators import filters, monotone, normalize, windows

K, O = ["e"], ["t"]
FEATURES = [*windows.FAMILIES, "from_early"]


def ramp(spark, n=50, seed=0, entities=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [(e, t, float(rng.normal()), float(rng.normal())) for e in entities for t in range(n)]
    return spark.createDataFrame(rows, "e string, t int, x double, z double")


def features(df):
    return windows.history_features(df, K, O, ["x", "z"], FEATURES).toPandas().sort_values(["e", "t"]).reset_index(drop=True)


def test_future_rows_do_not_matter(spark):
    d = ramp(spark)
    moved = d.withColumn("x", F.when(F.col("t") >= 25, F.col("x") + 100).otherwise(F.col("x")))
    a, b = features(d), features(moved)
    early = a["t"] < 25
    assert a[early].equals(b[early])
    assert not a[~early].equals(b[~early])


def test_row_arrival_order_does_not_matter(spark):
    d = ramp(spark)
    assert features(d).equals(features(d.orderBy(F.rand(1)).repartition(7)))


def test_known_rolling_values_and_first_row(spark):
    d = spark.createDataFrame([("a", t, float(t)) for t in range(10)], "e string, t int, x double")
    f = windows.history_features(d, K, O, ["x"], FEATURES).toPandas().set_index("t")
    assert f.loc[6, "x__from_roll5"] == 2.0 and f.loc[2, "x__from_roll5"] == 1.0
    assert f.loc[0, "x__lag1"] == 0.0
    assert (f.loc[0, ["x__diff1", "x__from_first", "x__from_roll5", "x__from_early"]] == 0).all()
    assert f.notna().all().all()


def test_robust_anchor_with_one_row_is_the_first_row(spark):
    f = windows.history_features(ramp(spark), K, O, ["x"], ["from_first", "from_early"], early=1).toPandas()
    np.testing.assert_allclose(f["x__from_first"], f["x__from_early"])


@pytest.mark.parametrize(("view", "width"), [("raw", 17), ("srl", 33), ("history", 81), ("lean", 49)])
def test_view_widths(view, width):
    assert len(windows.view_columns(view, [f"f{i}" for i in range(16)], "pos")) == width


def test_strict_rows_ignore_the_label_and_the_future(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0, inf, 1.0), ("a", 1, nan, 2.0), ("a", 2, 1.0, nan), ("a", 3, 2.0, 3.0), ("a", 4, None, 3.0)]
    d = spark.createDataFrame(rows, "e string, t int, x double, y double")
    keep = [r["t"] for r in filters.strict_rows(d, ["x"]).collect()]
    other = [r["t"] for r in filters.strict_rows(d.withColumn("y", F.lit(None).cast("double")), ["x"]).collect()]
    assert keep == other == [2, 3]
    cut = [r["t"] for r in filters.strict_rows(d.filter("t < 3"), ["x"]).collect()]
    assert cut == [2]


def test_three_sigma_reads_the_label_and_keeps_single_rows(spark):
    rows = [("a", t, 1.0 + 0.001 * t, 1.0) for t in range(30)] + [("a", 30, 1.0, 50.0), ("b", 0, 5.0, 5.0)]
    d = spark.createDataFrame(rows, "e string, t int, x double, y double")
    kept = {(r["e"], r["t"]) for r in filters.three_sigma_rows(d, K, O, ["x", "y"]).collect()}
    assert ("a", 30) not in kept and ("b", 0) in kept and len(kept) == 31


def test_source_normalisation_ignores_targets(spark):
    d = ramp(spark).withColumns({"unit": F.lit("u"), "is_test": F.col("e") == "b"})
    moved = d.withColumn("x", F.when(F.col("is_test"), F.col("x") * 3 + 7).otherwise(F.col("x")))
    pick = lambda df: normalize.source_minmax(df, ["unit"], ["x"]).filter("e = 'a'").orderBy("t").toPandas()["x"]
    np.testing.assert_array_equal(pick(d), pick(moved))


def test_constant_series_normalises_to_minus_one(spark):
    d = spark.createDataFrame([("a", t, 3.0) for t in range(4)], "e string, t int, x double")
    assert {r["x"] for r in normalize.entity_minmax(d, K, O, ["x"]).collect()} == {-1.0}


def test_forward_fill_never_looks_ahead(spark):
    rows = [("a", 0, None), ("a", 1, 5.0), ("a", 2, None), ("b", 0, 1.0)]
    d = spark.createDataFrame(rows, "e string, t int, x double").withColumns({"unit": F.lit("u"), "is_test": F.lit(False)})
    got = windows.impute_history_only(d, ["unit"], K, O, ["x"]).orderBy("e", "t").toPandas()["x__filled"].tolist()
    assert got == [3.0, 5.0, 5.0, 1.0]


def test_short_series_pass_the_centred_median(spark):
    d = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate([3, 1, 2, 9])], "e string, t int, x double")
    got = windows.rolling_median5(d, K, O, "x", "m").orderBy("t").toPandas()["m"].tolist()
    assert got == [3.0, 1.0, 2.0, 9.0]


def test_isotonic_example_and_gate(spark):
    y = [0.9, 0.95, 0.85, 0.88, 0.8, 0.7]
    d = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)], "e string, t int, y double")
    fit = monotone.isotonic(d, K, O, "y", "f").orderBy("t").toPandas()["f"].to_numpy()
    np.testing.assert_allclose(fit, [0.925, 0.925, 0.865, 0.865, 0.8, 0.7])
    closed = monotone.apply_gate(d, K, O, "y", float("-inf")).orderBy("t").toPandas()["gated"]
    assert closed.tolist() == y
    opened = monotone.apply_gate(d, K, O, "y", 10.0).orderBy("t").toPandas()["gated"]
    np.testing.assert_allclose(opened, fit)


def test_strict_mode_refuses_offline_postprocessing(spark):
    with pytest.raises(ValueError, match="future"):
        monotone.postprocess(ramp(spark), K, O, "x", ["iso"], strict=True)
