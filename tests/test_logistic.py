"""Grouped logistic regression against a direct fit, MLlib, and its stated edge cases."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cyclograin.operators import logistic

XS = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for unit, shift in ((None, 0.5), ("u", -1.0)):
        for i in range(240):
            a, b = 1000 + 5 * rng.normal(), 0.01 * rng.normal()
            p = 1 / (1 + np.exp(-(shift + 0.3 * (a - 1000) - 80 * b)))
            rows.append((unit, i, i % 3, float(a), float(b), int(rng.random() < p)))
    return spark.createDataFrame(rows, "unit string, id int, fold int, a double, b double, y int").cache()


def test_equals_mllib(data):
    got = {r["unit"]: r for r in logistic.coefficients(logistic.fit(data, ["unit"], XS, "y", 0.05), ["unit"], XS).collect()}
    assert set(got) == {None, "u"}
    for unit, r in got.items():
        part = VectorAssembler(inputCols=XS, outputCol="x").transform(data.filter(F.col("unit").eqNullSafe(unit)))
        m = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.05, tol=1e-12, maxIter=500).fit(part)
        np.testing.assert_allclose([r["b_a"], r["b_b"]], m.coefficients.toArray(), rtol=1e-4)
        assert r["b0"] == pytest.approx(m.intercept, rel=1e-4)


def test_folds_equal_separate_fits_and_predict_their_own_rows(data):
    models = logistic.fit(data, ["unit"], XS, "y", 0.1, "fold", 3)
    assert models.filter("done").count() == 6
    got = {(r["unit"], r["fold"]): r for r in logistic.coefficients(models, ["unit", "fold"], XS).collect()}
    for f in range(3):
        for r in logistic.coefficients(logistic.fit(data.filter(F.col("fold") != f), ["unit"], XS, "y", 0.1), ["unit"], XS).collect():
            assert tuple(got[r["unit"], f])[2:] == pytest.approx(tuple(r)[1:], rel=1e-6)
    rows = logistic.out_of_fold(data, ["unit"], "fold", 3, XS, "y", 0.1).collect()
    assert len(rows) == 480
    for r in rows[::37]:
        m = got[r["unit"], r["fold"]]
        assert r["proba"] == pytest.approx(1 / (1 + np.exp(-(m["b0"] + m["b_a"] * r["a"] + m["b_b"] * r["b"]))), rel=1e-6)


def test_one_class_constant_and_unknown(spark):
    rows = [("one", 1.0, 2.0, 1), ("one", 3.0, 2.0, 1), ("flat", 1.0, 5.0, 0), ("flat", 2.0, 5.0, 1), ("flat", 3.0, 5.0, 0), ("flat", None, 5.0, 1), ("flat", 2.0, 5.0, None)]
    # extra columns that share the model's names do no harm
    d = spark.createDataFrame(rows, "g string, a double, b double, y int").withColumns({"w": F.lit(7), "mean": F.lit("m"), "n": F.lit(0)})
    models = logistic.fit(d, ["g"], XS, "y", 0.1)
    got = logistic.predict(d, models, ["g"], XS).collect()
    assert [r["proba"] for r in got if r["g"] == "one"] == [1.0, 1.0]
    flat = [r for r in got if r["g"] == "flat"]
    assert all((r["proba"] is None) == (r["a"] is None) for r in flat) and all(r["w"] == 7 for r in flat)
    assert {r["g"]: r["n"] for r in models.collect()} == {"one": 2, "flat": 3}
    assert logistic.fit(d.filter("false"), ["g"], XS, "y").count() == 0


def test_steps_that_overshoot_are_halved(spark):
    # far outliers make full Newton steps overshoot
    x = [-1.0] * 30 + [1.0] * 30 + [400.0, -350.0]
    y = [0] * 28 + [1] * 2 + [1] * 29 + [0] + [0, 1]
    d = spark.createDataFrame([(1, a, a * a, b) for a, b in zip(x, y, strict=True)], "g int, a double, b double, y int")
    m = logistic.fit(d, ["g"], XS, "y", 1e-4).first()
    assert m["done"]
    z = (np.column_stack([x, np.square(x)]) - m["mean"]) / m["sd"]
    z = np.column_stack([np.ones(len(z)), z])
    w = np.array(m["w"])
    grad = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + 1e-4 * np.r_[0.0, w[1:]]
    assert np.abs(grad).max() < 1e-8
