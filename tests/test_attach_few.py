"""Rows of few units are not dealt by unit when a lookup per unit is attached."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cyclograin.operators import linear, normalize


@pytest.fixture(autouse=True)
def small_threshold(spark):
    """As on a large table: what is read is above the threshold for broadcasts, a written lookup below."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "16384")
    yield
    spark.conf.set(name, before)


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _rows(spark):
    d = spark.range(4000).select(
        F.when(F.col("id") % 10 < 9, F.lit("big")).when(F.col("id") % 10 == 9, F.lit(None).cast("string")).alias("unit"),
        (F.col("id") % 7).alias("entity"), (F.col("id") % 4 == 0).alias("is_test"), (F.col("id") % 11).cast("double").alias("x"),
    )
    return d.withColumn("y", F.col("x") * 2)


def test_minmax_per_unit_broadcasts_its_lookup(spark):
    d = normalize.source_minmax(_rows(spark), ["unit"], ["x"])
    assert "SortMergeJoin" not in _plan(d) and "BroadcastHashJoin" in _plan(d)
    assert d.count() == 4000
    assert d.agg(F.min("x"), F.max("x")).first() == (-1.0, 1.0)


def test_prediction_per_unit_broadcasts_its_models(spark):
    d = _rows(spark)
    got = linear.predict(d, linear.fit(linear.moments(d, ["unit"], ["x"], "y"), 0.0), ["unit"], ["x"])
    assert "SortMergeJoin" not in _plan(got)
    assert got.filter(F.abs(F.col("pred") - F.col("y")) < 1e-6).count() == 4000
