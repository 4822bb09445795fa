"""The chunked route must give the same values as plain windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cyclograin.operators import monotone, ranks
from cyclograin.operators import ordered as o
from cyclograin.plans.bindings import events


@pytest.fixture(scope="module")
def hot(spark, sf):
    """One group holds most rows; one column has gaps."""
    e = events(spark, sf)
    e = e.withColumn("g", F.when(F.col("entity") > 3, 1).otherwise(0))
    return e.select("g", "ts", "event_id", "y", "x2", "g1").repartition(5, "y").cache()


def scans():
    return {
        "t": o.ordinal(), "p1": o.prev("g1"), "p3": o.prev("g1", 3), "nx": o.following("g1", 2), "f": o.first("g1"),
        "la": o.last("g1"), "r5": o.rolling_avg("g1", 5), "mn": o.running_min("g1"), "mx": o.running_max("g1"),
        "sm": o.running_sum("g1"), "ff": o.last_valid("g1"), "em": o.early_median("g1", 7),
        "tot": o.total(F.stddev_pop("g1")),
    }


def frame(df):
    return df.toPandas().sort_values("event_id").reset_index(drop=True)


@pytest.mark.parametrize("max_rows", [2, 50])
def test_chunks_equal_windows(hot, max_rows):
    plain = o.Ordered(hot, ["g"], ["ts", "event_id"])
    cut = o.Ordered(hot, ["g"], ["ts", "event_id"], max_rows=max_rows)
    assert plain.bounds is None and cut.bounds is not None
    a, b = frame(plain.with_scans(**scans())), frame(cut.with_scans(**scans()))
    for c in scans():
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, err_msg=c)


def test_null_keys_and_texts_as_order(hot):
    """Rows with a NULL key stay; names with a long common prefix and tied leading values are cut too."""
    d = hot.withColumns({
        "g": F.when(F.col("g") == 1, F.lit(None)).otherwise(F.col("g")),
        "name": F.format_string("Supplier#%09d", F.col("event_id")), "same": F.lit("2020-01-01").cast("date"),
    })
    for order in (["name"], ["same", "event_id"]):
        cut = o.Ordered(d, ["g"], order, max_rows=40)
        a, b = frame(o.Ordered(d, ["g"], order).with_scans(**scans())), frame(cut.with_scans(**scans()))
        assert len(a) == len(b) == d.count()
        for c in scans():
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, err_msg=c)
        sizes = o.with_chunks(d, ["g"], order, cut.bounds).filter("__hot").groupBy("__chunk").count().agg(F.max("count"))
        assert sizes.first()[0] <= 3 * 40
    q = {"m": ("g1", 0.5)}
    key = lambda pdf: pdf.sort_values("g", na_position="last").reset_index(drop=True)
    pd.testing.assert_frame_equal(key(ranks.quantiles(d, ["g"], q).toPandas()), key(ranks.quantiles(d, ["g"], q, max_rows=9).toPandas()))
    a, b = (frame(ranks.with_average_rank(d, ["g"], "x2", "r", max_rows=n)) for n in (None, 11))
    np.testing.assert_allclose(a["r"], b["r"])
    s = d.select("g", "ts", "event_id", "y")
    a, b = (frame(monotone.isotonic(s, ["g"], ["ts", "event_id"], "y", "fit", max_rows=n)) for n in (None, 60))
    np.testing.assert_allclose(a["fit"], b["fit"], rtol=1e-9)


def test_whole_series_flush_with_each_new_series(spark):
    d = spark.range(200).selectExpr("id div 10 AS g", "id AS i", "cast(id % 7 as double) AS y")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = monotone.isotonic(d.coalesce(1), ["g"], ["i"], "y", "fit").toPandas().sort_values("i")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = np.concatenate([monotone.fit_decreasing(p["y"].to_numpy()) for _, p in got.groupby("g")])
    np.testing.assert_allclose(got["fit"], want)


def test_only_hot_keys_are_cut(hot):
    assert [r["g"] for r in o.hot_keys(hot, ["g"], 500).collect()] == [1]


def test_quantiles_of_split_groups(hot):
    q = {"a": ("g1", 0.1), "b": ("g1", 0.5), "c": ("x2", 0.99), "d": ("x2", 0.0), "e": ("x2", 1.0)}
    extra = [F.count(F.lit(1)).alias("n")]
    a = ranks.quantiles(hot, ["g"], q, extra=extra).toPandas().sort_values("g")
    b = ranks.quantiles(hot, ["g"], q, max_rows=7, extra=extra).toPandas().sort_values("g")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b[a.columns].reset_index(drop=True), rtol=1e-9)


def test_average_rank_of_split_groups(hot):
    a = frame(ranks.with_average_rank(hot, ["g"], "x2", "r"))
    b = frame(ranks.with_average_rank(hot, ["g"], "x2", "r", max_rows=11))
    np.testing.assert_allclose(a["r"], b["r"])


def test_hash_rank_is_a_permutation_and_ignores_partitioning(hot):
    a = frame(ranks.with_hash_rank(hot, ["g"], ["event_id"], 3, "s", "r", "n"))
    b = frame(ranks.with_hash_rank(hot.repartition(3), ["g"], ["event_id"], 3, "s", "r", "n", max_rows=13))
    assert a["r"].tolist() == b["r"].tolist()
    for _, part in a.groupby("g"):
        assert sorted(part["r"]) == list(range(part["n"].iloc[0]))


@pytest.mark.parametrize("trend", [0.0, -0.5, 0.5])
def test_isotonic_rounds_equal_single_pass(hot, trend):
    d = hot.select("g", "ts", "event_id", (F.col("y") + trend * F.col("event_id")).alias("y"))
    a = frame(monotone.isotonic(d, ["g"], ["ts", "event_id"], "y", "fit"))
    b = frame(monotone.isotonic(d, ["g"], ["ts", "event_id"], "y", "fit", max_rows=60))
    np.testing.assert_allclose(a["fit"], b["fit"], rtol=1e-9)


def test_isotonic_over_small_arrow_batches(spark, hot):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = hot.select("g", "ts", "event_id", "y")
        a = frame(monotone.isotonic(d, ["g"], ["ts", "event_id"], "y", "fit"))
        c = frame(monotone.causal_isotonic(d, ["g"], ["ts", "event_id"], "y", "fit"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, part in a.groupby("g"):
        want = monotone.fit_decreasing(part["y"].to_numpy())
        np.testing.assert_allclose(part["fit"], want)
        assert (np.diff(want) <= 1e-12).all()
    for _, part in c.groupby("g"):
        y = part["y"].to_numpy()
        want = [min(y[j : t + 1].mean() for j in range(t + 1)) for t in range(0, len(y), 25)]
        np.testing.assert_allclose(part["fit"].to_numpy()[::25], want)


@pytest.mark.parametrize("trend", [-0.5, 0.0, 0.5])
def test_causal_isotonic_in_steps_equals_streaming(hot, trend):
    d = hot.select("g", "ts", "event_id", (F.col("y") + trend * F.col("event_id")).alias("y"))
    a = frame(monotone.causal_isotonic(d, ["g"], ["ts", "event_id"], "y", "fit"))
    b = frame(monotone.causal_isotonic(d, ["g"], ["ts", "event_id"], "y", "fit", max_rows=300))
    assert len(a) == len(b)
    np.testing.assert_allclose(a["fit"], b["fit"], rtol=1e-9)


def test_falling_then_rising_series_pools_through_stack_slices(spark):
    y = [float(-k) for k in range(90)] + [500.0] * 5 + [0.0] * 5
    d = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)], "g string, ts int, y double")
    a = monotone.causal_isotonic(d, ["g"], ["ts"], "y", "fit").orderBy("ts").toPandas()
    b = monotone.causal_isotonic(d, ["g"], ["ts"], "y", "fit", max_rows=40).orderBy("ts").toPandas()
    np.testing.assert_allclose(a["fit"], b["fit"], rtol=1e-9)
