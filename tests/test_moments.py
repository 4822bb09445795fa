"""One moment matrix per key, whatever the number of keys, their order and NULL among them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.operators import inference, linear, normalize, sampling

WIDE = [f"f{i}" for i in range(7)]


def wide_rows(spark, n, keys, seed=1):
    d = spark.range(n, numPartitions=6).withColumn("entity", F.when(F.col("id") % keys > 0, (F.col("id") * 7919) % keys))
    d = d.withColumns({x: F.randn(seed + i) + 1e6 for i, x in enumerate([*WIDE, "y"])})
    return d.withColumn("y", F.col("f0") - 2 * F.col("f3") + F.col("y") / 1e6)


@pytest.mark.parametrize(("n", "keys", "held"), [(3000, 900, 2000), (4000, 2, 8 << 20), (5, 5, 1)])
def test_wide_moments_hold_each_key_once(spark, monkeypatch, n, keys, held):
    monkeypatch.setattr(linear, "HELD_BYTES", held)
    d = wide_rows(spark, n, keys)
    pdf = d.toPandas()
    got = {r["entity"]: np.array(r["m"]).reshape(9, 9) for r in linear.moments(d, ["entity"], WIDE, "y").collect()}
    rows = linear.moments(d, ["entity"], WIDE, "y")
    assert rows.count() == len(got) == pdf["entity"].nunique(dropna=False)
    for key, part in pdf.groupby("entity", dropna=False):
        g = got[None if np.isnan(key) else key]
        x = part[[*WIDE, "y"]].to_numpy()
        assert g[0, 0] == len(x)
        assert np.allclose(g[0, 1:], x.mean(axis=0), rtol=1e-12)
        assert np.allclose(g[1:, 1:], (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), atol=1e-4)
    whole = linear.pool(rows, []).collect()
    assert len(whole) == 1 and whole[0]["m"][0] == n


def test_empty_and_incomplete_rows(spark):
    d = wide_rows(spark, 50, 5)
    assert linear.moments(d.limit(0), ["entity"], WIDE, "y").collect() == []
    assert linear.moments(d.withColumn("f2", F.lit(None).cast("double")), ["entity"], WIDE, "y").collect() == []


def test_null_keys_come_back(spark):
    rows = [(None if i % 2 else "u", None if i % 6 == 1 else f"e{i % 6}", i, float(i), float(i % 7), i % 4 == 0) for i in range(120)]
    d = spark.createDataFrame(rows, "unit string, entity string, id int, x1 double, y double, is_test boolean")
    assert normalize.source_minmax(d, ["unit"], ["x1"]).count() == 120
    model = linear.fit(linear.moments(d, ["unit"], ["x1"], "y"))
    got = linear.predict(d, model, ["unit"], ["x1"])
    assert got.count() == 120 and got.filter("pred is null").count() == 0
    assert sampling.group_kfold(d, ["unit"], "entity", 2).count() == 120
    assert inference.bootstrap_interval(d, ["unit"], ["id"], "y", 50).count() == 2
