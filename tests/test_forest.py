"""The partition forest against the exact search, on clustered vectors of many dimensions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclograin.operators import forest, neighbors


def clustered(n=4000, clusters=60, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.5


def test_recall_and_work_in_64_dimensions(spark):
    x = clustered()
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(8)
    q = d.filter("id % 10 = 0")
    index = forest.build(d, exclude="id", n_trees=6, leaf_rows=24)
    found = forest.search(index, q, 10, exclude="id", probes=1)
    exact = neighbors.knn(q, d, 10, exclude="id")
    assert forest.recall(found, exact).first()["recall"] >= 0.95
    assert forest.routed_share(index, q, exclude="id", probes=1).first()["share"] < 0.1
    both = found.join(exact.select("id", "neighbor", F.col("dist").alias("want")), ["id", "neighbor"])
    assert both.filter(F.abs(F.col("dist") - F.col("want")) > 1e-9).count() == 0
    assert found.filter("id = neighbor").count() == 0 and found.groupBy("id").count().filter("count <> 10").count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_copies_edges_and_hot_leaves(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK_ROWS", block)
    rows = [(i, [1.0, 2.0], "x", 0.0) for i in range(40)] + [(i, [float(i), 0.0], "y", 0.0) for i in range(40, 60)]
    rows += [(90, None, "y", 0.0), (91, [1.0], "y", 0.0), (92, [float("nan"), 1.0], "y", 0.0), (93, [None, 1.0], None, 0.0), (41, [41.0, 0.0], "y", 0.0), (94, [50.2, 0.0], None, 0.0)]
    d = spark.createDataFrame(rows, "id long, vec array<double>, kind string, dist double")
    index = forest.build(d, exclude="kind", n_trees=4, leaf_rows=5)
    got = {}
    for r in forest.search(index, d, 2, exclude="kind").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["dist"]))
    assert not set(got) & {90, 91, 92, 93}
    # without a kind nothing is excluded, itself included
    assert [n for _, n, _ in sorted(got[94])] == [94, 50]
    assert all(n >= 40 for i in range(40) for _, n, _ in got.get(i, []))
    free = forest.search(forest.build(d, n_trees=4, leaf_rows=5), d.filter("id = 7"), 3).orderBy("rank").collect()
    assert [(r["neighbor"], r["dist"]) for r in free] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    assert forest.search(forest.build(d.limit(0)), d, 3).collect() == []
    index = forest.build(d)
    assert forest.search(index, d.limit(0), 3).collect() == []
    assert [tuple(r) for r in forest.search(index, d, 3).collect()] == [(1, 1, 0.0, 1)]
