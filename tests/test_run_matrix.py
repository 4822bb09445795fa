"""The run matrix: resumes exactly, records failures, retries them on request, survives a torn record."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from cyclograin.plans import run_matrix as rm


def test_resume_failures_and_torn_records(spark, tmp_path):
    d = spark.createDataFrame([(i, float(i), 2.0 * i, i % 3 == 0) for i in range(30)], "id int, x double, y double, is_test boolean")
    calls = []

    def load(name, seed, noise):
        if name == "missing":
            raise FileNotFoundError(name)
        return rm.Dataset("regression", d.filter("not is_test"), d.filter("is_test"), ["x"])

    def double(data, seed):
        calls.append(seed)
        return data.test.withColumn("pred", F.col("x") * 2)

    def broken(data, seed):
        raise ValueError("no")

    path = str(tmp_path / "runs")
    assert rm.records(spark, path).count() == 0
    first = rm.run_matrix(spark, path, load, ["a", "missing"], {"double": double, "broken": broken}, (0, 1), (0.0, 0.1))
    assert first.count() == 16 and len(calls) == 4
    good = first.filter("error is null").collect()
    assert len(good) == 4 and all(r["metrics"]["rmse"] == 0 and r["n_train"] == 20 for r in good)
    assert {r["error"].split(":")[0] for r in first.filter("error is not null").collect()} == {"ValueError", "FileNotFoundError"}
    (pathlib.Path(path) / "part-torn.json").write_text('{"dataset": "a", "meth')
    same = rm.run_matrix(spark, path, load, ["a", "missing"], {"double": double, "broken": broken}, (0, 1), (0.0, 0.1), retry_failed=False)
    assert same.count() == 16 and len(calls) == 4
    again = rm.run_matrix(spark, path, load, ["a"], {"double": double, "broken": double}, (0, 1), (0.0, 0.1))
    assert again.count() == 20 and len(calls) == 8
    best = rm.latest(again).filter("dataset = 'a'").collect()
    assert len(best) == 8 and all(r["error"] is None for r in best)


def test_unknown_task_is_an_error(spark):
    d = spark.createDataFrame([(1.0, 1.0)], "y double, pred double")
    with pytest.raises(ValueError, match="unknown task"):
        rm.scores(rm.Dataset("ranking", d, d, []), d)
