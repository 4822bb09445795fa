"""A resumable matrix of runs: every pending (dataset, method, seed, noise) once, failures on record.

What is pending is an anti-join of the grid with the records found at the path, so an interrupted matrix goes on
exactly where it stopped. Each run's record is appended as soon as it ends. The grid holds names, seeds and
rates, never data; the methods are Spark plans of any size.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.operators import joins, metrics
from cyclograin.sources import append_runs

KEYS = ("dataset", "method", "seed", "noise_rate")
RECORD = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("noise_rate", T.DoubleType()),
        T.StructField("task", T.StringType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("runtime_s", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Dataset:
    """One supervised task: label ``y``, features ``xs``, training and test rows."""

    task: str
    train: DataFrame
    test: DataFrame
    xs: Sequence[str]
    y: str = "y"


#: (data, seed) -> test rows with the label and a column ``pred``
Method = Callable[[Dataset, int], DataFrame]


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records so far; a torn last line is left out, and without a table there are none."""
    try:
        return spark.read.schema(RECORD).json(path).filter(F.col("dataset").isNotNull() & F.col("method").isNotNull())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def scores(data: Dataset, predicted: DataFrame) -> dict[str, float]:
    if data.task == "regression":
        found = metrics.regression_scores(predicted, [], data.y, "pred")
    elif data.task == "classification":
        found = metrics.classification_scores(predicted, [], data.y, "pred")
    else:
        raise ValueError(f"unknown task {data.task!r}")
    return {k: float(v) for k, v in found.first().asDict().items() if v is not None and not k.startswith("__")}


def run_matrix(
    spark: SparkSession, path: str, load: Callable[[str, int, float], Dataset], datasets: Sequence[str],
    methods: dict[str, Method], seeds: Sequence[int] = (0, 1, 2), noise_rates: Sequence[float] = (0.0,),
    retry_failed: bool = True,
) -> DataFrame:
    """Run what is pending, dataset by dataset, and return all records.

    ``load(dataset, seed, noise_rate)`` gives the data, once for all methods. A method that raises leaves a record with
    its error and no metrics, and the matrix goes on; it is pending again on the next call unless ``retry_failed`` is off.
    """
    keys = list(product(datasets, methods, map(int, seeds), map(float, noise_rates)))
    plan = spark.createDataFrame(keys, T.StructType([RECORD[k] for k in KEYS])).coalesce(1)
    known = records(spark, path)
    if not retry_failed:
        known = known.withColumn("error", F.lit(None).cast("string"))
    left = {tuple(r) for r in joins.pending(plan, known, KEYS).select(*KEYS).collect()}
    for dataset in datasets:
        for noise in noise_rates:
            for seed in seeds:
                todo = [m for m in methods if (dataset, m, int(seed), float(noise)) in left]
                if not todo:
                    continue
                data, problem = None, None
                try:
                    data = load(dataset, seed, noise)
                except Exception as failed:  # the record says which
                    problem = failed
                for method in todo:
                    record = _one(data, problem, methods[method], seed)
                    row = spark.createDataFrame([(dataset, method, int(seed), float(noise), *record)], RECORD)
                    append_runs(row.coalesce(1), path)
    return records(spark, path)


def _one(data: Dataset | None, problem: Exception | None, method: Method, seed: int) -> tuple:
    start = time.time()
    try:
        if data is None:
            raise problem
        n, got = data.train.count(), scores(data, method(data, seed))
        return data.task, n, got, time.time() - start, None
    except Exception as failed:
        message = f"{type(failed).__name__}: {failed}"
        return data.task if data else None, None, {}, time.time() - start, message[:2000]


def latest(runs: DataFrame) -> DataFrame:
    """One record per key: a success where there is one, else a failure."""
    best = F.max_by(F.struct("task", "n_train", "metrics", "runtime_s", "error"), F.struct(F.col("error").isNull(), "runtime_s"))
    return runs.groupBy(*KEYS).agg(best.alias("__r")).select(*KEYS, "__r.*")
