"""Canonical tables, ingest rules and the session used by tests and bench."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURVE_POINT = T.StructType(
    [
        T.StructField("t", T.DoubleType()),
        T.StructField("i", T.DoubleType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("q", T.DoubleType()),
    ]
)

CURVES = T.StructType(
    [
        T.StructField("entity", T.StringType(), False),
        T.StructField("cycle", T.IntegerType(), False),
        T.StructField("pts", T.ArrayType(CURVE_POINT)),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("view", T.StringType()),
        T.StructField("backbone", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("normalize", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("error", T.StringType()),
    ]
)

# The sixteen per-cycle feature columns of the released files, in order.
FEATURES_16 = (
    "voltage mean",
    "voltage std",
    "voltage kurtosis",
    "voltage skewness",
    "CC Q",
    "CC charge time",
    "voltage slope",
    "voltage entropy",
    "current mean",
    "current std",
    "current kurtosis",
    "current skewness",
    "CV Q",
    "CV charge time",
    "current slope",
    "current entropy",
)


def series_csv_schema() -> T.StructType:
    """Schema of one released per-entity file: features in order, then the label."""
    fields = [T.StructField(c, T.DoubleType()) for c in FEATURES_16]
    return T.StructType([*fields, T.StructField("capacity", T.DoubleType())])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def clean_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NaN and infinities become NULL once, at ingest; every operator assumes NULL."""
    from cyclograin.functions import finite

    return df.withColumns({c: finite(c) for c in cols})


def session(cores: str | int = "*", app: str = "cyclograin", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass your own session."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CYCLOGRAIN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
