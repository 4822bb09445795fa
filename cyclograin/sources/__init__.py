"""Readers and sinks: per-entity CSV, run archives, curve tables, manifests, exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.functions import finite
from cyclograin.operators.attach import attach, scratch_path
from cyclograin.operators.filters import strict_rows, three_sigma_rows
from cyclograin.operators.ordered import Ordered, ordinal
from cyclograin.schema import CURVE_POINT, CURVES, FEATURES_16, RUNS, clean_numeric, series_csv_schema

__all__ = [
    "append_runs", "dataset_summary", "export_csv", "file_manifest", "label_only", "load_series", "metrics_wide",
    "official_splits", "read_curves", "read_keyed_archive", "read_runs", "read_series_csv", "scratch_path",
    "write_scored_points", "write_summary",
]


def read_series_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, entity_pattern: str = r"([^/]+)\.csv$",
) -> DataFrame:
    """Per-entity files: entity from the file path, ``record_index`` = row number in the file.

    A large file is read in several splits; rows are numbered by (start of the split, running
    id inside it), which is their order in the file. Persist the result: the row number is
    the only trace of that order.
    """
    schema = schema or series_csv_schema()
    d = spark.read.csv(path, header=True, schema=schema, recursiveFileLookup=True)
    d = d.select(
        F.regexp_extract(F.col("_metadata.file_path"), entity_pattern, 1).alias("entity"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
        *[f.name for f in schema.fields],
    )
    d = Ordered(d, ["__file"], ["__start", "__id"]).with_scans(record_index=ordinal())
    d = d.withColumn("record_index", F.col("record_index").cast("int")).drop("__file", "__start", "__id")
    numeric = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return clean_numeric(d, numeric)


def load_series(
    raw: DataFrame, catalogue: DataFrame, is_test: Column, reader: str = "strict_online",
    inputs: Sequence[str] = FEATURES_16, capacity: str = "capacity",
) -> DataFrame:
    """Legal rows of every unit with label, split flag and the reader that produced them.

    ``catalogue`` maps entity to unit and nominal capacity. ``author_offline`` applies the
    full-lifetime filter that also reads the label; ``strict_online`` never looks ahead.
    """
    d = attach(raw, catalogue.select("entity", "unit", "nominal"), ["entity"])
    if reader == "strict_online":
        d = strict_rows(d, inputs)
    elif reader == "author_offline":
        d = three_sigma_rows(d, ["unit", "entity"], ["record_index"], [*inputs, capacity])
    else:
        raise ValueError(f"unknown reader {reader!r}")
    return d.withColumns(
        {"y": F.col(capacity) / F.col("nominal"), "is_test": is_test, "reader": F.lit(reader)}
    ).drop("nominal")


def label_only(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Just the label column; the Parquet scan then reads nothing else."""
    return df.select(*keys, label)


def read_runs(spark: SparkSession, path: str, keys: Sequence[str] = ("unit", "view", "backbone", "seed", "normalize")) -> DataFrame:
    """Run records, one JSON object per line, one row per configuration.

    Duplicate keys: a successful record beats a failed one, then the later file name, then
    the larger serialised record, so the choice does not depend on the read order.
    """
    d = spark.read.schema(RUNS).json(path).withColumn("__f", F.col("_metadata.file_name"))
    text = F.to_json(F.struct(*[f.name for f in RUNS.fields]))
    best = [F.col("error").isNull().desc(), F.col("__f").desc(), text.desc()]
    w = Window.partitionBy(*keys).orderBy(*best)
    return d.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r", "__f")


def read_keyed_archive(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Nested JSON ``{"a|b": {metric: value}}`` to rows: key parts as columns, one row per metric."""
    d = spark.read.text(path, wholetext=True)
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    rows = d.select(F.explode(F.from_json("value", kind)).alias("key", "metrics"))
    rows = rows.select("key", F.explode("metrics").alias("metric", "value"))
    parts = F.split("key", r"\|")
    return rows.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)], "metric", "value")


def append_runs(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def metrics_wide(runs: DataFrame, keys: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """Metric maps to one column per metric name that occurs anywhere."""
    long = runs.select(*keys, F.explode(metrics).alias("__name", "__value"))
    names = sorted(r[0] for r in long.select("__name").distinct().collect())
    return long.groupBy(*keys).pivot("__name", names).agg(F.first("__value"))


def export_csv(runs: DataFrame, keys: Sequence[str], path: str) -> None:
    metrics_wide(runs, keys).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, base: str, version: str) -> str:
    """Write a summary to a new versioned path; an existing version is never overwritten."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").json(path)
    return path


def write_scored_points(df: DataFrame, path: str, partition: Sequence[str] = ("unit",)) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Curve table with NaN and infinite readings inside the points as NULL."""

    def point(p: Column) -> Column:
        return F.struct(*[finite(p[f.name]).alias(f.name) for f in CURVE_POINT.fields])

    return spark.read.schema(CURVES).parquet(path).withColumn("pts", F.transform("pts", point))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Size and SHA-256 of every file below a path.

    Spark lists the files; tasks stream their bytes in blocks, so a file may have any size. Folders
    must be reachable by ``pyarrow.fs`` (local paths, HDFS, object stores).
    """
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_sha256(p) for p in batch.column(0).to_pylist()]
            names = [p.rsplit("/", 1)[-1] for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), batch.column(1), pa.array(digests, pa.string())], names=["file", "bytes", "sha256"]
            )

    return d.select("path", "length").mapInArrow(run, "file string, bytes long, sha256 string")


def _sha256(uri: str, block: int = 1 << 20) -> str:
    # Spark writes local paths with a single slash
    fs, path = pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    digest = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as stream:
        while part := stream.read(block):
            digest.update(part)
    return digest.hexdigest()


def dataset_summary(df: DataFrame, unit: str, entity: str, y: str, is_test: str = "is_test") -> DataFrame:
    """Entities, held-out entities, shortest and longest series and lowest label, with totals."""
    per = df.groupBy(unit, entity).agg(
        F.count(F.lit(1)).alias("__n"), F.min(y).alias("__y"), F.max(is_test).alias("__t")
    )
    return per.rollup(unit).agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if("__t").alias("n_held_out"),
        F.min("__n").alias("min_rows"), F.max("__n").alias("max_rows"), F.min("__y").alias("min_y"),
    )


def official_splits(df: DataFrame, unit: str, entity: str, is_test: str = "is_test") -> DataFrame:
    """Sorted entities per unit and side, one row per entity with its position in the list."""
    names = df.select(unit, is_test, entity).distinct()
    return Ordered(names, [unit, is_test], [entity]).with_scans(position=ordinal())
