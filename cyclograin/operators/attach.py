"""Lookup joins that adaptive execution sizes, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEMPORARY: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting (tests) gets a temporary folder; on a cluster
    every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _TEMPORARY:
            _TEMPORARY[app] = tempfile.mkdtemp(prefix="spark-")
        base = _TEMPORARY[app]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(app, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what :func:`scratch_path` named in this session, once no result that reads it is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where = hadoop(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    The table survives lost executors, is computed only once, and its size on disk gives
    later broadcast decisions a true figure.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that both sides have; NULL is a key like any other. ``how`` is no full or right join."""
    if not keys:
        return a.crossJoin(b)
    own = {k: f"__k{i}" for i, k in enumerate(keys)}
    other = b.select(*[F.col(f"`{k}`").alias(n) for k, n in own.items()], *[f"`{c}`" for c in b.columns if c not in own])
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in own.items()])
    return a.join(other, same, how).drop(*own.values())


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a lookup (one row per key) onto a big table; NULL is a key like any other.

    No side is forced to be broadcast: adaptive execution does so when the lookup, once it is
    computed, is below the session's threshold. Otherwise the join is a shuffle whose hot
    keys adaptive skew handling splits against their single lookup row.
    """
    if not keys:
        return big.crossJoin(F.broadcast(small))  # a lookup without keys is one row
    return key_join(big, small, keys, how)


def attach_few(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Like :func:`attach` for a lookup with few keys that is still to be computed, such as an aggregate per unit.

    The lookup is written first. Planning then knows its size, and the big table is not dealt by a handful
    of keys, one of which may be most of it, before adaptive execution learns that the lookup is small.
    """
    return attach(big, settled(small), keys, how)


def attach_global(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate) to every row."""
    return big.crossJoin(F.broadcast(one_row))
