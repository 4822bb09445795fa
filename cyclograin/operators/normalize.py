"""Normalisations. Names say whose statistics are used and whether the future is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclograin.functions import col
from cyclograin.operators.attach import attach_few
from cyclograin.operators.ordered import Ordered, ordinal, total


def _minmax(x: Column, lo: Column, hi: Column) -> Column:
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return 2.0 * (x - lo) / span - 1.0


def entity_minmax(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    max_rows: int | None = None,
) -> DataFrame:
    """Per-entity min-max to [-1, 1] over the whole life (offline)."""
    stats = {}
    for c in cols:
        stats[f"__lo_{c}"], stats[f"__hi_{c}"] = total(F.min(c)), total(F.max(c))
    d = Ordered(df, keys, order, max_rows).with_scans(**stats)
    return d.withColumns(
        {c: _minmax(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")) for c in cols}
    ).drop(*stats)


def source_minmax(
    df: DataFrame, unit: Sequence[str], cols: Sequence[str], is_test: str = "is_test"
) -> DataFrame:
    """Pooled min-max of the source entities, applied to every entity of the unit."""
    aggs = [F.min(c).alias(f"__lo_{c}") for c in cols] + [F.max(c).alias(f"__hi_{c}") for c in cols]
    stats = df.filter(~F.col(is_test)).groupBy(*unit).agg(*aggs)
    d = attach_few(df, stats, unit)
    out = d.withColumns(
        {c: _minmax(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")) for c in cols}
    )
    return out.select(*df.columns)


def pool_standardise(
    df: DataFrame, unit: Sequence[str], cols: Sequence[str], pool: Column | None = None,
    eps: float = 1e-9,
) -> DataFrame:
    """(x - mean) / (population deviation + eps), statistics of the pool rows of the unit."""
    base = df if pool is None else df.filter(pool)
    aggs = [F.avg(c).alias(f"__m_{c}") for c in cols]
    aggs += [F.stddev_pop(c).alias(f"__s_{c}") for c in cols]
    d = attach_few(df, base.groupBy(*unit).agg(*aggs), unit)
    return d.withColumns(
        {c: (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + eps) for c in cols}
    ).select(*df.columns)


def entity_scalar_zscore(
    df: DataFrame, unit: Sequence[str], entity: str, scalar: str, out: str,
    is_test: str = "is_test", eps: float = 1e-12,
) -> DataFrame:
    """z-score of one value per entity, statistics of the source entities (one vote each)."""
    per_entity = df.groupBy(*unit, entity, is_test).agg(F.first(scalar).alias("__v"))
    stats = (
        per_entity.filter(~F.col(is_test))
        .groupBy(*unit)
        .agg(F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s"))
    )
    d = attach_few(df, stats, unit)
    return d.withColumn(out, (F.col(scalar) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def position_scaled(t: str, scale: float = 200.0) -> Column:
    """Cycle position on a fixed scale (online)."""
    return col(t) / F.lit(scale)


def with_position_minmax(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, max_rows: int | None = None
) -> DataFrame:
    """Cycle position scaled to [-1, 1] by the entity's length (offline)."""
    d = Ordered(df, keys, order, max_rows).with_scans(
        __t=ordinal(), __n=total(F.count(F.lit(1)))
    )
    value = 2.0 * F.col("__t") / F.greatest(F.col("__n") - 1, F.lit(1)) - 1.0
    return d.withColumn(out, value).drop("__t", "__n")


def with_stage(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "stage",
    max_rows: int | None = None,
) -> DataFrame:
    """Within-entity position quantile in [0, 1] (offline)."""
    d = Ordered(df, keys, order, max_rows).with_scans(
        __t=ordinal(), __n=total(F.count(F.lit(1)))
    )
    return d.withColumn(out, F.col("__t") / F.greatest(F.col("__n") - 1, F.lit(1))).drop("__t", "__n")
