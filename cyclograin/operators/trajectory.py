"""Trajectory statistics: one row per entity or unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclograin.functions import ieee_divide, rmse
from cyclograin.operators import ordered as o
from cyclograin.operators.attach import key_join
from cyclograin.operators.ordered import Ordered
from cyclograin.operators.ranks import complement_quantiles, quantiles, top_n, with_average_rank


def with_steps(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: dict[str, str],
    max_rows: int | None = None,
) -> DataFrame:
    """Difference to the previous row for each ``{output: column}``; NULL on the first row."""
    d = Ordered(df, keys, order, max_rows).with_scans(**{f"__p_{k}": o.prev(c) for k, c in steps.items()})
    return d.withColumns({k: F.col(c) - F.col(f"__p_{k}") for k, c in steps.items()}).drop(
        *[f"__p_{k}" for k in steps]
    )


def violation(step: str | Column) -> Column:
    """Sum of rises over sum of falls, as an aggregate over a step column."""
    d = F.col(step) if isinstance(step, str) else step
    up = F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0.0))
    return up / F.greatest(down, F.lit(1e-9))


def roughness(step: str | Column) -> Column:
    """Population deviation of the steps; 0 for at most two rows."""
    d = F.col(step) if isinstance(step, str) else step
    return F.when(F.count(d) >= 2, F.stddev_pop(d)).otherwise(F.lit(0.0))


def violation_ratio(df, keys, order, y: str, out: str = "violation", max_rows: int | None = None) -> DataFrame:
    d = with_steps(df, keys, order, {"__d": y}, max_rows)
    return d.groupBy(*keys).agg(violation("__d").alias(out), roughness("__d").alias("roughness"))


def roughness_ratio(entity_roughness: Column, reference: Column) -> Column:
    return entity_roughness / F.greatest(reference, F.lit(1e-9))


def reference_roughness(df, unit: Sequence[str], keys, order, y: str, max_rows: int | None = None) -> DataFrame:
    """Median roughness over the entities of a unit with more than two rows, else 1e-9."""
    d = with_steps(df, keys, order, {"__d": y}, max_rows)
    per = d.groupBy(*keys).agg(F.stddev_pop("__d").alias("__r"), F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("__r", F.when(F.col("__n") > 2, F.col("__r")))
    ref = quantiles(per, unit, {"reference": ("__r", 0.5)})
    return ref.withColumn("reference", F.coalesce("reference", F.lit(1e-9)))


def reference_roughness_elsewhere(df, unit: str, keys, order, y: str, max_rows: int | None = None) -> DataFrame:
    """Leave-one-unit-out reference: the median over the entities of all other units.

    One number per entity; the medians of all complements come from counted values, without copies.
    """
    d = with_steps(df, keys, order, {"__d": y}, max_rows)
    per = d.groupBy(*keys).agg(F.stddev_pop("__d").alias("__r"), F.count(F.lit(1)).alias("__n"))
    per = per.filter(F.col("__n") > 2)
    return complement_quantiles(per, unit, {"reference": ("__r", 0.5)}).filter(F.col("reference").isNotNull())


def entity_records(df, keys, order, y: str, pred: str, modes: dict[str, str], max_rows: int | None = None) -> DataFrame:
    """Per-entity statistics and the paired gain of each post-processing column.

    ``modes`` maps a mode name to the column holding its projected trajectory; the mean
    correction refers to the mode called ``iso`` when present, else to the first one.
    """
    d = with_steps(df, keys, order, {"__dp": pred, "__dt": y}, max_rows)
    main = modes.get("iso", next(iter(modes.values())))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        violation("__dp").alias("v_pred"),
        F.avg(F.abs(F.col(pred) - F.col(main))).alias("corr_mag"),
        violation("__dt").alias("v_true"),
        roughness("__dp").alias("rough_pred"),
        roughness("__dt").alias("rough_true"),
        rmse(y, pred).alias("rmse_none"),
        *[rmse(y, c).alias(f"rmse_{m}") for m, c in modes.items()],
    ]
    base = F.greatest(F.col("rmse_none"), F.lit(1e-12))
    return d.groupBy(*keys).agg(*aggs).withColumns(
        {f"delta_{m}": (F.col(f"rmse_{m}") - F.col("rmse_none")) / base * 100.0 for m in modes}
    )


def end_to_end_rate(df, unit, keys, order, y: str, min_rows: int) -> DataFrame:
    """Mean over entities of abs(first - last) / rows, entities with more than ``min_rows - 1`` rows."""
    pos = F.struct(*order)
    per = df.groupBy(*keys).agg(
        F.min_by(y, pos).alias("a"), F.max_by(y, pos).alias("b"), F.count(F.lit(1)).alias("n")
    )
    per = per.filter(F.col("n") >= min_rows)
    return per.groupBy(*unit).agg(F.avg(F.abs(F.col("a") - F.col("b")) / F.col("n")).alias("rate"))


def trend_strength(df, unit, keys, order, cols: Sequence[str], min_rows: int = 5) -> DataFrame:
    """Mean absolute rank correlation of each feature with time, over features then entities."""
    d = Ordered(df, keys, order).with_scans(__t=o.ordinal())
    for c in cols:
        d = with_average_rank(d, keys, c, f"__k_{c}")
    per = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.abs(F.corr("__t", f"__k_{c}")).alias(c) for c in cols]
    )
    per = per.filter(F.col("__n") >= min_rows)
    rows = filters_mean(cols)
    return per.withColumn("__v", rows).groupBy(*unit).agg(F.avg("__v").alias("trend"))


def filters_mean(cols: Sequence[str]) -> Column:
    """Row mean that skips NULL and NaN."""
    vals = F.filter(F.array(*cols), lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def source_size(df, unit, entity: str, width: int) -> DataFrame:
    """Rows, width-to-rows ratio and mean rows per entity."""
    per = df.groupBy(*unit, entity).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*unit).agg(
        F.sum("n").alias("n_rows"),
        (F.lit(float(width)) / F.sum("n")).alias("width_ratio"),
        F.avg("n").alias("rows_per_entity"),
    )


def early_slope(df, unit, entity: str, order, y: str, choices: Sequence[int] = (100, 50)) -> DataFrame:
    """Slope of the first N labels on time, the first and the last label, per entity.

    N is the largest choice every entity of the unit can fill, else the shortest length.
    """
    keys = [*unit, entity]
    pos = F.struct(*order)
    ends = df.groupBy(*keys).agg(
        F.min_by(y, pos).alias("y_first"), F.max_by(y, pos).alias("y_last"), F.count(F.lit(1)).alias("n")
    )
    shortest = ends.groupBy(*unit).agg(F.min("n").alias("shortest"))
    pick = F.col("shortest")
    for c in sorted(choices):
        pick = F.when(F.col("shortest") >= c, F.lit(c)).otherwise(pick)
    window = shortest.withColumn("n_early", pick.cast("int"))
    heads = top_n(df.select(*keys, *order, y), keys, [F.col(c) for c in order], max(choices), "__r")
    heads = key_join(heads, window.select(*unit, "n_early"), unit)
    heads = heads.filter(F.col("__r") <= F.col("n_early")).withColumn("__t", F.col("__r") - 1)
    slope = heads.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col("__t").cast("double")).alias("slope"), F.first("n_early").alias("n_early")
    )
    return key_join(slope, ends.drop("n"), keys)


def self_ratio(
    df, keys, order, parts: Sequence[str], out: str = "ratio", max_rows: int | None = None, ieee: bool = False
) -> DataFrame:
    """(a + b)_t over (a + b)_1; NULL when the first sum is missing.

    After a first sum of zero the ratio is NULL, or with ``ieee`` infinite (NaN for zero over zero).
    """
    total = sum(F.col(p) for p in parts)
    d = Ordered(df.withColumn("__q", total), keys, order, max_rows).with_scans(__q1=o.first("__q"))
    ratio = ieee_divide("__q", "__q1") if ieee else F.when(F.col("__q1") != 0, F.col("__q") / F.col("__q1"))
    return d.withColumn(out, ratio).drop("__q", "__q1")


def noise_floor(df, group: Sequence[str], metric: str) -> DataFrame:
    """Relative range of a metric over seeds per group, in percent."""
    return df.groupBy(*group).agg(
        ((F.max(metric) - F.min(metric)) / F.avg(metric) * 100.0).alias("range_pct"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def weight_profile(weights: DataFrame, group: Sequence[str], position: str, weight: str, cols: Sequence[str] = ()) -> DataFrame:
    """First weight, mass of the first three, position of the largest.

    With ``cols`` also ``max_deviation``: how far the weighted anchor of any column lies from that
    column's first row. Columns without a known anchor or first row are passed over; NULL if all are.
    """
    p, w = F.col(position), F.col(weight)
    gaps = [F.abs(F.sum(w * F.col(c)) - F.max(F.when(p == 0, F.col(c)))) for c in cols]
    far = [] if not gaps else [(gaps[0] if len(gaps) == 1 else F.greatest(*gaps)).alias("max_deviation")]
    return weights.groupBy(*group).agg(
        F.max(F.when(p == 0, w)).alias("first_weight"),
        F.sum(F.when(p < 3, w).otherwise(0.0)).alias("mass3"),
        F.max_by(p, F.struct(w, -p)).alias("argmax"),
        *far,
    )
