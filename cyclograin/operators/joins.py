"""Joins of the evaluation and audit steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclograin.operators.attach import attach, key_join
from cyclograin.operators.inference import spearman
from cyclograin.operators.ordered import Ordered, ordinal


def grid(*dims: DataFrame) -> DataFrame:
    """Experiment grid: the product of small dimension tables (never of data tables)."""
    return reduce(lambda a, b: a.crossJoin(b), dims)


def pending(configs: DataFrame, runs: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Configurations without a successful run; failed ones are retried."""
    done = runs.filter(F.col(error).isNull()).select(*keys)
    return key_join(configs, done, keys, "left_anti")


def pair_arms(df: DataFrame, keys: Sequence[str], arm: str, value: str, arms: Sequence[str]) -> DataFrame:
    """One column per arm, keys where every arm is present."""
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])
    return wide.dropna(subset=list(arms))


def map_rows(
    rows: DataFrame, mapping: DataFrame, keys: Sequence[str], row: str, proc_row: str, raw_row: str,
    n_raw: str | None = None,
) -> DataFrame:
    """Attach the raw position of each row; -1 or out of range means unmapped (NULL)."""
    m = mapping.select(*keys, F.col(proc_row).alias(row), F.col(raw_row).alias("__raw"))
    d = rows.join(m, [*keys, row], "left")
    ok = F.col("__raw") >= 0
    if n_raw:
        ok = ok & (F.col("__raw") < F.col(n_raw))
    return d.withColumn(raw_row, F.when(ok, F.col("__raw"))).drop("__raw")


def exclude(df: DataFrame, keys: Sequence[str], reasons: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of admissible entities, and the audit list of excluded entities with reasons."""
    tagged = [t.select(*keys).distinct().withColumn("reason", F.lit(r)) for r, t in reasons.items()]
    out = reduce(DataFrame.unionByName, tagged)
    banned = out.groupBy(*keys).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    present = df.select(*keys).distinct()
    return df.join(banned.select(*keys), list(keys), "left_anti"), banned.join(present, list(keys), "left_semi")


def leave_one_out(df: DataFrame, unit: Sequence[str], entity: str, sums: dict[str, Column]) -> DataFrame:
    """Additive statistics of all other entities of the unit: unit total minus own.

    This replaces the join of every entity with all others.
    """
    own = df.groupBy(*unit, entity).agg(*[F.sum(c).alias(f"__own_{k}") for k, c in sums.items()])
    whole = own.groupBy(*unit).agg(*[F.sum(f"__own_{k}").alias(f"__all_{k}") for k in sums])
    d = attach(own, whole, unit)
    return d.select(
        *unit, entity, *[(F.col(f"__all_{k}") - F.col(f"__own_{k}")).alias(k) for k in sums],
        *[F.col(f"__own_{k}").alias(f"own_{k}") for k in sums],
    )


def gap_list(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """Entities present on one side only."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(True))
    d = a.join(b, list(keys), "full")
    reason = F.when(F.col("__a").isNull(), f"missing in {left_name}").when(
        F.col("__b").isNull(), f"missing in {right_name}"
    )
    return d.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("__a", "__b")


def release_gate(ledger: DataFrame, status: str = "status") -> DataFrame:
    """Route entities: identity failures are blocked, mapping failures lose row-level use."""
    gate = (
        F.when(F.col(status) == "pass", "row_level")
        .when(F.col(status) == "fail_mapping", "aggregate_only")
        .when(F.col(status) == "fail_identity", "blocked")
        .otherwise("unverified")
    )
    return ledger.withColumn("gate", gate)


def availability_audit(
    entities: DataFrame, scored: DataFrame, keys: Sequence[str], raw_row: str, window: int = 100,
    excluded: DataFrame | None = None, mapped: DataFrame | None = None, with_scalar: DataFrame | None = None,
) -> DataFrame:
    """Status of every entity: may its statistic be used for its scored rows?

    Every scored row must be mapped to a raw row, and lie after the window the statistic
    was computed from. The optional tables list entities that are excluded, have a mapping,
    or have the statistic at all.
    """
    per = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count(raw_row).alias("n_mapped"),
        F.min(raw_row).alias("raw_min"),
        F.max(raw_row).alias("raw_max"),
    )
    d = entities.select(*keys).distinct().join(per, list(keys), "left")
    for name, t in (("__ex", excluded), ("__map", mapped), ("__sc", with_scalar)):
        if t is None:
            d = d.withColumn(name, F.lit(name != "__ex"))
        else:
            d = key_join(d, t.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    gap = F.col("n_scored") - F.col("n_mapped")
    unmapped = F.when(gap > 0, F.concat(F.lit("unmapped_rows="), gap.cast("string")))
    early = F.when(F.col("raw_min") <= window, F.concat(F.lit("min_raw_cycle="), F.col("raw_min").cast("string")))
    bad = F.filter(F.array(unmapped, early), lambda v: v.isNotNull())
    # The status and violation texts.
    status = (
        F.when(F.coalesce("__ex", F.lit(False)), "excluded_identity")
        .when(F.col("__map").isNull(), "no_raw_curve_data")
        .when(F.col("__sc").isNull(), "no_scalar")
        .when(F.coalesce("n_scored", F.lit(0)) == 0, "no_scored_rows")
        .when(F.size(bad) > 0, "violation")
        .otherwise("ok")
    )
    return d.withColumns({"status": status, "violations": F.array_join(bad, ",")}).drop("__ex", "__map", "__sc")


def prefix_agreement(
    a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str], value: str
) -> DataFrame:
    """Rank correlation and largest relative deviation of two sequences matched by position."""
    pa = Ordered(a.select(*keys, *order, F.col(value).alias("__a")), keys, order).with_scans(__t=ordinal())
    pb = Ordered(b.select(*keys, *order, F.col(value).alias("__b")), keys, order).with_scans(__t=ordinal())
    d = key_join(pa.select(*keys, "__t", "__a"), pb.select(*keys, "__t", "__b"), [*keys, "__t"])
    d = d.filter(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    dev = F.abs(F.col("__a") - F.col("__b")) / F.greatest(F.abs("__b"), F.lit(1e-12))
    rho = spearman(d, keys, "__a", "__b", min_n=2)
    return key_join(rho, d.groupBy(*keys).agg(F.max(dev).alias("max_dev")), keys)


def scenarios(costs: DataFrame, cost: str, power_watt: Sequence[float], carbon: Sequence[float]) -> DataFrame:
    """Cost rows times power draws times carbon intensities: energy and emissions per day.

    The two factors are constant arrays, so this is a projection with two explodes.
    """
    d = costs.withColumn("power_w", F.explode(F.array(*[F.lit(float(p)) for p in power_watt])))
    d = d.withColumn("g_per_kwh", F.explode(F.array(*[F.lit(float(c)) for c in carbon])))
    kwh = F.col(cost) * F.col("power_w") / 3.6e6
    return d.withColumns({"kwh": kwh, "kg_co2": kwh * F.col("g_per_kwh") / 1000.0})


def gain_with_statistics(
    gains: DataFrame, stats: DataFrame, keys: Sequence[str], gain: str, statistic: str, by: Sequence[str] = ()
) -> DataFrame:
    """Join per-entity gains with label-free statistics and correlate them by rank."""
    d = key_join(gains, stats, keys)
    return spearman(d, by, statistic, gain)


def against_published(runs: DataFrame, published: DataFrame, unit: Sequence[str], score: str, other: str) -> DataFrame:
    """Our mean per unit next to the published value."""
    ours = runs.groupBy(*unit).agg(F.avg(score).alias("ours"))
    d = attach(ours, published.select(*unit, F.col(other).alias("published")), unit)
    return d.withColumns(
        {
            "delta": (F.col("ours") - F.col("published")) / F.col("published") * 100.0,
            "better": F.col("ours") < F.col("published"),
        }
    )
