"""Row filters, splits and projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclograin.functions import decode_rate, is_finite, row_mean
from cyclograin.operators.attach import attach
from cyclograin.operators.ordered import Ordered, ordinal, total


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def with_label(df: DataFrame, nominal: DataFrame, capacity: str = "capacity", out: str = "y") -> DataFrame:
    """Label = capacity over the nominal capacity of the unit."""
    d = attach(df, nominal.select("unit", "nominal"), ["unit"])
    return d.withColumn(out, F.col(capacity) / F.col("nominal")).drop("nominal")


def strict_rows(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Keep rows whose own inputs are all finite. The label plays no part (online-legal)."""
    return df.filter(_all([is_finite(c) for c in inputs]))


def three_sigma_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    max_rows: int | None = None,
) -> DataFrame:
    """Full-lifetime 3-sigma filter over ``cols`` (label included): offline use only.

    One pass: all masks use the statistics of the unfiltered series; sample deviation.
    """
    d = df.filter(_all([is_finite(c) for c in cols]))
    stats = {}
    for c in cols:
        stats[f"__m_{c}"] = total(F.avg(c))
        stats[f"__s_{c}"] = total(F.stddev_samp(c))
    d = Ordered(d, keys, order, max_rows).with_scans(**stats)
    ok = [
        F.coalesce(
            ~(
                (F.col(c) > F.col(f"__m_{c}") + 3.0 * F.col(f"__s_{c}"))
                | (F.col(c) < F.col(f"__m_{c}") - 3.0 * F.col(f"__s_{c}"))
            ),
            F.lit(True),
        )
        for c in cols
    ]
    return d.filter(_all(ok)).drop(*stats)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "t",
    max_rows: int | None = None,
) -> DataFrame:
    """Retained index: 0-based position among the rows present."""
    return Ordered(df, keys, order, max_rows).with_scans(**{out: ordinal()})


def split_by_substring(entity: str, marks: Sequence[str]) -> Column:
    """Test when the entity name contains any of the marks."""
    return reduce(lambda a, b: a | b, [F.col(entity).contains(m) for m in marks])


def split_by_index(
    df: DataFrame, unit: str, entity: str, period: int, residues: Sequence[int], base: int = 1,
    out: str = "is_test",
) -> DataFrame:
    """Test by position of the entity name in the sorted list of its unit."""
    names = df.select(unit, entity).distinct()
    placed = Ordered(names, [unit], [entity]).with_scans(__i=ordinal())
    flag = ((F.col("__i") + base) % period).isin(list(residues))
    return attach(df, placed.select(unit, entity, flag.alias(out)), [unit, entity])


def split_by_ids(entity: str, ids: Sequence[str]) -> Column:
    return F.col(entity).isin(list(ids))


def split_by_trailing_number(entity: str, period: int, residue: int = 0) -> Column:
    """Test by the number at the end of the entity name."""
    number = F.regexp_extract(F.col(entity).cast("string"), r"(\d+)$", 1).cast("bigint")
    return number % period == residue


def select_batch(df: DataFrame, name: str, batch: str) -> DataFrame:
    return df.filter(F.col(name).contains(batch))


def plausible(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, lo: float, hi: float,
    min_rows: int, points: str | None = None, min_points: int = 5, max_rows: int | None = None,
) -> DataFrame:
    """Keep labels strictly inside (lo, hi) of entities with enough rows before and after."""
    d = Ordered(df, keys, order, max_rows).with_scans(__n=total(F.count(F.lit(1))))
    d = d.filter(F.col("__n") >= min_rows).drop("__n")
    keep = (F.col(y) > lo) & (F.col(y) < hi)
    if points:
        keep = keep & (F.col(points) >= min_points)
    d = Ordered(d.filter(keep), keys, order, max_rows).with_scans(__n=total(F.count(F.lit(1))))
    return d.filter(F.col("__n") >= min_rows).drop("__n")


def drop_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k0: int, min_rows: int = 20,
    max_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drop the first ``k0`` rows; entities left with too few rows come back as skipped."""
    d = Ordered(df, keys, order, max_rows).with_scans(
        __t=ordinal(), __n=total(F.count(F.lit(1)))
    )
    enough = F.col("__n") - k0 >= min_rows
    kept = d.filter(enough & (F.col("__t") >= k0)).drop("__t", "__n")
    skipped = d.filter(~enough).select(*keys).distinct()
    return kept, skipped


def scoring_window(df: DataFrame, t: str, n0: int) -> DataFrame:
    return df.filter(F.col(t) >= n0)


def common_columns(df: DataFrame, entity: Sequence[str], cols: Sequence[str]) -> list[str]:
    """Columns that are not entirely NULL for any entity (one aggregate, one driver row)."""
    per = df.groupBy(*entity).agg(*[F.count(c).alias(c) for c in cols])
    low = per.agg(*[F.min(c).alias(c) for c in cols]).first()
    return [c for c in cols if low[c] and low[c] > 0]


def keep_common(df: DataFrame, entity: Sequence[str], cols: Sequence[str]) -> DataFrame:
    kept = common_columns(df, entity, cols)
    others = [c for c in df.columns if c not in cols]
    return df.select(*others, *kept).dropna(subset=kept)


def parse_conditions(name: str) -> dict[str, Column]:
    """Temperature, charge and discharge rates from names like ``CY25-05_1-#3``."""
    pattern = r"CY(\d+)-(\d+)_(\d+)-#(\d+)"
    part = [F.regexp_extract(F.col(name), pattern, i) for i in range(1, 5)]
    return {
        "temperature": part[0].cast("int"),
        "charge_rate": decode_rate(part[1]),
        "discharge_rate": decode_rate(part[2]),
        "replicate": part[3].cast("int"),
    }


def to_seconds(pts: str, nominal: float | None = None) -> Column:
    """Curve points from minutes to seconds and, if given, from relative to absolute current."""
    gain = F.lit(nominal if nominal is not None else 1.0)
    return F.transform(
        pts,
        lambda p: F.struct(
            (p["t"] * 60.0).alias("t"), (p["i"] * gain).alias("i"), p["v"].alias("v"), p["q"].alias("q")
        ),
    )


def charge_span(pts: str) -> Column:
    """Time span of the points with positive current."""
    times = F.transform(F.filter(pts, lambda p: p["i"] > 0), lambda p: p["t"])
    return F.array_max(times) - F.array_min(times)


def gate_long_charge(pts: str, limit: float = 7200.0) -> Column:
    """The whole curve becomes NULL when its positive-current span exceeds the limit."""
    return F.when(F.coalesce(charge_span(pts) <= limit, F.lit(True)), F.col(pts))


def missing_flags(cols: Sequence[str]) -> dict[str, Column]:
    flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in cols}
    flags["missing_share"] = row_mean(list(flags.values()))
    return flags


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Condition rows to one column per condition (the list of names is fixed, so no extra job)."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in cols], name, value)
