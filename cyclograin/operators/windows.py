"""History features, anchors, gap filling and causal smoothing over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclograin.operators import ordered as o
from cyclograin.operators.attach import attach, key_join
from cyclograin.operators.ranks import quantiles

FAMILIES = ("lag1", "diff1", "from_first", "from_roll5")
VIEWS = {
    "raw": (),
    "srl": ("from_first",),
    "history": FAMILIES,
    "lean": ("from_first", "from_roll5"),
    "robust": ("from_early",),
    **{f"raw+{f}": (f,) for f in FAMILIES},
    **{f"history-{f}": tuple(g for g in FAMILIES if g != f) for f in FAMILIES},
}


def history_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    families: Sequence[str] = FAMILIES, roll: int = 5, early: int = 5,
    max_rows: int | None = None,
) -> DataFrame:
    """Online feature families; every family of every column shares one window pass."""
    scans = {}
    for c in cols:
        if "lag1" in families or "diff1" in families:
            scans[f"__p_{c}"] = o.prev(c)
        if "from_first" in families:
            scans[f"__f_{c}"] = o.first(c)
        if "from_roll5" in families:
            scans[f"__r_{c}"] = o.rolling_avg(c, roll)
        if "from_early" in families:
            scans[f"__e_{c}"] = o.early_median(c, early)
    scans["__pos"] = o.ordinal()
    d = o.Ordered(df, keys, order, max_rows).with_scans(**scans)
    made: dict[str, Column] = {}
    for c in cols:
        x = F.col(c)
        lag = F.when(F.col("__pos") == 0, x).otherwise(F.col(f"__p_{c}"))
        parts = {
            "lag1": lambda lag=lag: lag,
            "diff1": lambda x=x, lag=lag: x - lag,
            "from_first": lambda x=x, c=c: x - F.col(f"__f_{c}"),
            "from_roll5": lambda x=x, c=c: x - F.col(f"__r_{c}"),
            "from_early": lambda x=x, c=c: x - F.col(f"__e_{c}"),
        }
        for f in families:
            made[f"{c}__{f}"] = parts[f]()
    return d.withColumns(made).drop(*scans)


def view_columns(view: str, cols: Sequence[str], position: str | None = None) -> list[str]:
    """Column names of a named view, in block order."""
    names = list(cols) + ([position] if position else [])
    for f in VIEWS[view]:
        names += [f"{c}__{f}" for c in cols]
    return names


def build_view(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], view: str,
    position: str | None = None, max_rows: int | None = None,
) -> DataFrame:
    """The input with the columns of one named view added."""
    if not VIEWS[view]:
        return df
    return history_features(df, keys, order, cols, VIEWS[view], max_rows=max_rows)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per entity: its first values (an aggregate, so it combines map-side)."""
    packed = F.min_by(F.struct(*cols), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(packed).select(
        *keys, *[F.col(f"__first.{c}").alias(f"{c}__first") for c in cols]
    )


def mispaired_lift(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], cols: Sequence[str],
    ref_map: DataFrame, suffix: str = "shuffled",
) -> DataFrame:
    """x_t minus the first row of the reference entity given by ``ref_map``.

    ``ref_map`` has (unit, entity, ref) and may carry extra columns such as a draw number.
    """
    anchors = first_rows(df, [*unit, entity], order, cols)
    anchors = anchors.withColumnRenamed(entity, "ref")
    anchored = key_join(ref_map, anchors, [*unit, "ref"])
    d = attach(df, anchored, [*unit, entity])
    return d.withColumns(
        {f"{c}__{suffix}": F.col(c) - F.col(f"{c}__first") for c in cols}
    ).drop(*[f"{c}__first" for c in cols])


def population_lift(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], cols: Sequence[str],
    is_test: str = "is_test", suffix: str = "pop",
) -> DataFrame:
    """x_t minus the mean first row of the source entities of the unit."""
    firsts = first_rows(df.filter(~F.col(is_test)), [*unit, entity], order, cols)
    anchor = firsts.groupBy(*unit).agg(*[F.avg(f"{c}__first").alias(f"{c}__anchor") for c in cols])
    d = attach(df, anchor, unit)
    return d.withColumns(
        {f"{c}__{suffix}": F.col(c) - F.col(f"{c}__anchor") for c in cols}
    ).drop(*[f"{c}__anchor" for c in cols])


def weighted_anchor(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], weights: Sequence[float],
) -> DataFrame:
    """Per entity, sum of weight_i * x_i over its first rows; weights renormalised if short."""
    k = len(weights)
    heads = early_rows(df, keys, order, cols, k)
    w = F.try_element_at(F.array(*[F.lit(float(a)) for a in weights]), F.col("t") + 1)
    aggs = [(F.sum(w * F.col(c)) / F.sum(w)).alias(f"{c}__anchor") for c in cols]
    return heads.groupBy(*keys).agg(*aggs)


def early_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], k: int
) -> DataFrame:
    """The first ``k`` rows of each entity with their position ``t``.

    A fixed ``k`` lets Spark keep at most ``k`` rows per entity in every map task.
    """
    from cyclograin.operators.ranks import top_n

    d = top_n(df, keys, [F.col(c) for c in order], k, "__r")
    return d.select(*keys, (F.col("__r") - 1).alias("t"), *cols)


def weighted_lift(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], weights: Sequence[float],
    suffix: str = "wlift",
) -> DataFrame:
    anchor = weighted_anchor(df, keys, order, cols, weights)
    d = attach(df, anchor, keys)
    return d.withColumns(
        {f"{c}__{suffix}": F.col(c) - F.col(f"{c}__anchor") for c in cols}
    ).drop(*[f"{c}__anchor" for c in cols])


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    max_rows: int | None = None,
) -> DataFrame:
    """``c__ff`` (latest non-NULL value), ``c__was_missing`` and ``c__still_missing``."""
    d = o.Ordered(df, keys, order, max_rows).with_scans(**{f"{c}__ff": o.last_valid(c) for c in cols})
    flags = {f"{c}__was_missing": F.col(c).isNull() for c in cols}
    flags.update({f"{c}__still_missing": F.col(f"{c}__ff").isNull() for c in cols})
    return d.withColumns(flags)


def source_medians(
    df: DataFrame, unit: Sequence[str], cols: Sequence[str], is_test: str = "is_test"
) -> DataFrame:
    return quantiles(df.filter(~F.col(is_test)), unit, {f"{c}__median": (c, 0.5) for c in cols})


def impute_history_only(
    df: DataFrame, unit: Sequence[str], keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    is_test: str = "is_test", max_rows: int | None = None,
) -> DataFrame:
    """Forward fill; leading gaps take the source median of the unit, else 0."""
    filled = forward_fill(df, keys, order, cols, max_rows)
    d = attach(filled, source_medians(df, unit, cols, is_test), unit, "left")
    return d.withColumns(
        {
            f"{c}__filled": F.coalesce(F.col(f"{c}__ff"), F.col(f"{c}__median"), F.lit(0.0))
            for c in cols
        }
    ).drop(*[f"{c}__median" for c in cols], *[f"{c}__still_missing" for c in cols])


def causal_cummin(df, keys, order, y: str, out: str, max_rows: int | None = None) -> DataFrame:
    return o.Ordered(df, keys, order, max_rows).with_scans(**{out: o.running_min(y)})


def causal_mean(df, keys, order, y: str, out: str, width: int = 5, max_rows: int | None = None) -> DataFrame:
    return o.Ordered(df, keys, order, max_rows).with_scans(**{out: o.rolling_avg(y, width)})


def causal_smooth_cummin(df, keys, order, y: str, out: str, width: int = 5, max_rows: int | None = None) -> DataFrame:
    """Causal mean, then running minimum."""
    d = causal_mean(df, keys, order, y, "__mean", width, max_rows)
    return causal_cummin(d, keys, order, "__mean", out, max_rows).drop("__mean")


def rolling_median5(df, keys, order, y: str, out: str, max_rows: int | None = None) -> DataFrame:
    """Centred median of five with edge values repeated (offline); short series unchanged."""
    d = o.Ordered(df, keys, order, max_rows).with_scans(
        __a=o.prev(y, 2), __b=o.prev(y, 1), __d=o.following(y, 1), __e=o.following(y, 2),
        __first=o.first(y), __last=o.last(y), __n=o.total(F.count(F.lit(1))),
    )
    five = F.array_sort(
        F.array(
            F.coalesce("__a", "__first"), F.coalesce("__b", "__first"), F.col(y),
            F.coalesce("__d", "__last"), F.coalesce("__e", "__last"),
        )
    )
    value = F.when(F.col("__n") < 5, F.col(y)).otherwise(five[2])
    return d.withColumn(out, value).drop("__a", "__b", "__d", "__e", "__first", "__last", "__n")


def shift_control(df, keys, order, y: str, out: str, max_rows: int | None = None) -> DataFrame:
    """Constant shift by the mean correction of the running minimum (offline control)."""
    d = causal_cummin(df, keys, order, y, "__min", max_rows).withColumn(
        "__gap", F.col(y) - F.col("__min")
    )
    d = o.Ordered(d, keys, order, max_rows).with_scans(__shift=o.total(F.avg("__gap")))
    return d.withColumn(out, F.col(y) - F.col("__shift")).drop("__min", "__gap", "__shift")
