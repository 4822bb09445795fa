"""Reductions of sampled curves stored as one array of points per cycle.

A cycle is one row, so every reduction here is a row-local expression: no shuffle, no sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.functions import col
from cyclograin.operators.attach import key_join
from cyclograin.operators.ranks import quantiles

Points = str | Column


def _zero(**kinds: str) -> Column:
    return F.struct(*[F.lit(0).cast(k).alias(n) for n, k in kinds.items()])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def longest_run(mask: Column) -> Column:
    """[start, stop) of the longest run of true values, the first one on ties; (0, 0) if none."""

    def step(a: Column, m: Column) -> Column:
        run = F.when(m, a["run"] + 1).otherwise(0)
        longer = run > a["best"]
        return F.struct(
            (a["i"] + 1).alias("i"),
            run.alias("run"),
            F.when(longer, run).otherwise(a["best"]).alias("best"),
            F.when(longer, a["i"] + 1).otherwise(a["stop"]).alias("stop"),
        )

    zero = _zero(i="int", run="int", best="int", stop="int")
    return F.aggregate(
        mask, zero, step, lambda a: F.struct((a["stop"] - a["best"]).alias("start"), a["stop"].alias("stop"))
    )


def _masked(pts: Points, cond) -> Column:
    return F.transform(col(pts), lambda p: F.coalesce(cond(p), F.lit(False)))


def trapezoid(pts: Points, x: str = "t", value: str = "i") -> Column:
    """Integral of value over x through the points where both are known; NULL below two."""

    def step(a: Column, p: Column) -> Column:
        area = (p[value] + a["y"]) / 2.0 * (p[x] - a["x"])
        return F.struct(
            p[x].alias("x"), p[value].alias("y"), (a["n"] + 1).alias("n"),
            F.when(a["n"] > 0, a["s"] + area).otherwise(F.lit(0.0)).alias("s"),
        )

    known = F.filter(col(pts), lambda p: p[x].isNotNull() & p[value].isNotNull())
    return F.aggregate(known, _zero(x="double", y="double", n="int", s="double"), step, lambda a: F.when(a["n"] >= 2, a["s"]))


def charge_ah(pts: Points) -> Column:
    """Trapezoidal integral of current over seconds, in ampere hours."""
    return trapezoid(pts) / 3600.0


def span(pts: Points, x: str = "t") -> Column:
    """Last minus first x; NULL below two points."""
    n = F.size(col(pts))
    return F.when(n >= 2, F.try_element_at(col(pts), F.lit(-1))[x] - F.try_element_at(col(pts), F.lit(1))[x])


def masked_duration(pts: Points, cond) -> Column:
    """Endpoint difference of the points that satisfy the condition."""
    return span(F.filter(col(pts), cond))


def run_slice(pts: Points, cond) -> Column:
    """Points of the longest run that satisfies the condition."""
    run = longest_run(_masked(pts, cond))
    return let(run, lambda r: F.slice(col(pts), r["start"] + 1, r["stop"] - r["start"]))


def low_current_window(pts: Points, thr: float = 0.5) -> Column:
    """Charge, duration and mean current of the longest run with current <= thr, anywhere."""

    def value(win: Column) -> Column:
        mean = F.aggregate(win, F.lit(0.0), lambda a, p: a + p["i"]) / F.size(win)
        got = F.struct(charge_ah(win).alias("ah"), span(win).alias("s"), mean.alias("i_mean"))
        return F.when(F.size(win) >= 2, got)

    return let(run_slice(pts, lambda p: p["i"] <= thr), value)


def positive_segments_ah(pts: Points) -> Column:
    """Sum of the integrals over every run of positive current, on the complete index.

    NULL without any positive point or below two points; isolated points add nothing.
    """

    def step(a: Column, p: Column) -> Column:
        on = F.coalesce(p["i"] > 0, F.lit(False))
        known = on & p["t"].isNotNull()
        area = F.when(known & a["on"], (p["i"] + a["y"]) / 2.0 * (p["t"] - a["x"])).otherwise(F.lit(0.0))
        return F.struct(
            F.when(known, p["t"]).otherwise(a["x"]).alias("x"),
            F.when(known, p["i"]).otherwise(a["y"]).alias("y"),
            (on & (known | a["on"])).alias("on"),
            (a["s"] + area).alias("s"),
            (a["any"] | on).alias("any"),
        )

    zero = _zero(x="double", y="double", on="boolean", s="double", any="boolean")
    out = F.aggregate(col(pts), zero, step, lambda a: F.when(a["any"], a["s"] / 3600.0))
    return F.when(F.size(col(pts)) >= 2, out)


def interpolate_at(pts: Points, value: str, xs: Sequence[float], x: str = "t") -> Column:
    """Linear interpolation at a few fixed positions; first value to the left, NULL to the right."""
    known = F.filter(col(pts), lambda p: p[x].isNotNull() & p[value].isNotNull())
    grid = F.array(*[F.lit(float(g)) for g in xs])

    def bracket(k: Column, g: Column) -> Column:
        lo = F.try_element_at(F.filter(k, lambda p: p[x] <= g), F.lit(-1))
        hi = F.try_element_at(F.filter(k, lambda p: p[x] >= g), F.lit(1))
        return F.struct(g.alias("g"), lo.alias("lo"), hi.alias("hi"))

    def at(b: Column) -> Column:
        lo, hi = b["lo"], b["hi"]
        w = (b["g"] - lo[x]) / (hi[x] - lo[x])
        inside = F.when(hi[x] == lo[x], lo[value]).otherwise(lo[value] + (hi[value] - lo[value]) * w)
        return F.when(lo.isNull(), hi[value]).when(hi.isNull(), F.lit(None).cast("double")).otherwise(inside)

    def values(k: Column) -> Column:
        made = F.transform(F.transform(grid, lambda g: bracket(k, g)), at)
        return F.when(F.size(k) >= 2, made)

    return let(known, values)


def _grid_udf(grid: Sequence[float], min_points: int):
    xs = np.asarray(grid, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def interpolate(v: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(v, q, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
            ok = np.isfinite(a) & np.isfinite(b)
            a, b = a[ok], b[ok]
            order = np.argsort(a, kind="stable")
            a, first = np.unique(a[order], return_index=True)
            if len(a) < min_points:
                out.append(None)
                continue
            out.append(np.interp(xs, a, b[order][first], left=np.nan, right=np.nan))
        return pd.Series(out, dtype=object)

    return interpolate


def resample(
    df: DataFrame, pts: str, grid: Sequence[float], x: str = "v", value: str = "q", out: str = "grid",
    min_points: int = 10,
) -> DataFrame:
    """Curve on a fixed grid (NULL outside) and the finite share ``{out}_share``.

    Points are sorted by x, the first of equal x wins; too few points give NULL and share 0.
    """
    udf = _grid_udf(grid, min_points)
    raw = udf(F.transform(col(pts), lambda p: p[x]), F.transform(col(pts), lambda p: p[value]))
    d = df.withColumn(out, raw)
    d = d.withColumn(out, F.transform(out, lambda g: F.when(~F.isnan(g), g)))
    share = F.size(F.filter(out, lambda g: g.isNotNull())) / F.lit(float(len(grid)))
    return d.withColumn(f"{out}_share", F.coalesce(share, F.lit(0.0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def early_stats(pts: Points, value: str, x: str = "t") -> Column:
    """Mean, population deviation and least-squares slope (0 for a zero span)."""
    known = F.filter(col(pts), lambda p: p[x].isNotNull() & p[value].isNotNull())

    def means(k: Column) -> Column:
        n = F.size(k).cast("double")
        return F.struct(
            k.alias("k"), n.alias("n"), (_sum(F.transform(k, lambda p: p[x])) / n).alias("mx"),
            (_sum(F.transform(k, lambda p: p[value])) / n).alias("my"),
        )

    def moments(s: Column) -> Column:
        return F.struct(
            s["n"].alias("n"), s["my"].alias("mean"),
            F.sqrt(_sum(F.transform(s["k"], lambda p: (p[value] - s["my"]) * (p[value] - s["my"]))) / s["n"]).alias("std"),
            _sum(F.transform(s["k"], lambda p: (p[x] - s["mx"]) * (p[value] - s["my"]))).alias("sxy"),
            _sum(F.transform(s["k"], lambda p: (p[x] - s["mx"]) * (p[x] - s["mx"]))).alias("sxx"),
        )

    def result(m: Column) -> Column:
        slope = F.when(m["sxx"] > 0, m["sxy"] / m["sxx"]).otherwise(0.0)
        return F.when(m["n"] >= 2, F.struct(m["mean"].alias("mean"), m["std"].alias("std"), slope.alias("slope")))

    return let(let(let(known, means), moments), result)


def early_layout(
    df: DataFrame, pts: str, channels: Sequence[str], times: Sequence[float], window: float,
    position: Column, conditions: Sequence[Column],
) -> DataFrame:
    """Wide early-window features: interpolated values, statistics, position / 200, conditions."""
    start = F.try_element_at(col(pts), F.lit(1))["t"]
    head = F.transform(
        F.filter(col(pts), lambda p: p["t"] - start <= window),
        lambda p: F.struct((p["t"] - start).alias("t"), *[p[c].alias(c) for c in channels]),
    )
    d = df.withColumn("__head", head)
    made: dict[str, Column] = {}
    for c in channels:
        d = d.withColumns({f"__at_{c}": interpolate_at("__head", c, times), f"__st_{c}": early_stats("__head", c)})
        for i, g in enumerate(times):
            made[f"{c}_at_{int(g)}"] = F.try_element_at(F.col(f"__at_{c}"), F.lit(i + 1))
        for s in ("mean", "std", "slope"):
            made[f"{c}_{s}"] = F.col(f"__st_{c}.{s}")
    made["position"] = position / 200.0
    for i, cond in enumerate(conditions):
        made[f"condition_{i + 1}"] = cond.cast("double")
    d = d.withColumns(made)
    return d.drop("__head", *[f"__at_{c}" for c in channels], *[f"__st_{c}" for c in channels])


def difference_scalar(
    df: DataFrame, entity: Sequence[str], cycle: str, pts: str, grid: Sequence[float], early: int, late: int,
    min_share: float = 0.99,
) -> DataFrame:
    """log10 of the variance of Q_late(V) - Q_early(V); NULL with a reason when undefined.

    Only the two wanted cycles of each entity are resampled.
    """
    lengths = df.groupBy(*entity).agg(F.max(cycle).alias("n_cycles"))
    two = df.filter(F.col(cycle).isin(early, late))
    g = resample(two, pts, grid)
    pick = [
        F.max(F.when(F.col(cycle) == c, F.struct("grid", "grid_share"))).alias(n)
        for c, n in ((early, "__a"), (late, "__b"))
    ]
    d = key_join(lengths, g.groupBy(*entity).agg(*pick), entity, "left")
    share = F.least(F.coalesce(F.col("__a.grid_share"), F.lit(0.0)), F.coalesce(F.col("__b.grid_share"), F.lit(0.0)))
    diff = F.filter(F.zip_with("__b.grid", "__a.grid", lambda b, a: b - a), lambda v: v.isNotNull())
    d = d.withColumns({"share": share, "__d": diff})
    n = F.size("__d").cast("double")
    mean = _sum(F.col("__d")) / n
    d = d.withColumn("__m", mean)
    var = _sum(F.transform("__d", lambda v: (v - F.col("__m")) * (v - F.col("__m")))) / n
    d = d.withColumn("__var", var)
    enough = F.col("n_cycles") >= late
    ok = enough & (F.col("share") >= min_share) & (F.col("__var") > 0)
    reason = F.when(~enough, "too_few_cycles").when(F.col("share") < min_share, "grid_not_finite").when(
        ~(F.col("__var") > 0), "no_variance"
    )
    return d.select(*entity, "n_cycles", "share", F.when(ok, F.log10("__var")).alias("scalar"), reason.alias("reason"))


def charge_windows(pts: Points, v_cut: float, i_min: float) -> dict[str, Column]:
    """Charge and duration of the constant-current and constant-voltage points of one cycle.

    Both integrals run over the selected points joined up, not per run.
    """
    cc = F.filter(col(pts), lambda p: (p["v"] <= v_cut) & (p["i"] >= i_min))
    cv = F.filter(col(pts), lambda p: p["v"] >= v_cut)
    return {"cc_ah": charge_ah(cc), "cc_s": span(cc), "cv_ah": charge_ah(cv), "cv_s": span(cv)}


def entity_medians(df: DataFrame, entity: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return quantiles(df, entity, {c: (c, 0.5) for c in cols})


def charge_readings(df: DataFrame, entity: Sequence[str], cycle: str, ah: str, early: int, late: int) -> DataFrame:
    """Charge at two cycles and its lifetime median."""
    at = [
        F.max(F.when(F.col(cycle) == early, F.col(ah))).alias("ah_early"),
        F.max(F.when(F.col(cycle) == late, F.col(ah))).alias("ah_late"),
    ]
    return quantiles(df, entity, {"ah_median": (ah, 0.5)}, extra=at)


def reconcile(ours: DataFrame, released: DataFrame, entity: Sequence[str], cols: Sequence[str], limit: float = 0.01) -> DataFrame:
    """Relative deviation per column between two sources and whether all stay within the limit."""
    r = released.select(*entity, *[F.col(c).alias(f"__r_{c}") for c in cols])
    d = key_join(ours, r, entity)
    dev = {f"{c}_dev": F.abs(F.col(c) - F.col(f"__r_{c}")) / F.abs(F.col(f"__r_{c}")) for c in cols}
    d = d.withColumns(dev)
    ok = F.lit(True)
    for c in dev:
        ok = ok & F.coalesce(F.col(c) <= limit, F.lit(False))
    return d.select(*entity, *dev, ok.alias("reconciled"))


def closure(df: DataFrame, entity: Sequence[str], cycle: str, pts: str, cycles: Sequence[int]) -> DataFrame:
    """Largest gap between the charge integral and the last counter value at chosen cycles."""
    d = df.filter(F.col(cycle).isin(list(cycles)))
    last = F.try_element_at(col(pts), F.lit(-1))["q"]
    d = d.withColumn("__gap", F.abs(charge_ah(pts) - last))
    return d.groupBy(*entity).agg(F.max("__gap").alias("max_gap"), F.count("__gap").alias("n_checked"))


def coverage_by_status(df: DataFrame, library: Sequence[str], status: str) -> DataFrame:
    return df.groupBy(*library).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(status) == "ok").alias("n_ok"),
        F.count_if(F.col(status) == "insufficient_cycles").alias("n_insufficient"),
        F.avg((F.col(status) == "ok").cast("double")).alias("share_ok"),
    )


def scalar_status(scalar: str, reason: str) -> Column:
    """Entity status; a curve that is not finite enough also counts as insufficient."""
    return (
        F.when(F.col(scalar).isNotNull(), "ok")
        .when(F.col(reason).isin("too_few_cycles", "grid_not_finite"), "insufficient_cycles")
        .otherwise("undefined")
    )
