"""Rank tests, bootstrap intervals, randomisation inference and gate calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclograin.functions.stats import (
    binomial_tail_col,
    correlation_p_col,
    rank_sum_p_col,
    signed_rank_p_col,
)
from cyclograin.operators.attach import attach, key_join, settled
from cyclograin.operators.ordered import Ordered, fits_one_task, ordinal, running_sum, total
from cyclograin.operators.ranks import complement_quantiles, quantiles, top_n, with_average_rank, with_average_ranks
from cyclograin.operators.sampling import bootstrap_sums

# an interpolated grid point may sit one rounding step beside the value it stands for
GRID_TOLERANCE = 1e-9


def spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 4, with_p: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Rank correlation with averaged ties; NULL below ``min_n`` complete pairs."""
    keys = list(by) or ["__all"]
    d = df if by else df.withColumn("__all", F.lit(0))
    d = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    if not fits_one_task(d):
        d = settled(d)  # counted and ranked by either column
    d = with_average_ranks(d, keys, {"__rx": "__x", "__ry": "__y"}, max_rows)
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("__rx", "__ry").alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))
    if with_p:
        out = out.withColumn("p", correlation_p_col(F.coalesce("rho", F.lit(float("nan"))), "n"))
    return out if by else out.drop("__all")


def signed_rank_stats(df: DataFrame, by: Sequence[str], a: str, b: str, max_rows: int | None = None) -> DataFrame:
    """Sum of positive ranks, tie term, win rate and mean difference of paired columns."""
    d = df.withColumn("__d", F.col(a) - F.col(b))
    basic = d.groupBy(*by).agg(
        F.avg("__d").alias("mean_diff"),
        F.avg((F.col("__d") > 0).cast("double")).alias("win_rate"),
        F.count("__d").alias("n_pairs"),
    )
    nz = d.filter(F.col("__d") != 0).withColumn("__abs", F.abs("__d"))
    nz = with_average_rank(nz, by, "__abs", "__r", max_rows)
    w = nz.groupBy(*by).agg(
        F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"),
        F.count(F.lit(1)).alias("n_used"),
    )
    ties = nz.groupBy(*by, "__abs").agg(F.count(F.lit(1)).alias("c"))
    ties = ties.groupBy(*by).agg(F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"))
    return key_join(key_join(basic, w, by, "left"), ties, by, "left").na.fill(0, ["w_plus", "n_used", "ties"])


def paired_wilcoxon(df: DataFrame, by: Sequence[str], a: str, b: str, max_rows: int | None = None) -> DataFrame:
    """Paired signed-rank test; p = 1 when all pairs are equal."""
    s = signed_rank_stats(df, by, a, b, max_rows)
    exact = (F.col("ties") == 0) & (F.col("n_used") == F.col("n_pairs"))
    return s.withColumn("p", signed_rank_p_col("n_used", "w_plus", "ties", exact))


def rank_sum_stats(df: DataFrame, by: Sequence[str], is_first: str, value: str, max_rows: int | None = None) -> DataFrame:
    """Mann-Whitney U of the first sample, sizes and tie term."""
    d = with_average_rank(df, by, value, "__r", max_rows)
    n1 = F.sum(F.col(is_first).cast("double"))
    r1 = F.sum(F.when(F.col(is_first), F.col("__r")))
    u = d.groupBy(*by).agg(
        F.count_if(F.col(is_first)).alias("n1"), F.count_if(~F.col(is_first)).alias("n2"),
        (r1 - n1 * (n1 + 1) / 2.0).alias("u1"),
    )
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    ties = ties.groupBy(*by).agg(F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"))
    return key_join(u, ties, by)


def mann_whitney(df: DataFrame, by: Sequence[str], is_first: str, value: str, max_rows: int | None = None) -> DataFrame:
    s = rank_sum_stats(df, by, is_first, value, max_rows)
    return s.withColumn("p", rank_sum_p_col("n1", "n2", "u1", "ties"))


def holm(tests: DataFrame, family: Sequence[str], name: str, p: str, out: str = "p_holm") -> DataFrame:
    """Step-down correction within each family of tests (one row per test)."""
    d = Ordered(tests, family, [p, name]).with_scans(__i=ordinal(), __m=total(F.count(F.lit(1))))
    d = d.withColumn("__s", (F.col("__m") - F.col("__i")) * F.col(p))
    w = Window.partitionBy(*family).orderBy(p, name).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.least(F.lit(1.0), F.max("__s").over(w))).drop("__i", "__m", "__s")


def indexed(items: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the items of a group 0..n-1 (``slot``) and attach the group size (``size``)."""
    return Ordered(items, group, order).with_scans(slot=ordinal(), size=total(F.count(F.lit(1))))


def bootstrap_means(
    items: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """Mean of each bootstrap replicate: one row per (group, b), in one pass over the items.

    Weights are Poisson, so a replicate's size varies about the group's; one that takes no row has no mean.
    """
    sums = bootstrap_sums(items, group, order, value, n_boot, seed)
    return sums.select(*group, "b", F.try_divide("total", "weight").alias("mean"))


def bootstrap_interval(
    items: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n_boot: int = 2000,
    seed: int = 0, level: float = 0.95,
) -> DataFrame:
    tail = (1.0 - level) / 2.0
    items = settled(items.select(*group, *order, value))
    means = bootstrap_means(items, group, order, value, n_boot, seed)
    ci = quantiles(means, group, {"ci_lo": ("mean", tail), "ci_hi": ("mean", 1.0 - tail)}, bounded=True)
    stats = items.groupBy(*group).agg(F.avg(value).alias("mean_diff"), F.count(value).alias("n_entities"))
    return key_join(stats, ci, group)


def bootstrap_decision(
    items: DataFrame, group: Sequence[str], order: Sequence[str], diff: str, n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """history / raw / abstain from the interval of the paired difference history - raw."""
    d = bootstrap_interval(items, group, order, diff, n_boot, seed)
    decision = F.when(F.col("ci_hi") < 0, "history").when(F.col("ci_lo") > 0, "raw").otherwise("abstain")
    return d.withColumn("decision", decision)


def relative_bootstrap(
    ours: DataFrame, theirs: DataFrame, group: Sequence[str], order: Sequence[str], value: str,
    n_boot: int = 5000, seed: int = 0,
) -> DataFrame:
    """Interval of 100 * (mean(ours) - mean(theirs)) / mean(theirs) under two-sample resampling."""
    a = bootstrap_means(ours, group, order, value, n_boot, seed).withColumnRenamed("mean", "__a")
    b = bootstrap_means(theirs, group, order, value, n_boot, seed + 1).withColumnRenamed("mean", "__b")
    d = key_join(a, b, [*group, "b"]).withColumn("delta", (F.col("__a") - F.col("__b")) / F.col("__b") * 100.0)
    return quantiles(d, group, {"ci_lo": ("delta", 0.025), "ci_hi": ("delta", 0.975)}, bounded=True)


def majority_vote(votes: DataFrame, by: Sequence[str], decision: str) -> DataFrame:
    """Most frequent decision; a tie abstains."""
    counts = votes.groupBy(*by, decision).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*by).agg(
        F.max("c").alias("votes"), F.max_by(decision, "c").alias("__top"), F.collect_list("c").alias("__cs")
    )
    leaders = F.size(F.filter("__cs", lambda c: c == F.col("votes")))
    return best.select(*by, F.when(leaders == 1, F.col("__top")).otherwise("abstain").alias("final"), "votes")


def randomisation_p(observed: DataFrame, null: DataFrame, by: Sequence[str], stat: str) -> DataFrame:
    """(1 + #{null <= observed}) / (M + 1), with the null's median and range."""
    d = key_join(null, observed.withColumnRenamed(stat, "__obs"), by) if by else null.crossJoin(
        F.broadcast(observed.withColumnRenamed(stat, "__obs"))
    )
    counts = [
        F.max("__obs").alias("observed"),
        F.count_if(F.col(stat) <= F.col("__obs")).alias("n_le"),
        F.count(F.lit(1)).alias("n_draws"),
        F.min(stat).alias("null_min"),
        F.max(stat).alias("null_max"),
    ]
    out = quantiles(d, by, {"null_median": (stat, 0.5)}, extra=counts)
    return out.withColumn("p", (F.col("n_le") + 1.0) / (F.col("n_draws") + 1.0))


def _grid(found: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return found.select(*by, F.array_sort(F.array_distinct(F.array(*measures))).alias("__grid"))


def _slot(stat: str) -> Column:
    """Grid points below the row's statistic."""
    return F.size(F.filter("__grid", lambda g: F.col(stat) - g > GRID_TOLERANCE))


def gate_trace(
    cal: DataFrame, by: Sequence[str], stat: str, harm: str, alpha: float = 0.1, risk: float = 0.1, n_grid: int = 30
) -> DataFrame:
    """Fixed-sequence trace: per threshold the covered rows, harms, tail p and acceptance.

    Each calibration row falls into one grid cell, so counting is one small aggregate and
    the cumulative counts run over at most ``n_grid`` rows per group.
    """
    measures = {f"__q{i:03d}": (stat, i / (n_grid - 1)) for i in range(n_grid)}
    grid = _grid(quantiles(cal, by, measures), by, list(measures))
    cells = attach(cal, grid, by).withColumn("__slot", _slot(stat)).groupBy(*by, "__slot").agg(
        F.count(F.lit(1)).alias("__c"), F.sum(F.col(harm).cast("int")).alias("__h")
    )
    return _accepted(grid, cells, by, alpha, risk)


def _accepted(grid: DataFrame, cells: DataFrame, by: Sequence[str], alpha: float, risk: float) -> DataFrame:
    """The trace from the grid of each group and the rows and harms of its cells."""
    points = grid.select(*by, F.posexplode("__grid").alias("__slot", "lam"))
    w = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    t = key_join(points, cells, [*by, "__slot"], "left").withColumns(
        {
            "n": F.coalesce(F.sum("__c").over(w), F.lit(0)),
            "harm": F.coalesce(F.sum("__h").over(w), F.lit(0)),
        }
    ).filter(F.col("n") > 0)
    t = t.withColumn("p", binomial_tail_col("harm", "n", F.lit(risk)))
    ok = F.col("p") > alpha + 1e-12
    before = F.min(ok.cast("int")).over(w)
    return t.select(*by, "lam", "n", "harm", "p", ok.alias("accept"), (before == 1).alias("reached"))


def gate_calibrate(
    cal: DataFrame, by: Sequence[str], stat: str, harm: str, alpha: float = 0.1, risk: float = 0.1, n_grid: int = 30
) -> DataFrame:
    """Largest threshold accepted before the first failure; -infinity when there is none."""
    return _largest_accepted(gate_trace(cal, by, stat, harm, alpha, risk, n_grid), by)


def _largest_accepted(t: DataFrame, by: Sequence[str]) -> DataFrame:
    best = F.max(F.when(F.col("reached"), F.col("lam")))
    return t.groupBy(*by).agg(F.coalesce(best, F.lit(float("-inf"))).alias("lam_star"))


def _covered(values: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and harms at or below each grid point (with the grid's tolerance): one scan of values and points."""
    keys = list(by) or ["__all"]
    if not by:
        values, points = values.withColumn("__all", F.lit(0)), points.withColumn("__all", F.lit(0))
    none = F.lit(None).cast("double")
    # a value counts for a point up to the tolerance above it; values stand before points at equal places
    v = values.select(*keys, F.col("__v").alias("__at"), F.lit(0).alias("__kind"), none.alias("__g"), "__c", "__h")
    zero = F.lit(0).cast("bigint")
    p = points.select(*keys, (F.col("__g") + GRID_TOLERANCE).alias("__at"), F.lit(1).alias("__kind"), "__g", zero.alias("__c"), zero.alias("__h"))
    d = Ordered(v.unionByName(p), keys, ["__at", "__kind"]).with_scans(__n=running_sum("__c"), __bad=running_sum("__h"))
    return d.filter("__kind = 1").select(*by, "__g", "__n", "__bad")


def gate_policies(
    cells: DataFrame, unit: str, stat: str, none: str, projected: str, direction: str = "le",
    alpha: float = 0.1, risk: float = 0.1, n_grid: int = 30,
) -> DataFrame:
    """Never / always / gated unit means with thresholds calibrated on all other units.

    ``cells`` has one row per entity and is never copied per unit. The grids of all complements come from
    counted values. Every distinct (unit, statistic, harm) is counted once; a complement's cells are the overall
    counts in its grid less the unit's own, both found by placing distinct grid points among distinct values.
    """
    sign = 1.0 if direction == "le" else -1.0
    d = cells.withColumns({"__v": F.col(stat) * sign, "__harm": F.col(projected) > F.col(none)})
    measures = {f"__q{i:03d}": ("__v", i / (n_grid - 1)) for i in range(n_grid)}
    grid = settled(_grid(complement_quantiles(d, unit, measures), [unit], list(measures)))
    points = grid.select(unit, F.posexplode("__grid").alias("__slot", "__g"))
    seen = settled(d.filter(F.col("__v").isNotNull()).groupBy(unit, "__v").agg(F.count(F.lit(1)).alias("__c"), F.sum(F.col("__harm").cast("int")).alias("__h")))
    overall = _covered(seen.groupBy("__v").agg(F.sum("__c").alias("__c"), F.sum("__h").alias("__h")), points.select("__g").distinct(), [])
    own = _covered(seen, points.select(unit, "__g"), [unit])
    both = key_join(key_join(points, overall, ["__g"]), own.withColumnsRenamed({"__n": "__n_own", "__bad": "__bad_own"}), [unit, "__g"])
    # rows up to each point, as differences between successive points
    w = Window.partitionBy(unit).orderBy("__slot")
    both = both.withColumns({"__n": F.col("__n") - F.col("__n_own"), "__bad": F.col("__bad") - F.col("__bad_own")})
    counted = both.select(unit, "__slot", (F.col("__n") - F.coalesce(F.lag("__n").over(w), F.lit(0))).alias("__c"), (F.col("__bad") - F.coalesce(F.lag("__bad").over(w), F.lit(0))).alias("__h"))
    lam = _largest_accepted(_accepted(grid, counted, [unit], alpha, risk), [unit]).withColumnRenamed(unit, "__target")
    d = attach(d, lam.withColumnRenamed("__target", unit), [unit])
    apply_it = F.col("__v") - F.col("lam_star") <= GRID_TOLERANCE
    return d.groupBy(unit).agg(
        F.avg(none).alias("never"),
        F.avg(projected).alias("always"),
        F.avg(F.when(apply_it, F.col(projected)).otherwise(F.col(none))).alias("gated"),
        F.avg(apply_it.cast("double")).alias("apply_rate"),
        F.max(sign * F.col("lam_star")).alias("lam"),
    )


def compare_methods(df: DataFrame, pair: Sequence[str], method: str, score: str, baseline: str) -> DataFrame:
    """Every method against the baseline on shared pairs: summary and signed-rank test."""
    base = df.filter(F.col(method) == baseline).select(*pair, F.col(score).alias("__base"))
    d = key_join(df.filter(F.col(method) != baseline), base, pair)
    guard = df.agg(F.count_if(F.col(method) == baseline).alias("__has"))
    d = d.crossJoin(F.broadcast(guard))
    d = d.filter(
        F.when(F.col("__has") == 0, F.raise_error(F.lit(f"baseline {baseline} missing")).isNull()).otherwise(True)
    )
    test = paired_wilcoxon(d, [method], score, "__base")
    stats = d.groupBy(method).agg(
        F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std")
    )
    return stats.join(test.select(method, "p", "mean_diff", "win_rate", "n_pairs"), method)


def select_config(estimates: DataFrame, by: Sequence[str], config: str, est: str, se: str, default: str) -> DataFrame:
    """Smallest estimate wins unless the runner-up is within the pooled error."""
    two = top_n(estimates, by, [F.col(est), F.col(config)], 2)

    def pick(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    d = two.groupBy(*by).agg(
        pick(1, config).alias("best"),
        (pick(2, est) - pick(1, est)).alias("gap"),
        F.sqrt(pick(1, se) * pick(1, se) + pick(2, se) * pick(2, se)).alias("pooled_se"),
    )
    tie = F.col("gap") < F.col("pooled_se")
    return d.select(
        *by, F.when(tie, F.lit(default)).otherwise(F.col("best")).alias("selected"),
        # The two reasons.
        F.when(tie, "tie->default").otherwise("clear-min").alias("reason"), "gap", "pooled_se",
    )


def cluster_mean_se(df: DataFrame, by: Sequence[str], entity: str, value: str) -> DataFrame:
    """Mean and standard error with the entity as the unit of independence."""
    per = df.groupBy(*by, entity).agg(F.avg(value).alias("__m"))
    n = F.count(F.lit(1))
    return per.groupBy(*by).agg(
        F.avg("__m").alias("est_macro"),
        F.when(n > 1, F.stddev_samp("__m") / F.sqrt(n.cast("double"))).otherwise(0.0).alias("se"),
        n.alias("n_entities"),
    )
