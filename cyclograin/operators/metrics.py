"""Scores, aggregation over seeds and units, and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclograin.functions import delta_pct, rmse
from cyclograin.operators.attach import key_join
from cyclograin.operators.ranks import quantiles, with_average_rank


def overall_rmse(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(rmse(y, pred).alias("rmse_overall"))


def entity_rmse(df: DataFrame, by: Sequence[str], entity: str, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by, entity).agg(rmse(y, pred).alias("rmse"), F.count(F.lit(1)).alias("n"))


def macro_rmse(df: DataFrame, by: Sequence[str], entity: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Overall and entity-macro error from one pass: squared errors are summed per entity."""
    d = F.col(y) - F.col(pred)
    per = df.groupBy(*by, entity).agg(F.sum(d * d).alias("__s"), F.count(d).alias("__n"))
    return per.groupBy(*by).agg(
        F.sqrt(F.sum("__s") / F.sum("__n")).alias("rmse_overall"),
        F.avg(F.sqrt(F.col("__s") / F.col("__n"))).alias("rmse_macro"),
        F.count(F.lit(1)).alias("n_entities"),
    )


def entity_map(
    per_entity: DataFrame, by: Sequence[str], entity: str, value: str, out: str = "per_entity", limit: int = 10_000
) -> DataFrame:
    """Maps entity -> value per run for result archives, about ``limit`` entities in a row.

    A run with more entities gets several rows, numbered by ``part``; none is refused or cut.
    """
    sizes = per_entity.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(limit))).alias("__parts"))
    d = key_join(per_entity, sizes, by).withColumn("part", F.pmod(F.hash(entity), F.col("__parts")).cast("int"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(entity).cast("string"), F.col(value))))
    return d.groupBy(*by, "part").agg(F.map_from_entries(pairs).alias(out))


def regression_scores(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    e = F.col(pred) - F.col(y)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(e).alias("bias"),
        F.stddev_pop(e).alias("residual_std"),
    )


def accuracy(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Unweighted mean of the per-class F1 over the classes that occur in either column."""
    pairs = df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("__n"))
    hit = F.when(F.col(y) == F.col(pred), F.col("__n")).otherwise(0)
    truth = pairs.groupBy(*by, F.col(y).alias("__c")).agg(F.sum("__n").alias("__t"), F.sum(hit).alias("__tp"))
    guess = pairs.groupBy(*by, F.col(pred).alias("__c")).agg(F.sum("__n").alias("__g"))
    both = truth.join(guess, [*by, "__c"], "full").na.fill(0, ["__t", "__tp", "__g"])
    return both.groupBy(*by).agg(F.avg(2.0 * F.col("__tp") / (F.col("__t") + F.col("__g"))).alias("macro_f1"))


def binary_auc(df: DataFrame, by: Sequence[str], y: str, score: str, max_rows: int | None = None) -> DataFrame:
    """Area under the curve by average ranks; NULL when a class is missing."""
    d = with_average_rank(df, by, score, "__rank", max_rows)
    pos = F.sum((F.col(y) == 1).cast("double"))
    neg = F.sum((F.col(y) == 0).cast("double"))
    up = F.sum(F.when(F.col(y) == 1, F.col("__rank")))
    value = (up - pos * (pos + 1) / 2.0) / (pos * neg)
    return d.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), value).alias("auc"))


def multiclass_auc(df: DataFrame, by: Sequence[str], y: str, proba: str, n_classes: int) -> DataFrame:
    """One-vs-rest macro area; NULL when any class is missing."""
    d = df.select(*by, y, F.posexplode(proba).alias("__class", "__score"))
    d = d.withColumn("__y", (F.col(y) == F.col("__class")).cast("int"))
    per = binary_auc(d, [*by, "__class"], "__y", "__score")
    full = F.count("auc") == n_classes
    return per.groupBy(*by).agg(F.when(full, F.avg("auc")).alias("auc"))


def log_loss(p_true: str | Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean clipped negative log-probability of the true class."""
    p = F.col(p_true) if isinstance(p_true, str) else p_true
    return F.avg(-F.ln(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))))


def seed_summary(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Mean, median, sample deviation (0 for one seed), extremes and count over seeds."""
    stats = [
        F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        F.count(metric).alias("n"),
    ]
    return quantiles(df, by, {"median": (metric, 0.5)}, extra=stats)


def paired_delta(df: DataFrame, by: Sequence[str], arm: str, metric: str, base: str, arms: Sequence[str]) -> DataFrame:
    """Percent change of every arm against the base arm within the same key."""
    wide = df.groupBy(*by).agg(
        *[F.max(F.when(F.col(arm) == a, F.col(metric))).alias(f"__{a}") for a in [base, *arms]]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(a).alias(arm), delta_pct(f"__{a}", f"__{base}").alias("delta")) for a in arms])
    )
    d = wide.select(*by, rows.alias("__d")).select(*by, f"__d.{arm}", "__d.delta")
    return d.filter(F.col("delta").isNotNull())


def delta_verdict(deltas: DataFrame, by: Sequence[str], need: int) -> DataFrame:
    """Median change, number improved, and whether at least ``need`` improved."""
    counts = [F.count_if(F.col("delta") < 0).alias("improved"), F.count(F.lit(1)).alias("n_units")]
    out = quantiles(deltas, by, {"median_delta": ("delta", 0.5)}, extra=counts)
    return out.withColumn("holds", F.col("improved") >= need)


def library_aggregate(df: DataFrame, library: str, rule: str, value: str, weight: str) -> DataFrame:
    """Per library: macro mean, weighted mean or the single value, by a rule column."""
    v, w = F.col(value), F.col(weight)
    r = F.max(rule)
    return df.groupBy(library).agg(
        F.when(r == "macro", F.avg(v)).when(r == "weighted", F.sum(v * w) / F.sum(w)).otherwise(F.max(v)).alias("score")
    )


def mean_ensemble(df: DataFrame, by: Sequence[str], y: str, members: Sequence[str]) -> DataFrame:
    """Member errors, ensemble error, better-than-all flag and the convexity check."""
    ens = sum(F.col(m) for m in members) / float(len(members))
    d = df.withColumn("__ens", ens)
    mse = [F.avg(F.pow(F.col(y) - F.col(m), F.lit(2.0))).alias(f"mse_{m}") for m in members]
    out = d.groupBy(*by).agg(*mse, F.avg(F.pow(F.col(y) - F.col("__ens"), F.lit(2.0))).alias("mse_ensemble"))
    cols = [F.col(f"mse_{m}") for m in members]
    return out.withColumns(
        {
            "beats_all": F.col("mse_ensemble") < F.least(*cols),
            "within_bound": F.col("mse_ensemble") <= sum(cols) / float(len(members)) + 1e-12,
        }
    )


def bias_diversity(df: DataFrame, by: Sequence[str], y: str, p: str, q: str) -> DataFrame:
    """Member errors, the diversity term E[(p - q)^2] / 4 and the residual correlation."""
    ep, eq = F.col(y) - F.col(p), F.col(y) - F.col(q)
    gap = F.col(p) - F.col(q)
    return df.groupBy(*by).agg(
        F.avg(ep * ep).alias("mse_p"), F.avg(eq * eq).alias("mse_q"),
        (F.avg(gap * gap) / 4.0).alias("diversity"), F.corr(ep, eq).alias("residual_corr"),
    )


def selection_regret(picked: DataFrame, scores: DataFrame, by: Sequence[str], config: str, score: str) -> DataFrame:
    """Score of the picked configuration minus the best one."""
    best = scores.groupBy(*by).agg(F.min(score).alias("best"), F.min_by(config, score).alias("oracle"))
    mine = key_join(picked, scores, [*by, config]).select(*by, config, F.col(score).alias("got"))
    d = key_join(mine, best, by)
    return d.withColumn("regret", F.col("got") - F.col("best"))


def abstention_cost(df: DataFrame, a: str, b: str, half_ci: str, effect: str) -> DataFrame:
    """Abstaining = the mean of both arms: its cost against the best, gain over the worst, SNR."""
    mid = (F.col(a) + F.col(b)) / 2.0
    best, worst = F.least(a, b), F.greatest(a, b)
    return df.agg(
        F.avg(mid).alias("bound"),
        F.avg((mid - best) / best * 100.0).alias("cost_vs_best"),
        F.avg((worst - mid) / worst * 100.0).alias("gain_vs_worst"),
        (F.avg(F.abs(F.col(effect))) / F.avg(half_ci)).alias("snr"),
    )


def family_share(df: DataFrame, by: Sequence[str], family: str, importance: str) -> DataFrame:
    """Non-negative importance per family in percent of the total (0 when nothing is left)."""
    per = df.groupBy(*by, family).agg(F.sum(F.greatest(F.col(importance), F.lit(0.0))).alias("__s"))
    whole = F.sum("__s").over(Window.partitionBy(*by))
    return per.select(*by, family, F.when(whole > 0, F.col("__s") / whole * 100.0).otherwise(0.0).alias("share"))


def adjacent_ties(summary: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Neighbours in the order of falling means: gap, combined deviation, range overlap, rank by gap."""
    w = Window.partitionBy(*by).orderBy(F.col("mean").desc(), name)
    d = summary.withColumns(
        {
            "next_name": F.lead(name).over(w), "gap": F.col("mean") - F.lead("mean").over(w),
            "combined_std": F.sqrt(F.pow("std", F.lit(2.0)) + F.pow(F.lead("std").over(w), F.lit(2.0))),
            "overlap": F.lead("max").over(w) >= F.col("min"),
        }
    ).filter(F.col("next_name").isNotNull())
    close = Window.partitionBy(*by).orderBy("gap", name)
    return d.select(
        *by, name, "next_name", "gap", "combined_std", "overlap", F.row_number().over(close).alias("closeness")
    )


def archive_deviation(now: DataFrame, archived: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    d = key_join(now, archived.withColumnRenamed(value, "__old"), keys)
    gap = F.abs(F.col(value) - F.col("__old"))
    return d.agg(F.max(gap).alias("max_dev"), F.count_if(gap > limit).alias("n_over"), F.count(F.lit(1)).alias("n"))


def verdict_rows(df: DataFrame, criteria: dict[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """(criterion, value, holds) rows from ``{name: (value, condition)}``."""
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("criterion"), v.cast("double").alias("value"), ok.alias("holds"))
            for k, (v, ok) in criteria.items()
        ]
    )
    return df.select(*by, F.explode(rows).alias("__r")).select(*by, "__r.*")


def gating_retention(never: Column, gated: Column, always: Column) -> Column:
    """Share of the full gain a gate keeps; NULL where there is no gain to keep."""
    return F.when(never != always, (never - gated) / (never - always))


def gap_closed(online: Column, student: Column, teacher: Column, headroom: float) -> Column:
    """Share of the teacher's advantage the student reaches; NULL below the headroom."""
    room = (online - teacher) / online
    return F.when(room >= headroom, (online - student) / (online - teacher))


def group_mse(df: DataFrame, by: Sequence[str], entity: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """1000 times the mean over entities of the entity MSE."""
    e = F.col(y) - F.col(pred)
    per = df.groupBy(*by, entity).agg(F.avg(e * e).alias("__m"))
    return per.groupBy(*by).agg((F.avg("__m") * 1000.0).alias("mse_x1000"))


def single_protocol(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Refuse (inside the plan) to pass on rows that mix several values of a metadata column."""
    seen = df.agg(*[F.count_distinct(c).alias(f"__u_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(seen))
    for c in columns:
        bad = F.col(f"__u_{c}") > 1
        d = d.filter(F.when(bad, F.raise_error(F.lit(f"mixed values of {c}")).isNull()).otherwise(F.lit(True)))
    return d.drop(*seen.columns)


def retrospective(decisions: DataFrame, scores: DataFrame, by: Sequence[str], arm: str, score: str) -> DataFrame:
    """Rule decision against the post-hoc winner: hit, miss or abstain."""
    winner = scores.groupBy(*by).agg(F.min_by(arm, F.struct(score, arm)).alias("winner"))
    d = key_join(decisions, winner, by)
    outcome = F.when(F.col("decision") == "abstain", "abstain").when(
        F.col("decision") == F.col("winner"), "hit"
    ).otherwise("miss")
    return d.withColumn("outcome", outcome)


def instrument_control(deltas: DataFrame, by: Sequence[str], bound: float) -> DataFrame:
    """Median absolute change of an arm that should change nothing, and whether it stays under a bound."""
    d = deltas.withColumn("__abs", F.abs(F.col("delta")))
    out = quantiles(d, by, {"median_abs": ("__abs", 0.5)})
    return out.withColumn("holds", F.col("median_abs") <= bound)
