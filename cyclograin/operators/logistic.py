"""Logistic regression of all groups and folds at once by Newton steps from summed moments.

One job per step serves every model: each row adds its gradient and curvature to the model's sums
(partial aggregation, so a model of any size is one row per task), and the small systems are
solved where the sums are. The driver learns only whether any model is still open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.operators.attach import attach, settled


def _standard(xs: Sequence[str], model: Column) -> list[Column]:
    """Columns in units of their deviation about the model's means; a constant column is zero, an unknown one NULL."""
    gaps = [F.col(x) - model["mean"][j] for j, x in enumerate(xs)]
    return [F.when(model["sd"][j] > 0, g / model["sd"][j]).otherwise(g * 0) for j, g in enumerate(gaps)]


def _logit(xs: Sequence[str], model: Column) -> Column:
    return sum((model["w"][j + 1] * z for j, z in enumerate(_standard(xs, model))), model["w"][0])


def _solver(k: int, reg: float, tol: float):
    """A Newton step per row of sums, or half of the last one where it made the loss worse."""
    upper = np.triu_indices(k)
    penalty = np.r_[0.0, np.full(k - 1, reg)]

    def solve(w: np.ndarray, base: np.ndarray, base_loss: float, sums: np.ndarray, n: float):
        loss = sums[0] / n + 0.5 * penalty @ (w * w)
        if loss > base_loss + 1e-12 * abs(base_loss):
            new = base + 0.5 * (w - base)
            return new, base, base_loss, bool(np.max(np.abs(new - base)) < tol)
        curvature = np.zeros((k, k))
        curvature[upper] = sums[1 + k :] / n
        curvature = curvature + np.triu(curvature, 1).T + np.diag(penalty)
        move = np.linalg.lstsq(curvature, sums[1 : 1 + k] / n + penalty * w, rcond=None)[0]
        done = bool(np.max(np.abs(move)) < tol)
        return w - move, w, loss, done

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            made = [solve(np.array(w), np.array(b), lo, np.array(s), n) for w, b, lo, s, n in zip(d["w"], d["base"], d["base_loss"], d["sums"], d["n"], strict=True)]
            out = d.drop(columns=["sums"])
            for i, c in enumerate(("w", "base")):
                out[c] = pd.Series([m[i].tolist() for m in made], index=d.index, dtype=object)
            out["base_loss"], out["done"] = [m[2] for m in made], [m[3] for m in made]
            yield out

    return run


def fit(
    df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, reg: float = 0.0, fold: str | None = None,
    n_folds: int = 0, max_steps: int = 50, tol: float = 1e-8,
) -> DataFrame:
    """Models of a 0/1 label, one per group: ``by``, n, mean, sd, w (intercept first), base, base_loss, done.

    Minimises the mean log-loss plus reg/2 times the squared slopes of the standardised columns (sample
    deviation). With ``fold`` and ``n_folds`` there is one model per group and held-out fold, fitted on the
    group's other folds and keyed by that column. Rows with a NULL column, label or fold teach nothing; a
    group without rows has no model. Where all labels agree the slopes are 0 and the intercept is infinite, so
    the probability is exactly that label. ``done`` tells whether a model settled within ``max_steps``.
    """
    by, k = list(by), len(xs) + 1
    d = df.select(*by, *([fold] if fold else []), *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("__y"))
    d = d.dropna(subset=[*xs, "__y", *([fold] if fold else [])])
    if fold:
        held = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col(fold))
        d = d.withColumn(fold, F.explode(held))
        by = [*by, fold]
    stats = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("__share"),
        F.array(*[F.avg(x) for x in xs]).alias("mean"), F.array(*[F.coalesce(F.stddev_samp(x), F.lit(0.0)) for x in xs]).alias("sd"),
    )
    share = F.col("__share")
    start = F.when(share == 0, float("-inf")).when(share == 1, float("inf")).otherwise(F.ln(share / (1 - share)))
    weights = F.array(start, *[F.lit(0.0)] * len(xs))
    one_class = (share == 0) | (share == 1)
    models = stats.withColumns({"w": weights, "base": weights, "base_loss": F.lit(float("inf")), "done": one_class}).drop("__share")
    models = settled(models)
    finished = models.filter("done")
    models = models.filter("NOT done")

    z = [F.lit(1.0), *[F.col(f"__z{j}") for j in range(1, k)]]
    # ln(1 + e^t) without overflow
    loss = F.greatest(F.col("__t"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("__t"))) - F.col("__y") * F.col("__t")
    gap, curve = F.col("__p") - F.col("__y"), F.col("__p") * (1 - F.col("__p"))
    sums = [F.sum(loss), *[F.sum(gap * v) for v in z], *[F.sum(curve * z[i] * z[j]) for i in range(k) for j in range(i, k)]]
    solve = _solver(k, reg, tol)
    for _ in range(max_steps):
        if models.isEmpty():
            break
        rows = attach(d, models.select(*by, F.struct("mean", "sd", "w").alias("__m")), by)
        m = F.col("__m")
        rows = rows.select(*by, "__y", _logit(xs, m).alias("__t"), *[v.alias(f"__z{j + 1}") for j, v in enumerate(_standard(xs, m))])
        rows = rows.withColumn("__p", 1 / (1 + F.exp(-F.col("__t"))))
        found = attach(models, rows.groupBy(*by).agg(F.array(*sums).alias("sums")), by)
        models = settled(found.mapInPandas(solve, T.StructType(models.schema.fields)))
        finished = finished.unionByName(models.filter("done"))
        models = models.filter("NOT done")
    return finished.unionByName(models)


def predict(df: DataFrame, models: DataFrame, by: Sequence[str], xs: Sequence[str], out: str = "proba") -> DataFrame:
    """Probability of label 1 by the model of the row's group; NULL without a model or with a NULL column."""
    m = F.col("__m")
    d = attach(df, models.select(*by, F.struct("mean", "sd", "w").alias("__m")), by, "left")
    p = 1 / (1 + F.exp(-_logit(xs, m)))
    return d.withColumn(out, p).drop("__m")


def coefficients(models: DataFrame, by: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Intercept and slopes in the columns' own units; the intercept is NULL where all labels agree (it is infinite)."""
    w = F.col("w")
    slope = [F.when(F.col("sd")[j] > 0, w[j + 1] / F.col("sd")[j]).otherwise(0.0) for j in range(len(xs))]
    base = w[0] - sum((s * F.col("mean")[j] for j, s in enumerate(slope)), F.lit(0.0))
    base = F.when(F.abs(w[0]) != float("inf"), base)
    return models.select(*by, "n", base.alias("b0"), *[s.alias(f"b_{x}") for s, x in zip(slope, xs, strict=True)])


def out_of_fold(df: DataFrame, by: Sequence[str], fold: str, n_folds: int, xs: Sequence[str], y: str, reg: float = 0.0, out: str = "proba") -> DataFrame:
    """Probability of every row by its group's model fitted without the row's fold."""
    return predict(df, fit(df, by, xs, y, reg, fold, n_folds), [*by, fold], xs, out)
