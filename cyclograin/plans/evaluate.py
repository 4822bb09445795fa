"""Evaluations composed from operators."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.functions import delta_pct, rmse
from cyclograin.operators import boosting, inference, linear, metrics, normalize, sampling, windows
from cyclograin.operators.attach import attach, key_join, settled
from cyclograin.operators.ordered import Ordered, first, ordinal, total


def missing_anchor(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], y: str, x: str,
    k0s: Sequence[int], min_rows: int = 20, share: float = 0.5,
) -> DataFrame:
    """Change of the anchored predictor when the first K0 rows of every entity are lost.

    Arms: ``x`` itself, and ``x`` minus a share of the first remaining row.
    """
    keys = [*unit, entity]
    d = Ordered(df.select(*keys, *order, y, x), keys, order).with_scans(
        __t=ordinal(), __n=total(F.count(F.lit(1)))
    )
    d = d.withColumn("k0", F.explode(F.array(*[F.lit(k) for k in k0s])))
    d = d.filter((F.col("__t") >= F.col("k0")) & (F.col("__n") - F.col("k0") >= min_rows))
    d = Ordered(d, ["k0", *keys], order).with_scans(__f=first(x))
    anchored = F.col(x) - F.col("__f") * share
    scores = d.withColumn("__p", anchored).groupBy("k0", *unit).agg(
        rmse(y, x).alias("raw"), rmse(y, "__p").alias("srl")
    )
    deltas = scores.select("k0", *unit, delta_pct("srl", "raw").alias("delta"))
    return metrics.delta_verdict(deltas, ["k0"], 1).drop("holds")


def evaluate_linear(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], ids: Sequence[str], xs: Sequence[str],
    y: str, views: Sequence[str], seeds: Sequence[int] = (0,), cap: int | None = None, alpha: float = 1.0,
    normalise: str = "source", is_test: str = "is_test",
) -> DataFrame:
    """Normalise, build views, fit and score: all units and seeds in one plan per view.

    ``cap`` makes the fit use a random sample of so many rows per unit and seed; by default it uses all.

    One set of moment matrices over the widest set of columns serves every view: a view is
    a sub-matrix. Rows are read once for the sampled contexts and once for the held-out
    entities.
    """
    keys = [*unit, entity]
    d = df.select(*keys, is_test, *dict.fromkeys([*order, *ids, *xs, y]))
    if normalise == "source":
        d = normalize.source_minmax(d, unit, xs, is_test)
    elif normalise == "entity":
        d = normalize.entity_minmax(d, keys, order, xs)
    elif normalise != "none":
        raise ValueError(f"unknown normalisation {normalise!r}")
    families = [f for f in (*windows.FAMILIES, "from_early") if any(f in windows.VIEWS[v] for v in views)]

    def featured(part: DataFrame) -> DataFrame:
        # an entity lies on one side, so each side is windowed on its own and only once
        return windows.history_features(part, keys, order, xs, families) if families else part

    every = [*xs, *[f"{x}__{f}" for f in families for x in xs]]
    seed_rows = F.explode(F.array(*[F.lit(s) for s in seeds]))
    source = featured(d.filter(~F.col(is_test)))
    if cap is not None:
        source = source.withColumn("seed", seed_rows)
        source = sampling.context_sample_by(source, [*unit, "seed"], "seed", ids, cap)
    place = {c: i for i, c in enumerate(every)}
    sets = F.array(
        *[
            F.struct(
                F.lit(n).alias("view"),
                F.array(*[F.lit(place[c]) for c in windows.view_columns(n, xs)]).cast("array<int>").alias("keep"),
            )
            for n in views
        ]
    )
    if cap is None:  # without a sample every seed has the same fit, so rows are not copied per seed
        m = linear.moments(source, unit, every, y).withColumn("seed", seed_rows)
    else:
        m = linear.moments(source, [*unit, "seed"], every, y)
    m = m.withColumn("__v", F.explode(sets))
    models = linear.fit(m.select(*unit, "seed", "m", "__v.view", "__v.keep"), alpha, F.col("keep"))
    held = linear.moments(featured(d.filter(F.col(is_test))), keys, every, y)
    return linear.score(held, models, [*unit, "seed", "view"], unit)


def evaluate_boosted(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], xs: Sequence[str], y: str,
    views: Sequence[str], params: boosting.Params = boosting.Params(), normalise: str = "source", is_test: str = "is_test",
) -> DataFrame:
    """The boosted arm: per view one model for every unit, all views and units together; overall and entity-macro error.

    Features are built once for all views and written; a model reads the columns of its view.
    """
    keys = [*unit, entity]
    d = df.select(*keys, is_test, *dict.fromkeys([*order, *xs, y]))
    if normalise == "source":
        d = normalize.source_minmax(d, unit, xs, is_test)
    elif normalise == "entity":
        d = normalize.entity_minmax(d, keys, order, xs)
    elif normalise != "none":
        raise ValueError(f"unknown normalisation {normalise!r}")
    families = [f for f in (*windows.FAMILIES, "from_early") if any(f in windows.VIEWS[v] for v in views)]
    d = settled(windows.history_features(d, keys, order, xs, families) if families else d)
    # a view's columns in its own order; where another view has more, its rows hold NULL, which splits nothing
    of = {view: windows.view_columns(view, xs) for view in views}
    places = [f"__x{i}" for i in range(max(map(len, of.values())))]
    copies = [
        F.struct(F.lit(view).alias("view"), *[(F.col(c) if c else F.lit(None)).cast("double").alias(p) for p, c in zip_longest(places, cols)])
        for view, cols in of.items()
    ]
    d = d.select(*keys, is_test, y, F.inline(F.array(*copies)))
    by = [*unit, "view"]
    got = boosting.predict(d.filter(F.col(is_test)), boosting.fit(d.filter(~F.col(is_test)), by, places, y, params), by)
    square = (F.col(y) - F.col("pred")) * (F.col(y) - F.col("pred"))
    per = got.groupBy(*keys, "view").agg(F.sum(square).alias("__s"), F.count(square).alias("__n")).filter(F.col("__n") > 0)
    scores = per.groupBy(*by).agg(
        F.sqrt(F.sum("__s") / F.sum("__n")).alias("rmse_overall"), F.avg(F.sqrt(F.col("__s") / F.col("__n"))).alias("rmse_macro"),
        F.count(F.lit(1)).alias("n_entities"),
    )
    return scores.select(*unit, "rmse_overall", "rmse_macro", "n_entities", "view")


def context_ladder(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], ids: Sequence[str], xs: Sequence[str],
    y: str, samplers: dict[str, tuple[str, int]], alpha: float = 1.0, seed: int = 0, is_test: str = "is_test",
) -> DataFrame:
    """Error by context sampler and size. ``samplers``: name -> (mode, cap); mode ``full`` has no cap."""
    keys = [*unit, entity]
    held = linear.moments(df.filter(F.col(is_test)), keys, xs, y)
    source = df.filter(~F.col(is_test))
    staged = normalize.with_stage(source, keys, order)
    out: DataFrame | None = None
    for name, (mode, cap) in samplers.items():
        if mode == "full":
            ctx = source
        elif mode in ("recent", "early"):
            ctx = sampling.end_sample(source, unit, entity, order, ids, mode, cap, seed)
        else:
            ctx = sampling.coverage_sample(staged, unit, entity, ids, mode, cap, seed, y)
        m = linear.moments(ctx, unit, xs, y)
        one = linear.score(held, linear.fit(m, alpha), unit)
        one = key_join(one, m.select(*unit, linear.n_rows().cast("bigint").alias("n_context")), unit)
        one = one.withColumn("sampler", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def permutation_test(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], xs: Sequence[str], y: str, n_draws: int,
    alpha: float = 1.0, is_test: str = "is_test",
) -> tuple[DataFrame, DataFrame]:
    """Self-referenced view against mispaired references: scores of all draws and the p-values.

    The rows are read once for the entity moment matrices and the first rows; every draw
    is algebra on those.
    """
    keys = [*unit, entity]
    per_entity = settled(linear.moments(df, [*keys, is_test], xs, y))
    anchors = settled(windows.first_rows(df, keys, order, xs))
    maps = sampling.derangements(per_entity, unit, entity, n_draws)
    own = per_entity.select(*keys).withColumns({"m": F.lit(-1), "ref": F.col(entity)})
    maps = maps.unionByName(own).withColumnRenamed("m", "draw")
    scores = settled(linear.anchored_scores(per_entity, maps, anchors, unit, entity, "draw", xs, alpha, is_test))
    observed = scores.filter(F.col("draw") == -1).select(*unit, "rmse_macro")
    null = scores.filter(F.col("draw") >= 0).select(*unit, "rmse_macro")
    return scores, inference.randomisation_p(observed, null, unit, "rmse_macro")


def curve_scalar_arms(
    df: DataFrame, scalar: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], xs: Sequence[str],
    y: str, n0: int, alpha: float = 1.0, is_test: str = "is_test",
) -> DataFrame:
    """Raw, anchored, raw + scalar and anchored + scalar on one common scoring set (t >= n0)."""
    keys = [*unit, entity]
    d = Ordered(df, keys, order).with_scans(__t=ordinal())
    d = windows.history_features(d, keys, order, xs, ["from_first"])
    z = normalize.entity_scalar_zscore(
        attach(d, scalar.select(*keys, "scalar").filter(F.col("scalar").isNotNull()), keys), unit, entity, "scalar", "z"
    ).filter(F.col("__t") >= n0)
    lift = [f"{x}__from_first" for x in xs]
    every = [*xs, *lift, "z"]
    per_entity = linear.moments(z, [*keys, is_test], every, y)
    arms = {"raw": list(xs), "srl": [*xs, *lift], "raw+scalar": [*xs, "z"], "srl+scalar": every}
    return linear.ablation(per_entity, unit, every, arms, is_test, alpha)
