"""Model-based operators on MLlib and on the moment matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.functions import hash_key, rmse
from cyclograin.operators import boosting, linear, metrics
from cyclograin.operators.attach import attach, attach_global, key_join, settled
from cyclograin.operators.neighbors import as_vector, knn, nearest_to_centroids
from cyclograin.operators.ordered import Ordered, ordinal
from cyclograin.operators.ranks import quantiles
from cyclograin.operators.sampling import context_sample, kfold

ESTIMATORS: dict[str, tuple[str, Callable[[int], object]]] = {
    "gbdt_reg": ("regression", lambda seed: boosting.Params(n_trees=20, depth=4)),
    "rf_reg": ("regression", lambda seed: RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed)),
    "gbdt": ("classification", lambda seed: boosting.Params(n_trees=10, depth=3)),
    "rf": ("classification", lambda seed: RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed)),
    "logistic": ("classification", lambda seed: LogisticRegression(maxIter=50, regParam=1e-3)),
}


def register_estimator(name: str, task: str, factory: Callable[[int], object]) -> None:
    """Add a backbone: ``factory(seed)`` returns an MLlib estimator or the size of boosted trees."""
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task {task!r}")
    ESTIMATORS[name] = (task, factory)


def primary_metric(name: str) -> str:
    """The score by which backbones are compared; of both, more is better."""
    return "r2" if ESTIMATORS[name][0] == "regression" else "accuracy"


def fit_predict(
    train: DataFrame, test: DataFrame, xs: Sequence[str], y: str, backbone: str, seed: int = 0,
    out: str = "pred", proba: str | None = None,
) -> DataFrame:
    """Train on one table, add predictions (and class probabilities) to another."""
    task, factory = ESTIMATORS[backbone]
    estimator = factory(seed)
    if isinstance(estimator, boosting.Params):
        fitted = boosting.fit(train, [], xs, y, estimator, task == "classification")
        return boosting.predict(test, fitted, [], out, proba)
    assembler = VectorAssembler(inputCols=list(xs), outputCol="__features")
    estimator = estimator.setFeaturesCol("__features").setLabelCol("__label").setPredictionCol(out)
    label = F.col(y).cast("double").alias("__label")
    model = estimator.fit(assembler.transform(train.select(*xs, label)))
    got = model.transform(assembler.transform(test))
    drop = [c for c in ("__features", "rawPrediction", "probability") if c in got.columns]
    if proba and task == "classification":
        got = got.withColumn(proba, vector_to_array("probability"))
    return got.drop(*drop)


def fit_predict_units(
    df: DataFrame, unit: Sequence[str], xs: Sequence[str], y: str, params: boosting.Params = boosting.Params(),
    is_test: str = "is_test", classify: bool = False, out: str = "pred", proba: str | None = None,
) -> DataFrame:
    """Boosted trees of every unit, fitted together on its source rows, applied to its test rows."""
    fitted = boosting.fit(df.filter(~F.col(is_test)), unit, xs, y, params, classify)
    return boosting.predict(df.filter(F.col(is_test)), fitted, unit, out, proba)


def per_unit(
    df: DataFrame, unit: str, run: Callable[[DataFrame], DataFrame], is_test: str = "is_test"
) -> DataFrame:
    """Union of ``run`` over the units (few, each an MLlib job of its own).

    Units without both source and test rows cannot be evaluated and are left out.
    """
    sides = df.groupBy(unit).agg(F.count_distinct(is_test).alias("sides")).filter("sides = 2")
    units = sorted(r[0] for r in sides.select(unit).collect())
    if not units:
        raise ValueError("no unit has both source and test rows")
    return reduce(DataFrame.unionByName, [run(df.filter(F.col(unit) == u)) for u in units])


def out_of_fold(
    df: DataFrame, fold: str, n_folds: int, xs: Sequence[str], y: str, backbone: str, seed: int = 0,
    out: str = "oof", proba: str | None = None,
) -> DataFrame:
    """Every row predicted by the model that did not see its fold; the folds are computed once.

    Boosted trees of all folds grow together, each fold a unit of its own.
    """
    df = settled(df)
    task, factory = ESTIMATORS[backbone]
    params = factory(seed)
    if isinstance(params, boosting.Params):
        others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col(fold))
        fitted = boosting.fit(df.withColumn("__held", F.explode(others)), ["__held"], xs, y, params, task == "classification")
        return boosting.predict(df.withColumn("__held", F.col(fold)), fitted, ["__held"], out, proba).drop("__held")
    parts = [
        fit_predict(df.filter(F.col(fold) != f), df.filter(F.col(fold) == f), xs, y, backbone, seed, out, proba)
        for f in range(n_folds)
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d


def shift_auc(
    df: DataFrame, xs: Sequence[str], is_target: str, ids: Sequence[str], n_folds: int = 3, seed: int = 0,
    backbone: str = "logistic",
) -> DataFrame:
    """How well a classifier tells source from target rows: mean held-out area over folds."""
    d = settled(df.select(*ids, *xs, F.col(is_target).cast("int").alias("__y")))
    d = kfold(d, ids, n_folds, seed, ["__y"])
    got = out_of_fold(d, "fold", n_folds, xs, "__y", backbone, seed, "__p", "__proba")
    got = settled(got.select("fold", "__y", F.col("__proba")[1].alias("__s")))
    auc = metrics.binary_auc(got, ["fold"], "__y", "__s")
    return auc.agg(F.coalesce(F.avg("auc"), F.lit(0.5)).alias("shift_auc"))


def stack_regression(
    train: DataFrame, test: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], base: str, corrector: str,
    alpha: float = 1.0, n_folds: int = 5, seed: int = 0,
) -> DataFrame:
    """base(x) + alpha * corrector(y - out-of-fold base); alpha 0 is the base model."""
    d = kfold(train, ids, n_folds, seed, out="__fold")
    oof = out_of_fold(d, "__fold", n_folds, xs, y, base, seed, "__oof").withColumn("__res", F.col(y) - F.col("__oof"))
    oof = settled(oof.select(*xs, "__res"))
    got = fit_predict(train, test, xs, y, base, seed, "base")
    got = fit_predict(oof, got, xs, "__res", corrector, seed, "correction")
    return got.withColumn("pred", F.col("base") + alpha * F.col("correction"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def stack_classification(
    train: DataFrame, test: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], n_classes: int, base: str,
    corrector: str, alpha: float = 1.0, n_folds: int = 5, seed: int = 0, eps: float = 1e-6,
) -> DataFrame:
    """Correct the base log-probabilities by regressors of (one-hot - out-of-fold probability)."""
    d = kfold(train, ids, n_folds, seed, out="__fold")
    oof = out_of_fold(d, "__fold", n_folds, xs, y, base, seed, "__p", "__proba")
    got = fit_predict(train, test, xs, y, base, seed, "base", "base_proba")
    corrections = []
    for c in range(n_classes):
        target = (F.col(y) == c).cast("double") - F.coalesce(F.try_element_at("__proba", F.lit(c + 1)), F.lit(0.0))
        got = fit_predict(oof.withColumn("__res", target), got, xs, "__res", corrector, seed, f"__c{c}")
        corrections.append(F.col(f"__c{c}"))
    logits = F.transform("base_proba", lambda p: F.ln(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))))
    shifted = F.zip_with(logits, F.array(*corrections), lambda a, b: a + alpha * b)
    got = got.withColumn("proba", softmax(shifted)).drop(*[f"__c{c}" for c in range(n_classes)])
    return got.withColumn("pred", argmax(F.col("proba")))


# The defaults of rounds, shares and sizes below.
def context_boosting(
    train: DataFrame, test: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], backbone: str = "rf",
    strategy: str = "prune", n_rounds: int = 3, prune_ratio: float = 0.1, relabel_conf: float = 0.85,
    min_context: int = 40, n_folds: int = 3, seed: int = 0,
) -> tuple[DataFrame, list[dict]]:
    """Refine the training rows by out-of-fold suspicion; predict with the best-scoring context.

    Each round is one out-of-fold pass and one relational refinement, settled before the next.
    Returns the predictions and one trace record per round.
    """
    if strategy not in ("prune", "relabel", "reweight"):
        raise ValueError(f"unknown strategy {strategy!r}")
    ctx = settled(train.select(*ids, *xs, F.col(y).cast("int").alias(y)).withColumn("__copy", F.lit(0)))
    row = [*ids, "__copy"]
    best, best_acc, trace = ctx, -1.0, []
    for t in range(n_rounds):
        smallest = ctx.groupBy(y).count().agg(F.min("count")).first()[0]
        folds = min(n_folds, smallest)
        if folds >= 2:
            d = kfold(ctx, row, folds, seed + t, [y], "__fold")
            d = out_of_fold(d, "__fold", folds, xs, y, backbone, seed + t, "__p", "__proba").drop("__fold")
            d = d.withColumns({"__conf": F.array_max("__proba"), "__p": F.col("__p").cast("int")}).drop("__proba")
        else:
            d = ctx.withColumns({"__p": F.col(y), "__conf": F.lit(1.0)})
        d = settled(d.withColumn("__wrong", F.col("__p") != F.col(y)))
        n, wrong, flips = d.agg(
            F.count(F.lit(1)), F.count_if("__wrong"), F.count_if(F.col("__wrong") & (F.col("__conf") >= relabel_conf))
        ).first()
        acc = 1.0 - wrong / n
        trace.append({"round": t, "n_context": n, "oof_accuracy": acc, "changed": 0})
        if acc > best_acc:
            best, best_acc = ctx, acc
        keep = [*ids, *xs, y, "__copy"]
        if strategy == "prune":
            n_prune = min(int(n * prune_ratio), n - min_context)
            if n_prune <= 0 or wrong == 0:
                break
            suspects = d.filter("__wrong").select(*row, (-F.col("__conf")).alias("__by"), F.lit(0).alias("__all"))
            ranked = Ordered(suspects, ["__all"], ["__by", *row]).with_scans(__r=ordinal())
            drop = ranked.filter(F.col("__r") < n_prune).select(*row)
            trace[-1]["changed"] = min(n_prune, wrong)
            ctx = settled(d.join(drop, row, "left_anti").select(*keep))
        elif strategy == "relabel":
            if flips == 0:
                break
            flip = F.col("__wrong") & (F.col("__conf") >= relabel_conf)
            trace[-1]["changed"] = flips
            ctx = settled(d.withColumn(y, F.when(flip, F.col("__p")).otherwise(F.col(y))).select(*keep))
        else:
            d = attach_global(d, quantiles(d, [], {"__mid": ("__conf", 0.5)}))
            hard = d.filter(~F.col("__wrong") & (F.col("__conf") < F.col("__mid")))
            more = hard.count()
            if more == 0:
                break
            trace[-1]["changed"] = more
            copies = hard.withColumn("__copy", F.col("__copy") + (1 << t))
            ctx = settled(d.select(*keep).unionByName(copies.select(*keep)))
    return fit_predict(best, test, xs, y, backbone, seed, "pred", "proba"), trace


def retrieval_predict(
    pool: DataFrame, queries: DataFrame, xs: Sequence[str], y: str, id_col: str, strategy: str = "knn",
    k: int = 50, n_clusters: int = 10, cap: int | None = None, alpha: float = 1.0, seed: int = 0,
) -> DataFrame:
    """Group the queries, build one context per group from the pool, fit one ridge per group.

    ``knn``: union of the neighbours of every query of the group; ``cluster``: rows nearest to
    the group's centre; ``random``: one uniform sample for all. The last two need ``cap``, the
    size of a context; the neighbours are all used unless a cap is given.
    """
    if cap is None and strategy != "knn":
        raise ValueError(f"strategy {strategy!r} needs a context size")
    p = pool.withColumns({"id": F.col(id_col), "vec": as_vector(xs)})
    q = queries.withColumns({"id": F.col(id_col), "vec": as_vector(xs)})
    if strategy == "random":
        ctx = context_sample(p.withColumn("cluster", F.lit(0)), ["cluster"], ["id"], cap, seed)
        q = q.withColumn("cluster", F.lit(0))
    else:
        km = KMeans(k=n_clusters, seed=seed, featuresCol="__f", predictionCol="cluster", maxIter=20)
        feat = settled(q.withColumn("__f", array_to_vector("vec")))
        model = km.fit(feat)
        q = settled(model.transform(feat).drop("__f"))
        if strategy == "knn":
            got = knn(q.select("id", "vec"), p.select("id", "vec"), k)
            members = got.join(q.select("id", "cluster"), "id").select("cluster", F.col("neighbor").alias("id")).distinct()
            if cap is not None:
                members = context_sample(members, ["cluster"], ["id"], cap, seed)
        elif strategy == "cluster":
            centres = [c.tolist() for c in model.clusterCenters()]
            members = nearest_to_centroids(p, centres, cap).select("cluster", F.col("neighbor").alias("id"))
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        ctx = members.join(p.drop("cluster") if "cluster" in p.columns else p, "id")
    fitted = linear.fit(linear.moments(ctx, ["cluster"], xs, y), alpha)
    return linear.predict(q, fitted, ["cluster"], xs).drop("vec", "id")


# Locality thresholds with their neighbourhood sizes, the shift threshold with
# its factor, and the allowed range of sizes.
LOCALITY_HIGH, LOCALITY_MID = 0.8, 0.5
SIZE_HIGH, SIZE_MID, SIZE_LOW = 30, 60, 120
SHIFT_LIMIT, SHIFT_FACTOR = 0.85, 1.5
SIZE_RANGE = (20, 300)


def adaptive_k(locality: Column, auc: Column) -> Column:
    """Neighbourhood size: strong locality narrows it, strong shift widens it."""
    base = F.when(locality > LOCALITY_HIGH, SIZE_HIGH).when(locality > LOCALITY_MID, SIZE_MID).otherwise(SIZE_LOW)
    wide = F.when(auc > SHIFT_LIMIT, F.floor(base * SHIFT_FACTOR)).otherwise(base)
    return F.greatest(F.lit(SIZE_RANGE[0]), F.least(F.lit(SIZE_RANGE[1]), wide)).cast("int")


def knn_locality(
    df: DataFrame, xs: Sequence[str], y: str, id_col: str, k: int = 10, n_folds: int = 3, seed: int = 0
) -> DataFrame:
    """Mean held-out R2 of a k-nearest-neighbour mean over folds."""
    d = kfold(df.withColumns({"id": F.col(id_col), "vec": as_vector(xs)}), ["id"], n_folds, seed).select("id", "vec", "fold", y)
    d = settled(d)
    r2 = None
    for f in range(n_folds):
        held, rest = d.filter(F.col("fold") == f), d.filter(F.col("fold") != f)
        got = knn(held.select("id", "vec"), rest.select("id", "vec"), k)
        lab = rest.select(F.col("id").alias("neighbor"), F.col(y).alias("__z"))
        pred = got.join(lab, "neighbor").groupBy("id").agg(F.avg("__z").alias("pred")).join(held.select("id", y), "id")
        one = metrics.regression_scores(pred.withColumn("fold", F.lit(f)), ["fold"], y, "pred").select("r2")
        r2 = one if r2 is None else r2.unionByName(one)
    return r2.agg(F.avg("r2").alias("locality"))


def nystroem(
    df: DataFrame, train: Column, xs: Sequence[str], ids: Sequence[str], n_landmarks: int = 32, seed: int = 0,
    gamma: float | None = None, prefix: str = "rbf",
) -> DataFrame:
    """Append kernel features exp(-gamma |x - l|^2) K^(-1/2) for a bounded set of landmark rows."""
    g = gamma if gamma is not None else 1.0 / len(xs)
    marks = df.filter(train).orderBy(hash_key(seed, "landmarks", *ids), *ids).limit(n_landmarks).select(*xs).collect()
    land = np.array([[float(v) for v in r] for r in marks])
    gap = ((land[:, None, :] - land[None, :, :]) ** 2).sum(-1)
    w, u = np.linalg.eigh(np.exp(-g * gap))
    root = u @ np.diag(1.0 / np.sqrt(np.maximum(w, 1e-12))) @ u.T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def expand(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.empty((0, land.shape[1]))
        d = ((x[:, None, :] - land[None, :, :]) ** 2).sum(-1)
        return pd.Series(list(np.exp(-g * d) @ root))

    d = df.withColumn("__k", expand(as_vector(xs)))
    return d.withColumns({f"{prefix}{i}": F.col("__k")[i] for i in range(len(land))}).drop("__k")


def physical_reference(
    rows: DataFrame, unit: Sequence[str], entity: str, y: str, q: str, nominal: str, raw_row: str, position: str,
    is_test: str = "is_test", window: int = 100, min_rows: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """y = eta * q / nominal, eta the median ratio over early source rows of the unit.

    Returns the scored points and one audit row per test entity. A test entity counts only if
    all of its scored rows are mapped and have a finite reading.
    """
    d = rows.withColumn("__rel", F.col(q) / F.col(nominal))
    early = d.filter(~F.col(is_test) & (F.col(raw_row) >= 0) & (F.col(raw_row) < window) & (F.col("__rel") > 0))
    early = early.withColumn("__ratio", F.col(y) / F.col("__rel"))
    eta = quantiles(early, unit, {"eta": ("__ratio", 0.5)})
    enough = early.groupBy(*unit).agg(F.count(F.lit(1)).alias("calib_rows")).filter(F.col("calib_rows") >= min_rows)
    eta = key_join(eta, enough, unit)
    scored = d.filter(F.col(is_test) & (F.col(position) >= window))
    audit = scored.groupBy(*unit, entity).agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col(raw_row).isNull()).alias("n_unmapped"),
        F.count_if(F.col(raw_row).isNotNull() & F.col("__rel").isNull()).alias("n_missing"),
    )
    reason = F.when(F.col("n_unmapped") > 0, "unmapped_rows").when(F.col("n_missing") > 0, "missing_reading").otherwise("scored")
    audit = audit.withColumn("status", reason)
    good = audit.filter(F.col("status") == "scored").select(*unit, entity)
    points = attach(key_join(scored, good, [*unit, entity], "left_semi"), eta, unit)
    return points.withColumn("pred", F.col("eta") * F.col("__rel")).drop("__rel"), audit


def early_slope_reference(features: DataFrame, unit: Sequence[str], is_test: str = "is_test", alpha: float = 0.0) -> DataFrame:
    """Linear model (early slope, first label) -> last label on the source entities, per unit."""
    m = linear.moments(features.filter(~F.col(is_test)), unit, ["slope", "y_first"], "y_last")
    return linear.predict(features, linear.fit(m, alpha), unit, ["slope", "y_first"], "pred_last")


def blend_targets(df: DataFrame, y: str, teacher: str, lambdas: Sequence[float]) -> DataFrame:
    """(1 - lambda) y + lambda * teacher for every lambda, as rows."""
    d = linear.with_grid(df, "lam", lambdas)
    return d.withColumn("target", (1.0 - F.col("lam")) * F.col(y) + F.col("lam") * F.col(teacher))


def distill(
    df: DataFrame, unit: Sequence[str], entity: str, teacher_xs: Sequence[str], student_xs: Sequence[str], y: str,
    lambdas: Sequence[float], n_folds: int = 5, seed: int = 0, alpha: float = 1.0, is_test: str = "is_test",
    mispaired_xs: Sequence[str] = (), mispaired_lambda: float = 0.5,
) -> DataFrame:
    """Student fitted on blended targets, teacher predicted out of fold by entity groups.

    ``mispaired_xs`` names a second set of student columns of the same width whose reference belongs
    to another entity (see ``windows.mispaired_lift``). The control is fitted on the same targets at
    ``mispaired_lambda`` and scored on the same rows; column ``arm`` then tells the two apart.
    """
    from cyclograin.operators.sampling import group_kfold

    if mispaired_xs and mispaired_lambda not in lambdas:
        raise ValueError("the control needs the targets of one of the lambdas")
    source = group_kfold(df.filter(~F.col(is_test)), unit, entity, n_folds, seed)
    taught = linear.out_of_fold(source, unit, "fold", teacher_xs, y, alpha, "teacher").drop("fold")
    if mispaired_xs:
        taught = settled(taught)  # both arms learn from one teacher, run once

    def arm(xs: Sequence[str], lams: Sequence[float]) -> DataFrame:
        blended = blend_targets(taught, y, "teacher", lams)
        models = linear.fit(linear.moments(blended, [*unit, "lam"], xs, "target"), alpha)
        per_entity = linear.moments(df.filter(F.col(is_test)), [*unit, entity], xs, y)
        return linear.score(per_entity, models, [*unit, "lam"], unit)

    found = arm(student_xs, lambdas)
    if not mispaired_xs:
        return found
    control = arm(mispaired_xs, [mispaired_lambda]).withColumn("arm", F.lit("mispaired"))
    return found.withColumn("arm", F.lit("distilled")).unionByName(control)


def pooled_rmse(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*by).agg(rmse(y, pred).alias("rmse"), F.count(F.lit(1)).alias("n"))
