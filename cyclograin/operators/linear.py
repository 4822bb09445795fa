"""Linear models from sufficient statistics.

The moment matrix of ``[1, x_1..x_d, y]`` is taken once per entity: the row count, the means, and
the co-moments about those means. Everything else works on those small matrices: merging them fits
a unit, taking one out gives the fit without an entity, sub-matrices give ablations, an affine
change of the features (another anchor) is ``T' M T``, and the squared error of any coefficient
vector on any entity follows from M. Rows are read once, however many folds, penalties,
ablations or random draws follow.

Products are never summed about zero: features far from it (time stamps, large ids) keep their
precision. A row with a NULL among its features or label counts nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.operators.attach import attach, attach_few, key_join

ARRAY = T.ArrayType(T.DoubleType())
#: features up to which the matrix is one built-in aggregate
CODEGEN_WIDTH = 4
#: bytes of finished matrices in an Arrow batch
HELD_BYTES = 8 * 1024 * 1024


def moments(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, out: str = "m") -> DataFrame:
    """Row-major matrix of [1, *xs, y] per group, over the rows without NULL in these columns.

    Its first row and column hold the row count and the means, the rest the co-moments about the
    means. Narrow designs are one built-in aggregate. Wide ones are computed per task with matrix
    products first, so a task sends at most one matrix per group and batch, and few rows as they are.
    """
    cols = [*xs, y]
    plain = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)]
    src = df.dropna(subset=list(dict.fromkeys(cols))).select(*by, *plain)
    z = [f"__x{i}" for i in range(len(cols))]
    if len(xs) <= CODEGEN_WIDTH:
        k = len(z)
        aggs = [F.count(F.lit(1)).cast("double").alias("__n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(z)]]
        aggs += [F.covar_pop(z[i], z[j]).alias(f"__c{i}_{j}") for i in range(k) for j in range(i, k)]
        flat = [F.col("__n"), *[F.col(f"__m{i}") for i in range(k)]]
        for i in range(k):
            flat += [F.col(f"__m{i}"), *[F.col(f"__c{min(i, j)}_{max(i, j)}") * F.col("__n") for j in range(k)]]
        return src.groupBy(*by).agg(*aggs).select(*by, F.array(*flat).alias(out))

    return pool(_grouped_rows(src, by, len(z), out), by, out, len(z))


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, int, int]]:
    """Keys (the first columns; NULL is a key) of a batch and where each run of equal keys begins and ends."""
    if not n_keys:
        yield (), 0, batch.num_rows
        return
    keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)], strict=True))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], start, i
            start = i


def _of_rows(rows: np.ndarray) -> np.ndarray:
    """The moment matrix of rows [*xs, y]."""
    k = rows.shape[1] + 1
    mean = rows.mean(axis=0)
    part = rows - mean
    g = np.empty((k, k))
    g[0, 0], g[0, 1:], g[1:, 0], g[1:, 1:] = len(rows), mean, mean, part.T @ part
    return g


def _grouped_rows(df: DataFrame, by: Sequence[str], width: int, out: str) -> DataFrame:
    """Rows of a key that stand together, as one matrix where that is smaller than the rows themselves.

    Rows are brought together inside each task, without an exchange. A piece is ``width`` + 1 squared numbers
    (a matrix) or a multiple of ``width`` (rows); no number is both, so the length tells which.
    """
    schema = T.StructType([*df.select(*by).schema.fields, T.StructField(out, ARRAY)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(len(by) + i).to_numpy() for i in range(width)])
            keys, pieces = [], []
            for key, a, b in _runs(batch, len(by)):
                part = rows[a:b]
                keys.append(key)
                pieces.append(part.ravel() if (b - a) * width < (width + 1) ** 2 else _of_rows(part).ravel())
            if pieces:
                yield _pieces(keys, pieces, batch.schema.types[: len(by)], schema.names)

    near = df.sortWithinPartitions(*by) if by else df
    return near.mapInArrow(run, schema)


def _pieces(keys: list[tuple], pieces: list[np.ndarray], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(c, kind) for c, kind in zip(zip(*keys, strict=True), kinds, strict=True)]
    ends = np.cumsum([0, *map(len, pieces)])
    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pieces))))
    return pa.RecordBatch.from_arrays(cols, names=names)


def _one_per_key(df: DataFrame, by: Sequence[str], out: str, width: int | None) -> DataFrame:
    """Merge the pieces of each run of equal keys; a task holds one matrix and a few megabytes of finished ones.

    ``width`` is that of rows among the pieces; without it all are matrices.
    """
    schema = df.select(*by, out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        loose: list[np.ndarray] = []
        keys, done, size, kinds = [], [], 0, []

        def settle() -> None:
            nonlocal held
            if loose:
                g = _of_rows(np.concatenate(loose))
                held = g if held is None else merged(held, g)
                loose.clear()

        for batch in batches:
            kinds = batch.schema.types[: len(by)]
            column = batch.column(len(by))
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            empty = column.is_null().to_numpy(zero_copy_only=False)
            for now, a, b in _runs(batch, len(by)):
                if now != key or (held is None and not loose):
                    settle()
                    if held is not None:
                        keys.append(key)
                        done.append(held.ravel())
                        size += held.nbytes
                    key, held = now, None
                    if size > HELD_BYTES:
                        yield _pieces(keys, done, kinds, schema.names)
                        keys, done, size = [], [], 0
                for i in range(a, b):
                    piece = values[offsets[i] : offsets[i + 1]]
                    if empty[i] or not len(piece):
                        continue
                    if width and len(piece) % width == 0:
                        loose.append(piece.reshape(-1, width))
                        if len(loose) > 4096:
                            settle()
                    else:
                        g = _square(piece)
                        held = g if held is None else merged(held, g)
        settle()
        if held is not None:
            keys.append(key)
            done.append(held.ravel())
        if done:
            yield _pieces(keys, done, kinds, schema.names)

    return df.mapInArrow(run, schema)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of two disjoint sets of rows."""
    na, nb = a[0, 0], b[0, 0]
    n = na + nb
    if n <= 0:
        return a
    gap = b[0, 1:] - a[0, 1:]
    mean = a[0, 1:] + gap * (nb / n)
    out = a + b
    out[0, 0], out[0, 1:], out[1:, 0] = n, mean, mean
    out[1:, 1:] += np.outer(gap, gap) * (na * nb / n)
    return out


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of the rows of ``a`` that are not in its part ``b``."""
    na, nb = a[0, 0], b[0, 0]
    n = na - nb
    out = a - b
    if n <= 0:
        return np.zeros_like(a)
    gap = (b[0, 1:] - a[0, 1:]) * (na / n)
    mean = b[0, 1:] - gap
    out[0, 0], out[0, 1:], out[1:, 0] = n, mean, mean
    out[1:, 1:] -= np.outer(gap, gap) * (n * nb / na)
    return out


def _square(v) -> np.ndarray:
    g = np.asarray(v, dtype=float)
    k = int(round(np.sqrt(g.size)))
    return g.reshape(k, k)


def pool(m: DataFrame, by: Sequence[str], out: str = "m", width: int | None = None) -> DataFrame:
    """One matrix per key of a coarser grouping: merged in each task first, then over all tasks.

    Pieces are brought together by sorting, so a task holds one matrix however many keys it has, and a key
    that many tasks share sends one matrix from each. ``width`` allows rows of that width among the pieces.
    """
    by = list(by)
    pieces = m.select(*by, out)
    if width is None:
        pieces = _one_per_key(pieces.sortWithinPartitions(*by) if by else pieces, by, out, None)
    placed = pieces.repartition(*by).sortWithinPartitions(*by) if by else pieces.repartition(1)
    return _one_per_key(placed, by, out, width)


@F.pandas_udf(ARRAY)
def minus(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column of matrices ``a`` without the rows of ``b``."""
    return pd.Series([without(_square(x), _square(y)).ravel() for x, y in zip(a, b, strict=True)], dtype=object)


def solve_ridge(m: np.ndarray, alpha: float, keep: Sequence[int] | None = None) -> np.ndarray:
    """[intercept, coefficients] with an unpenalised intercept; alpha 0 uses the pseudo-inverse."""
    k = int(round(np.sqrt(m.size)))
    g = m.reshape(k, k)
    d, n = k - 2, g[0, 0]
    idx = np.arange(d) if keep is None else np.asarray(keep, dtype=int)
    beta = np.zeros(d + 1)
    if n <= 0:
        return np.full(d + 1, np.nan)
    mean = g[0, 1 : k - 1]
    sxx, sxy = g[1 : k - 1, 1 : k - 1], g[1 : k - 1, k - 1]
    a, b = sxx[np.ix_(idx, idx)], sxy[idx]
    if alpha > 0:
        beta[1 + idx] = np.linalg.solve(a + alpha * np.eye(len(idx)), b)
    elif len(idx):
        beta[1 + idx] = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
    beta[0] = g[0, k - 1] - beta[1:] @ mean
    return beta


@F.pandas_udf(ARRAY)
def ridge_column(m: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([solve_ridge(np.asarray(v, dtype=float), a) for v, a in zip(m, alpha, strict=True)])


@F.pandas_udf(ARRAY)
def ridge_subset_column(m: pd.Series, alpha: pd.Series, keep: pd.Series) -> pd.Series:
    rows = zip(m, alpha, keep, strict=True)
    return pd.Series([solve_ridge(np.asarray(v, dtype=float), a, list(i)) for v, a, i in rows])


@F.pandas_udf(T.DoubleType())
def sse_column(m: pd.Series, beta: pd.Series) -> pd.Series:
    """Sum of squared errors of a coefficient vector over the rows behind a moment matrix."""
    return pd.Series([_sse(_square(v), b) for v, b in zip(m, beta, strict=True)], dtype="float64")


def _sse(g: np.ndarray, beta) -> float:
    w = np.append(np.asarray(beta, dtype=float), -1.0)
    shift = w[0] + w[1:] @ g[0, 1:]
    return float(w[1:] @ g[1:, 1:] @ w[1:] + g[0, 0] * shift * shift)


def _held_out_udf(alphas: tuple[float, ...]):
    @F.pandas_udf(ARRAY)
    def held_out(whole: pd.Series, m: pd.Series) -> pd.Series:
        """Squared errors over the rows of ``m`` of the models of all other rows, one per penalty; NULL where there are none."""
        out = []
        for a, b in zip(whole, m, strict=True):
            own = _square(b)
            rest = without(_square(a), own)
            out.append([_sse(own, solve_ridge(rest, x)) for x in alphas] if rest[0, 0] > 0.5 else None)
        return pd.Series(out, dtype=object)

    return held_out


def fit(m: DataFrame, alpha: float | Column = 1.0, keep: Column | None = None, out: str = "beta") -> DataFrame:
    """Coefficients for every moment matrix in the table, solved where the rows are."""
    a = F.lit(float(alpha)) if not isinstance(alpha, Column) else alpha
    beta = ridge_column("m", a) if keep is None else ridge_subset_column("m", a, keep)
    return m.withColumn(out, beta)


def linear_expression(beta: str | Column, xs: Sequence[str]) -> Column:
    b = F.col(beta) if isinstance(beta, str) else beta
    value = b[0]
    for i, x in enumerate(xs):
        value = value + b[i + 1] * F.col(x)
    return value


def predict(df: DataFrame, model: DataFrame, by: Sequence[str], xs: Sequence[str], out: str = "pred") -> DataFrame:
    """Predictions as a plain column expression over the attached coefficients."""
    d = attach_few(df, model.select(*by, F.col("beta").alias("__beta")), by)
    return d.withColumn(out, linear_expression("__beta", xs)).drop("__beta")


def n_rows(m: str = "m") -> Column:
    return F.col(m)[0]


def score(
    per_entity: DataFrame, model: DataFrame, by: Sequence[str], on: Sequence[str] | None = None
) -> DataFrame:
    """Overall and entity-macro error of each unit's models, from entity moment matrices.

    ``on`` names the columns both tables share when there are several models per unit.
    """
    d = key_join(per_entity, model.select(*by, "beta"), on or by)
    d = d.withColumns({"__sse": sse_column("m", "beta"), "__n": n_rows()})
    return d.groupBy(*by).agg(
        F.sqrt(F.sum("__sse") / F.sum("__n")).alias("rmse_overall"),
        F.avg(F.sqrt(F.col("__sse") / F.col("__n"))).alias("rmse_macro"),
        F.count(F.lit(1)).alias("n_entities"),
    )


def total_ss(m: str | Column, d: int) -> Column:
    """Total sum of squares of y behind a moment matrix of ``d`` features."""
    k = d + 2
    c = F.col(m) if isinstance(m, str) else m
    return c[k * k - 1]


def leave_one_out(per_entity: DataFrame, unit: Sequence[str], entity: str) -> DataFrame:
    """Per entity the moment matrix of all others (``rest``) next to its own (``m``).

    Valid only if features and sample do not depend on the fold: per-entity or fixed
    normalisation, and no cap or a cap drawn once.
    """
    whole = pool(per_entity.select(*unit, "m"), unit).withColumnRenamed("m", "__all")
    d = attach(per_entity, whole, unit)
    return d.withColumn("rest", minus("__all", "m")).drop("__all")


def loco_estimate(
    per_entity: DataFrame, unit: Sequence[str], entity: str, alpha: float = 1.0, fold_free: bool = True
) -> DataFrame:
    """Nested leave-one-entity-out error of the source entities: one row per entity."""
    if not fold_free:
        raise ValueError("subtraction needs fold-independent normalisation and sampling")
    d = leave_one_out(per_entity, unit, entity).filter(F.col("rest")[0] > 0.5)
    d = d.withColumn("beta", ridge_column("rest", F.lit(float(alpha))))
    return d.select(*unit, entity, F.sqrt(sse_column("m", "beta") / n_rows()).alias("rmse"))


def fold_models(per_fold: DataFrame, unit: Sequence[str], fold: str, alpha: float | Column = 1.0) -> DataFrame:
    """One model per fold fitted on all other folds, by subtraction."""
    whole = pool(per_fold.select(*unit, "m"), unit).withColumnRenamed("m", "__all")
    d = attach(per_fold, whole, unit).withColumn("rest", minus("__all", "m")).drop("__all")
    a = F.lit(float(alpha)) if not isinstance(alpha, Column) else alpha
    return d.withColumn("beta", ridge_column("rest", a))


def out_of_fold(
    df: DataFrame, unit: Sequence[str], fold: str, xs: Sequence[str], y: str, alpha: float = 1.0, out: str = "oof"
) -> DataFrame:
    """Out-of-fold predictions of a ridge model."""
    models = fold_models(moments(df, [*unit, fold], xs, y), unit, fold, alpha)
    return predict(df, models, [*unit, fold], xs, out)


def cross_validated_r2(df: DataFrame, unit: Sequence[str], fold: str, xs: Sequence[str], y: str, alpha: float = 1.0) -> DataFrame:
    """Mean over folds of the held-out R2."""
    d = fold_models(moments(df, [*unit, fold], xs, y), unit, fold, alpha)
    r2 = 1.0 - sse_column("m", "beta") / total_ss("m", len(xs))
    return d.withColumn("__r2", r2).groupBy(*unit).agg(F.avg("__r2").alias("r2"))


def with_grid(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def select_alpha(
    per_group: DataFrame, unit: Sequence[str], alphas: Sequence[float], entity_weighted: bool = False
) -> DataFrame:
    """Penalty with the smallest grouped cross-validation error, and the model refitted with it.

    ``per_group`` has one moment matrix per (unit, group); all penalties share them.
    """
    whole = pool(per_group.select(*unit, "m"), unit).withColumnRenamed("m", "__all")
    # all in one function: each in a row would be a Python process of its own in every task
    d = attach(per_group, whole, unit).withColumn("__held", _held_out_udf(tuple(map(float, alphas)))("__all", "m"))
    tried = F.arrays_zip(F.array(*[F.lit(float(a)) for a in alphas]).alias("alpha"), F.col("__held").alias("sse"))
    d = d.filter(F.col("__held").isNotNull()).select(*unit, n_rows().alias("__n"), F.explode(tried).alias("__t"))
    d = d.select(*unit, "__n", F.col("__t.alpha").alias("alpha"), F.col("__t.sse").alias("__sse"))
    value = F.avg(F.sqrt(F.col("__sse") / F.col("__n"))) if entity_weighted else F.sqrt(F.sum("__sse") / F.sum("__n"))
    cv = d.groupBy(*unit, "alpha").agg(value.alias("cv_rmse"))
    best = cv.groupBy(*unit).agg(
        F.min_by("alpha", F.struct("cv_rmse", "alpha")).alias("alpha"), F.min("cv_rmse").alias("cv_rmse")
    )
    return key_join(best, whole.withColumnRenamed("__all", "m"), unit).withColumn(
        "beta", ridge_column("m", F.col("alpha"))
    ).drop("m")


def ablation(
    per_entity: DataFrame, unit: Sequence[str], xs: Sequence[str], conditions: dict[str, Sequence[str]],
    is_test: str = "is_test", alpha: float = 1.0,
) -> DataFrame:
    """Error of every feature subset, from one set of moment matrices."""
    place = {x: i for i, x in enumerate(xs)}
    sets = F.array(
        *[
            F.struct(F.lit(k).alias("condition"), F.array(*[F.lit(place[x]) for x in v]).cast("array<int>").alias("keep"))
            for k, v in conditions.items()
        ]
    )
    source = pool(per_entity.filter(~F.col(is_test)).select(*unit, "m"), unit)
    d = source.withColumn("__c", F.explode(sets)).select(*unit, "m", "__c.condition", "__c.keep")
    models = fit(d, alpha, F.col("keep")).select(*unit, "condition", "beta")
    return score(per_entity.filter(F.col(is_test)), models, [*unit, "condition"], unit)


def shift_moments(m: Column | str, d: int, base: Sequence[int], anchors: Sequence[Column]) -> Column:
    """Moments of [1, x, x_base - anchor, y] from the moments of [1, x, y]: only means move."""
    udf = _shift_udf(d, tuple(base))
    return udf(m, F.array(*[a.cast("double") for a in anchors]))


def _shift_udf(d: int, base: tuple[int, ...]):
    k, wide = d + 2, d + 2 + len(base)

    @F.pandas_udf(ARRAY)
    def shift(m: pd.Series, anchors: pd.Series) -> pd.Series:
        out = []
        for v, a in zip(m, anchors, strict=True):
            place = np.array([*range(1, d + 1), *[1 + b for b in base], k - 1])
            g = _square(v)
            moved = np.empty((wide, wide))
            moved[1:, 1:] = g[np.ix_(place, place)]
            mean = g[0, place]
            mean[d : d + len(base)] -= np.asarray(a, dtype=float)
            moved[0, 0], moved[0, 1:], moved[1:, 0] = g[0, 0], mean, mean
            out.append(moved.ravel())
        return pd.Series(out)

    return shift


def anchored_scores(
    per_entity: DataFrame, maps: DataFrame, anchors: DataFrame, unit: Sequence[str], entity: str, draw: str,
    xs: Sequence[str], alpha: float = 1.0, is_test: str = "is_test",
) -> DataFrame:
    """Error of the anchored view for every draw of the reference map.

    ``maps`` has (unit, draw, entity, ref); ``anchors`` one row per entity with ``{x}__first``.
    A draw costs one small matrix product per entity: the series themselves are not touched.
    """
    a = anchors.withColumnRenamed(entity, "ref")
    d = key_join(key_join(maps, a, [*unit, "ref"]), per_entity, [*unit, entity])
    moved = shift_moments("m", len(xs), range(len(xs)), [F.col(f"{x}__first") for x in xs])
    d = d.select(*unit, draw, entity, is_test, moved.alias("m"))
    source = pool(d.filter(~F.col(is_test)).select(*unit, draw, "m"), [*unit, draw])
    return score(d.filter(F.col(is_test)), fit(source, alpha), [*unit, draw])


def permutation_importance(
    df: DataFrame, model: DataFrame, unit: Sequence[str], entity: str, ids: Sequence[str], xs: Sequence[str],
    y: str, n_repeats: int = 5, seed: int = 0,
) -> DataFrame:
    """Rise of the entity-macro error when one column is shuffled within the unit.

    For a linear model the prediction moves by beta_j (x' - x), so all columns and repeats
    come from one pass over the rows joined with their shuffled partner row.
    """
    from cyclograin.operators.ranks import with_hash_rank

    d = attach_few(df.select(*unit, entity, *ids, *xs, y), model.select(*unit, "beta"), unit)
    d = d.withColumn("__e", F.col(y) - linear_expression("beta", xs))
    d = d.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    groups = [*unit, "repeat"]
    d = with_hash_rank(d, groups, [*ids, "repeat"], seed, "slot", "__to")
    donors = with_hash_rank(d.select(*groups, *ids, *xs), groups, [*ids, "repeat"], seed + 1, "donor", "__to")
    donors = donors.select(*groups, "__to", *[F.col(x).alias(f"__d_{x}") for x in xs])
    d = key_join(d, donors, [*groups, "__to"])
    sq = {x: F.col("__e") - F.col("beta")[i + 1] * (F.col(f"__d_{x}") - F.col(x)) for i, x in enumerate(xs)}
    aggs = [F.avg(e * e).alias(f"__p_{x}") for x, e in sq.items()]
    per = d.groupBy(*groups, entity).agg(F.avg(F.col("__e") * F.col("__e")).alias("__base"), *aggs)
    rises = [
        F.struct(F.lit(x).alias("feature"), F.avg(F.sqrt(f"__p_{x}") - F.sqrt("__base")).alias("rise")) for x in xs
    ]
    per_repeat = per.groupBy(*groups).agg(F.array(*rises).alias("__r"))
    return per_repeat.select(*groups, F.explode("__r").alias("__x")).groupBy(*unit, "__x.feature").agg(
        F.avg("__x.rise").alias("importance"), F.coalesce(F.stddev_samp("__x.rise"), F.lit(0.0)).alias("std")
    )


@F.pandas_udf(T.DoubleType())
def effective_rank_column(m: pd.Series) -> pd.Series:
    """exp(entropy of squared singular values) of the standardised features behind a matrix."""
    out = []
    for v in m:
        g = _square(v)
        cov = g[1:-1, 1:-1] / g[0, 0]
        sd = np.sqrt(np.clip(np.diag(cov), 0, None)) + 1e-9
        w = np.clip(np.linalg.eigvalsh(cov / np.outer(sd, sd)), 0, None)
        p = w[w > 0] / w.sum()
        out.append(float(np.exp(-(p * np.log(p)).sum())))
    return pd.Series(out, dtype="float64")


def effective_rank(df: DataFrame, unit: Sequence[str], xs: Sequence[str]) -> DataFrame:
    m = moments(df.withColumn("__zero", F.lit(0.0)), unit, xs, "__zero")
    d = m.withColumn("effective_rank", effective_rank_column("m"))
    return d.select(*unit, "effective_rank", (F.col("effective_rank") / len(xs)).alias("rank_ratio"))
