"""Exact order statistics and ranks that never gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclograin.functions import hash_key
from cyclograin.operators.attach import key_join, settled
from cyclograin.operators.ordered import (
    MAX_ROWS_PER_TASK,
    Ordered,
    Scan,
    has_hot_key,
    last_valid,
    ordinal,
    running_sum,
    total,
)

PERCENTILE_ROWS = 1_000_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-NULL values per key with their row counts; combines map-side."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__cnt"))
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, tuple[str, float]],
    max_rows: int | None = None,
    extra: Sequence[Column] = (),
    bounded: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key: ``{output: (column, q)}``.

    ``extra`` are further aggregates wanted per key; ``bounded`` says that the group size is
    limited by construction, so no count is needed.

    Small groups use the built-in aggregate. A group above ``max_rows`` is reduced to
    counted distinct values, cut into chunks by value, and only the one or two chunks that
    hold the wanted positions are ranked.
    """
    keys = list(keys)
    keyed = keys or ["__all"]
    src = df if keys else df.withColumn("__all", F.lit(0))
    limit = max_rows or PERCENTILE_ROWS
    if bounded or not has_hot_key(src, keyed, limit):
        out = src.groupBy(*keyed).agg(
            *extra, *[F.percentile(c, F.lit(q)).alias(k) for k, (c, q) in measures.items()]
        )
    else:
        out = src.groupBy(*keyed).agg(*(extra or [F.lit(0).alias("__no")])).drop("__no")
        by_column: dict[str, dict[str, float]] = {}
        for name, (c, q) in measures.items():
            by_column.setdefault(c, {})[name] = q
        for c, wanted in by_column.items():
            out = key_join(out, _selected(src, keyed, c, wanted, limit), keyed, "left")
    return out if keys else out.drop("__all")


def _selected(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], max_rows: int
) -> DataFrame:
    counts = settled(value_counts(df, keys, value))
    placed = Ordered(counts, keys, [value], max_rows=max_rows).with_scans(
        __hi=running_sum("__cnt")
    )
    sizes = counts.groupBy(*keys).agg(F.sum("__cnt").alias("__n"))
    placed = key_join(placed, sizes, keys)
    lo, hi, n = F.col("__hi") - F.col("__cnt"), F.col("__hi"), F.col("__n")
    aggs = []
    for name, q in wanted.items():
        pos = F.lit(q) * (n - 1)
        for end, index in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            hit = (index >= lo) & (index < hi)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{end}_{name}"))
        aggs.append(F.first(pos - F.floor(pos)).alias(f"__w_{name}"))
    out = placed.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (
                F.col(f"__a_{k}") + (F.col(f"__b_{k}") - F.col(f"__a_{k}")) * F.col(f"__w_{k}")
            ).alias(k)
            for k in wanted
        ],
    )


def median(df: DataFrame, keys: Sequence[str], **cols: str) -> DataFrame:
    return quantiles(df, keys, {k: (c, 0.5) for k, c in cols.items()})


def with_average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, max_rows: int | None = None
) -> DataFrame:
    """1-based rank with ties averaged; NULL values get NULL."""
    return with_average_ranks(df, keys, {out: value}, max_rows)


def with_average_ranks(
    df: DataFrame, keys: Sequence[str], ranks: dict[str, str], max_rows: int | None = None
) -> DataFrame:
    """Average ranks of several columns, ``{output: column}``; of a large table one look at the rows each."""
    keys = list(keys)
    if not has_hot_key(df, keys, max_rows or MAX_ROWS_PER_TASK):
        out = df
        for name, value in ranks.items():
            order = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value)
            peers = order.rangeBetween(Window.currentRow, Window.currentRow)
            rank = F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2.0
            out = out.withColumn(name, F.when(F.col(value).isNotNull(), rank))
        return out
    out = df
    for name, value in ranks.items():
        counts = settled(value_counts(df, keys, value))
        ranked = Ordered(counts, keys, [value], max_rows=max_rows).with_scans(__hi=running_sum("__cnt"))
        ranked = settled(ranked.select(*keys, value, (F.col("__hi") - (F.col("__cnt") - 1) / 2.0).alias(name)))
        out = key_join(out, ranked, [*keys, value], "left")
    return out


def with_hash_rank(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    seed: int,
    salt: str,
    rank: str = "rnd",
    size: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """0-based random rank inside each group (a shuffle by hash), optionally its size."""
    d = df.withColumn("__h", hash_key(seed, salt, *ids))
    scans: dict[str, Scan] = {rank: ordinal()}
    if size:
        scans[size] = total(F.count(F.lit(1)))
    return Ordered(d, groups, ["__h", *ids], max_rows=max_rows).with_scans(**scans).drop("__h")


def top_n(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group; a fixed ``n`` lets Spark cut each map task to ``n`` rows."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def complement_quantiles(df: DataFrame, unit: str, measures: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact linear-interpolation quantiles over the rows of all *other* units, for every unit.

    ``measures`` is {output: (column, q)}. Rows are never copied per unit: values are counted per unit and
    overall, and the wanted place among the others is where (rows at or below a value overall) less (those of
    the unit) passes it. Between two values of the unit that difference follows the overall counts, so a
    unit meets only its own distinct values and, per output, two rows looked up in one scan of all values.
    NULL is a unit like any other; units whose complement is empty get NULL.
    """
    units = df.select(unit).distinct()
    out = units
    by_column: dict[str, dict[str, float]] = {}
    for name, (c, q) in measures.items():
        by_column.setdefault(c, {})[name] = q
    for c, wanted in by_column.items():
        out = key_join(out, _complement(df.select(unit, F.col(c).cast("double").alias("__v")), units, unit, wanted), [unit], "left")
    return out


def _complement(df: DataFrame, units: DataFrame, unit: str, wanted: dict[str, float]) -> DataFrame:
    own = settled(value_counts(df, [unit], "__v"))
    overall = own.groupBy("__v").agg(F.sum("__cnt").alias("__cnt")).withColumn("__all", F.lit(0))
    # rows up to and including each value, overall and within the unit
    up = settled(Ordered(overall, ["__all"], ["__v"]).with_scans(__hi=running_sum("__cnt")).drop("__all"))
    mine = Ordered(own, [unit], ["__v"]).with_scans(__own=running_sum("__cnt")).select(unit, "__v", "__own")
    sizes = key_join(units, own.groupBy(unit).agg(F.sum("__cnt").alias("__n_own")), [unit], "left")
    sizes = sizes.crossJoin(F.broadcast(up.agg(F.max("__hi").alias("__n_all"))))
    n = F.col("__n_all") - F.coalesce("__n_own", F.lit(0))
    place = {k: F.lit(float(q)) * (n - 1) for k, q in wanted.items()}
    places = [f(v).cast("bigint") for v in place.values() for f in (F.floor, F.ceil)]
    sizes = settled(sizes.filter(n > 0).select(unit, F.array(*place.values()).alias("__p"), F.array(*places).alias("__k")))
    # a unit's values that the place among the others passes by: its last one tells how many rows of the
    # unit stand before the wanted row, hence that row's place overall
    others = F.col("__hi") - F.col("__own")
    d = key_join(key_join(mine, up.select("__v", "__hi"), ["__v"]), sizes.select(unit, "__k"), [unit])
    passed = d.groupBy(unit).agg(F.array(*[F.max(F.when(others <= F.col("__k")[i], F.col("__own"))) for i in range(len(places))]).alias("__before"))
    ranked = key_join(sizes, passed, [unit], "left").withColumn(
        "__rank", F.transform("__k", lambda k, i: k + F.coalesce(F.col("__before")[i], F.lit(0)))
    )
    ranked = settled(ranked.select(unit, "__p", "__rank"))
    ranks = ranked.select(F.explode("__rank").alias("__rank")).distinct()
    steps = up.select(F.lit(0).alias("__all"), (F.col("__hi") - F.col("__cnt")).alias("__pos"), F.lit(0).alias("__kind"), "__v")
    asked = ranks.select(F.lit(0).alias("__all"), F.col("__rank").alias("__pos"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__v"))
    found = Ordered(steps.unionByName(asked), ["__all"], ["__pos", "__kind"]).with_scans(__x=last_valid("__v"))
    found = found.filter("__kind = 1").select(F.col("__pos").alias("__rank"), "__x")
    each = ranked.select(unit, "__p", F.posexplode("__rank").alias("__i", "__rank"))
    values = key_join(each, found, ["__rank"]).groupBy(unit).agg(
        F.max("__p").alias("__p"), *[F.max(F.when(F.col("__i") == i, F.col("__x"))).alias(f"__x{i}") for i in range(len(places))]
    )
    out = {}
    for i, k in enumerate(wanted):
        lo, hi = F.col(f"__x{2 * i}"), F.col(f"__x{2 * i + 1}")
        out[k] = lo + (hi - lo) * (F.col("__p")[i] - F.floor(F.col("__p")[i]))
    return values.select(unit, *[v.alias(k) for k, v in out.items()])
