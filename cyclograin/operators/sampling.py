"""Deterministic sampling, splitting and label noise driven by hashes of row keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclograin.functions import hash_key, hash_uniform
from cyclograin.operators.attach import attach, attach_global, settled
from cyclograin.operators.ordered import Ordered, first, following, ordinal, total
from cyclograin.operators.ranks import quantiles, top_n, with_hash_rank


def context_sample(
    df: DataFrame, unit: Sequence[str], ids: Sequence[str], cap: int = 2048, seed: int = 0
) -> DataFrame:
    """Uniform sample of at most ``cap`` rows per unit without replacement.

    The fixed cap is a rank limit, so each map task forwards at most ``cap`` rows per unit.
    """
    h = hash_key(seed, "context", *ids)
    return top_n(df, unit, [h, *[F.col(c) for c in ids]], cap, "__r").drop("__r")


def context_sample_by(
    df: DataFrame, groups: Sequence[str], seed: str, ids: Sequence[str], cap: int
) -> DataFrame:
    """As :func:`context_sample` with the seed taken from a column of the grid."""
    h = hash_key(F.col(seed), "context", *ids)
    return top_n(df, groups, [h, *[F.col(c) for c in ids]], cap, "__r").drop("__r")


def end_sample(
    df: DataFrame, unit: Sequence[str], entity: str, order: Sequence[str], ids: Sequence[str],
    mode: str, cap: int, seed: int = 0,
) -> DataFrame:
    """Even budget per entity from its latest (``recent``) or earliest (``early``) rows.

    The total is then cut or topped up to ``cap`` at random.
    """
    keys = [*unit, entity]
    n_entities = df.groupBy(*unit).agg(F.count_distinct(entity).alias("__e"), F.count(F.lit(1)).alias("__rows"))
    by = [F.col(c).desc() if mode == "recent" else F.col(c) for c in order]
    h = hash_key(seed, f"end-{mode}", *ids)
    ranked = df.withColumn("__h", h)
    # rows beyond the cap of their own entity can enter only through the random top-up,
    # and there only the cap best hashes of an entity can matter
    near = top_n(ranked, keys, by, cap, "__pos")
    lucky = top_n(ranked, keys, [F.col("__h"), *[F.col(c) for c in ids]], cap, "__pos")
    pool = near.unionByName(lucky.withColumn("__pos", F.lit(1 << 40))).groupBy(*df.columns, "__h").agg(
        F.min("__pos").alias("__pos")
    )
    pool = attach(pool, n_entities, unit)
    budget = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("__e")))
    pool = pool.withColumn("__rest", (F.col("__pos") > budget) & (F.col("__rows") > cap))
    order_cols = [F.col("__rest"), F.col("__h"), *[F.col(c) for c in ids]]
    return top_n(pool, unit, order_cols, cap, "__r").select(*df.columns)


def quota_sample(
    df: DataFrame, unit: Sequence[str], group: Sequence[str], ids: Sequence[str], cap: int, seed: int = 0
) -> DataFrame:
    """Even quota over groups; small groups are taken whole, leftovers top up to ``cap``."""
    h = hash_key(seed, "quota", *ids)
    by = [F.col("__h"), *[F.col(c) for c in ids]]
    d = df.withColumn("__h", h)
    groups = d.groupBy(*unit).agg(
        F.count_distinct(F.struct(*group)).alias("__g"), F.count(F.lit(1)).alias("__rows")
    )
    # a row ranked beyond the cap inside its own group can never be drawn
    d = top_n(d, [*unit, *group], by, cap, "__r")
    d = attach(d, groups, unit)
    quota = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("__g")))
    d = d.withColumn("__rest", (F.col("__r") > quota) & (F.col("__rows") > cap))
    return top_n(d, unit, [F.col("__rest"), *by], cap, "__k").select(*df.columns)


def with_label_bins(
    df: DataFrame, unit: Sequence[str], y: str, n_bins: int, out: str = "bin"
) -> DataFrame:
    """Equal-mass bins of the label with exact, half-open quantile edges."""
    measures = {f"__e{i}": (y, i / n_bins) for i in range(1, n_bins)}
    d = attach(df, quantiles(df, unit, measures), unit)
    number = sum((F.col(e) <= F.col(y)).cast("int") for e in measures)
    return d.withColumn(out, number).drop(*measures)


def stage_bin(stage: str, n_bins: int = 10) -> Column:
    """Equal-width bins of [0, 1 + 1e-9], so an exact edge falls into the lower bin."""
    return F.least(
        F.lit(n_bins - 1), F.floor(F.col(stage) * n_bins / F.lit(1 + 1e-9)).cast("int")
    )


def coverage_sample(
    df: DataFrame, unit: Sequence[str], entity: str, ids: Sequence[str], mode: str, cap: int,
    seed: int = 0, y: str = "y", stage: str = "stage", n_bins: int = 10,
) -> DataFrame:
    """Context selection covering labels, stages, entities or labels within entities."""
    # The mode names.
    if mode == "random":
        return context_sample(df, unit, ids, cap, seed)
    if mode == "soh_strat":
        d, group = with_label_bins(df, unit, y, n_bins, "__bin"), ["__bin"]
    elif mode == "stage_strat":
        d, group = df.withColumn("__bin", stage_bin(stage, n_bins)), ["__bin"]
    elif mode == "cell_balanced":
        d, group = df, [entity]
    elif mode == "soh_cell":
        d, group = with_label_bins(df, unit, y, 5, "__bin"), [entity, "__bin"]
    else:
        raise ValueError(f"unknown coverage mode {mode!r}")
    return quota_sample(d, unit, group, ids, cap, seed).select(*df.columns)


def coverage_diagnostics(
    selected: DataFrame, pool: DataFrame, unit: Sequence[str], entity: str, y: str = "y",
    stage: str = "stage",
) -> DataFrame:
    """Quantile distance, range ratio, entity coverage and stage deviation of a selection."""
    probe = {f"q{i}": (y, i / 20) for i in range(21)}
    qs = quantiles(selected, unit, {f"__s_{k}": v for k, v in probe.items()})
    qa = quantiles(pool, unit, {f"__a_{k}": v for k, v in probe.items()})
    gap = sum(F.abs(F.col(f"__s_{k}") - F.col(f"__a_{k}")) for k in probe) / 21.0

    def stats(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(*unit).agg(
            (F.max(y) - F.min(y)).alias(f"{p}range"),
            F.count_distinct(entity).alias(f"{p}entities"),
            F.stddev_pop(stage).alias(f"{p}stage"),
        )

    keys = list(unit)
    d = qs.join(qa, keys).join(stats(selected, "__s_"), keys).join(stats(pool, "__a_"), keys)
    return d.select(
        *keys,
        gap.alias("label_distance"),
        (F.col("__s_range") / (F.col("__a_range") + 1e-9)).alias("range_ratio"),
        (F.col("__s_entities") / F.col("__a_entities")).alias("entity_coverage"),
        F.col("__s_stage").alias("stage_std"),
    )


def entity_subset(df: DataFrame, unit: Sequence[str], entity: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` entities per unit at random (all of them when there are fewer)."""
    ids = df.select(*unit, entity).distinct()
    h = hash_key(seed, "entities", entity)
    return top_n(ids, unit, [h, F.col(entity)], k, "__r").drop("__r")


def first_entities(df: DataFrame, unit: Sequence[str], entity: str, k: int) -> DataFrame:
    return top_n(df.select(*unit, entity).distinct(), unit, [F.col(entity)], k, "__r").drop("__r")


def derangement(
    df: DataFrame, unit: Sequence[str], entity: str, seed: Column | str | int, extra: Sequence[str] = (),
) -> DataFrame:
    """Map every entity to another one of its unit: random order, then a cyclic shift.

    ``seed`` may be a column (with ``extra`` naming it), giving one map per seed value.
    A unit with a single entity has no derangement and is left out.
    """
    ids = df.select(*unit, *extra, entity).distinct()
    d = ids.withColumn("__h", hash_key(seed, "derange", entity))
    d = Ordered(d, [*unit, *extra], ["__h", entity]).with_scans(
        __next=following(entity), __first=first(entity), __n=total(F.count(F.lit(1)))
    )
    ref = F.coalesce("__next", "__first").alias("ref")
    return d.filter(F.col("__n") > 1).select(*unit, *extra, entity, ref)


def derangements(df: DataFrame, unit: Sequence[str], entity: str, n_draws: int, seed0: int = 0) -> DataFrame:
    """``n_draws`` derangements per unit in one plan, numbered by column ``m``."""
    ids = df.select(*unit, entity).distinct()
    grid = ids.withColumn("m", F.explode(F.sequence(F.lit(seed0), F.lit(seed0 + n_draws - 1))))
    return derangement(grid, unit, entity, "m", ["m"])


def stratified_split(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], test_share: float, seed: int = 0
) -> DataFrame:
    """Exact share per stratum goes to the test side."""
    d = with_hash_rank(df, strata, ids, seed, "split", "__r", "__n")
    is_test = F.col("__r") < F.round(F.col("__n") * test_share)
    return d.withColumn("is_test", is_test).drop("__r", "__n")


def apportioned(sizes: DataFrame, size: str, quota: Column, order: Sequence[str], out: str) -> DataFrame:
    """Shares of a whole-number total over rows, by largest remainder; ties go to the first in ``order``.

    ``quota`` is the total, the same in every row and no larger than the sum of ``size``. Products are
    decimals of 38 digits, so the shares are exact: they add up to the total and none passes its size.
    """
    one = Ordered(sizes.withColumn("__one", F.lit(0)), ["__one"], list(order))
    d = one.with_scans(__all=total(F.sum(size))).withColumn("__q", quota)
    product = F.col(size).cast("decimal(19,0)") * F.col("__q").cast("decimal(18,0)")
    whole = F.col("__all").cast("decimal(19,0)")
    # without rows nothing is shared out
    rest = F.when(whole > 0, product % whole).otherwise(0).cast("decimal(19,0)")
    d = d.withColumns({"__rest": rest, "__floor": F.when(whole > 0, (product - rest) / whole).otherwise(0).cast("long")})
    d = d.withColumn("__back", -F.col("__rest"))
    d = Ordered(d, ["__one"], ["__back", *order]).with_scans(__r=ordinal(), __given=total(F.sum("__floor")))
    more = (F.col("__r") < F.col("__q") - F.col("__given")).cast("long")
    return d.withColumn(out, F.col("__floor") + more).drop("__one", "__all", "__q", "__rest", "__floor", "__back", "__r", "__given")


def capped_split(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], test_share: float, max_train: int, max_test: int, seed: int = 0,
) -> DataFrame:
    """Stratified split of exact size whose sides hold at most ``max_train`` and ``max_test`` rows.

    The test side gets ceil(rows * test_share) rows, or ``max_test`` if that is less, and the train
    side the remaining ones up to ``max_train``. Both totals are apportioned over the strata by largest
    remainder (NULL is a stratum like any other), and rows are drawn within a stratum by hash. Rows
    beyond the caps are left out: the caps are the operator's purpose and have no default.
    """
    if max_train < 0 or max_test < 0 or not 0 <= test_share <= 1:
        raise ValueError("caps are not negative and the share lies between 0 and 1")
    order = list(strata)
    sizes = settled(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n")))
    test = apportioned(sizes, "__n", F.ceil(F.col("__all") * test_share), order, "__test")
    test = test.withColumn("__rest_n", F.col("__n") - F.col("__test"))
    test = apportioned(test, "__test", F.least(F.col("__all"), F.lit(max_test)), order, "__t")
    both = apportioned(test, "__rest_n", F.least(F.col("__all"), F.lit(max_train)), order, "__l")
    d = with_hash_rank(df, strata, ids, seed, "split", "__r")
    d = attach(d, both.select(*strata, "__test", "__t", "__l"), strata)
    is_test = F.col("__r") < F.col("__test")
    kept = d.filter(F.when(is_test, F.col("__r") < F.col("__t")).otherwise(F.col("__r") - F.col("__test") < F.col("__l")))
    return kept.withColumn("is_test", is_test).drop("__r", "__test", "__t", "__l")


def label_noise(
    df: DataFrame, ids: Sequence[str], y: str, n_classes: int, rate: float, seed: int = 0,
    group: Sequence[str] = (), out: str = "y_noisy",
) -> DataFrame:
    """Flip exactly round(n * rate) labels to another class, chosen uniformly."""
    keys = list(group) or ["__all"]
    src = df if group else df.withColumn("__all", F.lit(0))
    d = with_hash_rank(src, keys, ids, seed, "noise", "__r", "__n")
    step = 1 + hash_key(seed, "class", *ids) % F.lit(n_classes - 1)
    flipped = ((F.col(y) + step) % n_classes).cast("int")
    hit = F.col("__r") < F.round(F.col("__n") * rate)
    return d.withColumn(out, F.when(hit, flipped).otherwise(F.col(y))).drop("__r", "__n", "__all")


def gaussian(seed: int, salt: str, *ids: str) -> Column:
    """Standard normal draw per row (Box-Muller on two hashed uniforms)."""
    u1 = hash_uniform(seed, salt + "-a", *ids)
    u2 = hash_uniform(seed, salt + "-b", *ids)
    return F.sqrt(-2.0 * F.ln(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def target_noise(
    df: DataFrame, ids: Sequence[str], y: str, rate: float, seed: int = 0, scale: float = 2.0,
    out: str = "y_noisy",
) -> DataFrame:
    """Add scale * population deviation * N(0, 1) to an exact share of the rows."""
    d = with_hash_rank(df.withColumn("__all", F.lit(0)), ["__all"], ids, seed, "target", "__r", "__n")
    d = attach_global(d, df.agg(F.stddev_pop(y).alias("__sd")))
    noisy = F.col(y) + scale * F.col("__sd") * gaussian(seed, "gauss", *ids)
    hit = F.col("__r") < F.round(F.col("__n") * rate)
    return d.withColumn(out, F.when(hit, noisy).otherwise(F.col(y))).drop("__r", "__n", "__sd", "__all")


def kfold(
    df: DataFrame, ids: Sequence[str], k: int, seed: int = 0, strata: Sequence[str] = (), out: str = "fold"
) -> DataFrame:
    """Balanced folds; with ``strata`` every class is balanced over the folds."""
    keys = list(strata) or ["__all"]
    src = df if strata else df.withColumn("__all", F.lit(0))
    d = with_hash_rank(src, keys, ids, seed, "fold", "__r")
    return d.withColumn(out, (F.col("__r") % k).cast("int")).drop("__r", "__all")


def group_kfold(
    df: DataFrame, unit: Sequence[str], entity: str, k: int, seed: int = 0, out: str = "fold"
) -> DataFrame:
    """Folds that keep every entity whole."""
    ids = df.select(*unit, entity).distinct()
    placed = with_hash_rank(ids, unit, [entity], seed, "gfold", "__r")
    return attach(df, placed.select(*unit, entity, (F.col("__r") % k).cast("int").alias(out)), [*unit, entity])


#: the prime modulus of the hashed weights
PRIME = 2_147_483_647


def poisson_thresholds(limit: int = 12) -> list[int]:
    """Values of a uniform draw below :data:`PRIME` at which the Poisson(1) weight rises to 1, 2, ..., ``limit``."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(limit):
        total += p
        out.append(math.floor(total * PRIME))
        p /= k + 1
    return out


def poisson_weight(x: Column, b: Column) -> Column:
    """How often replicate ``b`` takes the row with hash ``x`` (below :data:`PRIME`).

    The row is hashed once; a replicate costs a linear and a quadratic step in 64-bit arithmetic.
    """
    line = (((b * 1_103_515_245 + 12_345) % (PRIME - 1) + 1) * x + (b * 214_013 + 2_531_011) % PRIME) % PRIME
    draw = (line * line + x) % PRIME
    return sum((draw >= t).cast("int") for t in poisson_thresholds())


def bootstrap_sums(
    items: DataFrame, group: Sequence[str], ids: Sequence[str], value: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """``group, b, weight, total``: Poisson bootstrap in one pass over the rows.

    Every row has an independent Poisson(1) weight in every replicate, so nothing is numbered, looked up or
    gathered: tasks add up their rows per replicate and the exchange moves one row per group, replicate and
    task. Rows without a value count nowhere.
    """
    x = (hash_key(seed, "poisson", *group, *ids) % PRIME).alias("__x")
    d = items.filter(F.col(value).isNotNull()).select(*group, x, F.col(value).cast("double").alias("__v"))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    d = d.withColumn("__w", poisson_weight(F.col("__x"), F.col("b").cast("long")))
    return d.groupBy(*group, "b").agg(F.sum("__w").alias("weight"), F.sum(F.col("__w") * F.col("__v")).alias("total"))


def bootstrap_draws(
    items: DataFrame, group: Sequence[str], index: str, size: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """Resample indices: one row (group, b, slot, pick) per draw, ``pick`` in [0, size).

    The draws of a replicate are spread over all tasks; nothing is gathered per group.
    """
    d = items.select(*group, F.col(index).alias("slot"), size)
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    pick = hash_key(seed, "boot", *group, "b", "slot") % F.col(size)
    return d.select(*group, "b", "slot", pick.cast("int").alias("pick"))
