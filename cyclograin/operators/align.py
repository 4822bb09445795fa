"""Alignment of a processed series with its raw series, and the identity verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.operators.attach import key_join, settled
from cyclograin.operators.inference import spearman
from cyclograin.operators.ordered import Ordered, has_hot_key, ordinal
from cyclograin.operators.ranks import quantiles

# Tolerance ladder, search window and thresholds of the alignment rule.
TOLERANCES = (1e-6, 1e-5, 1e-4, 5e-4, 1e-3, 5e-3)
SEARCH_WINDOW = 256
GOOD_RATIO = 0.9
STRICT_TOLERANCE = 1e-4
STRICT_ROWS = 30
STRICT_RATIO = 0.5
IDENTITY_BAND = 0.03

PAIR_ROWS = 1_000_000


def greedy_match(raw: np.ndarray, proc: np.ndarray, tol: float, window: int = SEARCH_WINDOW) -> np.ndarray:
    """For each processed value the first raw position ahead within tolerance, else -1.

    The pointer moves past a match and stays put on a miss; zero and missing values are skipped.
    """
    out = np.full(len(proc), -1, dtype=np.int64)
    at = 0
    for i, b in enumerate(proc):
        if not np.isfinite(b) or b == 0:
            continue
        ahead = raw[at : at + window]
        near = np.abs(ahead - b) <= tol * abs(b)
        k = int(near.argmax()) if near.size else 0
        if near.size and near[k]:
            out[i] = at + k
            at += k + 1
    return out


def climb(raw: np.ndarray, proc: np.ndarray, tolerances: Sequence[float]) -> tuple[np.ndarray, list[int]]:
    """Mapping of the first rung with a good ratio (else of the last) and matches per rung tried."""
    matched: list[int] = []
    found = np.full(len(proc), -1, dtype=np.int64)
    for tol in tolerances:
        found = greedy_match(raw, proc, tol)
        matched.append(int((found >= 0).sum()))
        if len(proc) and matched[-1] / len(proc) >= GOOD_RATIO:
            break
    return found, matched


def align(
    raw: DataFrame, proc: DataFrame, keys: Sequence[str], raw_row: str, proc_row: str, value: str,
    tolerances: Sequence[float] = TOLERANCES, max_rows: int = PAIR_ROWS,
) -> DataFrame:
    """One row per processed row: raw position or NULL, deviation, tolerance, rung counts.

    The two series of an entity meet in one task while both have at most ``max_rows`` rows.
    Longer ones are matched slice by slice: a step reads one bounded slice of each series and
    hands the two positions on to the next step, so the result is that of a single pass.
    """
    keys, rungs = list(keys), [float(t) for t in tolerances]
    left = raw.select(*keys, F.col(raw_row).cast("bigint").alias("__r"), F.col(value).cast("double").alias("__a"))
    right = proc.select(
        *keys, F.col(proc_row).cast("bigint").alias("proc_row"), F.col(value).cast("double").alias("__b")
    )
    long = [d for d in (left, right) if has_hot_key(d, keys, max_rows)]
    if not long:
        return _align_whole(left, right, keys, rungs)
    counts = [d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows) for d in long]
    hot = settled(reduce(DataFrame.unionByName, counts).select(*keys).distinct())
    short = [key_join(d, hot, keys, "left_anti") for d in (left, right)]
    cut = [key_join(d, hot, keys, "left_semi") for d in (left, right)]
    return _align_whole(*short, keys, rungs).unionByName(_align_in_steps(*cut, keys, rungs, max_rows))


def _align_whole(left: DataFrame, right: DataFrame, keys: list[str], rungs: list[float]) -> DataFrame:
    """Short series: one row per entity with both series as arrays, many entities per batch."""
    kind = T.StructType(
        [T.StructField("found", T.ArrayType(T.LongType())), T.StructField("rungs", T.ArrayType(T.LongType()))]
    )

    @F.pandas_udf(kind)
    def match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [climb(np.asarray(x, dtype=float), np.asarray(y, dtype=float), rungs) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"found": [f for f, _ in got], "rungs": [m for _, m in got]})

    def packed(d: DataFrame, row: str, value: str) -> DataFrame:
        series = F.array_sort(F.collect_list(F.struct(row, value)))
        s = d.groupBy(*keys).agg(series.alias("__s"))
        return s.select(
            *keys, F.transform("__s", lambda p: p[row]).alias(f"{row}s"), F.transform("__s", lambda p: p[value]).alias(f"{value}s")
        )

    d = key_join(packed(right, "proc_row", "__b"), packed(left, "__r", "__a"), keys, "left")
    none = F.array().cast(T.ArrayType(T.DoubleType()))
    d = d.withColumn("__a", F.coalesce("__as", none)).withColumn("__m", match("__a", "__bs"))

    def row_of(x: Column) -> Column:
        at = (x["found"] + 1).cast("int")
        hit = x["found"] >= 0
        return F.struct(
            x["proc_rows"].alias("proc_row"), F.when(hit, F.try_element_at("__rs", at)).alias("raw_row"),
            x["__bs"].alias("proc_value"), F.when(hit, F.try_element_at("__a", at)).alias("raw_value"),
        )

    rows = F.transform(F.arrays_zip("proc_rows", "__bs", F.col("__m.found").alias("found")), row_of)
    d = d.select(*keys, rows.alias("__z"), F.col("__m.rungs").alias("rungs"), F.size("__a").cast("bigint").alias("n_raw"))
    tol = F.try_element_at(F.array(*[F.lit(t) for t in rungs]), F.size("rungs"))
    d = d.select(*keys, F.explode("__z").alias("__x"), tol.alias("tol"), "rungs", "n_raw")
    return d.select(*keys, "__x.*", "tol", "rungs", "n_raw")


def _align_in_steps(
    left: DataFrame, right: DataFrame, keys: list[str], rungs: list[float], max_rows: int
) -> DataFrame:
    size = max(max_rows, 4 * SEARCH_WINDOW)
    slices = F.floor(F.col("__i") / size).alias("__c")
    raw = settled(Ordered(left, keys, ["__r"], size).with_scans(__i=ordinal()).select("*", slices))
    proc = settled(Ordered(right, keys, ["proc_row"], size).with_scans(__i=ordinal()).select("*", slices))
    n_raw = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"))
    n_proc = proc.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_proc"))
    sizes = settled(key_join(n_proc, n_raw, keys, "left").na.fill(0, ["n_raw"]))
    state = sizes.withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(len(rungs) - 1))))
    state = settled(state.withColumns({"at_proc": F.lit(0).cast("bigint"), "at_raw": F.lit(0).cast("bigint")}))
    group = [*keys, "rung"]
    schema = T.StructType(
        [
            *[state.schema[c] for c in group],
            T.StructField("proc_at", T.LongType()), T.StructField("raw_at", T.LongType()), T.StructField("state", T.BooleanType()),
        ]
    )

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("__i"), b.sort_values("__i")
        tol, total = rungs[int(b["rung"].iloc[0])], int(b["n_raw"].iloc[0])
        values, base, at = a["__a"].to_numpy(), int(b["at_raw"].iloc[0]), int(b["at_raw"].iloc[0])
        end, pairs, done = base + len(values), [], int(b["__i"].iloc[0])
        for i, v in zip(b["__i"].to_numpy(), b["__b"].to_numpy(), strict=True):
            if at + SEARCH_WINDOW > end and end < total:
                break
            if np.isfinite(v) and v != 0:
                near = np.abs(values[at - base : at - base + SEARCH_WINDOW] - v) <= tol * abs(v)
                k = int(near.argmax()) if near.size else 0
                if near.size and near[k]:
                    pairs.append((int(i), at + k, False))
                    at += k + 1
            done = int(i) + 1
        pairs.append((done, at, True))
        out = pd.DataFrame(pairs, columns=["proc_at", "raw_at", "state"])
        for c in group:
            out[c] = b[c].iloc[0]
        return out[[*group, "proc_at", "raw_at", "state"]]

    steps: list[DataFrame] = []
    while True:
        open_ = state.filter((F.col("at_proc") < F.col("n_proc")) & (F.col("at_raw") < F.col("n_raw")))
        if not open_.take(1):
            break
        here = F.floor(F.col("at_raw") / size)
        want_raw = open_.withColumn("__c", F.explode(F.array(here, here + 1)))
        want_proc = open_.withColumn("__c", F.floor(F.col("at_proc") / size))
        a = key_join(raw, F.broadcast(want_raw), [*keys, "__c"]).filter(F.col("__i") >= F.col("at_raw"))
        b = key_join(proc, F.broadcast(want_proc), [*keys, "__c"]).filter(F.col("__i") >= F.col("at_proc"))
        a = a.select(*group, "__i", "__a")
        # fresh column identities on one side: both sides stem from the same state table
        b = b.select(*[F.col(c).alias(c) for c in (*group, "__i", "__b", "at_raw", "n_raw")])
        got = settled(a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(run, schema))
        steps.append(got.filter(~F.col("state")).drop("state"))
        moved = got.filter("state").select(*group, F.col("proc_at").alias("__p"), F.col("raw_at").alias("__q"))
        d = key_join(state, F.broadcast(moved), group, "left")
        d = d.withColumns({"at_proc": F.coalesce("__p", "at_proc"), "at_raw": F.coalesce("__q", "at_raw")})
        state = settled(d.drop("__p", "__q"))
    if steps:
        pairs = reduce(DataFrame.unionByName, steps)
    else:
        pairs = proc.sparkSession.createDataFrame([], T.StructType(schema.fields[:-1]))
    counts = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    tried = key_join(state.select(*group, "n_proc", "n_raw"), counts, group, "left").na.fill(0, ["m"])
    good = F.min(F.when(F.col("m") / F.col("n_proc") >= GOOD_RATIO, F.col("rung")))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("rung", "m"))), lambda s: s["m"])
    choice = tried.groupBy(*keys).agg(
        F.coalesce(good, F.lit(len(rungs) - 1)).alias("rung"), packed.alias("__m"), F.first("n_raw").alias("n_raw")
    )
    choice = settled(choice)
    mine = key_join(pairs, F.broadcast(choice.select(*group)), group).select(
        *keys, F.col("proc_at").alias("__i"), F.col("raw_at")
    )
    d = key_join(key_join(proc, mine, [*keys, "__i"], "left"), F.broadcast(choice), keys)
    a = raw.select(*keys, F.col("__i").alias("raw_at"), F.col("__r").alias("raw_row"), F.col("__a").alias("raw_value"))
    d = key_join(d, a, [*keys, "raw_at"], "left")
    tol = F.try_element_at(F.array(*[F.lit(t) for t in rungs]), F.col("rung") + 1)
    return d.select(
        *keys, "proc_row", "raw_row", F.col("__b").alias("proc_value"), "raw_value", tol.alias("tol"),
        F.slice("__m", F.lit(1), F.col("rung") + 1).alias("rungs"), "n_raw",
    )


def verdict(
    mapping: DataFrame, keys: Sequence[str], tolerances: Sequence[float] = TOLERANCES
) -> DataFrame:
    """Match statistics, identity and release status of every aligned entity."""
    d = mapping.withColumns(
        {
            "__hit": F.col("raw_row").isNotNull(),
            "__raw": F.when(F.col("raw_row").isNotNull(), F.col("raw_value")),
        }
    )
    dev = F.when(F.col("__hit"), F.abs(F.col("raw_value") - F.col("proc_value")) / F.abs("proc_value"))
    ratio = F.when(F.col("__hit"), F.col("proc_value") / F.greatest(F.col("raw_value"), F.lit(1e-12)))
    d = d.withColumns({"__dev": dev, "__ratio": ratio})
    n_strict = sum(t <= STRICT_TOLERANCE for t in tolerances)
    stats = d.groupBy(*keys).agg(
        F.count_if("__hit").alias("matched"),
        F.count(F.lit(1)).alias("proc_rows"),
        F.max("n_raw").alias("raw_rows"),
        F.max("tol").alias("tol_used"),
        F.max("__dev").alias("dev_max"),
        F.first("rungs").alias("__rungs"),
        F.min("raw_row").alias("raw_first"),
        F.max("raw_row").alias("raw_last"),
    )
    q = quantiles(d, keys, {"dev_median": ("__dev", 0.5), "dev_p99": ("__dev", 0.99), "ratio_median": ("__ratio", 0.5)})
    rho = spearman(d, keys, "__raw", "proc_value", min_n=3).select(*keys, "rho")
    s = key_join(key_join(stats, q, keys), rho, keys, "left")
    strict = F.try_element_at("__rungs", F.least(F.size("__rungs"), F.lit(n_strict)))
    s = s.withColumns(
        {
            "matched_ratio": F.col("matched") / F.col("proc_rows"),
            "matched_strict": F.coalesce(strict, F.lit(0)),
            "unmatched_raw": F.col("raw_rows") - F.col("matched"),
        }
    )
    strict_ok = (F.col("matched_strict") >= STRICT_ROWS) & (F.col("matched_strict") / F.col("proc_rows") >= STRICT_RATIO)
    ratio_ok = F.coalesce(F.abs(F.col("ratio_median") - 1.0) <= IDENTITY_BAND, F.lit(False))
    row_ok = F.col("matched_ratio") >= GOOD_RATIO
    no_raw = F.coalesce(F.col("raw_rows"), F.lit(0)) == 0
    s = s.withColumn("tol_used", F.when(~no_raw, F.col("tol_used")))
    # The identity and status texts.
    identity = F.when(strict_ok & ratio_ok, "pass").when(strict_ok, "fail").otherwise("unverifiable")
    status = (
        F.when(no_raw, "fail_mapping")
        .when(strict_ok & ratio_ok & row_ok, "pass")
        .when(strict_ok & ratio_ok, "fail_mapping")
        .when(strict_ok, "fail_identity")
        .otherwise("unverifiable")
    )
    exact = row_ok & (F.col("tol_used") <= 1e-5) & (F.col("dev_max") <= 1e-5)
    return s.withColumns(
        {
            "identity_status": identity, "status": status, "row_level_mapping": row_ok,
            "exact_subsequence": F.coalesce(exact, F.lit(False)),
        }
    ).drop("__rungs")
