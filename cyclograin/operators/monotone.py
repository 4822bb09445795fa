"""Monotone projections of trajectories.

Pooling adjacent violators is the same whatever the order of merging, so an oversized
series is pooled chunk by chunk, the surviving blocks are cut into new chunks with shifted
borders, and the rounds stop when no two neighbours violate the order anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.operators import windows
from cyclograin.operators.attach import attach, key_join, settled
from cyclograin.operators.ordered import Ordered, following, last_valid, ordinal
from cyclograin.operators.trajectory import violation_ratio

MAX_ROUNDS = 10_000
PANDAS_ROWS = 1_000_000


def pool_blocks(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (first index, sum, count) of the non-increasing least-squares fit."""
    start: list[int] = []
    s: list[float] = []
    n: list[float] = []
    for i in range(len(sums)):
        cs, cn, at = float(sums[i]), float(counts[i]), i
        while s and s[-1] * cn < cs * n[-1]:
            cs += s.pop()
            cn += n.pop()
            at = start.pop()
        start.append(at)
        s.append(cs)
        n.append(cn)
    return np.array(start, dtype=np.int64), np.array(s), np.array(n)


def fit_decreasing(y: np.ndarray) -> np.ndarray:
    """The fit over the known values; unknown ones stay unknown and separate nothing."""
    known = ~np.isnan(y)
    out = np.full(len(y), np.nan)
    if known.any():
        _, s, n = pool_blocks(y[known], np.ones(int(known.sum())))
        out[known] = np.repeat(s / n, n.astype(int))
    return out


class CausalFit:
    """Last value of the fit of every prefix; the block stack is all that is remembered.

    Unknown values stay unknown and change nothing.
    """

    def __init__(self) -> None:
        self.sums: list[float] = []
        self.counts: list[float] = []

    def extend(self, y: np.ndarray) -> np.ndarray:
        s, n, out = self.sums, self.counts, np.empty(len(y))
        for i, v in enumerate(y.tolist()):
            if v != v:
                out[i] = v
                continue
            cs, cn = v, 1.0
            while s and s[-1] * cn < cs * n[-1]:
                cs += s.pop()
                cn += n.pop()
            s.append(cs)
            n.append(cn)
            out[i] = cs / cn
        return out


def group_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which the key differs from the row before (0 included)."""
    change = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        v, gap = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        change[1:] |= (v[1:] != v[:-1]) & ~(gap[1:] & gap[:-1])
    if len(pdf):
        change[0] = True
    return np.flatnonzero(change)


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _whole_series(df: DataFrame, keys, order, y: str, out: str, fit) -> DataFrame:
    """Fit complete series; many short series share one Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[pd.DataFrame] = []

        def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
            starts = group_starts(pdf, keys)
            v = pdf[y].to_numpy(dtype=float)
            return pdf.assign(**{out: np.concatenate([fit(p) for p in np.split(v, starts[1:])])})

        for pdf in batches:
            if not len(pdf):
                continue
            if tail and len(group_starts(pd.concat([tail[-1].tail(1), pdf.head(1)], ignore_index=True), keys)) == 2:
                # the batch begins a new series, so the open one is complete
                yield fitted(pd.concat(tail, ignore_index=True))
                tail = []
            last = int(group_starts(pdf, keys)[-1])
            if last:
                yield fitted(pd.concat([*tail, pdf.iloc[:last]], ignore_index=True))
                tail = []
            tail.append(pdf.iloc[last:])
        if tail:
            yield fitted(pd.concat(tail, ignore_index=True))

    return _sorted(df, keys, order).mapInPandas(run, schema)


def isotonic(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, out: str, max_rows: int | None = None
) -> DataFrame:
    """Non-increasing isotonic regression of every trajectory (offline); rows without a label stay without a fit.

    Pass only the columns you need: rows cross into Python once.
    """
    scan = Ordered(df, keys, order, max_rows, PANDAS_ROWS)
    if scan.bounds is None:
        return _whole_series(df, keys, order, y, out, fit_decreasing)
    hot = scan.bounds.select(*keys)
    short = _whole_series(key_join(df, hot, keys, "left_anti"), keys, order, y, out, fit_decreasing)
    long = Ordered(key_join(df, hot, keys, "left_semi"), keys, order, max_rows, PANDAS_ROWS)
    return short.unionByName(_isotonic_in_rounds(long, y, out, max_rows or PANDAS_ROWS))


def _isotonic_in_rounds(scan: Ordered, y: str, out: str, max_rows: int) -> DataFrame:
    keys = scan.keys
    rows = settled(scan.with_scans(__pos=ordinal()))
    blocks = rows.filter(F.col(y).isNotNull()).select(
        *keys, F.col("__pos").cast("bigint").alias("__start"), F.col(y).alias("__sum"), F.lit(1.0).alias("__n")
    )
    schema = blocks.schema

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__start", kind="stable").reset_index(drop=True)
        at, s, n = pool_blocks(pdf["__sum"].to_numpy(), pdf["__n"].to_numpy())
        return pdf.iloc[at].assign(__sum=s, __n=n)[list(pdf.columns)]

    for i in range(MAX_ROUNDS):
        shift = (i % 2) * (max_rows // 2)
        numbered = Ordered(blocks, keys, ["__start"], max_rows).with_scans(__no=ordinal())
        chunk = F.floor((F.col("__no") + shift) / max_rows).alias("__part")
        cut = numbered.select(*keys, "__start", "__sum", "__n", chunk)
        blocks = settled(
            cut.groupBy(*keys, "__part").applyInPandas(
                lambda pdf: pool(pdf.drop(columns="__part")), schema
            )
        )
        pairs = Ordered(blocks, keys, ["__start"], max_rows).with_scans(
            __s2=following("__sum"), __n2=following("__n")
        )
        if not pairs.filter(F.col("__sum") * F.col("__n2") < F.col("__s2") * F.col("__n")).take(1):
            break
    else:
        raise RuntimeError("isotonic pooling did not settle")
    means = blocks.select(
        *keys, F.col("__start").cast("int").alias("__pos"), (F.col("__sum") / F.col("__n")).alias("__mean")
    )
    placed = key_join(rows, means, [*keys, "__pos"], "left")
    fitted = Ordered(placed, keys, ["__pos"], max_rows).with_scans(**{out: last_valid("__mean")})
    return fitted.withColumn(out, F.when(F.col(y).isNotNull(), F.col(out))).drop("__pos", "__mean")


def causal_isotonic(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, out: str, max_rows: int | None = None
) -> DataFrame:
    """Last value of the non-increasing fit of every prefix (online): min over j of mean(y_j..y_t).

    Rows without a label get none and change nothing.

    Rows stream through in order; between batches only the block stack of the open series
    is kept, never its rows. A series above ``max_rows`` is worked off in steps instead: each
    step reads one slice of its rows and the top slice of its block stack.
    """
    scan = Ordered(df, keys, order, max_rows, PANDAS_ROWS)
    if scan.bounds is None:
        return _causal_streamed(df, keys, order, y, out)
    hot = scan.bounds.select(*keys)
    short = key_join(df, hot, keys, "left_anti")
    long = key_join(df, hot, keys, "left_semi")
    done = _causal_in_steps(long, keys, order, y, out, max_rows or PANDAS_ROWS)
    return _causal_streamed(short, keys, order, y, out).unionByName(done)


def _causal_streamed(df: DataFrame, keys, order, y: str, out: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = CausalFit(), None
        for pdf in batches:
            if not len(pdf):
                continue
            starts = group_starts(pdf, keys)
            made = []
            for i, part in enumerate(np.split(pdf[y].to_numpy(dtype=float), starts[1:])):
                key = tuple(pdf[k].iloc[starts[i]] for k in keys)
                if key != last:
                    state, last = CausalFit(), key
                made.append(state.extend(part))
            yield pdf.assign(**{out: np.concatenate(made)})

    return _sorted(df, keys, order).mapInPandas(run, schema)


def _causal_in_steps(df: DataFrame, keys, order, y: str, out: str, size: int) -> DataFrame:
    """Slices of rows against the top of the block stack.

    A row that pools through the whole slice of the stack is left pending and goes on with the
    next slice below, so neither rows nor stack are ever held whole.
    """
    keys = list(keys)
    unknown = df.filter(F.col(y).isNull()).withColumn(out, F.lit(None).cast("double"))
    rows = Ordered(df.filter(F.col(y).isNotNull()), keys, order, size).with_scans(__pos=ordinal())
    rows = settled(rows.withColumns({"__pos": F.col("__pos").cast("bigint"), "__part": F.floor(F.col("__pos") / size)}))
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    state = settled(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumns(
            {"at": zero, "pend_s": none, "pend_n": none, "top": zero}
        )
    )
    kinds = T.StructType(
        [
            *[rows.schema[k] for k in keys], T.StructField("kind", T.IntegerType()), T.StructField("pos", T.LongType()),
            T.StructField("s", T.DoubleType()), T.StructField("n", T.DoubleType()), T.StructField("top", T.LongType()),
        ]
    )

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("__pos"), b.sort_values("pos")
        top = int(a["top"].iloc[0])
        base, s, n = top - len(b), b["s"].tolist(), b["n"].tolist()
        cs, cn = float(a["pend_s"].iloc[0]), float(a["pend_n"].iloc[0])
        made, at = [], int(a["__pos"].iloc[0])
        for i, v in zip(a["__pos"].tolist(), a["__v"].tolist(), strict=True):
            if cn == 0:
                cs, cn = v, 1.0
            while s and s[-1] * cn < cs * n[-1]:
                cs += s.pop()
                cn += n.pop()
            if not s and base > 0:
                break
            s.append(cs)
            n.append(cn)
            made.append((0, i, cs / cn, 0.0, 0))
            cs, cn, at = 0.0, 0.0, i + 1
        made += [(1, base + j, x, w, 0) for j, (x, w) in enumerate(zip(s, n, strict=True))]
        made.append((2, at, cs, cn, base + len(s)))
        got = pd.DataFrame(made, columns=["kind", "pos", "s", "n", "top"])
        for k in keys:
            got[k] = a[k].iloc[0]
        return got[[*keys, "kind", "pos", "s", "n", "top"]]

    spark = df.sparkSession
    stack = spark.createDataFrame([], T.StructType([f for f in kinds.fields if f.name not in ("kind", "top")]))
    values: list[DataFrame] = []
    while True:
        open_ = state.filter(F.col("at") < F.col("rows"))
        if not open_.take(1):
            break
        want = open_.withColumn("__part", F.floor(F.col("at") / size)).drop("rows")
        a = rows.select(*keys, "__part", "__pos", F.col(y).cast("double").alias("__v"))
        a = key_join(a, want, [*keys, "__part"]).filter(F.col("__pos") >= F.col("at")).drop("__part", "at")
        low = F.greatest(F.col("top") - size, F.lit(0))
        edge = open_.select(*keys, low.alias("__low"))
        marked = key_join(stack, edge, keys, "left").withColumn(
            "__near", F.coalesce(F.col("pos") >= F.col("__low"), F.lit(False))
        )
        # fresh column identities on one side of the pairing
        b = marked.filter("__near").select(*[F.col(c).alias(c) for c in (*keys, "pos", "s", "n")])
        got = settled(a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, kinds))
        values.append(got.filter("kind = 0").select(*keys, F.col("pos").alias("__pos"), F.col("s").alias(out)))
        fresh = got.filter("kind = 1").select(*keys, "pos", "s", "n")
        stack = settled(marked.filter("not __near").select(*keys, "pos", "s", "n").unionByName(fresh))
        moved = got.filter("kind = 2").select(
            *keys, F.col("pos").alias("__at"), F.col("s").alias("__s"), F.col("n").alias("__n"), F.col("top").alias("__t")
        )
        d = key_join(state, moved, keys, "left")
        state = settled(
            d.select(
                *keys, "rows", F.coalesce("__at", "at").alias("at"), F.coalesce("__s", "pend_s").alias("pend_s"),
                F.coalesce("__n", "pend_n").alias("pend_n"), F.coalesce("__t", "top").alias("top"),
            )
        )
    if not values:
        return unknown
    fitted = reduce(DataFrame.unionByName, values)
    return key_join(rows, fitted, [*keys, "__pos"]).select(*df.columns, out).unionByName(unknown)


def smooth_isotonic(df, keys, order, y: str, out: str, max_rows: int | None = None) -> DataFrame:
    """Centred median of five, then the non-increasing fit (offline)."""
    d = windows.rolling_median5(df, keys, order, y, "__smooth", max_rows)
    return isotonic(d, keys, order, "__smooth", out, max_rows).drop("__smooth")


# The mode names. Mode name -> (operator, reads only the past).
POSTPROCESSORS = {
    "none": (lambda df, keys, order, y, out: df.withColumn(out, F.col(y)), True),
    "iso": (isotonic, False),
    "smooth": (windows.rolling_median5, False),
    "iso_smooth": (smooth_isotonic, False),
    "causal": (windows.causal_cummin, True),
    "causal_sm": (windows.causal_smooth_cummin, True),
    "iso_causal": (causal_isotonic, True),
    "shift_ctrl": (windows.shift_control, False),
}


def register_postprocessor(name: str, operator, online: bool) -> None:
    """Add a mode: ``operator(df, keys, order, y, out) -> DataFrame``."""
    POSTPROCESSORS[name] = (operator, online)


def postprocess(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, modes: Sequence[str], strict: bool = False
) -> DataFrame:
    """Add one column ``{y}__{mode}`` per mode; ``strict`` refuses modes that read the future."""
    for m in modes:
        operator, online = POSTPROCESSORS[m]
        if strict and not online:
            raise ValueError(f"mode {m!r} reads the future")
        df = operator(df, keys, order, y, f"{y}__{m}")
    return df


def apply_gate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pred: str, lam: DataFrame | float,
    mode: str = "iso", out: str = "gated",
) -> DataFrame:
    """Project only the entities whose predicted trajectory has violation ratio <= lambda.

    ``lam`` is a number or a table with the columns of the key and ``lam_star``.
    """
    operator, _ = POSTPROCESSORS[mode]
    v = violation_ratio(df, keys, order, pred).select(*keys, "violation")
    if isinstance(lam, DataFrame):
        v = attach(v, lam, [c for c in lam.columns if c in keys])
    else:
        v = v.withColumn("lam_star", F.lit(float(lam)))
    passing = v.filter(F.col("violation") <= F.col("lam_star")).select(*keys)
    projected = operator(key_join(df, passing, keys, "left_semi"), keys, order, pred, out)
    return projected.unionByName(key_join(df, passing, keys, "left_anti").withColumn(out, F.col(pred)))
