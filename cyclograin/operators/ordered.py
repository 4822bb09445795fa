"""Skew-safe ordered scans over keyed series.

A window partitioned by entity puts one entity into one task. That is the right plan
while every entity is small, and the wrong one when a single entity holds a third of
all rows. :class:`Ordered` offers one vocabulary for both cases.

* Small input, or a row count per key below ``max_rows``: plain windows that share one
  partitioning and one sort.
* Otherwise only the oversized keys are cut into chunks along their order columns. Each
  chunk is scanned on its own, its summary (count, minimum, sum, last value) is carried
  forward over the small summary table, and the few rows a sliding frame needs from the
  neighbouring chunk are copied over as a halo. Results are the same rows and values.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclograin.functions import array_median
from cyclograin.operators.attach import key_join
from cyclograin.schema import require_columns

MAX_ROWS_PER_TASK = 2_000_000
SMALL_INPUT_BYTES = 64 * 1024 * 1024
SMALL_INPUT_ROWS = 1_000_000

_CHUNK, _HALO, _RANK = "__chunk", "__halo", "__rank"


@dataclass(frozen=True)
class Scan:
    """One value per row, computed along the order of its entity."""

    kind: str
    expr: Column | None = None
    n: int = 1


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ordinal() -> Scan:
    """0-based position."""
    return Scan("ordinal")


def prev(value: str | Column, n: int = 1) -> Scan:
    return Scan("prev", _c(value), n)


def following(value: str | Column, n: int = 1) -> Scan:
    return Scan("next", _c(value), n)


def first(value: str | Column) -> Scan:
    """Value of the first row."""
    return Scan("first", _c(value))


def last(value: str | Column) -> Scan:
    """Value of the last row (reads the whole life)."""
    return Scan("last", _c(value))


def rolling_avg(value: str | Column, width: int) -> Scan:
    """Mean of the last ``width`` rows including the current one."""
    return Scan("rolling_avg", _c(value), width)


def running_min(value: str | Column) -> Scan:
    return Scan("running_min", _c(value))


def running_max(value: str | Column) -> Scan:
    return Scan("running_max", _c(value))


def running_sum(value: str | Column) -> Scan:
    return Scan("running_sum", _c(value))


def last_valid(value: str | Column) -> Scan:
    """Latest non-NULL value up to the current row."""
    return Scan("last_valid", _c(value))


def early_median(value: str | Column, k: int) -> Scan:
    """Median of the first ``min(t + 1, k)`` values."""
    return Scan("early_median", _c(value), k)


def total(aggregate: Column) -> Scan:
    """An aggregate over the whole entity (reads the whole life)."""
    return Scan("total", aggregate)


def input_bytes(df: DataFrame) -> int:
    """Total size of the tables a plan reads, as stored."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_one_task(df: DataFrame, limit: int = SMALL_INPUT_BYTES) -> bool:
    """True when the tables read are so small that counting rows per key is not worth a job.

    This only picks the physical route, so unlike a broadcast it needs no proven bound.
    """
    return input_bytes(df) <= limit


_PROBES: OrderedDict[tuple, bool] = OrderedDict()


def has_hot_key(df: DataFrame, keys: Sequence[str], max_rows: int) -> bool:
    """Whether any key exceeds ``max_rows`` rows: one map-side combined count over the keys.

    The answer is remembered for the same plan over the same files, since one evaluation asks
    several times. It only picks the physical route; both routes give the same rows.
    """
    if max_rows >= SMALL_INPUT_ROWS and fits_one_task(df):
        return False
    files = tuple(sorted(df.inputFiles()))
    probe = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), files, tuple(keys), max_rows)
    if probe not in _PROBES:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        _PROBES[probe] = bool(counts.filter(F.col("__n") > max_rows).take(1))
        if len(_PROBES) > 1000:
            _PROBES.popitem(last=False)
    return _PROBES[probe]


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys above ``max_rows`` rows with the number of chunks ``__pieces`` each needs.

    There are at most rows / ``max_rows`` of them.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_rows)
    return _settled(counts.select(*keys, F.ceil(F.col("__n") / F.lit(float(max_rows))).alias("__pieces")))


def _settled(df: DataFrame) -> DataFrame:
    from cyclograin.operators.attach import settled

    return settled(df)


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """Attach a chunk number that rises along the order; keys that are not hot stay in chunk 0.

    Hot keys are cut by a range partitioning over the key and all order columns, of any type, and
    written once, so every later use sees the same chunks. Only their rows are written.
    """
    pieces = hot.agg(F.sum("__pieces")).first()[0] or 1
    names = hot.select(*keys)
    cold = key_join(df, names, keys, "left_anti").withColumns({_CHUNK: F.lit(0), "__hot": F.lit(False)})
    cut = key_join(df, names, keys, "left_semi").repartitionByRange(int(pieces) + 1, *keys, *order)
    cut = _settled(cut.withColumns({_CHUNK: F.spark_partition_id(), "__hot": F.lit(True)}))
    return cold.unionByName(cut)


class Ordered:
    """A keyed series with an explicit order; see the module text."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        max_rows: int | None = None,
        default_rows: int = MAX_ROWS_PER_TASK,
    ) -> None:
        self.keys, self.order = list(keys), list(order)
        self.df = require_columns(df, [*self.keys, *self.order])
        self.bounds: DataFrame | None = None
        limit = max_rows or default_rows
        if has_hot_key(df, self.keys, limit):
            self.bounds = hot_keys(df, self.keys, limit)

    def with_scans(self, **scans: Scan) -> DataFrame:
        """The input plus one column per scan."""
        if self.bounds is None:
            return self._plain(scans)
        return self._chunked(scans)

    # plain windows -------------------------------------------------------------
    def _plain(self, scans: dict[str, Scan]) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        whole = Window.partitionBy(*self.keys)
        df = self.df
        early = {k: s for k, s in scans.items() if s.kind == "early_median"}
        rest = {k: _plain_column(s, w, whole) for k, s in scans.items() if k not in early}
        if early:
            rest[_RANK] = F.row_number().over(w)
        df = df.withColumns(rest)
        if early:
            upto = w.rowsBetween(Window.unboundedPreceding, 0)
            df = df.withColumns(
                {
                    k: F.percentile(F.when(F.col(_RANK) <= s.n, s.expr), F.lit(0.5)).over(upto)
                    for k, s in early.items()
                }
            ).drop(_RANK)
        return df

    # chunked scan --------------------------------------------------------------
    def _chunked(self, scans: dict[str, Scan]) -> DataFrame:
        keys, kc = self.keys, [*self.keys, _CHUNK]
        src = self.df.withColumns(
            {f"__v_{k}": s.expr for k, s in scans.items() if s.expr is not None and s.kind != "total"}
        )
        d = with_chunks(src, keys, self.order, self.bounds)
        # used several times below: computed once, one row per key and chunk
        summary = _settled(self._summary(d, scans))

        back = max([_reach(s) for s in scans.values()], default=0)
        ahead = max([s.n for s in scans.values() if s.kind == "next"], default=0)
        rows = d.withColumn(_HALO, F.lit(False))
        if back:
            rows = rows.unionByName(self._halo(d, summary, back, forward=False))
        if ahead:
            rows = rows.unionByName(self._halo(d, summary, ahead, forward=True))

        w = Window.partitionBy(*kc).orderBy(*self.order)
        local = {
            f"__l_{k}": _local_column(k, s, w) for k, s in scans.items() if s.kind in _LOCAL
        }
        out = rows.withColumns(local).filter(~F.col(_HALO)) if local else rows.filter(~F.col(_HALO))
        carry = summary.select(*kc, *[c for c in summary.columns if c.startswith("__s_")])
        out = key_join(out, carry, kc)
        out = out.withColumns({k: _finish(k, s) for k, s in scans.items()})
        return out.select(*self.df.columns, *scans)

    def _summary(self, d: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        keys, kc = self.keys, [*self.keys, _CHUNK]
        pos = F.struct(*self.order)
        aggs = [F.count(F.lit(1)).alias("__n")]
        for k, s in scans.items():
            v = F.col(f"__v_{k}")
            if s.kind == "running_min":
                aggs.append(F.min(v).alias(f"__a_{k}"))
            elif s.kind == "running_max":
                aggs.append(F.max(v).alias(f"__a_{k}"))
            elif s.kind == "running_sum":
                aggs.append(F.sum(v).alias(f"__a_{k}"))
            elif s.kind == "last_valid":
                aggs.append(F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"__a_{k}"))
            elif s.kind == "first":
                aggs.append(F.min_by(F.struct(v), pos).alias(f"__a_{k}"))
            elif s.kind == "last":
                aggs.append(F.max_by(F.struct(v), pos).alias(f"__a_{k}"))
        summary = d.groupBy(*kc).agg(*aggs)

        order = Window.partitionBy(*keys).orderBy(_CHUNK)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols = {
            "__s___before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
            "__idx": F.row_number().over(order),
        }
        for k, s in scans.items():
            a = F.col(f"__a_{k}")
            if s.kind == "running_min":
                cols[f"__s_{k}"] = F.min(a).over(before)
            elif s.kind == "running_max":
                cols[f"__s_{k}"] = F.max(a).over(before)
            elif s.kind == "running_sum":
                cols[f"__s_{k}"] = F.sum(a).over(before)
            elif s.kind == "last_valid":
                cols[f"__s_{k}"] = F.last(a, ignorenulls=True).over(before)
            elif s.kind == "first":
                cols[f"__s_{k}"] = F.first(a).over(whole)
            elif s.kind == "last":
                cols[f"__s_{k}"] = F.last(a).over(whole)
        summary = summary.withColumns(cols)

        totals = {k: s for k, s in scans.items() if s.kind == "total"}
        if totals:
            per_key = self.df.groupBy(*keys).agg(
                *[s.expr.alias(f"__s_{k}") for k, s in totals.items()]
            )
            summary = key_join(summary, per_key, keys)
        early = {k: s for k, s in scans.items() if s.kind == "early_median"}
        if early:
            summary = key_join(summary, self._heads(d, summary, early), keys)
        return summary

    def _heads(self, d: DataFrame, summary: DataFrame, early: dict[str, Scan]) -> DataFrame:
        """Per key, the medians of its first 1, 2, ..., k values."""
        kc = [*self.keys, _CHUNK]
        k_max = max(s.n for s in early.values())
        w = Window.partitionBy(*kc).orderBy(*self.order)
        heads = d.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) <= k_max)
        heads = (
            key_join(heads, summary.select(*kc, "__s___before"), kc)
            .withColumn(_RANK, F.col(_RANK) + F.col("__s___before"))
            .filter(F.col(_RANK) <= k_max)
        )
        packed = heads.groupBy(*self.keys).agg(
            F.array_sort(
                F.collect_list(F.struct(_RANK, *[F.col(f"__v_{k}") for k in early]))
            ).alias("__h")
        )
        return packed.select(
            *self.keys, *[_prefix_medians(f"__v_{k}", s.n).alias(f"__s_{k}") for k, s in early.items()]
        )

    def _halo(self, d: DataFrame, summary: DataFrame, reach: int, forward: bool) -> DataFrame:
        """Copies of the rows a neighbouring chunk needs, addressed to that chunk."""
        keys, kc = self.keys, [*self.keys, _CHUNK]
        order = [F.col(o) if forward else F.col(o).desc() for o in self.order]
        w = Window.partitionBy(*kc).orderBy(*order)
        edge = (
            d.filter(F.col("__hot"))
            .withColumn(_RANK, F.row_number().over(w))
            .filter(F.col(_RANK) <= reach)
        )
        start, end = F.col("__s___before"), F.col("__s___before") + F.col("__n")
        here = summary.select(*kc, F.col("__idx"), start.alias("__start"), end.alias("__end"))
        steps = F.explode(F.sequence(F.lit(1), F.lit(reach)))
        sign = -1 if forward else 1
        here = here.withColumn("__step", steps).withColumn(
            "__to", F.col("__idx") + sign * F.col("__step")
        )
        there = summary.select(
            *keys,
            F.col("__idx").alias("__to"),
            F.col(_CHUNK).alias("__dest"),
            start.alias("__dstart"),
            end.alias("__dend"),
        )
        gap = F.col("__start") - F.col("__dend") if forward else F.col("__dstart") - F.col("__end")
        pairs = key_join(here, there, [*keys, "__to"]).withColumn("__gap", gap)
        pairs = pairs.filter(F.col("__gap") < reach).select(*kc, "__dest", "__gap")
        return (
            key_join(edge, pairs, kc)
            .filter(F.col(_RANK) + F.col("__gap") <= reach)
            .withColumn(_CHUNK, F.col("__dest"))
            .withColumn(_HALO, F.lit(True))
            .drop(_RANK, "__dest", "__gap")
        )


def _prefix_medians(field: str, k: int) -> Column:
    def value(r: Column) -> Column:
        return r[field]

    def upto(i: Column) -> Column:
        return array_median(F.transform(F.slice("__h", F.lit(1), i), value))

    return F.transform(F.sequence(F.lit(1), F.least(F.size("__h"), F.lit(k))), upto)


_LOCAL = (
    "ordinal", "prev", "next", "rolling_avg", "running_min", "running_max", "running_sum",
    "last_valid", "early_median",
)


def _reach(s: Scan) -> int:
    return {"prev": s.n, "rolling_avg": s.n - 1}.get(s.kind, 0)


def _plain_column(s: Scan, w, whole) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    make: dict[str, Callable[[], Column]] = {
        "ordinal": lambda: F.row_number().over(w) - 1,
        "prev": lambda: F.lag(s.expr, s.n).over(w),
        "next": lambda: F.lead(s.expr, s.n).over(w),
        "first": lambda: F.first(s.expr).over(upto),
        "last": lambda: F.last(s.expr).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
        "rolling_avg": lambda: F.avg(s.expr).over(w.rowsBetween(1 - s.n, 0)),
        "running_min": lambda: F.min(s.expr).over(upto),
        "running_max": lambda: F.max(s.expr).over(upto),
        "running_sum": lambda: F.sum(s.expr).over(upto),
        "last_valid": lambda: F.last(s.expr, ignorenulls=True).over(upto),
        "total": lambda: s.expr.over(whole),
    }
    return make[s.kind]()


def _local_column(name: str, s: Scan, w) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(f"__v_{name}") if s.expr is not None else None
    own = F.when(~F.col(_HALO), v) if v is not None else None
    if s.kind in ("ordinal", "early_median"):
        return F.sum(F.when(~F.col(_HALO), 1).otherwise(0)).over(upto)
    if s.kind == "prev":
        return F.lag(v, s.n).over(w)
    if s.kind == "next":
        return F.lead(v, s.n).over(w)
    if s.kind == "rolling_avg":
        return F.avg(v).over(w.rowsBetween(1 - s.n, 0))
    if s.kind == "last_valid":
        return F.last(own, ignorenulls=True).over(upto)
    fn = {"running_min": F.min, "running_max": F.max, "running_sum": F.sum}[s.kind]
    return fn(own).over(upto)


def _finish(name: str, s: Scan) -> Column:
    """Local value combined with what earlier chunks carry in."""
    local, carry = F.col(f"__l_{name}"), F.col(f"__s_{name}")
    if s.kind == "ordinal":
        return (F.col("__s___before") + local - 1).cast("int")
    if s.kind in ("prev", "next", "rolling_avg"):
        return local
    if s.kind == "running_min":
        return F.least(local, carry)
    if s.kind == "running_max":
        return F.greatest(local, carry)
    if s.kind == "running_sum":
        return F.when(
            local.isNotNull() | carry.isNotNull(),
            F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
        )
    if s.kind == "last_valid":
        return F.coalesce(local, carry)
    if s.kind in ("first", "last"):
        return carry.getField(f"__v_{name}")
    if s.kind == "early_median":
        at = F.least(F.col("__s___before") + local, F.size(carry)).cast("int")
        return F.try_element_at(carry, at)
    return carry
