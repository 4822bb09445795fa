"""Incremental twins of the history features for one row per arrival.

State per entity is typed (doubles and arrays of doubles, no encoded text), small and fixed in
size, except for the block stack of the causal isotonic fit, which can grow with a steadily
falling series. Within a micro-batch the rows of an entity are sorted by (event time, tie-break)
and worked on as arrays. A row not after the last processed one is late: what was already
emitted cannot be revised, so it comes out flagged, without values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Values = dict[str, np.ndarray]

#: Stands for an unknown time or tie-break, which comes before all others as in Spark's ascending order.
BEFORE_ALL = -(1 << 63)


@dataclass(frozen=True)
class Step:
    """What an operator remembers of an entity, and how a run of its rows changes that.

    ``advance(memory, rows)`` gets the state's fields (None for a new entity) and the new rows'
    columns, NaN where unknown; it returns the fields' new values and the output columns.
    """

    fields: Sequence[T.StructField]
    advance: Callable[[dict | None, Values], tuple[dict, Values]]


def _number(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def _list(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.DoubleType()))


def _trailing_mean(before: Sequence[float], x: np.ndarray, width: int) -> np.ndarray:
    """Mean of the known values among the last ``width`` rows; ``before`` holds the rows ahead of ``x``."""
    ahead = np.full(width - 1, np.nan)
    if width > 1 and len(before):
        kept = np.asarray(before, float)[-(width - 1) :]
        ahead[-len(kept) :] = kept
    seen = sliding_window_view(np.concatenate([ahead, x]), width)
    known = ~np.isnan(seen)
    n = known.sum(axis=1)
    return np.where(n > 0, np.where(known, seen, 0.0).sum(axis=1) / np.maximum(n, 1), np.nan)


def _median_of_known(values: np.ndarray) -> float:
    known = values[~np.isnan(values)]
    return float(np.median(known)) if len(known) else np.nan


def history_step(cols: Sequence[str], roll: int = 5, early: int = 5) -> tuple[Step, list[str]]:
    """lag1, diff1, from_first, from_roll5 and from_early of each column."""
    families = ("lag1", "diff1", "from_first", "from_roll5", "from_early")

    def advance(memory: dict | None, rows: Values) -> tuple[dict, Values]:
        after, out = {}, {}
        for c in cols:
            x = rows[c]
            first, last = (x[0], x[0]) if memory is None else (memory[f"{c}_first"], memory[f"{c}_last"])
            tail, head = ([], []) if memory is None else (memory[f"{c}_tail"], memory[f"{c}_head"])
            lag = np.concatenate([[last], x[:-1]])
            start = np.concatenate([head, x[: early - len(head)]])
            # the anchor settles once the first rows are complete
            anchor = np.full(len(x), _median_of_known(start))
            for i in range(min(early - len(head), len(x))):
                anchor[i] = _median_of_known(start[: len(head) + i + 1])
            out[f"{c}__lag1"], out[f"{c}__diff1"], out[f"{c}__from_first"] = lag, x - lag, x - first
            out[f"{c}__from_roll5"] = x - _trailing_mean(tail, x, roll)
            out[f"{c}__from_early"] = x - anchor
            after[f"{c}_first"], after[f"{c}_last"] = first, x[-1]
            after[f"{c}_tail"], after[f"{c}_head"] = np.concatenate([tail, x])[-roll:], start
        return after, out

    fields = [f(f"{c}_{part}") for c in cols for part, f in (("first", _number), ("last", _number), ("tail", _list), ("head", _list))]
    return Step(fields, advance), [f"{c}__{f}" for c in cols for f in families]


def fill_step(cols: Sequence[str], medians: dict[str, float] | None = None) -> tuple[Step, list[str]]:
    """Forward fill; a leading gap takes the given source median, else 0."""
    medians = medians or {}

    def advance(memory: dict | None, rows: Values) -> tuple[dict, Values]:
        after, out = {}, {}
        for c in cols:
            carried = np.concatenate([[np.nan if memory is None else memory[c]], rows[c]])
            newest = np.maximum.accumulate(np.where(np.isnan(carried), 0, np.arange(len(carried))))
            carried = carried[newest]
            after[c] = carried[-1]
            out[f"{c}__filled"] = np.where(np.isnan(carried), medians.get(c, 0.0), carried)[1:]
        return after, out

    return Step([_number(c) for c in cols], advance), [f"{c}__filled" for c in cols]


def smoothing_step(y: str, width: int = 5) -> tuple[Step, list[str]]:
    """Running minimum, causal mean, minimum of means, and causal isotonic fit.

    As in the batch operators an unknown value takes up its place in the mean's window but no more:
    the running values go on unchanged, and the fit has none for its row.
    """

    def advance(memory: dict | None, rows: Values) -> tuple[dict, Values]:
        v = rows[y]
        m = memory or {"least": np.nan, "least_mean": np.nan, "tail": [], "sums": [], "counts": []}
        least = np.fmin.accumulate(np.concatenate([[m["least"]], v]))[1:]
        mean = _trailing_mean(m["tail"], v, width)
        least_mean = np.fmin.accumulate(np.concatenate([[m["least_mean"]], mean]))[1:]
        fit = np.full(len(v), np.nan)
        sums, counts = list(m["sums"]), list(m["counts"])
        for i in np.flatnonzero(~np.isnan(v)):
            s, n = float(v[i]), 1.0
            while sums and sums[-1] * n < s * counts[-1]:
                s, n = s + sums.pop(), n + counts.pop()
            sums.append(s)
            counts.append(n)
            fit[i] = s / n
        after = {"least": least[-1], "least_mean": least_mean[-1], "sums": sums, "counts": counts}
        after["tail"] = np.concatenate([m["tail"], v])[-width:]
        return after, dict(zip(outputs, (least, mean, least_mean, fit), strict=True))

    outputs = [f"{y}__{m}" for m in ("cummin", "causal_mean", "causal_sm", "iso_causal")]
    return Step([_number("least"), _number("least_mean"), _list("tail"), _list("sums"), _list("counts")], advance), outputs


def _plain(v):
    return v if v is None else v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v


def _bucket_scan(
    src: DataFrame, keys: Sequence[str], cols: Sequence[str], step: Step, outputs: Sequence[str],
    made_fields: Sequence[T.StructField], buckets: int,
) -> DataFrame:
    """The scan with one state per bucket of entities: its fields are arrays, one place per entity."""
    kinds = [src.schema[k].dataType for k in keys]
    if not all(isinstance(t, (T.IntegralType, T.StringType)) for t in kinds):
        raise ValueError("entities in buckets need keys that are whole numbers or text")
    # a key travels as a value and whether it is known: exact, and NULL is a key like any other
    own = [f"__k{i}" for i in range(len(keys))]
    gone = [f"__n{i}" for i in range(len(keys))]
    blank = [F.lit("") if isinstance(t, T.StringType) else F.lit(0).cast(t) for t in kinds]
    d = src.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("__bucket"), *cols, *[f.name for f in made_fields[:2]],
        *[F.coalesce(k, b).alias(n) for k, b, n in zip(keys, blank, own, strict=True)],
        *[F.col(k).isNull().alias(n) for k, n in zip(keys, gone, strict=True)],
    )
    key_fields = [T.StructField(n, t) for n, t in zip(own, kinds, strict=True)] + [T.StructField(n, T.BooleanType()) for n in gone]
    place = [*own, *gone]
    names = [f.name for f in step.fields]
    state_schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*key_fields, *made_fields[:2], *step.fields]]
    )
    made_schema = T.StructType([*key_fields, *made_fields, *[_number(o) for o in outputs]])
    n_place = len(place)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        held = [list(v) for v in state.get] if state.exists else [[] for _ in state_schema]
        slots = {k: i for i, k in enumerate(zip(*held[:n_place], strict=True))}
        n_known = len(slots)
        slot = np.array([slots.setdefault(k, len(slots)) for k in zip(*[pdf[c].tolist() for c in place], strict=True)], np.int64)
        at, tied = pdf["__at"].to_numpy(), pdf["__tie"].to_numpy()
        sort = np.lexsort((tied, at, slot))
        at, tied, slot = at[sort], tied[sort], slot[sort]
        late = np.zeros(len(sort), bool)
        late[1:] = (at[1:] == at[:-1]) & (tied[1:] == tied[:-1]) & (slot[1:] == slot[:-1])
        old = np.flatnonzero(slot < n_known)
        if len(old):
            last_at, last_tie = (np.array(held[n_place + i], np.int64)[slot[old]] for i in range(2))
            late[old] |= (at[old] < last_at) | ((at[old] == last_at) & (tied[old] <= last_tie))
        fresh = np.flatnonzero(~late)
        values = {o: np.full(len(sort), np.nan) for o in outputs}
        rows = {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan)[sort][fresh] for c in cols}
        new = list(slots)[n_known:]
        for i in range(n_place):
            held[i] += [k[i] for k in new]
        for v in held[n_place:]:
            v += [None] * len(new)
        starts = np.flatnonzero(np.diff(slot[fresh], prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(fresh)], strict=True):
            s = int(slot[fresh[a]])
            memory = {n: v[s] for n, v in zip(names, held[n_place + 2 :], strict=True)} if s < n_known else None
            memory, found = step.advance(memory, {c: v[a:b] for c, v in rows.items()})
            for o in outputs:
                values[o][fresh[a:b]] = found[o]
            end = fresh[b - 1]
            held[n_place][s], held[n_place + 1][s] = int(at[end]), int(tied[end])
            for n, v in zip(names, held[n_place + 2 :], strict=True):
                v[s] = _plain(memory[n])
        state.update(tuple(held))
        # nullable integers stay exact where Spark pads a batch
        fixed = {c: pdf[c].to_numpy()[sort] for c in place}
        yield pd.DataFrame({**fixed, "__at": pd.array(at, dtype="Int64"), "__tie": pd.array(tied, dtype="Int64"), "late": late, **values})

    made = d.groupBy("__bucket").applyInPandasWithState(run, made_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
    return made.select(
        *[F.when(~F.col(g), F.col(n)).alias(k) for k, n, g in zip(keys, own, gone, strict=True)],
        *[f.name for f in made_fields], *outputs,
    )


def stream_scan(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str], step: Step, outputs: Sequence[str],
    watermark: str | None = None, idle_ms: int | None = None, buckets: int | None = None,
) -> DataFrame:
    """Apply a step along each entity of a stream: one output row per input row.

    With ``buckets`` entities share states by a hash of their keys (whole numbers or text): a call of the
    function costs more than the few rows of an entity, so many entities are worked on in one. A
    micro-batch rewrites the states of the buckets it meets; expiry is per entity and goes without.

    ``tie`` is a whole number. A row without a time or tie-break comes before all others of its
    entity; of rows that share both, the first is on time. With a ``watermark`` and ``idle_ms`` the
    state of an entity leaves once the watermark is that far beyond its last row; a row that comes
    later still begins a new series.
    """
    if idle_ms is not None and watermark is None:
        raise ValueError("state can only expire by a watermark")
    if buckets is not None and idle_ms is not None:
        raise ValueError("entities that share a state cannot expire alone")
    keys = list(keys)
    src = df.select(*keys, F.col(ts).cast("timestamp").alias(ts), F.col(tie), *[F.col(c).cast("double").alias(c) for c in cols])
    if watermark:
        src = src.withWatermark(ts, watermark)
    tie_type = src.schema[tie].dataType
    # order columns travel as plain 64-bit numbers: exact, and in no session's time zone
    order = {"__at": F.unix_micros(ts), "__tie": F.col(tie).cast("long")}
    src = src.select(*keys, ts, *cols, *[F.coalesce(c, F.lit(BEFORE_ALL)).alias(n) for n, c in order.items()])
    known = {n: F.when(F.col(n) != BEFORE_ALL, F.col(n)) for n in order}
    made_fields = [T.StructField(n, T.LongType()) for n in order] + [T.StructField("late", T.BooleanType())]
    if buckets is not None:
        made = _bucket_scan(src, keys, cols, step, outputs, made_fields, buckets)
        return made.select(
            *keys, F.timestamp_micros(known["__at"]).alias(ts), known["__tie"].cast(tie_type).alias(tie), "late", *outputs
        )
    made_schema = T.StructType([*[src.schema[k] for k in keys], *made_fields, *[_number(o) for o in outputs]])
    state_schema = T.StructType([*[T.StructField(n, T.LongType()) for n in order], T.StructField("begun", T.BooleanType()), *step.fields])
    names = [f.name for f in step.fields]
    blank = dict.fromkeys(names)
    plain = _plain

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        at, tied = pdf["__at"].to_numpy(), pdf["__tie"].to_numpy()
        sort = np.lexsort((tied, at))
        at, tied = at[sort], tied[sort]
        memory = None
        late = np.zeros(len(sort), bool)
        late[1:] = (at[1:] == at[:-1]) & (tied[1:] == tied[:-1])
        if state.exists:
            last_at, last_tie, begun, *held = state.get
            late |= (at < last_at) | ((at == last_at) & (tied <= last_tie))
            memory = dict(zip(names, held, strict=True)) if begun else None
        fresh = ~late
        values = {o: np.full(len(sort), np.nan) for o in outputs}
        if fresh.any():
            rows = {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan)[sort][fresh] for c in cols}
            memory, found = step.advance(memory, rows)
            for o in outputs:
                values[o][fresh] = found[o]
            last_at, last_tie = int(at[fresh][-1]), int(tied[fresh][-1])
            state.update((last_at, last_tie, True, *[plain(v) for v in {**blank, **memory}.values()]))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(last_at // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        fixed = {k: [v] * len(sort) for k, v in zip(keys, key, strict=True)}
        # nullable integers stay exact where Spark pads a batch with empty rows for expired states
        yield pd.DataFrame({**fixed, "__at": pd.array(at, dtype="Int64"), "__tie": pd.array(tied, dtype="Int64"), "late": late, **values})

    made = src.groupBy(*keys).applyInPandasWithState(
        run, made_schema, state_schema, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout,
    )
    return made.select(
        *keys, F.timestamp_micros(known["__at"]).alias(ts), known["__tie"].cast(tie_type).alias(tie), "late", *outputs
    )


def split_late(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """On-time rows with values, and the side output of late rows."""
    return df.filter(~F.col("late")).drop("late"), df.filter(F.col("late"))


def read_table_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 1
) -> DataFrame:
    """A table folder (or one file of a folder) as a file stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain the available input into a Parquet table and read it back."""
    q = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def differences(batch: DataFrame, stream: DataFrame, ids: Sequence[str], cols: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Rows whose batch and stream values disagree, or that only one side has."""
    b = batch.select(*ids, *[F.col(c).alias(f"__b_{c}") for c in cols]).withColumn("__inb", F.lit(True))
    s = stream.select(*ids, *cols).withColumn("__ins", F.lit(True))
    d = b.join(s, list(ids), "full")
    bad = F.col("__inb").isNull() | F.col("__ins").isNull()
    for c in cols:
        gap = F.abs(F.col(c) - F.col(f"__b_{c}")) > tol
        bad = bad | F.coalesce(gap, F.col(c).isNull() != F.col(f"__b_{c}").isNull())
    return d.filter(bad).select(*ids)
