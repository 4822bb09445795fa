"""Column helpers shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """The value as double, or NULL for NaN and the infinities."""
    v = col(c).cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(~bad, v)


def is_finite(c: ColumnLike) -> Column:
    return finite(c).isNotNull()


def clip(c: ColumnLike, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(hi)), F.lit(lo))


def stable(c: ColumnLike, digits: int = 6) -> Column:
    """Round half-up with a tiny shift, so exact ties of decimal data agree across engines."""
    scale = float(10**digits)
    v = col(c) * scale + 0.50001
    # floor gives a 64-bit integer; from 2^53 on a double is whole, and infinities and NaN stay what they are
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v) / scale


def ieee_divide(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as IEEE 754 has it: infinite or NaN, not NULL, where b is zero."""
    x, y = col(a).cast("double"), col(b).cast("double")
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))


def ieee_log(c: ColumnLike, log=F.ln) -> Column:
    """Logarithm as IEEE 754 has it: minus infinity at zero, NaN below."""
    v = col(c).cast("double")
    return F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(log(v))


def stable_columns(df: DataFrame, cols: Iterable[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: stable(c, digits) for c in cols})


def hash_key(seed: ColumnLike | int, salt: str, *keys: ColumnLike) -> Column:
    """60-bit pseudo-random order key, a pure function of seed, salt and row keys.

    It replaces a random stream: a retried task gives the same draw.
    """
    seed_col = F.lit(str(seed)) if isinstance(seed, int) else col(seed).cast("string")
    parts = [seed_col, F.lit(salt), *[col(k).cast("string") for k in keys]]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_uniform(seed: ColumnLike | int, salt: str, *keys: ColumnLike) -> Column:
    """Uniform draw in [0, 1) from :func:`hash_key`."""
    return (hash_key(seed, salt, *keys) % F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def row_mean(cols: Iterable[ColumnLike]) -> Column:
    items = [col(c) for c in cols]
    total = items[0]
    for c in items[1:]:
        total = total + c
    return total / F.lit(float(len(items)))


def array_median(values: Column) -> Column:
    """Median of an array of doubles (NULLs ignored); NULL when nothing is left."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(s)
    lo = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2.0)


def decode_rate(code: ColumnLike) -> Column:
    """Rate code to number: a leading zero marks the decimal point (``025`` -> 0.25)."""
    c = col(code)
    digits = c.cast("double")
    return F.when(c.startswith("0"), digits / F.pow(F.lit(10.0), F.length(c) - 1)).otherwise(digits)


def rmse(y: ColumnLike, pred: ColumnLike) -> Column:
    d = col(y) - col(pred)
    return F.sqrt(F.avg(d * d))


def delta_pct(arm: ColumnLike, base: ColumnLike) -> Column:
    return (col(arm) - col(base)) / col(base) * 100.0
