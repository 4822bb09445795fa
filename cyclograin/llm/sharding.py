"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are packed by falling weight; each goes to the bin with the least remaining capacity that
still holds it, found in a balanced search tree, and a new bin is opened when none does. Groups of
equal weight are interchangeable, so packing works on the histogram of weights: a run of equal
groups fills the tightest bin, then the next. The histogram has at most sqrt(2 * total weight)
rows, whatever the number of groups; it and the runs are all that the driver holds. Groups are then
numbered within their weight, by salted counts, and joined to the runs.

Edge cases: a group heavier than the capacity gets a bin of its own; a null group key is a
group; repeated rows belong to the same group each with its own slot; an empty table needs no bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclograin.operators.attach import settled

#: rows of one key that one task numbers, about
NUMBERED = 200_000


class CapacityTree:
    """A balanced (AA) tree of (remaining capacity, bin), with a search for the tightest fit."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key, level, left, right):
            self.key, self.level, self.left, self.right = key, level, left, right

    def __init__(self):
        self.nil = self._Node(None, 0, None, None)
        self.nil.left = self.nil.right = self.nil
        self.root = self.nil

    def _skew(self, t):
        if t.left.level == t.level and t is not self.nil:
            t.left.right, t.left, t = t, t.left.right, t.left
        return t

    def _split(self, t):
        if t.right.right.level == t.level and t is not self.nil:
            up = t.right
            t.right, up.left = up.left, t
            up.level += 1
            return up
        return t

    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, t, key):
        if t is self.nil:
            return self._Node(key, 1, self.nil, self.nil)
        if key < t.key:
            t.left = self._insert(t.left, key)
        else:
            t.right = self._insert(t.right, key)
        return self._split(self._skew(t))

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t, key):
        if t is self.nil:
            return t
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is self.nil:
            return t.right
        else:
            heir = t.left
            while heir.right is not self.nil:
                heir = heir.right
            t.key = heir.key
            t.left = self._remove(t.left, heir.key)
        if t.left.level < t.level - 1 or t.right.level < t.level - 1:
            t.level -= 1
            t.right.level = min(t.right.level, t.level)
            t = self._skew(t)
            t.right = self._skew(t.right)
            t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
        return t

    def tightest(self, weight: int):
        """The smallest (remaining, bin) with at least this much room, or None."""
        t, best = self.root, None
        while t is not self.nil:
            if t.key[0] >= weight:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def pack(histogram: Sequence[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit-decreasing over ``(weight, number of groups)``.

    Runs ``(weight, first, last, bin)`` say that the groups first..last (from 0) of a weight
    go to a bin. None when more than ``most_bins`` would be needed.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for weight, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            room = tree.tightest(weight)
            if room is None:
                if most_bins is not None and bins >= most_bins:
                    return None
                room, bins = (max(capacity, weight), bins), bins + 1
            else:
                tree.remove(room)
            n = min(count - done, room[0] // weight) if weight else count - done
            runs.append((weight, done, done + n - 1, room[1]))
            tree.insert((room[0] - n * weight, room[1]))
            done += n
    return runs


def pack_into(histogram: Sequence[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Pack into at most ``bins`` bins of the smallest common capacity that a bisection finds.

    No capacity below the mean or the heaviest group can do; the search stops within a millionth of it.
    """
    total = sum(w * n for w, n in histogram)
    low = max(-(-total // bins), max((w for w, _ in histogram), default=0))
    best, step = pack(histogram, low, bins), max(1, low >> 20)
    while best is None:
        best, low, step = pack(histogram, low + step, bins), low + step, step * 2
    high, low = low, low - step // 2
    while high - low > max(1, high >> 20):
        middle = (low + high) // 2
        found = pack(histogram, middle, bins)
        if found is None:
            low = middle
        else:
            best, high = found, middle
    return best


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in no task more than a salted part of them."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-largest // NUMBERED))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(o) if isinstance(o, str) else o for o in order]), F.lit(salts)))
    row = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)) - 1
    if salts == 1:
        return salted.withColumn(out, row.cast("long")).drop("_salt")
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, "_salt").count().select(*keys, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_salt"]]
    placed = salted.withColumn("_row", row).alias("a").join(offsets.alias("b"), same)
    return placed.select("a.*", (F.col("_before") + F.col("_row")).cast("long").alias(out)).drop("_salt", "_row")


def assign(rows: DataFrame, group: str, weight: str, capacity: int | None = None, bins: int | None = None) -> DataFrame:
    """``group, bin`` for every distinct value of a non-null group column, packed by summed weight.

    Give either a fixed ``capacity`` (as few bins as best fit finds) or a number of ``bins``
    (as small a capacity as the search finds).
    """
    if (capacity is None) == (bins is None):
        raise ValueError("give either capacity or bins")
    spark = rows.sparkSession
    groups = settled(rows.groupBy(F.col(group).alias("_g")).agg(F.sum(weight).alias("_w")))
    histogram = [(r["_w"], r["count"]) for r in groups.groupBy("_w").count().toLocalIterator()]
    runs = pack_into(histogram, bins) if capacity is None else pack(histogram, capacity)
    plan = spark.createDataFrame(runs, "_w long, _first long, _last long, bin int")
    place = numbered(groups, ["_w"], ["_g"], "_n").join(plan, "_w")
    return place.filter(F.col("_n").between(F.col("_first"), F.col("_last"))).select(F.col("_g").alias(group), "bin")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot``: equal texts stay together, shards have near-equal bytes.

    A text's size is its bytes plus one; a null text counts as empty. Texts are told apart by a
    64-bit hash; two texts that collide would merely share a shard.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    rows = settled(rows)
    placed = rows.join(assign(rows, "_text", "size", bins=n_shards), "_text").withColumnRenamed("bin", "shard")
    out = numbered(settled(placed), ["shard"], ["id", "text_crc32", "size"], "slot")
    return out.select("id", "size", "text_crc32", "shard", "slot")
