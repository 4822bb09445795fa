"""Connected components of a link table, by alternating star contractions.

Each round is a few shuffles over the remaining links and is written to the shared folder, so
a lost executor costs a re-read and the plan does not grow. Hubs are handled by aggregates and
skew-splittable joins; no node's links meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.operators.attach import settled


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of each node on its smallest neighbour."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if small:
        # links are stored as (larger a, smaller b)
        kept = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.unionByName(least.select("a", F.col("m").alias("b")))
    return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Links may come in either direction and repeated; self-links and nulls are ignored.
    """
    ends = links.filter(F.col("a") != F.col("b"))
    now = settled(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        large = _star(now, small=False).distinct()
        now = settled(_star(large, small=True).filter(F.col("a") != F.col("b")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
