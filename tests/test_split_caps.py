"""Capped stratified split, largest remainders, anchor deviation."""

from fractions import Fraction
from math import ceil

import pytest
from pyspark.sql import functions as F

from cyclograin.operators import sampling, trajectory


def shares(sizes, quota):
    """Largest remainder by fractions; ties go to the first stratum, NULL before all."""
    whole = sum(sizes.values())
    exact = {k: Fraction(n * quota, whole) for k, n in sizes.items()}
    given = {k: int(x) for k, x in exact.items()}
    order = sorted(sizes, key=lambda k: (given[k] - exact[k], k is not None, k or ""))
    for k in order[: quota - sum(given.values())]:
        given[k] += 1
    return given


@pytest.fixture(scope="module")
def rows(spark):
    sizes = {None: 7, "a": 61, "b": 20, "c": 1, "d": 11}
    data = [(f"{k}-{i}", k, "kept") for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "id string, s string, is_old string"), sizes


@pytest.mark.parametrize(("train", "test"), [(1000, 1000), (33, 10), (0, 3), (50, 0)])
def test_sizes_are_exact(rows, train, test):
    df, sizes = rows
    got = sampling.capped_split(df, ["s"], ["id"], 0.3, train, test, 4)
    assert set(got.columns) == {"id", "s", "is_old", "is_test"}
    found = {(r["s"], r["is_test"]): r["n"] for r in got.groupBy("s", "is_test").agg(F.count("*").alias("n")).collect()}
    held = shares(sizes, ceil(100 * 0.3))
    left = {k: n - held[k] for k, n in sizes.items()}
    for side, of, cap in ((True, held, test), (False, left, train)):
        expected = shares(of, min(cap, sum(of.values())))
        assert {k: found.get((k, side), 0) for k in sizes} == expected
    assert got.select("id").distinct().count() == got.count()


def test_partitions_do_not_matter(rows):
    df, _ = rows
    one = {(r["id"], r["is_test"]) for r in sampling.capped_split(df, ["s"], ["id"], 0.3, 60, 30, 4).collect()}
    five = {(r["id"], r["is_test"]) for r in sampling.capped_split(df.repartition(5), ["s"], ["id"], 0.3, 60, 30, 4).collect()}
    assert one == five


def test_empty_table_and_wrong_caps(rows):
    df, _ = rows
    assert sampling.capped_split(df.filter("false"), ["s"], ["id"], 0.3, 5, 5).count() == 0
    with pytest.raises(ValueError):
        sampling.capped_split(df, ["s"], ["id"], 0.3, -1, 5)
    with pytest.raises(ValueError):
        sampling.capped_split(df, ["s"], ["id"], 1.3, 1, 5)


def test_counts_beyond_doubles_are_shared_exactly(spark):
    sizes = {"a": 3_000_000_000_000_000_001, "b": 2_999_999_999_999_999_999, "c": 7}
    d = spark.createDataFrame(list(sizes.items()), "s string, n long")
    got = sampling.apportioned(d, "n", F.lit(100_000_000_000_000_001), ["s"], "k")
    assert {r["s"]: r["k"] for r in got.collect()} == shares(sizes, 100_000_000_000_000_001)


def test_anchor_deviation(spark):
    d = spark.createDataFrame([(1, 0, 0.5, 2.0, 1.0), (1, 1, 0.5, 4.0, -7.0), (2, 0, 1.0, None, 3.0)], "e int, t int, w double, a double, b double")
    got = {r["e"]: r for r in trajectory.weight_profile(d, ["e"], "t", "w", ["a", "b"]).collect()}
    assert got[1]["max_deviation"] == pytest.approx(4.0) and got[2]["max_deviation"] == 0.0
    assert "max_deviation" not in trajectory.weight_profile(d, ["e"], "t", "w").columns
