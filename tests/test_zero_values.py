"""Values of zero: first ones, logarithms and denominators, beside SQL."""

from __future__ import annotations

import pathlib

import pytest
from compare import connect, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    """The smallest tables, with the first value of some users and some later values set to zero."""
    path = tmp_path_factory.mktemp("zeros")
    for f in pathlib.Path(sf).glob("*.parquet"):
        if f.stem != "events":
            (path / f.name).symlink_to(f)
    connect(sf).execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN user_id % 5 < 2 AND user_id % 3 = 0 AND (t = 1 OR event_id % 6 = 0) THEN 0.0 ELSE value END AS value)
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL)
        TO '{path}/events.parquet' (FORMAT parquet)"""
    )
    return str(path)


@pytest.mark.parametrize("name", ["g11_self_ratio", "p18_scalar_projections", "j17_prefix_agreement"])
def test_zeros_match_sql(spark, zeros, name):
    got = entry.queries()[name](spark, zeros).toPandas()
    want = connect(zeros).execute(entry.oracle_sql()[name]).df()
    assert difference(got[want.columns.tolist()], want) == ""
