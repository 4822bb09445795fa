"""Registered queries beside their SQL, and all of them on the smallest data."""

from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from compare import connect, difference  # noqa: E402

from cyclograin.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in queries.ORACLE:
        assert difference(got, connect(sf).execute(queries.ORACLE[name]).df()) == ""
