"""Run registered queries next to their SQL in DuckDB and report differences.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    def norm(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int,)) or type(v).__name__.startswith(("int", "uint")):
            return float(v)
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return None if math.isnan(v) else float(v) + 0.0
        if hasattr(v, "tolist"):
            return tuple(norm(x) for x in v.tolist())
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return str(v)

    cols = sorted(pdf.columns)
    rows = [tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def difference(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(spark_pdf.columns)} {bad[0]}"
    return ""


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    from __spark_entry__ import oracle_sql, queries

    from cyclograin import session

    spark = session(8)
    con = connect(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            pdf = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            note = ""
            if name in sqls:
                t0 = time.time()
                note = difference(pdf, con.execute(sqls[name]).df())
                kind = f"sql {time.time() - t0:5.1f}s"
            else:
                kind = "rows only"
        except Exception as exc:
            took, kind, note = time.time() - start, "error", str(exc)[:500]
            pdf = []
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok':4} {name:28} {took:6.2f}s rows={len(pdf):7} {kind} {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
