"""Tables that grow beyond what planning takes them for are never broadcast."""

from __future__ import annotations

import corpus_pipeline
from cyclograin.llm import simhash


def test_replicas_are_not_broadcast(spark, tmp_path):
    # read from a file, so planning knows a size: far below the broadcast limit, though each row becomes sixty
    spark.range(1000).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "fp"))
    links = simhash.fingerprint_links(spark.read.parquet(str(tmp_path / "fp")))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


def test_stage_of_the_pipeline_broadcasts_no_table_made_in_python(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i * j % 89}" for j in range(40))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    plans, write = [], simhash.settled
    monkeypatch.setattr(simhash, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "").count()
    made = [p for p in plans if "MapInArrow" in p]
    assert made
    assert not [p for p in made if "Broadcast" in p]
