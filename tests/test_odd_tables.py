"""Queries on small tables with cases that the standard tables lack."""

import duckdb
import oracle
from oracle import both
from pyspark.sql import functions as F

from marlstone.operators import sync
from marlstone.plans import registry


def test_short_benchmark_items_are_cases(spark, tmp_path, monkeypatch):
    docs = [(1, "a zebra and an ox"), (2, "two zebras ran past the old stone mill"), (3, None), (4, "nothing here"), (5, "ox")]
    items = [(1, "zebra"), (2, "past the old stone mill"), (3, "an ox"), (4, "missing"), (5, "ox")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    for name, part in (("documents", "d"), ("benchmark", "b")):
        duckdb.sql(f"copy (select * from '{tmp_path}/{part}/*.parquet') to '{tmp_path}/{name}.parquet' (format parquet)")
    monkeypatch.setattr(oracle, "TABLES", tmp_path)
    ours, theirs = both(spark, registry.queries["eval_hit_mrr"], registry.oracle_sql["eval_hit_mrr"])
    assert ours == theirs and ours[0][0] == "4"


def test_names_are_unique_within_a_dataset_only(spark):
    manifest = spark.createDataFrame([("k1", "a.docx", "sales", "h1"), ("k2", "a.docx", "hr", "h2"), ("k3", "b.docx", "hr", "h3")], "key string, name string, domain string, content_hash string")
    receipts = spark.createDataFrame([("k1", 1, "h1", True, None)], "key string, document_id int, hash string, metadata_applied boolean, retired_at timestamp")
    rows = [("a.docx", 1, "available", "sales"), ("a.docx", 2, "available", "hr"), ("b.docx", 3, "available", "sales")]
    remote = spark.createDataFrame(rows, "name string, document_id int, status string, domain string")
    plan = {r["key"]: (r["action"], r["document_id"]) for r in sync.upload_plan(manifest, receipts, remote).collect()}
    assert plan == {"k1": ("skip", 1), "k2": ("update", 2), "k3": ("create", None)}
    assert sync.ambiguous(remote).count() == 0
    twice = remote.unionByName(remote.filter("document_id = 2").withColumn("document_id", F.lit(9)))
    assert [r["name"] for r in sync.ambiguous(twice).collect()] == ["a.docx"]
    try:
        sync.upload_plan(manifest, receipts, twice).collect()
        raise SystemError("two documents of one name in a dataset must raise")
    except Exception as e:
        assert "duplicate remote name: a.docx" in str(e)
