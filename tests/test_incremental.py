"""Incremental builds: what is made again, what stays, and what a failure leaves behind."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from marlstone.sources import incremental

SCHEMA = "source_id string, signature string, ready boolean, body string"


def sources(spark, rows):
    return spark.createDataFrame([(i, s, True, b) if len(r) == 3 else r for r in rows for i, s, *_, b in [r]], SCHEMA)


def make(changed):
    return changed.select("source_id", F.explode(F.split("body", " ")).alias("word"))


def words(spark, root):
    return sorted((r["source_id"], r["word"], r["number"]) for r in incremental.read(spark, root).collect())


def test_changes_alone_are_made(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"s{i:03d}", "v1", f"a{i} b{i}") for i in range(100)]
    first = incremental.build(sources(spark, rows), make, root, version=1)
    assert (first["source_count"], first["built"], first["reused"], first["pending"], first["rows"], first["written"]) == (100, 100, 0, 0, 200, 200)
    # one in a hundred changes: one in a hundred rows is written
    rows[7] = ("s007", "v2", "new words here")
    second = incremental.build(sources(spark, rows), make, root, version=1)
    assert (second["built"], second["reused"], second["written"], second["rows"]) == (1, 99, 3, 201)
    got = words(spark, root)
    assert [w for w in got if w[0] == "s007"] == [("s007", x, 2) for x in ("here", "new", "words")] and sum(w[2] == 1 for w in got) == 198
    # nothing changes, one leaves, one is not ready, one is new
    assert incremental.build(sources(spark, rows), make, root, version=1)["written"] == 0
    rows = [("s001", "v3", False, "x"), *rows[2:], ("t", "v1", "fresh")]
    third = incremental.build(sources(spark, rows), make, root, version=1)
    assert (third["source_count"], third["built"], third["pending"]) == (100, 1, 1)
    assert {w[0] for w in words(spark, root)} & {"s000", "s001", "t"} == {"t"}
    before = [w[:2] for w in words(spark, root)]
    assert incremental.compact(spark, root)["builds"] and [w[:2] for w in words(spark, root)] == before
    assert incremental.build(sources(spark, rows), make, root, version=1)["written"] == 0
    assert incremental.build(sources(spark, rows), make, root, version=2)["built"] == 99


def test_lost_rows_limits_and_rules(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"s{i}", "v1", "12 x" if i == 3 else "w w") for i in range(6)] + [("empty", "v1", None)]
    touched = F.col("word").rlike("^[0-9]+$")
    first = incremental.build(sources(spark, rows), make, root, version=1, touched=touched, limit=4)
    assert (first["built"], first["pending"]) == (4, 3)
    second = incremental.build(sources(spark, rows), make, root, version=1, touched=touched)
    assert (second["built"], second["reused"], second["pending"]) == (3, 4, 0)
    # newer rules touch only what is marked; a source without rows is built once
    third = incremental.build(sources(spark, rows), make, root, version=1, rules=2, touched=touched)
    assert (third["built"], {w[0] for w in words(spark, root) if w[2] == 3}) == (1, {"s3"})
    for f in glob.glob(f"{root}/data/build={first['build']}/*.parquet"):
        os.remove(f)
    # sources whose rows are gone are made again
    again = incremental.build(sources(spark, rows), make, root, version=1, rules=2, touched=touched)
    assert again["rows"] == 12 and len(words(spark, root)) == 12 and again["pending"] == 0


def test_a_failed_build_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="nothing has been built"):
        incremental.read(spark, root)
    incremental.build(sources(spark, [("a", "v1", "x y")]), make, root, version=1)
    broken = lambda df: make(df).withColumn("word", F.when(F.col("word") == "bad", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("word")))
    with pytest.raises(Exception, match="broken"):
        incremental.build(sources(spark, [("a", "v2", "bad z"), ("b", "v1", "q")]), broken, root, version=1)
    assert words(spark, root) == [("a", "x", 1), ("a", "y", 1)]
    assert incremental.build(sources(spark, [("a", "v2", "z"), ("b", "v1", "q")]), make, root, version=1)["built"] == 2
    assert words(spark, root) == [("a", "z", 2), ("b", "q", 2)]
    assert incremental.build(sources(spark, []), make, root, version=1)["rows"] == 0 and words(spark, root) == []
