"""Stages that a request ends, figures of the pass itself."""

import os
import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators import progress, running
from marlstone.operators.running import Requests


def slow(spark):
    wait = F.udf(lambda i: (time.sleep(0.2), i)[1], "long")
    spark.range(0, 4000, 1, 8).select(wait("id").alias("x")).agg(F.sum("x")).collect()


def test_cancel_ends_the_running_stage(spark, tmp_path):
    ran, start = [], time.time()

    def stage(name, work):
        return name, lambda s: (ran.append(name), work(s))

    stages = [stage("scan", lambda s: s.range(10).count()), stage("build", slow), stage("package", lambda s: None)]
    asked_at = []

    def requests():
        if "build" in ran and time.time() - start > 1 and not asked_at and len(ran) == 2:
            asked_at.append(time.time() + 1.5)
        return Requests(cancel=bool(asked_at) and time.time() > asked_at[0])

    out = running.run_stages(spark, "j", stages, requests, str(tmp_path))
    assert out == ("cancelled", ["scan"]) and time.time() - asked_at[0] < 2
    assert running.markers(spark, str(tmp_path), "j") == {"scan"} and ran == ["scan", "build"]
    # a later run goes on with the stage that was ended; other jobs have markers of their own
    again = running.run_stages(spark, "j", [stage("scan", slow), stage("build", lambda s: None)], Requests, str(tmp_path))
    assert again == ("completed", ["build"]) and running.markers(spark, str(tmp_path), "k") == set()
    assert spark.range(5).count() == 5 and not spark.sparkContext.getJobTags()


def test_pause_is_heeded_between_stages(spark, tmp_path):
    ran = []
    stages = [("a", lambda s: (ran.append("a"), s.range(3).count())), ("b", lambda s: ran.append("b"))]
    assert running.run_stages(spark, "j", stages, lambda: Requests(pause=bool(ran)), str(tmp_path)) == ("paused", ["a"])
    assert running.run_stages(spark, "j", stages, lambda: Requests(True, True), str(tmp_path)) == ("cancelled", [])
    assert running.run_stages(spark, "j", stages, Requests, str(tmp_path)) == ("completed", ["b"]) and ran == ["a", "b"]


def test_what_a_stage_raises(spark, tmp_path):
    def bad(s):
        s.range(3).select(F.raise_error(F.lit("no such page"))).collect()

    with pytest.raises(Exception, match="no such page"):
        running.run_stages(spark, "j", [("a", lambda s: None), ("b", bad)], Requests, str(tmp_path))
    assert running.markers(spark, str(tmp_path), "j") == {"a"}


def test_collection(spark, tmp_path):
    c = progress.Collection()
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    c.watch(df, "texts", **progress.quality(F.col("t"))).write.parquet(f"{tmp_path}/t")
    c.watch(df.limit(0), "none", **progress.quality(F.col("t"))).write.parquet(f"{tmp_path}/n")
    found = {(r["section"], r["metric"]): r["value"] for r in c.rows(spark).collect()}
    assert found == {("texts", "rows"): 3, ("texts", "missing"): 1, ("texts", "chars"): 2, ("texts", "longest"): 2} | {("none", m): 0 for m in ("rows", "missing", "chars", "longest")}
    with pytest.raises(ValueError):
        c.watch(df, "texts", n=F.count("t"))
    with pytest.raises(ValueError):
        c.watch(df, "more")


def test_stream_progress(spark, tmp_path):
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    listener = progress.StreamProgress("five", told.append, every=2)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    watched = stream.observe("five", F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    writer = watched.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    assert progress.run_stream(writer, listener, spark) == {"n": 50, "total": sum(range(50))} and listener.error is None
    assert [t["batches"] for t in told] == [2, 4, 5] and told[-1]["n"] == 50
    assert len([f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")]) >= 5
