"""Incremental builds: only sources that changed are made again.

A build writes the rows of the sources it makes into a folder of its own, then the
state - one row a source: signature, version, the build that has its rows and how many -
and, last, the pointer.  Readers join rows and state by source and build, so a build
that fails at any point leaves the one before in place, and rows that were replaced are
never seen; ``compact`` takes them out.

A source is made when it is new, when its signature or the version differs from the
state's, when the state promises rows that are not there, or when it was made under
older rules and is marked as one that they touch.  Sources that are not ready, and those
beyond a limit, are pending: they are not in the state, even if an older build has them.
Sources that are no longer listed leave the state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "source_id string, signature string, version int, rules int, touched boolean, build string, rows long, number int"


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: the last build's name, number and report."""
    try:
        last = spark.read.schema("info string, number int").parquet(f"{root}/current").orderBy(F.desc("number")).first()
    except AnalysisException:
        return None
    return json.loads(last["info"]) if last else None


def state(spark: SparkSession, root: str) -> DataFrame:
    """The state that the pointer names; empty before the first build."""
    now = current(spark, root)
    return spark.read.schema(STATE).parquet(f"{root}/state/{now['build']}") if now else spark.createDataFrame([], STATE)


def _data(spark: SparkSession, root: str, builds: list[str]) -> DataFrame:
    """Rows of some builds, as they were written."""
    return spark.read.option("mergeSchema", True).option("basePath", f"{root}/data").parquet(*[f"{root}/data/build={b}" for b in builds])


def read(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the current state, with the number of the build that made them; raises before the first build."""
    now = current(spark, root)
    if now is None:
        raise ValueError("nothing has been built")
    live = state(spark, root).select("source_id", "build", "number")
    return _data(spark, root, now["builds"]).join(live, ["source_id", "build"]).drop("build")


def stale(sources: DataFrame, had: DataFrame, there: DataFrame | None, version: int, rules: int) -> DataFrame:
    """``sources`` (source_id, signature, ...) with fresh: whether the state's rows can stay.  ``there``: source_id, build, found (rows that are there)."""
    known = had.select("source_id", F.col("signature").alias("__signature"), F.col("version").alias("__version"), F.col("rules").alias("__rules"), "touched", "build", "rows")
    if there is None:
        known = known.withColumn("found", F.lit(0).cast("long"))
    else:
        known = known.join(there, ["source_id", "build"], "left")
    same = (F.col("signature") == F.col("__signature")) & (F.col("__version") == version) & ~((F.col("__rules") < rules) & F.col("touched"))
    whole = F.coalesce("found", F.lit(0)) == F.col("rows")
    return sources.join(known.withColumn("__whole", whole), "source_id", "left").withColumn("fresh", F.coalesce(same & F.col("__whole"), F.lit(False))).select(*sources.columns, "fresh")


def build(sources: DataFrame, make: Callable[[DataFrame], DataFrame], root: str, version: int, rules: int = 1, touched: Column | None = None, limit: int | None = None) -> dict:
    """Make what changed, move the pointer, and report source_count, built, reused, pending, rows, written.

    ``sources``: source_id (string, unique), signature, ready, and what ``make`` needs;
    ``make`` gives rows with a column source_id.  ``touched``: a condition on these rows
    that marks a source for the next change of ``rules``.  ``limit``: sources made at
    most, in the order of their ids.  An input that has not changed writes no rows.
    """
    spark = sources.sparkSession
    now, had = current(spark, root), state(spark, root)
    there = _data(spark, root, now["builds"]).groupBy("source_id", "build").agg(F.count("*").alias("found")) if now else None
    name, number = f"b{uuid.uuid4().hex}", (now["number"] if now else 0) + 1
    judged = stale(sources, had, there, version, rules)
    todo = judged.filter(~F.col("fresh") & F.col("ready")).drop("fresh")
    if limit is not None:
        todo = todo.orderBy("source_id").limit(limit)
    # the signatures as they are made, next to their rows: what is read twice cannot come apart
    todo.select("source_id", "signature").write.parquet(f"{root}/state/{name}-made")
    made = spark.read.schema("source_id string, signature string").parquet(f"{root}/state/{name}-made")
    out = make(todo.join(made.select("source_id"), "source_id", "left_semi"))
    out.write.parquet(f"{root}/data/build={name}")
    written = spark.read.schema(out.schema).parquet(f"{root}/data/build={name}")
    counts = written.groupBy("source_id").agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(touched) if touched is not None else F.lit(False), F.lit(False)).alias("touched"))
    new = made.join(counts, "source_id", "left").select(
        "source_id", "signature", F.lit(version).alias("version"), F.lit(rules).alias("rules"), F.coalesce("touched", F.lit(False)).alias("touched"), F.lit(name).alias("build"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(number).alias("number")
    )
    kept = had.join(judged.filter("fresh").select("source_id"), "source_id", "left_semi")
    kept.unionByName(new).write.parquet(f"{root}/state/{name}")
    live = spark.read.schema(STATE).parquet(f"{root}/state/{name}")
    told = live.agg(F.count("*").alias("n"), F.count_if(F.col("build") == name).alias("built"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("build") == name, F.col("rows"))), F.lit(0)).alias("written"), F.collect_set("build").alias("builds")).first()
    total = sources.count()
    # a build without rows still tells their columns
    builds = sorted({*told["builds"], name})
    report = {"build": name, "number": number, "builds": builds, "source_count": total, "built": told["built"], "reused": told["n"] - told["built"], "pending": total - told["n"], "rows": told["rows"], "written": told["written"]}
    spark.createDataFrame([(json.dumps(report), number)], "info string, number int").coalesce(1).write.mode("append").parquet(f"{root}/current")
    return report


def compact(spark: SparkSession, root: str) -> dict:
    """Write all live rows as one build and move the pointer; older builds are then no longer read."""
    now = current(spark, root)
    if now is None:
        raise ValueError("nothing has been built")
    name, number = f"b{uuid.uuid4().hex}", now["number"] + 1
    read(spark, root).drop("number").write.parquet(f"{root}/data/build={name}")
    state(spark, root).withColumn("build", F.lit(name)).write.parquet(f"{root}/state/{name}")
    report = now | {"build": name, "number": number, "builds": [name], "built": 0, "reused": now["built"] + now["reused"], "written": now["rows"]}
    spark.createDataFrame([(json.dumps(report), number)], "info string, number int").coalesce(1).write.mode("append").parquet(f"{root}/current")
    return report
