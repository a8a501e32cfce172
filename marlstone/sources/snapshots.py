"""Incremental embeddings and immutable snapshots.

A snapshot is a folder of Parquet tables; a one-row pointer names the current
one and is written last, so a failed build leaves the old one in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators.retrieval import Settings

VERSION = 1


class StaleIndex(ValueError):
    """The index does not belong to the settings or the input."""


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: version, snapshot, settings, fingerprint, counts."""
    rows = _read(spark, f"{root}/current")
    if rows is None:
        return None
    last = rows.orderBy(F.desc("at")).first()
    return json.loads(last["info"]) if last else None


def fingerprint(df: DataFrame) -> str:
    """Fingerprint of a table that no order of rows changes: two sums and a count, from one aggregation."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*"), part(1), part(13)).first()
    return ":".join(map(str, r))


def embed(texts: DataFrame, encode: Callable[[list[str]], list], batch: int = 256) -> DataFrame:
    """key, vector of texts (key, text) by an encoder that is made once per worker; wrong counts and invalid vectors raise."""

    @F.pandas_udf("array<double>")
    def vector(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out = []
            for at in range(0, len(s), batch):
                part = list(s[at : at + batch])
                got = list(encode(part))
                if len(got) != len(part):
                    raise ValueError("embedding count mismatch")
                out += [[float(x) for x in v] for v in got]
            yield pd.Series(out, dtype=object)

    raw = texts.select("key", vector("text").alias("vector"))
    return raw.select("key", vectors.checked(F.col("vector")).alias("vector"))


def build_index(docs: DataFrame, passage_rows: DataFrame, encode: Callable[[list[str]], list], root: str, settings: Settings = Settings()) -> dict:
    """Embed what the cache lacks, write a snapshot, move the pointer.  An unchanged input embeds and writes nothing."""
    spark = docs.sparkSession
    now = current(spark, root)
    stamp = {"version": VERSION, "settings": repr(settings), "fingerprint": fingerprint(docs)}
    if now and all(now.get(k) == v for k, v in stamp.items()):
        return now | {"embedded": 0, "reused": now["passages"], "unchanged": True}
    key = F.sha2(F.concat_ws("\x1f", F.lit(f"{VERSION}:{settings.embedding_model}"), "text"), 256)
    keyed = passage_rows.withColumn("key", key)
    cache = _read(spark, f"{root}/cache")
    before = 0 if cache is None else cache.count()
    needed = keyed.select("key", "text").dropDuplicates(["key"])
    missing = needed if cache is None else needed.join(cache.select("key"), "key", "left_anti")
    embed(missing, encode).write.mode("append").parquet(f"{root}/cache")
    cache = spark.read.parquet(f"{root}/cache")
    name = uuid.uuid4().hex
    ready = keyed.join(cache, "key").withColumn("vector", vectors.normalized(F.col("vector")))
    ready.write.parquet(f"{root}/snapshot={name}/passages")
    docs.write.parquet(f"{root}/snapshot={name}/docs")
    if fingerprint(docs) != stamp["fingerprint"]:
        raise StaleIndex("the input changed while it was indexed")
    written = spark.read.parquet(f"{root}/snapshot={name}/passages")
    sums = written.agg(F.count("*"), F.countDistinct("key"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if sums[2] != sums[3]:
        raise ValueError("vectors of different dimensions")
    embedded = cache.count() - before
    info = stamp | {"snapshot": name, "passages": sums[0], "dimension": sums[2], "embedded": embedded, "reused": sums[0] - embedded}
    spark.createDataFrame([(json.dumps(info),)], "info string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/current")
    return info


def open_index(spark: SparkSession, root: str, settings: Settings = Settings(), docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and passages of the current snapshot; raises StaleIndex if settings or documents are not those it was made from."""
    now = current(spark, root)
    if now is None or now["version"] != VERSION or now["settings"] != repr(settings):
        raise StaleIndex("index settings changed: build the index again")
    if docs is not None and fingerprint(docs) != now["fingerprint"]:
        raise StaleIndex("index is stale: build it again")
    return tuple(spark.read.parquet(f"{root}/snapshot={now['snapshot']}/{t}") for t in ("docs", "passages"))
