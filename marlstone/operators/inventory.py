"""Sources: inventory, duplicates, page tasks, upserts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metadata import assign_domain


def summary(files: DataFrame, id_col: str, size_col: str, hash_col: str) -> DataFrame:
    """One row: number of files, their bytes, distinct contents, and whether contents are unique."""
    return files.agg(F.count(id_col).alias("file_count"), F.sum(size_col).alias("total_bytes"), F.countDistinct(hash_col).alias("unique_contents")).withColumn("all_unique", F.col("file_count") == F.col("unique_contents"))


def duplicates(files: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """``files`` with same_as: the first file, in order, of equal content; null for that file itself.

    The first is found by an aggregation, so a content that very many files
    share is no single task's work; the join back is one that skew handling splits.
    """
    first = files.groupBy(F.col(hash_col).alias("__h")).agg(F.min(order_col).alias("__first"))
    joined = files.join(first, files[hash_col] == F.col("__h"))
    return joined.withColumn("same_as", F.when(F.col(order_col) != F.col("__first"), F.col("__first"))).drop("__h", "__first")


def keep_first(files: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    return duplicates(files, hash_col, order_col).filter("same_as is null").drop("same_as")


def page_tasks(sources: DataFrame) -> DataFrame:
    """One row per page of every source that can be read: source_id, sha256, path, name, page, total_pages."""
    ok = sources.filter("status = 'ok' and pages >= 1")
    return ok.select("source_id", "sha256", "path", "name", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"), F.col("pages").alias("total_pages"))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Tasks that are not done, up to ``limit``: done ones don't count towards it."""
    left = tasks.join(done.select(*keys), keys, "left_anti")
    return left if limit is None else left.orderBy(*order).limit(limit)


def reusable(tasks: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks with ``reuse``: whether a complete result of the same run signature exists."""
    r = results.select(*keys, F.lit(True).alias("__there"), F.col("status").alias("__status"), F.col("run_signature").alias("__sig"))
    same = F.col("__there") & (F.col("__status") == "complete") & F.col("run_signature").eqNullSafe(F.col("__sig"))
    return tasks.join(r, keys, "left").withColumn("reuse", F.coalesce(same, F.lit(False))).drop("__there", "__status", "__sig")


def upsert_files(existing: DataFrame, scanned: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Files after a scan: attributes from the scan; a domain that was there stays and counts as confirmed; unscanned files stay."""
    e = existing.select(*keys, *[F.col(a).alias(f"__{a}") for a in attributes], F.col("domain").alias("__domain"), F.col("status").alias("__status"), F.lit(True).alias("__old"))
    s = scanned.select(*keys, *attributes, "domain", "status", F.lit(True).alias("__new"))
    both = e.join(s, keys, "full")
    values = [F.when(F.col("__new"), F.col(a)).otherwise(F.col(f"__{a}")).alias(a) for a in attributes]
    status = F.when(F.col("__new").isNull(), F.col("__status")).when(F.col("__old") & F.col("__domain").isNotNull(), "confirmed").otherwise(F.col("status"))
    return both.select(*keys, *values, F.coalesce("__domain", "domain").alias("domain"), status.alias("status"))


def with_overrides(files: DataFrame, confirmed: DataFrame, key: str, automatic: Column) -> DataFrame:
    """``files`` with domain and status: confirmed domains (key, domain) win over the automatic rule."""
    c = confirmed.select(F.col(key).alias("__k"), F.col("domain").alias("__fixed"))
    domain, status = assign_domain(F.col("__fixed"), automatic)
    return files.join(c, files[key] == F.col("__k"), "left").withColumns({"domain": domain, "status": status}).drop("__k", "__fixed")


def top_groups(files: DataFrame, path_col: str, k: int = 8) -> DataFrame:
    """The ``k`` largest first path segments."""
    return files.groupBy(F.split(path_col, "/")[0].alias("top")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "top").limit(k)


def shards(groups: DataFrame, id_col: str, size_col: str, n: int = 4) -> DataFrame:
    """id, size, shard: longest first, each to the shard that has least so far (the first of equals).

    Each deal depends on those before it, so ids and sizes stream sorted through one
    task that holds ``n`` sums.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [(0, i) for i in range(n)]
        for b in batches:
            out = []
            for size in b["size"].tolist():
                load, i = heapq.heappop(loads)
                heapq.heappush(loads, (load + size, i))
                out.append(i)
            yield b.assign(shard=out)

    rows = groups.select(F.col(id_col).cast("string").alias("id"), F.col(size_col).cast("long").alias("size"))
    return rows.repartition(1).sortWithinPartitions(F.desc("size"), "id").mapInPandas(deal, "id string, size long, shard int")
