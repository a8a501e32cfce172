"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """``expected`` (query_id, expected: array of ids, ...) with hit_rank, the first rank within ``k`` of an expected id, or null."""
    hits = results.filter(F.col("rank") <= k).join(expected.select("query_id", "expected"), "query_id").filter(F.expr("array_contains(expected, doc_id)"))
    best = hits.groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return expected.join(best, "query_id", "left")


def summary(rows: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Per group: cases, hit_at_1, hit_at_k, mrr (null for no cases), and median_ms if there is a column ms."""
    hit = lambda n: F.avg(F.coalesce(F.col("hit_rank") <= n, F.lit(False)).cast("double"))
    cols = [F.count("*").alias("cases"), hit(1).alias("hit_at_1"), hit(k).alias(f"hit_at_{k}"), F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias(f"mrr_at_{k}")]
    if "ms" in rows.columns:
        cols.append(F.percentile("ms", 0.5).alias("median_ms"))
    return rows.groupBy(*by).agg(*cols) if by else rows.agg(*cols)


def must_contain(records: DataFrame, text_col: str, needles_col: str) -> DataFrame:
    """``records`` with ok: whether the text has all substrings asked for."""
    return records.withColumn("ok", F.expr(f"forall({needles_col}, s -> contains({text_col}, s))"))


def isolated(results: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Results whose section title starts with a prefix that their query forbids."""
    return results.join(forbidden, "query_id").filter("startswith(section_title, forbidden_prefix)")


def source_recall(results: DataFrame, expected: DataFrame, k: int = 6) -> DataFrame:
    """query_id, first_rank, hit: the first result whose document name holds one of the expected parts.

    ``results``: query_id, rank, name; ``expected``: query_id, expected (array of parts of names).
    """
    hits = results.join(expected.select("query_id", "expected"), "query_id").filter(F.expr("exists(expected, s -> contains(name, s))"))
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").join(first, "query_id", "left").withColumn("hit", F.coalesce(F.col("first_rank") <= k, F.lit(False)))


def graded(results: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, passed: whether a result has the case's key in its name and all of its codes in its content.

    ``results``: query_id, name, content; ``cases``: query_id, key, codes (array).
    """
    good = results.join(cases, "query_id").filter(F.expr("contains(name, key) and forall(codes, c -> contains(content, c))")).select("query_id").distinct()
    return cases.select("query_id").join(good.withColumn("passed", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("passed", F.lit(False)).alias("passed"))


def expected_cards(cases: DataFrame, cards: DataFrame) -> DataFrame:
    """``cases`` (query_id, page, ...) with expected_card_id: the first card (card_id, pos, pages) with a source on that page."""
    by_page = cards.select("card_id", "pos", F.explode("pages").alias("__page")).groupBy("__page").agg(F.min_by("card_id", F.struct("pos", "card_id")).alias("expected_card_id"))
    return cases.join(by_page, F.col("page") == F.col("__page"), "left").drop("__page")


def within(names: Column, allowed: Column) -> Column:
    """Whether all names that results have are allowed, and there are some."""
    return (F.size(names) > 0) & (F.size(F.array_except(names, allowed)) == 0)
