"""Audits: violations as rows (key, error)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE_BYTES, MAX_IMAGE_BYTES, MAX_IMAGES = 15 * 1024 * 1024, 2 * 1024 * 1024, 10


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, error for every check that a row fails (a check that is null fails): one pass, no union of scans."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(failed).alias("error"))


def corpus_checks() -> dict[str, Column]:
    """Checks of export rows: file_bytes (null: missing), image_count, shown_images, name_shown, largest_image, sha256, source_sha256, version_ok."""
    return {
        "stale_source": F.col("sha256") == F.col("source_sha256"),
        "stale_version": F.col("version_ok"),
        "missing_file": F.col("file_bytes").isNotNull(),
        "file_too_large": F.coalesce("file_bytes", F.lit(0)) <= MAX_FILE_BYTES,
        "image_count_differs": F.col("image_count") == F.col("shown_images"),
        "source_name_missing": F.col("name_shown"),
        "too_many_images": F.col("image_count") <= MAX_IMAGES,
        "image_too_large": F.coalesce("largest_image", F.lit(0)) < MAX_IMAGE_BYTES,
    }


def remote_checks() -> dict[str, Column]:
    """Checks of remote documents: hash, status, metadata, page mention, images, anchor, exactly one parent."""
    return {
        "hash_differs": F.col("hash") == F.col("content_hash"),
        "not_completed": (F.col("status") == "completed") & F.col("enabled"),
        "metadata_differs": F.col("remote_metadata").eqNullSafe(F.col("metadata")),
        "page_not_mentioned": F.forall("pages", lambda p: F.col("content").contains(F.concat(F.lit("PDF 第"), p.cast("string"), F.lit("页")))),
        "image_count_differs": F.col("image_count") == F.col("remote_images"),
        "anchor_differs": F.col("anchor").eqNullSafe(F.col("remote_anchor")),
        "parents_not_one": F.col("parents") == 1,
    }


def coverage(expected: DataFrame, covered: DataFrame, key: str, page: str) -> DataFrame:
    """key, expected, missing: numbers of pages per source."""
    want = expected.select(key, page).distinct().withColumn("w", F.lit(1))
    have = covered.select(key, page).distinct().withColumn("h", F.lit(1))
    return want.join(have, [key, page], "left").groupBy(key).agg(F.count("*").alias("expected"), F.count_if(F.col("h").isNull()).alias("missing"))


def all_pass(settings: DataFrame, key: str, checks: list[Column]) -> DataFrame:
    """key, ready: whether all rows of a key pass all checks."""
    return settings.groupBy(key).agg(F.bool_and(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])).alias("ready"))


def differences(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, error of a bundle against its manifest (path, bytes, sha256): missing, unlisted, or of other size or content."""
    m = manifest.select(F.col(key), F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"), F.lit(True).alias("listed"))
    f = files.select(F.col(key), "bytes", "sha256", F.lit(True).alias("there"))
    error = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("bytes") != F.col("want_bytes"), "size").when(F.col("sha256") != F.col("want_sha"), "content")
    return m.join(f, key, "full").select(key, error.alias("error")).filter("error is not null")
