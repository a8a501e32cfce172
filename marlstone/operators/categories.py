"""Domains that users add to the preset ones, and edits of single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata import DOMAINS, valid_category_name


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, True) for k, v in DOMAINS.items()], "id string, name string, preset boolean")


def all_categories(spark: SparkSession, custom: DataFrame) -> DataFrame:
    """Preset and custom domains."""
    return presets(spark).unionByName(custom.select("id", "name", F.lit(False).alias("preset")))


def check_new(spark: SparkSession, custom: DataFrame, name: str) -> None:
    """Raise ValueError for a name that is not valid or, whatever its case, taken."""
    asked = spark.createDataFrame([(name.strip(),)], "name string")
    if not asked.select(valid_category_name(F.col("name")).alias("ok")).first()["ok"]:
        raise ValueError("invalid category name")
    if all_categories(spark, custom).filter(F.lower(F.trim("name")) == name.strip().lower()).head(1):
        raise ValueError("category name is taken")


def create(spark: SparkSession, custom: DataFrame, name: str) -> DataFrame:
    """Custom domains with a new one; its id comes from its name and never changes."""
    check_new(spark, custom, name)
    new = spark.createDataFrame([(name.strip(),)], "name string").select(F.concat(F.lit("custom_"), F.substring(F.sha2(F.lower("name"), 256), 1, 8)).alias("id"), "name")
    return custom.select("id", "name").unionByName(new)


def rename(spark: SparkSession, custom: DataFrame, category_id: str, name: str) -> DataFrame:
    check_new(spark, custom.filter(F.col("id") != category_id), name)
    return custom.select("id", F.when(F.col("id") == category_id, name.strip()).otherwise(F.col("name")).alias("name"))


def set_value(rows: DataFrame, where: dict, **values) -> DataFrame:
    """Rows with some columns set where others have given values; unknown columns raise."""
    if unknown := (set(where) | set(values)) - set(rows.columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    hit = F.lit(True)
    for k, v in where.items():
        hit &= F.col(k).eqNullSafe(F.lit(v))
    return rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete(rows: DataFrame, keys: DataFrame, on: str, inactive: F.Column | None = None) -> DataFrame:
    """Rows without those of ``keys``; with ``inactive`` only such rows go."""
    goes = keys.select(on) if inactive is None else rows.filter(inactive).select(on).join(keys.select(on), on, "left_semi")
    return rows.join(goes, on, "left_anti")
