"""Quality and throughput figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def element_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group and name: the element at floor(n * share) of the sorted values, counted from 0.

    Ranks come from counts of distinct values, so what is sorted per group is
    its distinct values, not its rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*by))})
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col(value)))
    return placed.groupBy(*by).agg(*[pick(p).alias(name) for name, p in shares.items()])


def confidence(lines: DataFrame, by: list[str], score: str, low: float) -> DataFrame:
    """Per group: n, mean, p10, p90, low (number below a score) and low_share."""
    base = lines.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.count_if(F.col(score) < low).alias("low")).withColumn("low_share", F.col("low") / F.col("n"))
    return base.join(element_percentiles(lines, by, score, {"p10": 0.1, "p90": 0.9}), by)


def median(value: str) -> Column:
    """Mean of the middle two."""
    return F.percentile(value, 0.5)


def throughput(n: Column, start: Column, end: Column) -> Column:
    """Items a minute between two timestamps; null for no time."""
    seconds = end.cast("double") - start.cast("double")
    return F.when(seconds > 0, n / (seconds / 60))


def tree_fingerprint(files: DataFrame, path: str, sha: str) -> DataFrame:
    """One row: fingerprint of a file tree that no order of rows changes.

    Files are first folded by directory, so no list of all files is gathered.
    """
    line = F.sha2(F.concat_ws("\x1f", path, sha), 256)
    folder = F.regexp_extract(path, "^(.*?)[^/]*$", 1)
    dirs = files.select(folder.alias("d"), line.alias("l")).groupBy("d").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), ""), 256).alias("f"))
    return dirs.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("d", F.lit("\x1f"), "f"))), ""), 256).alias("fingerprint"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """One row of worker reports (done, skipped, failures array): sums, and the number of failures.  ``failures`` has these themselves."""
    return reports.agg(F.sum("done").alias("done"), F.sum("skipped").alias("skipped"), F.sum(F.coalesce(F.size("failures"), F.lit(0)).cast("long")).alias("failed"))


def failures(reports: DataFrame) -> DataFrame:
    """A row for each failure of worker reports."""
    return reports.select(F.explode("failures").alias("failure"))
