"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets a few scores where higher is worse.  For each score and
stratum (language) a fixed grid of cutoffs is tested on labelled good
documents: a cutoff is certified if an exact binomial bound shows that it
rejects at most ``ALPHA`` of good documents, with the error probability
``DELTA`` split over all strata, rules and cutoffs (Bonferroni).  The lowest
certified cutoff is used; a stratum without enough labels rejects nothing.
Shares of the ``ALPHA`` of all rules add up, so the share of good documents that
the method rejects is at most ``len(RULES) * ALPHA`` in every stratum.

Defined results: null and empty texts have no words and fail the base rules;
null languages form a stratum of their own; labels that disagree count as not
good; repeated rows are judged one by one; a score that equals a cutoff passes;
texts of any length are counted whole; columns beyond doc_id, text and lang are
left out, whatever their names; without labels nothing but the base rules rejects;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

ALPHA = 0.01
DELTA = 0.05
#: Score name -> cutoffs that may be certified, from strict to lenient; all of one length.
RULES = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeat_share": [0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.35, 0.4],
    "mean_word": [6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0],
}
_SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the number of its uses."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _covered(positions: Column) -> Column:
    """Number of distinct positions in windows of three words that start at the given ones."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))


def _repeated(tri: Column) -> Column:
    """Words in windows found twice or more, from the windows' 64-bit hashes: sorted with their places, equal neighbours count."""
    placed = F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        hits = F.filter(s, lambda v, i: F.coalesce(v["h"] == F.get(s, i + 1)["h"], F.lit(False)) | F.coalesce(v["h"] == F.get(s, i - 1)["h"], F.lit(False)))
        return _covered(F.transform(hits, lambda v: v["i"]))

    return _let(placed, found)


def n_repeat_words(word_array: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text, first occurrences included."""

    def windows(h: Column) -> Column:
        tri = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return _let(tri, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(_repeated(t)))

    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    return F.when(F.size(word_array) < 4, F.lit(0)).otherwise(_let(hashes, windows)).cast("long")


def text_stats(text: Column) -> Column:
    """Struct of the base counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    dup = _let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def stats(both: Column) -> Column:
        w, d = both["w"], both["d"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            d["dup"].cast("long").alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
            d["lines"].cast("long").alias("n_lines"),
        )

    return _let(F.struct(words(text).alias("w"), dup.alias("d")), stats)


def _scores() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "mean_word": over("word_chars", "n_words"),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p, summed in logs; 1.0 where k is over the mean."""
    start = F.struct((n * math.log1p(-p)).alias("t"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = F.when(i == 0, acc["t"]).otherwise(acc["t"] + F.log((n - i + 1) / i) + math.log(p / (1 - p)))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda a: a["s"]))


def thresholds(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rule, cutoff: the lowest certified cutoff, where there is one."""
    good = labels.groupBy(F.col("doc_id").alias("k")).agg(F.min("quality").alias("q"), F.max("quality").alias("most")).filter("q = 1 and most = 1").select("k")
    per_rule = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), sum(((col > c).cast("int") for c in RULES[name]), F.lit(0)).alias("over"), F.array(*map(F.lit, RULES[name])).alias("grid"))
            for name, col in _scores().items()
        ]
    )
    judged = stats.filter(~F.col("base_failed")).join(good, stats["doc_id"] == good["k"]).select("stratum", F.explode(per_rule).alias("r")).select("stratum", "r.*")
    size = len(next(iter(RULES.values())))
    counts = judged.groupBy("stratum", "rule", "grid").agg(F.count("*").alias("n"), F.array(*[F.sum((F.col("over") > j).cast("long")) for j in range(size)]).alias("ks"))
    # a row for each stratum and rule that is tested
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))) / len(RULES))
    tests = counts.select("stratum", "rule", "n", "strata", F.explode(F.arrays_zip("grid", "ks")).alias("g"))
    certified = binomial_cdf(F.col("g.ks"), F.col("n"), ALPHA) <= DELTA / (F.col("strata") * len(RULES) * size)
    return tests.filter(certified).groupBy("stratum", "rule").agg(F.min("g.grid").alias("cutoff"))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document."""
    stats = documents.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), text_stats(F.col("text")).alias("s")).select("doc_id", "stratum", "s.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stash(stats.withColumn("base_failed", failed), "quality")
    # one row for each stratum that has hundreds of labels: few, whatever the input
    cut = thresholds(stats, labels).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cut = stash(cut, "cutoffs").withColumnRenamed("stratum", "of")
    passed = ~F.col("base_failed")
    for name, col in _scores().items():
        passed &= F.coalesce(col <= F.element_at("cuts", name), F.lit(True))
    return (
        stats.join(cut, F.col("stratum") == F.col("of"), "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", passed.alias("kept"), "n_lines")
    )
