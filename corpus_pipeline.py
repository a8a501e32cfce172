"""The corpus pipeline: toxicity, near-dedup, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  Each says what it
does with nulls and repeated rows; in all of them texts of any length are taken
whole, columns beyond those of ``documents`` are passed on whatever their names
(but for packing, whose columns are its own), and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, neardup, packing, secretscan, toxicity
from marlstone.llm.common import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null and empty texts score the bias, those with a null id are scored like
    others, repeated rows are judged each; without labels all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(docs, model)("text") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8 or more.

    Rows that share an id but not their text are documents of their own, told apart
    by a key; of rows that share both, any one stays.  Null and empty texts, and rows
    with a null id, have no copies and stay.  The keys to leave out are written
    first, so the join broadcasts them only while they are small.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    own = F.col("d.doc_id").cast("long")
    again = stash(rows.filter("d.doc_id is not null").groupBy("d.doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        keyed = rows.withColumn("key", own)
    else:
        repeated = rows.join(again, F.col("d.doc_id") == F.col("doc_id"), "left_semi")
        # aggregated, so that an id with very many rows is cut down before it is moved
        one = repeated.groupBy("d.doc_id", "d.text").agg(F.first("d").alias("d")).select("d", F.xxhash64("d.doc_id", "d.text").alias("key"))
        single = rows.join(again, F.col("d.doc_id") == F.col("doc_id"), "left_anti").withColumn("key", own)
        # written first, so that the rows that stay are the same wherever they are read
        keyed = stash(single.unionAll(one), "keyed")
    found = neardup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("d.text").alias("text")), k=5, percent=80)
    out = stash(found.filter("not kept").select(F.col("doc_id").alias("key")).distinct(), "out")
    return keyed.join(out, "key", "left_anti").select("d.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark, and ``n_chars`` that fits; null texts stay null, repeated rows are cleaned each."""
    return secretscan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them: null languages and sources are leaves of their own, rows that share an id go together."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens: a null text is its end token alone, a null id stays null, repeated rows are packed each."""
    return packing.pack(docs, packing.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
