"""Documents that retrieval reads: sections of the current manifest and overviews of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import corpus, retrieval


def details(manifest: DataFrame, chunks: DataFrame, records: DataFrame) -> DataFrame:
    """One document per manifest row that is not retired.

    ``manifest``: key, source_id, source_name, domain, pages, metadata, chunk_ids;
    ``chunks``: source_id, chunk_id, title, notes, regions; ``records``: source_id,
    filename_topic, title.  A chunk that the manifest names and that is not there
    raises: an incomplete conversion is never skipped.
    """
    live = manifest.filter(retrieval.not_retired(F.col("metadata")["validity_status"]))
    wanted = live.select("key", "source_id", "source_name", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    have = chunks.select(F.col("source_id").alias("__s"), F.col("chunk_id").alias("__c"), "title", "notes", "regions")
    rows = wanted.join(have, (F.col("source_id") == F.col("__s")) & (F.col("chunk_id") == F.col("__c")), "left")
    parts = F.concat(F.array("title"), F.coalesce("notes", F.array().cast("array<string>")), F.transform("regions", lambda r: corpus.region_text(F.col("source_name"), r)))
    parts = F.when(F.col("__c").isNotNull(), parts).otherwise(F.raise_error(F.concat(F.lit("missing chunk "), "chunk_id")).cast("array<string>"))
    pictures = F.flatten(F.transform("regions", lambda r: F.transform(r["images"], lambda m: F.struct(m["image_id"].alias("image_id"), r["page"].alias("page")))))
    merged = rows.select("key", "i", parts.alias("parts"), pictures.alias("images")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "parts", "images"))).alias("x"))
    topics = records.select(F.col("source_id").alias("__r"), "filename_topic", F.col("title").alias("record_title"))
    return (
        live.join(merged, "key")
        .join(topics, F.col("source_id") == F.col("__r"), "left")
        .select(
            F.col("key").alias("doc_id"),
            F.lit("detail").alias("kind"),
            F.col("metadata")["section_title"].alias("title"),
            F.coalesce("filename_topic", "record_title", "source_name").alias("topic"),
            "source_id",
            "source_name",
            F.array("domain").alias("domains"),
            "pages",
            F.col("metadata")["section_title"].alias("section_title"),
            F.array_join(F.flatten(F.transform("x", lambda c: c["parts"])), "\n\n").alias("content"),
            F.flatten(F.transform("x", lambda c: c["images"])).alias("images"),
        )
    )


def overviews(records: DataFrame) -> DataFrame:
    """One document per navigation record."""
    entry = lambda e: F.concat(e["title"], F.lit("（PDF 第 "), F.array_join(e["pages"].cast("array<string>"), ","), F.lit(" 页）"))
    quote = lambda e: F.concat(F.lit("PDF 第 "), e["page"].cast("string"), F.lit(" 页：\n"), e["text"], F.lit("\n"), F.array_join(e["table_rows"], "\n"))
    lines = F.concat(
        F.array(F.concat(F.lit("流程名称："), "title"), F.concat(F.lit("原文名称别称："), F.array_join("aliases", "；")), F.concat(F.lit("资料主题："), "filename_topic"), F.lit("原文目录：")),
        F.transform("outline", entry),
        F.transform("overview_evidence", quote),
    )
    return records.select(
        F.concat(F.lit("nav-"), "key").alias("doc_id"),
        F.lit("overview").alias("kind"),
        "title",
        F.col("filename_topic").alias("topic"),
        "source_id",
        "source_name",
        "domains",
        F.array_sort(F.array_distinct(F.flatten(F.transform("outline", lambda e: e["pages"])))).alias("pages"),
        F.col("title").alias("section_title"),
        F.array_join(lines, "\n").alias("content"),
        F.transform("images", lambda m: F.struct(m["image_id"].alias("image_id"), m["page"].cast("int").alias("page"))).alias("images"),
    )


def documents(manifest: DataFrame, chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Sections and overviews in one table."""
    pages = lambda df: df.withColumns({"pages": F.col("pages").cast("array<int>"), "images": F.transform("images", lambda m: F.struct(m["image_id"].alias("image_id"), m["page"].cast("int").alias("page")))})
    return pages(details(manifest, chunks, records)).unionByName(pages(overviews(records)))


def listing(manifest: DataFrame, navigation: DataFrame) -> DataFrame:
    """What a reader is shown of both manifests: key, domain, source_name, title, pages, image_count."""
    view = lambda df: df.select("key", "domain", "source_name", F.col("metadata")["section_title"].alias("title"), F.col("pages").cast("array<int>").alias("pages"), F.col("image_count").cast("int").alias("image_count"))
    return view(manifest).unionByName(view(navigation))


def allowed_assets(docs: DataFrame) -> DataFrame:
    """image_id of every picture that a document refers to: nothing else is served."""
    return docs.select(F.explode("images").alias("m")).select("m.image_id").distinct()


def payload(text_col: Column, most: int = 3500) -> Column:
    """A card's text, or an error if it is too long to be sent."""
    return F.when(F.length(text_col) <= most, text_col).otherwise(F.raise_error(F.lit(f"card text exceeds {most} characters")).cast("string"))
