"""Navigation records: what each source is called, what it holds, and how it is shown.

``chunks`` here are rows of source_id, section_index, chunk_id, title, domain,
pages and regions (array of struct page, top, bottom, text, tables (rows), images
(image_id, path)); their order within a source is that of ``chunk_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import catalog
from .metadata import shown_domains

#: The field that names a process, its pages, the titles of diagrams, and how many of these are shown.
NAME_FIELD, NAME_PAGES = "流程名称", 3
DIAGRAM_TITLE, DIAGRAMS = "业务流程图", 2
#: A source with more entries than these, or texts shorter than this, have no stand-in for an overview.
FALLBACK_ENTRIES, FALLBACK_CHARS, OVERVIEW_CHARS = 12, 30, 10_000


def _regions(chunks: DataFrame) -> DataFrame:
    """source_id, chunk_id, title, i, r: a row for each region."""
    return chunks.select("source_id", "chunk_id", "title", F.posexplode("regions").alias("i", "r"))


def names_found(chunks: DataFrame) -> DataFrame:
    """source_id, pos, name, page, basis: names that tables and texts of the first pages give."""
    rows = _regions(chunks).filter(F.col("r.page") <= NAME_PAGES)
    cells = F.flatten(F.transform(F.coalesce(F.col("r.tables"), F.array().cast("array<struct<rows:array<array<string>>>>")), lambda t: t["rows"]))
    named = F.filter(cells, lambda c: (F.size(c) >= 2) & (text.compact(F.get(c, F.lit(0))) == NAME_FIELD) & (F.coalesce(F.get(c, F.lit(1)), F.lit("")) != ""))
    hits = F.transform(F.regexp_extract_all(text.text_of("r.text"), F.lit(NAME_FIELD + "[：:\t ]*([^\n]+)"), 1), text.compact)
    fit = F.filter(hits, lambda h: (F.length(h) > 2) & (F.length(h) < 100))
    both = F.concat(
        F.transform(named, lambda c: F.struct(text.compact(F.get(c, F.lit(1))).alias("name"), F.lit("cover_table").alias("basis"))),
        F.transform(fit, lambda h: F.struct(h.alias("name"), F.lit("cover_text").alias("basis"))),
    )
    out = rows.select("source_id", "chunk_id", "i", "r.page", F.posexplode(both).alias("j", "f"))
    return out.select("source_id", F.struct("chunk_id", "i", "j").alias("pos"), "f.name", "page", "f.basis")


def evidence(chunks: DataFrame, outlines: DataFrame) -> DataFrame:
    """source_id, pos, kind, size, block (page, text, table_rows, chunk_id): the parts that an overview quotes.

    Sections that describe the process come first; only where a source has none, and
    no more than ``FALLBACK_ENTRIES`` entries in its outline, those of operations
    stand in for them.  A part of a page counts once.
    """
    rows = _regions(chunks).withColumn("kind", catalog.overview_kind(F.col("title"))).filter("kind is not null")
    row = lambda cells: F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\n", "")), " | ")
    tables = F.transform(F.flatten(F.transform(F.coalesce(F.col("r.tables"), F.array().cast("array<struct<rows:array<array<string>>>>")), lambda t: t["rows"])), row)
    first = F.col("kind") == "primary"
    said = text.text_of("r.text")
    parts = rows.select(
        "source_id",
        "kind",
        F.struct("chunk_id", "i").alias("pos"),
        F.struct(F.col("r.page").alias("page"), F.col("r.top").alias("top"), F.col("r.bottom").alias("bottom")).alias("place"),
        F.struct(F.col("r.page").alias("page"), F.when(first, text.strip(said)).otherwise(said).alias("text"), F.when(first, tables).otherwise(F.array().cast("array<string>")).alias("table_rows"), "chunk_id").alias("block"),
    )
    length = F.length(text.strip(F.col("block.text")))
    parts = parts.filter(((F.col("kind") == "primary") & ((length > 0) | (F.size("block.table_rows") > 0))) | ((F.col("kind") == "fallback") & (length >= FALLBACK_CHARS)))
    once = parts.groupBy("source_id", "kind", "place").agg(F.min("pos").alias("pos"), F.min_by("block", "pos").alias("block"))
    told = once.filter("kind = 'primary'").select("source_id", F.lit(True).alias("told")).distinct()
    entries = outlines.groupBy("source_id").agg(F.count("*").alias("entries"))
    chosen = once.join(told, "source_id", "left").join(entries, "source_id", "left")
    chosen = chosen.filter((F.col("kind") == "primary") | (F.col("told").isNull() & (F.coalesce("entries", F.lit(0)) <= FALLBACK_ENTRIES)))
    size = F.length("block.text") + F.aggregate("block.table_rows", F.lit(0), lambda n, r: n + F.length(r))
    return chosen.select("source_id", "kind", "pos", size.alias("size"), "block")


def diagrams(chunks: DataFrame) -> DataFrame:
    """source_id, images: the first ``DIAGRAMS`` pictures of sections of diagrams, each path once."""
    rows = _regions(chunks).filter(F.contains("title", F.lit(DIAGRAM_TITLE))).select("source_id", "chunk_id", "i", F.col("r.page").alias("page"), F.posexplode("r.images").alias("j", "m"))
    once = rows.groupBy("source_id", F.col("m.path").alias("path")).agg(F.min(F.struct("chunk_id", "i", "j", "page", F.col("m.image_id").alias("image_id"))).alias("f"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("f"))).filter(F.col("n") <= DIAGRAMS)
    listed = F.array_sort(F.collect_list(F.struct("n", F.struct(F.col("f.page").alias("page"), "path", F.col("f.image_id").alias("image_id")).alias("m"))))
    return first.groupBy("source_id").agg(F.transform(listed, lambda x: x["m"]).alias("images"))


def records(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """One record a source with chunks: names, domains, outline, overview evidence, pictures.

    ``sources``: source_id, name, sha256, pages.
    """
    found = names_found(chunks)
    given = catalog.names(found, sources.select("source_id", "name"))
    last = found.groupBy("source_id", "name").agg(F.min("pos").alias("pos"), F.max_by(F.struct("page", "basis"), "pos").alias("e"))
    proof = last.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("name", "e.page", "e.basis").alias("e")))), lambda x: x["e"]).alias("name_evidence"))
    domains = chunks.groupBy("source_id").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    entries = catalog.outline(chunks)
    listed = entries.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_index", F.struct("title", "pages", "chunk_ids").alias("e")))), lambda x: x["e"]).alias("outline"))
    blocks = evidence(chunks, entries)
    quoted = catalog.overview(blocks, OVERVIEW_CHARS).withColumnRenamed("kept", "overview_evidence").withColumnRenamed("complete", "evidence_complete")
    told = blocks.groupBy("source_id").agg(F.bool_or(F.col("kind") == "primary").alias("has_process_description"))
    out = sources.select("source_id", F.col("name").alias("source_name"), F.col("sha256").alias("source_hash"), F.col("pages").alias("source_pages")).join(domains, "source_id").join(given, "source_id")
    for part in (proof, listed, quoted, told, diagrams(chunks)):
        out = out.join(part, "source_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), out.schema[c].dataType)).alias(c)
    no = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select(
        F.col("source_id").alias("key"), "source_id", "source_name", "source_hash", "source_pages", "domains", "title", "aliases", "name_basis", "filename_topic",
        empty("name_evidence"), empty("outline"), empty("overview_evidence"), no("evidence_complete", True), no("has_process_description", False), empty("images"),
    )


def paragraphs() -> Column:
    """Array of the paragraphs that show a record; the sentences are fixed values."""
    source, lit, page = F.col("source_name"), F.lit, lambda c: c.cast("string")
    array = lambda *c: F.array(*c)
    named = F.transform("name_evidence", lambda e: F.concat(lit("原文流程名称："), e["name"], lit("。来源："), source, lit("，PDF 第"), page(e["page"]), lit("页")))
    entry = lambda e: F.concat(e["title"], lit("｜来源："), source, lit("，PDF 第"), text.page_label(e["pages"]), lit("页"))
    quote = lambda e: F.array_compact(
        array(
            F.concat(lit("来源："), source, lit("，PDF 第"), page(e["page"]), lit("页\n"), e["text"]),
            F.when(F.size(e["table_rows"]) > 0, F.concat(lit("原页表格逐行文本（跨页/合并关系仍需核对）：\n"), F.array_join(e["table_rows"], "\n"))),
        )
    )
    quoted = F.concat(
        array(F.when(F.col("has_process_description"), "原文流程说明及步骤表摘录（需要保留条件分支与原文编号）：").otherwise("原文操作说明摘录（需要保留条件分支与原文编号；不把局部操作声称为全部流程）：")),
        F.flatten(F.transform("overview_evidence", quote)),
    )
    none = array(lit("本卡没有抽取到独立的完整流程步骤说明。可以按上述章节给出覆盖范围/简要环节，并追问用户想展开哪一部分；不得因此声称原手册缺少正文。"))
    return F.concat(
        array(
            F.concat(lit("流程/手册导航："), "title"),
            F.concat(lit("可识别名称："), F.array_join("aliases", "；")),
            F.concat(lit("原始资料："), source, lit("；共"), page(F.col("source_pages")), lit("页。业务主题："), F.array_join(shown_domains(F.col("domains")), "、")),
            lit("资料适用版本待确认；业务复核待完成。本卡是原始资料的导航和摘录，不是新增操作规范。"),
        ),
        F.when(F.size("name_evidence") > 0, F.concat(named, array(lit("封面流程名可能被多份分册复用；实际范围以文件主题和下列目录为准。")))).otherwise(array(lit("原文未提取到明确“流程名称”字段；本卡名称取自文件名，不冒充原文正式流程名称。"))),
        array(lit("全书章节导航（顺序为原书章节顺序，不代表所有环节必须依次执行；条件分支保持独立）：")),
        F.transform("outline", entry),
        F.when(F.size("overview_evidence") > 0, quoted).otherwise(none),
        F.when(F.col("evidence_complete"), F.array().cast("array<string>")).otherwise(array(lit("步骤说明摘录未覆盖全部说明章节；只能作为概览，详细操作需进入对应章节。"))),
        array(lit("用户只给流程名称时，先给有依据的概览并列出可展开部分；目录不能伪装成逐项必做的全流程。")),
    )


def shown(record_rows: DataFrame) -> DataFrame:
    """key, paragraphs (text that XML allows, pictures announced at the end), images: rows for ``office.render``."""
    notes = F.transform("images", lambda m: F.concat(F.lit("原文流程配图："), "source_name", F.lit("，PDF 第"), m["page"].cast("string"), F.lit("页；以原图核对分支与箭头。")))
    return record_rows.select("key", F.transform(F.concat(paragraphs(), notes), text.xml_text).alias("paragraphs"), "images")


def manifest(record_rows: DataFrame) -> DataFrame:
    """Rows of an export manifest for navigation documents."""
    meta = {"process_key": F.col("source_id"), "source_id": F.col("source_id"), "source_hash": F.col("source_hash"), "entry_kind": F.lit("process_navigation"), "validity_status": F.lit("unconfirmed"), "review_status": F.lit("pending"), "system_version": F.lit("unknown"), "section_title": F.col("title")}
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform("outline", lambda e: e["pages"]))))
    return record_rows.select("key", F.lit("process_navigation").alias("domain"), "source_id", "source_name", pages.alias("pages"), F.size("images").alias("image_count"), text.fingerprint(*record_rows.columns).alias("content_hash"), F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)]).alias("metadata"))
