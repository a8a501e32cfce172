"""Corpus: section boundaries, regions, chunks, pending sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds, geometry, text


def page_titles(pages: DataFrame) -> DataFrame:
    """source_id, page, title: first line of each page that is not just page numbers; pages without one are left out."""
    shown = F.filter(F.transform(text.lines("text"), text.strip), lambda x: (x != "") & ~text.page_number_only(x))
    return pages.select("source_id", "page", F.get(shown, F.lit(0)).alias("title")).filter("title is not null")


def repeated_title_boundaries(pages: DataFrame) -> DataFrame:
    """Boundaries of slide decks: the start, and each page after the first whose title differs from the last title before it."""
    titles = page_titles(pages)
    before = F.lag("title").over(Window.partitionBy("source_id").orderBy("page"))
    turns = titles.withColumn("before", before).filter("page > 1 and (before is null or before <> title)")
    starts = pages.select("source_id").distinct().select("source_id", F.lit(1).cast("long").alias("page"), F.lit(0.0).alias("top"), F.lit(text.FIRST_TITLE).alias("title"))
    return last_wins(starts.unionByName(turns.select("source_id", F.col("page").cast("long"), F.lit(0.0).alias("top"), F.substring("title", 1, 120).alias("title"))).withColumn("pos", F.col("page")))


def faq_boundaries(pages: DataFrame) -> DataFrame:
    """Boundaries of question files: one per page but 1 and 28, titled by the question or the second and third line."""
    asked = F.regexp_extract("text", "问题描述[：:]([^\n]+)", 1)
    other = F.array_join(F.slice(text.lines("text"), 2, 2), " / ")
    rows = pages.filter("page not in (1, 28)").select("source_id", F.col("page").cast("long"), F.lit(0.0).alias("top"), F.coalesce(F.nullif(asked, F.lit("")), F.nullif(other, F.lit("")), F.col("name")).alias("title"))
    starts = pages.select("source_id").distinct().select("source_id", F.lit(1).cast("long").alias("page"), F.lit(0.0).alias("top"), F.lit(text.FIRST_TITLE).alias("title"))
    return last_wins(starts.unionByName(rows).withColumn("pos", F.col("page")))


def toc_boundaries(toc: DataFrame) -> DataFrame:
    """Boundaries from outline rows (source_id, pos, page, title, level, height, view_y, is_xyz)."""
    kept = toc.filter(F.col("page").isNotNull() & text.toc_heading(F.col("title"), F.col("level")))
    rows = kept.select("source_id", F.col("page").cast("long"), geometry.toc_top(F.col("height"), F.col("view_y"), F.col("is_xyz")).alias("top"), "title", F.col("pos").cast("long") + 1)
    starts = toc.select("source_id").distinct().select("source_id", F.lit(1).cast("long").alias("page"), F.lit(0.0).alias("top"), F.lit(text.FIRST_TITLE).alias("title"), F.lit(0).cast("long").alias("pos"))
    return last_wins(starts.union(rows))


def last_wins(bounds: DataFrame) -> DataFrame:
    """One boundary per place: the last in order."""
    return bounds.groupBy("source_id", "page", "top").agg(F.max_by("title", "pos").alias("title"))


def sections(bounds: DataFrame, sizes: DataFrame) -> DataFrame:
    """source_id, section_index, title, page, top, bottom: each section's part of each page it touches.

    ``sizes``: source_id, pages, height.  A section ends where the next begins;
    slices under two points are left out.  The interval join is an explode.
    """
    w = Window.partitionBy("source_id").orderBy("page", "top")
    b = bounds.join(sizes, "source_id").withColumns({"section_index": F.row_number().over(w), "stop_page": F.coalesce(F.lead("page").over(w), F.col("pages") + 1), "stop_top": F.coalesce(F.lead("top").over(w), F.lit(0.0))})
    span = b.withColumn("p", F.explode(F.sequence("page", F.greatest(F.col("page"), F.least("stop_page", F.col("pages")))))).filter(F.col("p") <= F.col("pages"))
    cut = span.select("source_id", "section_index", "title", F.col("p").alias("page"), F.when(F.col("p") == F.col("page"), F.col("top")).otherwise(F.lit(0.0)).alias("top"), F.when(F.col("p") == F.col("stop_page"), F.col("stop_top")).otherwise(F.col("height")).alias("bottom"))
    return cut.filter("bottom - top >= 2")


def place_boxes(slices: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of ``boxes`` (source_id, page, bbox, ...) with the slice that holds their middle."""
    return slices.join(boxes, ["source_id", "page"]).filter(geometry.in_band(F.col("bbox"), F.col("top"), F.col("bottom")))


#: Fixed value: a page that says so shows a diagram.
DIAGRAM = "流程图"


def parsed_pages(pages: DataFrame, min_width: float = 0.0, min_height: float = 0.0, ignored=()) -> DataFrame:
    """Pages as evidence: source_id, page, width, height, native_text, cleaned_text, excluded_lines, lines, images, excluded, tables.

    ``pages``: rows of ``files.decode_pages``.  Boxes are cut to the page; small and
    reviewed pictures are listed apart with the reason; boxes that repeat an earlier
    one go; a page without pictures and with hardly any text is a picture itself.
    """
    clean = text.clean_lines("raw_text")
    box = lambda m: geometry.clamp_box(m["bbox"][0], m["bbox"][1], m["bbox"][2], m["bbox"][3], F.col("width"), F.col("height"))
    boxed = F.filter(F.transform("images", lambda m: F.struct(box(m).alias("bbox"), m["sha256"].alias("sha256"))), lambda m: m["bbox"].isNotNull())
    why = lambda m: geometry.image_verdict(m["bbox"][2] - m["bbox"][0], m["bbox"][3] - m["bbox"][1], m["sha256"], min_width, min_height, ignored)
    judged = F.transform(F.col("boxed"), lambda m: F.struct(m["bbox"].alias("bbox"), why(m).alias("reason")))
    kept = geometry.distinct_boxes(F.transform(F.filter("judged", lambda m: m["reason"].isNull()), lambda m: m["bbox"]))
    shown = geometry.page_boxes(F.col("clean.text"), kept, F.col("width"), F.col("height"))
    rows = pages.filter("status = 'complete'").withColumns({"clean": clean, "boxed": boxed}).withColumn("judged", judged)
    return rows.select(
        "source_id",
        "page",
        "width",
        "height",
        F.col("raw_text").alias("native_text"),
        F.col("clean.text").alias("cleaned_text"),
        F.col("clean.removed").alias("excluded_lines"),
        "lines",
        F.transform(shown, lambda b: F.struct(text.image_id(F.col("source_id"), F.col("page"), b).alias("image_id"), b.alias("bbox"))).alias("images"),
        F.filter("judged", lambda m: m["reason"].isNotNull()).alias("excluded"),
        "tables",
    )


def make_regions(slices: DataFrame, evidence: DataFrame) -> DataFrame:
    """source_id, section_index, title, page, top, bottom, text, images, tables: what each slice of a page holds.

    ``slices``: rows of ``sections``; ``evidence``: source_id, page, height,
    cleaned_text, lines (text, top, bottom), images (image_id, bbox, text), tables
    (bbox, rows).  A whole page has the page's text, a part the lines whose middle
    is in it.  Without pictures, a page with tables or a short text about a diagram
    is shown itself.  Slices with nothing in them are left out.
    """
    e = evidence.select("source_id", "page", F.col("height").alias("__h"), "cleaned_text", "lines", F.col("images").alias("__images"), F.col("tables").alias("__tables"))
    rows = slices.join(e, ["source_id", "page"])
    inside = lambda x: geometry.in_band(x["bbox"], F.col("top"), F.col("bottom"))
    whole = (F.col("top") == 0) & (F.col("bottom") == F.col("__h"))
    part = F.filter("lines", lambda x: ((x["top"] + x["bottom"]) / 2 >= F.col("top")) & ((x["top"] + x["bottom"]) / 2 < F.col("bottom")))
    said = text.clean_lines(F.when(whole, F.col("cleaned_text")).otherwise(F.array_join(F.transform(part, lambda x: x["text"]), "\n")))["text"]
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    page_box = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("__h").cast("double"))
    page_image = F.struct(text.image_id(F.col("source_id"), F.col("page")).alias("image_id"), page_box.alias("bbox"), F.lit("").alias("text"))
    seen = reading_order(F.transform(F.filter("__images", inside), lambda m: F.struct(m["image_id"].alias("image_id"), m["bbox"].alias("bbox"), m["text"].alias("text"))))
    drawn = (F.col("text").contains(DIAGRAM) & (F.length("text") < 1000)) | some(F.col("__tables"))
    rows = rows.withColumn("text", said).withColumn("seen", F.coalesce(seen, F.array().cast("array<struct<image_id:string,bbox:array<double>,text:string>>")))
    rows = rows.withColumn("images", F.when(some(F.col("seen")), F.col("seen")).when(drawn, F.array(page_image)).otherwise(F.col("seen")))
    tables = F.filter("__tables", lambda t: (F.coalesce(F.size(t["rows"]), F.lit(0)) > 0) & F.coalesce(inside(t), F.lit(False)))
    rows = rows.withColumn("tables", tables).filter((F.col("text") != "") | some(F.col("images")) | some(F.col("tables")))
    return rows.select("source_id", "section_index", "title", "page", "top", "bottom", "text", "images", "tables")


def assemble(region_rows: DataFrame) -> DataFrame:
    """source_id, section_index, title, first_page, regions: sections with their regions in order; contents pages get their title."""
    fields = ("page", "top", "bottom", "text", "images", "tables")
    rows = region_rows.groupBy("source_id", "section_index", "title").agg(F.array_sort(F.collect_list(F.struct("page", "top", F.struct(*fields).alias("r")))).alias("x"))
    regions = F.transform("x", lambda x: x["r"])
    return rows.select("source_id", "section_index", evidence_title(F.col("title"), F.transform(regions, lambda r: r["text"])).alias("title"), F.col("x")[0]["page"].alias("first_page"), regions.alias("regions"))


def reading_order(images: Column) -> Column:
    """Images from top to bottom, then from left to right."""
    keyed = F.array_sort(F.transform(images, lambda m: F.struct(m["bbox"][1].alias("y"), m["bbox"][0].alias("x"), m.alias("m"))))
    return F.transform(keyed, lambda k: k["m"])


def region_text(name: Column, region: Column) -> Column:
    """Evidence of a region (struct page, text, tables: array of rows, images with text) with its source at the head."""
    head = F.concat(F.lit("来源："), name, F.lit("，PDF 第"), region["page"].cast("string"), F.lit("页"))
    row = lambda cells: F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" / "))), " | ")
    tables = F.flatten(F.transform(region["tables"], lambda t: F.concat(F.array(F.lit("原页表格逐行记录（保留空列；跨页及合并单元格关系以原图为准）：")), F.transform(t["rows"], row))))
    seen = F.flatten(F.transform(F.filter(region["images"], lambda m: F.coalesce(m["text"], F.lit("")) != ""), lambda m: F.array(F.lit("截图文字（本地 OCR 辅助检索；可能有识别误差，事务码以原文正文为准）："), m["text"])))
    return text.xml_text(F.array_join(F.concat(F.array(head, F.coalesce(region["text"], F.lit(""))), F.coalesce(tables, F.array().cast("array<string>")), F.coalesce(seen, F.array().cast("array<string>"))), "\n"))


def chunk_id(source_id: Column, section_index: Column, part: Column) -> Column:
    return F.format_string("%s-s%04d-p%02d", source_id, section_index, part)


def chunks(section_rows: DataFrame) -> DataFrame:
    """Bounded chunks of sections: chunk_id, source_id, section_index, title, part, parts, notes, pages, regions.

    ``section_rows``: source_id, section_index, title, regions (array of struct
    page, text, images in order; text is the rendered one).  At most 10,000
    characters and ten images a chunk; no page and no image is lost.  The fold
    runs inside a section's row, never across sections.
    """
    cut = section_rows.withColumn("parts_", folds.split_images(F.col("regions")))
    cut = cut.withColumn("groups", folds.chunk_regions(F.col("parts_"), F.transform("parts_", lambda p: F.length(p["text"]))))
    rows = cut.withColumn("parts", F.coalesce(F.array_max("groups"), F.lit(0))).withColumn("part", F.explode(F.sequence(F.lit(1), F.greatest("parts", F.lit(1))))).filter("parts > 0")
    mine = F.transform(F.filter(F.arrays_zip(F.col("parts_").alias("r"), F.col("groups").alias("g")), lambda x: x["g"] == F.col("part")), lambda x: x["r"])
    note = F.concat(F.lit("本章节分为"), F.col("parts").cast("string"), F.lit("部分，此为第"), F.col("part").cast("string"), F.lit("部分。回答全流程时需要其余部分依据，不得将本部分声称为全部步骤。"))
    return rows.withColumn("mine", mine).select(
        chunk_id(F.col("source_id"), F.col("section_index"), F.col("part")).alias("chunk_id"),
        "source_id",
        "section_index",
        "title",
        "part",
        "parts",
        F.when(F.col("parts") > 1, F.array(note)).otherwise(F.array().cast("array<string>")).alias("notes"),
        F.array_sort(F.array_distinct(F.transform("mine", lambda r: r["page"]))).alias("pages"),
        F.transform("mine", lambda r: F.struct(r["page"].alias("page"), r["text"].alias("text"), r["images"].alias("images"))).alias("regions"),
    )


def evidence_title(title: Column, region_texts: Column) -> Column:
    """A contents page is navigation: its title is 目录 if every region starts with that line."""
    first = lambda t: F.regexp_replace(F.get(F.filter(F.transform(text.lines(t), text.strip), lambda x: x != ""), F.lit(0)), r"(?U)\s+", "")
    return F.when((F.size(region_texts) > 0) & F.forall(region_texts, lambda t: F.coalesce(first(t) == "目录", F.lit(False))), "目录").otherwise(title)


def build_status(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """``sources`` (source_id, pages, sha256) with built: every page is complete and of the same content."""
    done = pages.filter("status = 'complete'").groupBy("source_id", "sha256").agg(F.countDistinct("page").alias("__n"))
    return sources.join(done, ["source_id", "sha256"], "left").withColumn("built", F.coalesce(F.col("__n") >= F.col("pages"), F.lit(False))).drop("__n")


def missing_pages(expected: DataFrame, covered: DataFrame, key: str, page: str = "page") -> DataFrame:
    """Pages that no chunk covers."""
    return expected.select(key, page).join(covered.select(key, page), [key, page], "left_anti")


def export_documents(chunk_rows: DataFrame, names: DataFrame) -> DataFrame:
    """One export row per chunk: key, domain, source_id, chunk_id, pages, image_count, content_hash, metadata.

    ``names``: source_id, name, relative_path, sha256; ``chunk_rows`` has domain.
    """
    number = F.row_number().over(Window.partitionBy("source_id", "domain").orderBy("chunk_id"))
    meta = F.create_map(
        *[
            x
            for k, v in {
                "domain": F.col("domain"),
                "source_id": F.col("source_id"),
                "source_hash": F.col("sha256"),
                "system_version": F.lit("unknown"),
                "document_version": text.document_version(F.col("name")),
                "review_status": F.lit("pending"),
                "validity_status": F.lit("unconfirmed"),
                "project_type": text.project_type(F.col("relative_path")),
                "section_title": F.col("title"),
            }.items()
            for x in (F.lit(k), v)
        ]
    )
    rows = chunk_rows.join(names, "source_id").withColumn("metadata", meta)
    return rows.select(
        F.format_string("%s-%s-%03d", "source_id", "domain", number).alias("key"),
        "domain",
        "source_id",
        F.col("name").alias("source_name"),
        "chunk_id",
        "pages",
        F.aggregate("regions", F.lit(0), lambda a, r: a + F.size(r["images"])).alias("image_count"),
        text.fingerprint("title", "notes", "regions", "sha256").alias("content_hash"),
        "metadata",
    )
