"""Navigation catalogue: outlines, names, headings, overviews, cards, packets, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds, text
from .metadata import shown_domains

#: Titles, words and patterns of navigation texts, cards and search anchors.
PRIMARY_SECTION = "业务流程简介|业务步骤详细描述|流程步骤说明"
FALLBACK_SECTION = "操作|步骤|业务描述|流程描述"
BRANCH_HEAD, BRANCH_TAIL = "原文第 ", " 页的情形：\n"
BRANCH_FLAG = "同一问题有不同业务情形，回答前须确认适用条件"
PACKET_HEADING = r"(?U)^\s*(\d+(?:\.\d+){2,4})\s+([^\n]+)"
#: The procedures that are exported as packets.
PROCEDURE_NUMBERS = ("1.5.2", "1.5.3", "1.5.4", "1.5.5", "1.5.6", "1.5.7")
TOPIC_CUTS = ((r"(?U)^.*?MDG\.[\d.]+[-_\s]*", ""), (r"(?iU)[_\s]*V\d[\d.]*.*$", ""), (r"(?U)^\d+[.、\s]*", ""), (r"(?U)[_\s]+", " "))
CODE_LINE, CODE = "^(创建|查询|事务码|事物码)[：:]", r"[A-Za-z]+[0-9]"
LABEL_ENDS = ("主数据", "主数据查询", "批量导入")
GENERIC_HEADING, GENERIC_STEP, TRANSACTION = "设备管理主数据", "业务流程操作", "事务码"
SCREEN_VERB = "^(创建|修改|显示|查询|维护|申请|审批|工单管理)"
FURNITURE = ("目录", text.FIRST_TITLE, "谢谢", "感谢聆听", "结束语")
CONTENTS, FAQ = "目录", "常见问题"
ANCHOR_HEAD, ANCHOR_TOPIC = "检索主题：", "资料主题："
CONDITION = "上市|未上市|内部|外部|内修|外修"


def outline(chunks: DataFrame) -> DataFrame:
    """source_id, section_index, title, pages, chunk_ids: one entry per section that is not just furniture."""
    kept = chunks.filter(~text.ignored_heading(F.col("title")))
    return kept.groupBy("source_id", "section_index").agg(
        F.min_by(text.strip(F.col("title")), "chunk_id").alias("title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"),
    )


def page_runs(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """key, first_page, last_page: runs of consecutive pages."""
    distinct = pages.select(key, page).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page))
    return distinct.withColumn("island", island).groupBy(key, "island").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page")).drop("island")


def names(found: DataFrame, files: DataFrame) -> DataFrame:
    """source_id, title, aliases, name_basis, filename_topic.

    ``found``: source_id, pos, name (names that the first pages give); ``files``:
    source_id, name.  Names keep the order in which they first occur.
    """
    first = found.groupBy("source_id", "name").agg(F.min("pos").alias("pos")).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("given"))
    topic = text.filename_topic(F.col("name"))
    given = F.coalesce("given", F.array().cast("array<string>"))
    return files.join(first, "source_id", "left").select(
        "source_id",
        F.coalesce(F.get(given, F.lit(0)), topic).alias("title"),
        text.aliases(given, topic).alias("aliases"),
        F.when(F.size(given) > 0, "cover").otherwise("filename").alias("name_basis"),
        topic.alias("filename_topic"),
    )


def names_in_text(pages: DataFrame) -> DataFrame:
    """source_id, pos, name: values of the field 流程名称 on the first three pages, 3 to 99 characters."""
    hits = F.regexp_extract_all(text.text_of("text"), F.lit("流程名称[：:\t ]*([^\n]+)"), 1)
    rows = pages.filter("page <= 3").select("source_id", "page", F.posexplode(hits).alias("i", "raw"))
    return rows.select("source_id", F.struct("page", "i").alias("pos"), text.compact("raw").alias("name")).filter(F.length("name").between(3, 99))


def heading_context(headings: DataFrame) -> DataFrame:
    """source_id, pos, context: the nearest numbered ancestor whose title has a condition word.

    ``headings``: source_id, pos, title.  Of headings with one number the latest
    before the heading counts, and only then is the condition asked for.
    """
    numbered = headings.withColumn("number", text.heading_number(text.strip(F.col("title")))).filter("number <> ''")
    parts = F.split("number", r"\.")
    child = numbered.select("source_id", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("up"), F.size(parts).alias("depth"), "number").filter("up <> number")
    above = numbered.select("source_id", F.col("number").alias("up"), F.col("pos").alias("above_pos"), text.strip(F.col("title")).alias("above"))
    latest = child.join(above, ["source_id", "up"]).filter("above_pos < pos").groupBy("source_id", "pos", "up").agg(F.max_by("above", "above_pos").alias("above"))
    return latest.filter(F.col("above").rlike(CONDITION)).groupBy("source_id", "pos").agg(F.max_by("above", F.length("up")).alias("context"))


def overview(blocks: DataFrame, budget: int = 10_000) -> DataFrame:
    """source_id, kept (array of blocks), complete: blocks in order as long as they fit the budget.

    ``blocks``: source_id, pos, size and a payload.
    """
    rows = blocks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "block"))).alias("b"))
    kept = rows.withColumn("ok", folds.within_budget(F.transform("b", lambda x: x["size"].cast("long")), budget))
    chosen = F.transform(F.filter(F.arrays_zip("b", "ok"), lambda x: x["ok"]), lambda x: x["b"]["block"])
    return kept.select("source_id", chosen.alias("kept"), F.forall("ok", lambda x: x).alias("complete"))


def overview_kind(title: Column) -> Column:
    """primary for sections that describe the process, fallback for those of operations, else null."""
    return F.when(title.rlike(PRIMARY_SECTION), "primary").when(title.rlike(FALLBACK_SECTION) & ~text.compact(title).rlike(text.IGNORED_HEADING), "fallback")


def card_rows(pages: DataFrame) -> DataFrame:
    """Rows for ``merge_cards`` from pages (source_id, page, name, module, text) that have a question and an answer under their labels."""
    fields = pages.withColumn("f", text.faq_fields("text"))
    of = lambda label: F.coalesce(F.try_element_at("f", F.lit(label)), F.lit(""))
    rows = fields.select("*", of("问题描述").alias("question"), of("解决办法").alias("answer"), of("问题原因").alias("cause")).filter("question <> '' and answer <> ''")
    source = F.struct(F.col("name").alias("filename"), "page", "source_id", F.col("text").alias("evidence_text"))
    return rows.select(
        F.format_string("faq-%s-p%03d", F.substring("source_id", 1, 8), "page").alias("card_id"),
        "question", "answer", "cause", "module", F.col("page").cast("long").alias("page"),
        source.alias("source"), F.array().cast("array<string>").alias("flags"), F.col("text").alias("evidence"), F.array().cast("array<string>").alias("images"),
    )


def merge_cards(rows: DataFrame) -> DataFrame:
    """Cards by question: question, card_id, answer, branches, sources, images, review_flags.

    ``rows``: question, page, card_id, answer, source, flags, evidence, images.  A
    question that occurs on several pages gets a branch per page, with its own
    evidence, and a flag that says so.  A card has all its pages in one row.
    """
    grouped = rows.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("page", "card_id", "answer", "source", "flags", "evidence", "images"))).alias("r"))
    many = F.size("r") > 1
    told = F.array_join(F.transform("r", lambda x: F.concat(F.lit(BRANCH_HEAD), x["page"].cast("string"), F.lit(BRANCH_TAIL), x["answer"])), "\n\n")
    flags = F.flatten(F.transform("r", lambda x: x["flags"]))
    return grouped.select(
        "question",
        F.col("r")[0]["card_id"].alias("card_id"),
        F.when(many, told).otherwise(F.col("r")[0]["answer"]).alias("answer"),
        F.filter(F.transform("r", lambda x: F.struct(x["page"].alias("page"), x["answer"].alias("answer"), x["evidence"].alias("evidence"))), lambda x: many).alias("branches"),
        F.transform("r", lambda x: x["source"]).alias("sources"),
        F.flatten(F.transform("r", lambda x: x["images"])).alias("images"),
        F.array_distinct(F.when(many, F.concat(flags, F.array(F.lit(BRANCH_FLAG)))).otherwise(flags)).alias("review_flags"),
    )


def card_issues(question: Column, answer: Column, cause: Column, evidence: Column, branches: Column | None = None) -> Column:
    """What is wrong with a card: missing parts, and fields that no evidence text has under the same label.

    ``branches`` (array of struct answer, evidence): a merged card's answer is
    grounded if each branch's answer is the one its own evidence gives.
    """
    own = lambda b: F.coalesce(F.element_at(text.faq_fields(b["evidence"]), "解决办法") == b["answer"], F.lit(False))
    branched = F.lit(False) if branches is None else (F.coalesce(F.size(branches), F.lit(0)) > 0) & F.coalesce(F.forall(branches, own), F.lit(False))
    said = lambda label, value: F.exists(evidence, lambda t: F.coalesce(F.element_at(text.faq_fields(t), label).contains(value), F.lit(False)))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = [
        F.when(empty(question) | empty(answer), "missing_question_or_answer"),
        F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "missing_sources"),
    ]
    for name, label, value in (("question", "问题描述", question), ("answer", "解决办法", answer), ("cause", "问题原因", cause)):
        grounded = F.coalesce(said(label, value), F.lit(False)) | (branched if name == "answer" else F.lit(False))
        checks.append(F.when(~empty(value) & ~grounded, f"{name}_not_extractively_grounded"))
    return F.array_compact(F.array(*checks))


def packets(pages: DataFrame, numbers: list[str] | None = None) -> DataFrame:
    """source_id, number, title, spans (array of page, text): procedures across pages by numbered headings.

    Each page's text stands at its offset in the whole; a heading's span reaches
    to the next heading's start and overlaps the pages it is cut from.
    """
    w = Window.partitionBy("source_id").orderBy("page")
    size = F.length("text") + 1
    placed = pages.select("source_id", "page", text.text_of("text").alias("text")).withColumn("end", F.sum(size).over(w)).withColumn("start", F.col("end") - size)
    line_rows = placed.select("source_id", "start", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lw = Window.partitionBy("source_id").orderBy("start", "i")
    at = F.coalesce(F.sum(F.length("line") + 1).over(lw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = line_rows.withColumn("at", at).withColumn("number", F.regexp_extract("line", PACKET_HEADING, 1)).filter("number <> ''")
    heads = found.withColumn("title", F.regexp_extract("line", PACKET_HEADING, 2))
    total = placed.groupBy("source_id").agg(F.max("end").alias("total"))
    spans = heads.join(total, "source_id").withColumn("stop", F.coalesce(F.lead("at").over(Window.partitionBy("source_id").orderBy("at")), F.col("total")))
    if numbers is not None:
        spans = spans.filter(F.col("number").isin(numbers))
    cut = spans.select("source_id", "number", "title", F.col("at").alias("a"), F.col("stop").alias("b")).join(placed, "source_id").filter("start < b and end > a")
    piece = text.strip(F.concat("text", F.lit("\n")).substr(F.greatest(F.col("a") - F.col("start"), F.lit(0)).cast("int") + 1, (F.least("end", "b") - F.greatest("start", "a")).cast("int")))
    return cut.groupBy("source_id", "number", "title").agg(F.array_sort(F.collect_list(F.struct("page", piece.alias("text")))).alias("spans"))


def procedures(pages: DataFrame, numbers: tuple[str, ...] = PROCEDURE_NUMBERS) -> DataFrame:
    """``packets`` of the exported procedures, with packet_id, pages, and the state in which they wait for a review."""
    packet = F.concat(F.lit("procedure-"), F.substring(F.col("source_id").cast("string"), 1, 8), F.lit("-"), F.translate("number", ".", "-"))
    return packets(pages, list(numbers)).select(
        packet.alias("packet_id"), "source_id", "number", "title", "spans", F.transform("spans", lambda s: s["page"]).alias("pages"),
        F.lit("draft").alias("status"), F.lit("pending").alias("business_review"),
    )


def topic_of(source_name: Column) -> Column:
    """Topic in a source's name for search anchors."""
    t = text.file_stem(source_name)
    for pattern, to in TOPIC_CUTS:
        t = F.regexp_replace(t, pattern, to)
    return text.strip(t)


def native_labels(region_texts: Column) -> Column:
    """Short headings and transaction codes in the first four lines of each region; contents pages have none."""
    tidy = lambda t: F.filter(F.transform(text.lines(t), lambda s: F.btrim(s, F.lit(" •\t"))), lambda s: (s != "") & ~s.rlike(r"(?U)^[\d\W]+$"))
    code = lambda s: s.rlike(CODE_LINE) & s.rlike(CODE)
    heading = lambda s: s.endswith(LABEL_ENDS[0]) | s.endswith(LABEL_ENDS[1]) | s.endswith(LABEL_ENDS[2])
    fit = lambda s: ~s.isin(GENERIC_HEADING, GENERIC_STEP) & F.length(s).between(3, 40) & ~s.rlike("[，。；]") & (code(s) | heading(s))
    of = lambda ls: F.when((F.size(ls) == 0) | (F.regexp_replace(F.get(ls, F.lit(0)), r"(?U)\s+", "") == CONTENTS), F.array().cast("array<string>")).otherwise(F.filter(F.slice(ls, 1, 4), fit))
    return F.array_distinct(F.flatten(F.transform(region_texts, lambda t: F.transform(F.array(tidy(t)), of)[0])))


def screen_labels(lines: Column) -> Column:
    """Window titles among the first eight recognised lines of an image: 4 to 20 characters, a verb at the start, score 0.9 or more."""
    return F.transform(F.filter(F.slice(lines, 1, 8), lambda x: F.length(text.strip(x["text"])).between(4, 20) & text.strip(x["text"]).rlike(SCREEN_VERB) & (x["score"] >= 0.9)), lambda x: text.strip(x["text"]))


def anchor_text(section_title: Column, source_name: Column, domain: Column, context: Column, labels: Column, screen: Column) -> Column:
    """Short text that leads a search to a section; null for furniture.

    ``context``: J-10's ancestor or null; ``labels``: native labels; ``screen``:
    labels of a transaction page, in order of preference.
    """
    plain = text.strip(section_title)
    title = F.when(context.isNotNull() & ~plain.contains(context), F.concat(context, F.lit(" / "), plain)).otherwise(plain)
    topic = topic_of(source_name)
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    faq = topic.contains(FAQ)
    tail = F.when(~faq & ~topic.contains(title) & ~title.contains(topic), F.concat(F.lit(ANCHOR_TOPIC), topic, F.lit("。"))).otherwise(F.lit(""))
    return (
        F.when(plain.isin(*FURNITURE), F.lit(None).cast("string"))
        .when((domain == "equipment") & (title == GENERIC_HEADING) & some(labels), F.concat(F.lit(ANCHOR_HEAD), F.array_join(labels, "；"), F.lit("。" + ANCHOR_TOPIC), topic, F.lit("。")))
        .when((domain == "equipment") & (title.startswith(TRANSACTION) | (title == GENERIC_STEP)) & some(screen), F.concat(F.array_join(F.slice(screen, 1, 8), "；"), F.lit("。"), title, F.lit("。"), topic, F.lit("。")))
        .when((domain == "funds") & ~faq, F.concat(topic, F.lit("。"), title, F.lit("。")))
        .otherwise(F.concat(F.lit(ANCHOR_HEAD), title, F.lit("。"), tail))
    )


def transaction_labels(regions: Column) -> Column:
    """Labels of a transaction page, at most eight, each once: native lines of 4 to 35 characters and window titles of its pictures, region by region.

    ``regions``: array of struct text, images (lines: text, score).
    """
    tidy = lambda t: F.transform(text.lines(t), lambda s: F.btrim(s, F.lit(" •\t")))
    fit = lambda s: F.length(s).between(4, 35) & (s != GENERIC_STEP) & ~s.startswith(TRANSACTION) & ~s.rlike(r"(?U)^[\d\W]+$")
    of = lambda r: F.concat(F.filter(tidy(r["text"]), fit), F.flatten(F.transform(r["images"], lambda m: screen_labels(F.coalesce(m["lines"], F.array().cast("array<struct<text:string,score:double>>"))))))
    return F.slice(F.array_distinct(F.flatten(F.transform(regions, of))), 1, 8)


def selection_lines(records: DataFrame) -> DataFrame:
    """One line per record: key, shown names of its domains, topic and names."""
    return records.select(F.concat_ws(" | ", "key", F.array_join(shown_domains(F.col("domains")), "、"), F.concat(F.lit("文件主题："), F.col("filename_topic")), F.concat(F.lit("封面/别称："), F.array_join("aliases", "；"))).alias("line"))
