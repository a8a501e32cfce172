"""Evidence queries: documents as sources whose lines are pages, from page boxes to search documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import catalog, corpus, documents, graph, inventory, metadata, navigation
from .base import query, table
from .corpus import _LINES, _lines

_CLAMP = "[greatest(0.0, {0}), greatest(0.0, {1}), least(100.0, {2}), least(200.0, {3})]"


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as decoded pages of 100 by 200 points with three pictures each."""
    q, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    image = lambda sha, *edges: F.struct(F.array(*[x if not isinstance(x, int) else F.lit(float(x)) for x in edges]).alias("bbox"), F.lit(sha).alias("sha256"))
    none = F.array().cast("array<struct<text:string,top:double,bottom:double>>")
    tables = F.array().cast("array<struct<bbox:array<double>,rows:array<array<string>>,status:string,error:string>>")
    words = F.array_join(F.array_repeat("l_returnflag", F.col("l_linenumber") * 4), " ")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_id"),
        F.col("l_linenumber").cast("long").alias("page"),
        F.lit(100.0).alias("width"),
        F.lit(200.0).alias("height"),
        F.concat(F.lit(" "), words, F.lit(" \n\n第 1 页 共 2 页\n ")).alias("raw_text"),
        F.array(image("a", q - 10, tax * 1000, 40, 90), image("b", q - 10 + disc * 40, tax * 1000, 40, 90), image("deco", q, 5, 150, 300)).alias("images"),
        none.alias("lines"),
        tables.alias("tables"),
        F.lit("complete").alias("status"),
    )


@query(f"""with x as (select 'o' || l_orderkey as source_id, cast(l_linenumber as bigint) as page, rtrim(repeat(l_returnflag || ' ', l_linenumber * 4)) as body,
        {_CLAMP.format('l_quantity - 10', 'l_tax * 1000', '40.0', '90.0')} as a, {_CLAMP.format('l_quantity - 10 + l_discount * 40', 'l_tax * 1000', '40.0', '90.0')} as b, {_CLAMP.format('l_quantity', '5.0', '150.0', '300.0')} as c from lineitem),
    y as (select *, a[3] > a[1] and a[4] > a[2] as in_a, b[3] > b[1] and b[4] > b[2] as in_b, c[3] > c[1] and c[4] > c[2] as in_c from x),
    z as (select *, in_a and a[3] - a[1] >= 20 and a[4] - a[2] >= 30 as ok_a, in_b and b[3] - b[1] >= 20 and b[4] - b[2] >= 30 as big_b, abs(a[1] - b[1]) < 2 and abs(a[2] - b[2]) < 2 and abs(a[3] - b[3]) < 2 and abs(a[4] - b[4]) < 2 as near from y),
    w as (select *, big_b and not (ok_a and near) as ok_b, (ok_a::int + big_b::int) as big from z)
    select source_id, page, body as cleaned_text, 1 as removed, case when ok_a or ok_b then ok_a::int + ok_b::int when length(body) < 40 then 1 else 0 end as images,
        case when ok_a or ok_b then '' when length(body) < 40 then 'whole' else '' end as shown, in_a::int + in_b::int - big as small, in_c::int as reviewed from w""")
def corpus_parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Boxes cut to the page, small and reviewed pictures apart, near repeats gone, bare pages shown whole."""
    out = corpus.parsed_pages(_page_rows(spark, d), 20, 30, ["deco"])
    whole = F.exists("images", lambda m: m["bbox"] == F.array(*map(F.lit, (0.0, 0.0, 100.0, 200.0))))
    why = lambda r: F.size(F.filter("excluded", lambda m: m["reason"] == r))
    return out.select("source_id", "page", "cleaned_text", F.size("excluded_lines").alias("removed"), F.size("images").alias("images"), F.when(whole, "whole").otherwise("").alias("shown"), why("small_image_candidate_not_indexed").alias("small"), why("reviewed_decoration").alias("reviewed"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pages of 100 points: two halves of text, two pictures on every fifth, a table on every seventh page."""
    page = F.col("page")
    half = F.ceil(F.length("text") / 2).cast("int")
    part = lambda s, top: F.struct(s.alias("text"), F.lit(top).alias("top"), F.lit(top + 10).alias("bottom"))
    image = lambda i, top, bottom: F.struct(F.lit(i).alias("image_id"), F.array(*map(F.lit, (0.0, top, 10.0, bottom))).alias("bbox"), F.lit("").alias("text"))
    row = F.struct(F.array(*map(F.lit, (0.0, 70.0, 10.0, 90.0))).alias("bbox"), F.array(F.array(F.lit("a"), F.lit(None).cast("string")), F.array(F.lit("b\nc"), F.lit("d"))).alias("rows"))
    return _lines(spark, d).select(
        "source_id",
        "page",
        F.lit(100.0).alias("height"),
        F.col("text").alias("cleaned_text"),
        F.array(part(F.col("text").substr(F.lit(1), half), 10.0), part(F.col("text").substr(half + 1, F.length("text")), 60.0)).alias("lines"),
        F.when(page % 5 == 0, F.array(image("low", 60.0, 80.0), image("high", 10.0, 30.0))).otherwise(F.array().cast("array<struct<image_id:string,bbox:array<double>,text:string>>")).alias("images"),
        F.when(page % 7 == 0, F.array(row)).otherwise(F.array().cast("array<struct<bbox:array<double>,rows:array<array<string>>>>")).alias("tables"),
    )


def _region_rows(spark: SparkSession, d: str) -> DataFrame:
    """Even pages whole, odd ones in halves that belong to two sections."""
    e = _evidence(spark, d)
    band = lambda top, bottom, section: F.struct(F.lit(top).alias("top"), F.lit(bottom).alias("bottom"), section.cast("int").alias("section_index"))
    section = F.floor(F.col("page") / 4)
    bands = F.when(F.col("page") % 2 == 0, F.array(band(0.0, 100.0, section))).otherwise(F.array(band(0.0, 50.0, section), band(50.0, 100.0, section + 1)))
    slices = e.select("source_id", "page", F.explode(bands).alias("b")).select("source_id", "b.section_index", F.concat(F.lit("t"), F.col("b.section_index").cast("string")).alias("title"), "page", "b.top", "b.bottom")
    return corpus.make_regions(slices, e)


_BLANKS = "E' \\t\\n\\x0b\\x0c\\r'"
_REGIONS = f"""{_LINES}, h as (select source_id, page, text, cast(ceil(length(text) / 2.0) as integer) as n from lines),
    sl as (
        select source_id, page, page // 4 as section_index, 0.0 as top, 100.0 as bottom, trim(text, {_BLANKS}) as text from h where page % 2 = 0
        union all select source_id, page, page // 4, 0.0, 50.0, trim(substring(text, 1, n), {_BLANKS}) from h where page % 2 = 1
        union all select source_id, page, page // 4 + 1, 50.0, 100.0, trim(substring(text, n + 1), {_BLANKS}) from h where page % 2 = 1
    ), im as (select *, case when page % 5 = 0 then list_filter(['high', 'low'], lambda x: case x when 'high' then 20 else 70 end >= top and case x when 'high' then 20 else 70 end < bottom) else [] end as seen,
        case when page % 7 = 0 and bottom > 80 then 1 else 0 end as tables from sl),
    rg as (select *, case when len(seen) > 0 then seen when page % 7 = 0 then [source_id || '-p' || lpad(cast(page as varchar), 4, '0') || '-page'] else [] end as images from im),
    regions as (select source_id, cast(section_index as integer) as section_index, page, top, bottom, text, images, tables from rg where text <> '' or len(images) > 0 or tables > 0)"""


@query(f"with {_REGIONS} select source_id, section_index, page, top, bottom, md5(text) as digest, array_to_string(images, ',') as images, tables from regions")
def corpus_make_regions(spark: SparkSession, d: str) -> DataFrame:
    """Text, pictures and tables of each part of a page; parts that hold nothing are gone."""
    out = _region_rows(spark, d)
    return out.select("source_id", "section_index", "page", "top", "bottom", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join(F.transform("images", lambda m: m["image_id"]), ",").alias("images"), F.size("tables").alias("tables"))


_HEADLINE = "'来源：f.pdf，PDF 第' || page || '页'"
_TABLE_TEXT = "chr(10) || '原页表格逐行记录（保留空列；跨页及合并单元格关系以原图为准）：' || chr(10) || 'a | ' || chr(10) || 'b / c | d'"
_ITEMS = f"""select source_id, section_index, page, top, n, length({_HEADLINE}) + 1 + length(text) + case when tables > 0 then length({_TABLE_TEXT}) else 0 end as size, len(images) as images from (select *, 1 as n from regions)"""


def _section_rows(spark: SparkSession, d: str) -> DataFrame:
    regions = corpus.assemble(_region_rows(spark, d))
    shown = F.transform("regions", lambda r: F.struct(r["page"].alias("page"), corpus.region_text(F.lit("f.pdf"), r).alias("text"), r["images"].alias("images")))
    return regions.select("source_id", "section_index", "title", shown.alias("regions"))


@query(f"""with {_REGIONS} select source_id, section_index, count(*) as n_regions, min(page) as first_page, sum(length({_HEADLINE}) + 1 + length(text) + case when tables > 0 then length({_TABLE_TEXT}) else 0 end)::bigint as chars from regions group by all""")
def corpus_region_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their regions' rendered texts: source line, text, table rows."""
    rows = _section_rows(spark, d)
    return rows.select("source_id", "section_index", F.size("regions").cast("long").alias("n_regions"), F.col("regions")[0]["page"].alias("first_page"), F.aggregate("regions", F.lit(0).cast("long"), lambda n, r: n + F.length(r["text"])).alias("chars"))


@query("""with recursive i as (select doc_id, p, cast(8 * length(line) as bigint) as size, cast((p * 7 + doc_id) % 27 as bigint) as images from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from documents)),
    e as (select doc_id, p, size, images as all_images, k, least(images - 10 * k, 10) as images, row_number() over (partition by doc_id order by p, k) as no from (select *, unnest(range(0, greatest(cast(ceil(images / 10.0) as bigint), 1))) as k from i)),
    f as (
        select doc_id, no, p, 1 as g, size as total, images as n, images from e where no = 1
        union all
        select e.doc_id, e.no, e.p, case when e.k > 0 or f.total + e.size > 10000 or f.n + e.all_images > 10 then f.g + 1 else f.g end,
            case when e.k > 0 or f.total + e.size > 10000 or f.n + e.all_images > 10 then e.size else f.total + e.size end, case when e.k > 0 or f.total + e.size > 10000 or f.n + e.all_images > 10 then e.images else f.n + e.images end, e.images
        from f join e on e.doc_id = f.doc_id and e.no = f.no + 1
    ), t as (select doc_id, max(g) as parts from f group by all)
    select printf('%d-s%04d-p%02d', doc_id, 1, g) as chunk_id, g as part, parts, case when parts > 1 then 1 else 0 end as notes, array_to_string(list_sort(list(distinct p)), ',') as pages, count(*) as regions, cast(sum(images) as bigint) as images from f join t using (doc_id) group by doc_id, g, parts""")
def corpus_chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 10,000 characters and ten pictures; more pictures than ten go to companion chunks with the text again."""
    line = F.split(text.text_of("text"), "\n")
    region = lambda x, i: F.struct(
        (i + 1).alias("page"),
        F.repeat(x, 8).alias("text"),
        F.transform(F.slice(F.sequence(F.lit(0), F.lit(27)), 1, (((i + 1) * 7 + F.col("doc_id")) % 27).cast("int")), lambda k: F.struct(k.alias("image_id"))).alias("images"),
    )
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("section_index"), F.lit("t").alias("title"), F.transform(line, region).alias("regions"))
    out = corpus.chunks(rows)
    count = F.aggregate("regions", F.lit(0).cast("long"), lambda n, r: n + F.size(r["images"]))
    return out.select("chunk_id", "part", "parts", F.size("notes").alias("notes"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.size("regions").cast("long").alias("regions"), count.alias("images"))


#: Titles of a document's first section by its number.
_TITLES = ("2 业务流程简介", "3 操作", "4 其他", "5 业务流程图")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every line a chunk of its own: titles that quote, stand in, or do neither; names on first pages; pictures in diagrams."""
    k = F.col("source_id") + F.col("page")
    tables = F.when(F.col("source_id") % 6 == 0, F.array(F.struct(F.array(F.array(F.lit("流程名称："), F.concat(F.lit("甲"), F.col("source_id").cast("string"), F.lit("业务流程"))), F.array(F.lit("x\ny"), F.lit(None).cast("string"))).alias("rows"))))
    named = F.when((F.col("source_id") % 4 == 0) & (F.col("page") == 2), F.concat(F.lit("流程名称 乙"), F.col("source_id").cast("string"), F.lit(" 手册\n"), "text")).otherwise(F.col("text"))
    images = F.when(k % 4 == 3, F.array(*[F.struct(F.concat(F.lit(f"i{i}-"), (F.col("page") % 6).cast("string")).alias("image_id"), F.concat(F.lit(f"assets/{i}/"), (F.col("page") % 6).cast("string")).alias("path")) for i in (1, 2)])).otherwise(F.array().cast("array<struct<image_id:string,path:string>>"))
    region = F.struct("page", F.lit(0.0).alias("top"), F.lit(100.0).alias("bottom"), named.alias("text"), F.when(F.col("page") == 1, tables).alias("tables"), images.alias("images"))
    return _lines(spark, d).select(F.col("source_id").cast("string").alias("source_id"), F.col("page").alias("section_index"), F.format_string("c%04d", "page").alias("chunk_id"), F.element_at(F.array(*map(F.lit, _TITLES)), (k % 4 + 1).cast("int")).alias("title"), F.when(k % 3 == 0, "funds").otherwise("finance").alias("domain"), F.array("page").alias("pages"), F.array(region).alias("regions"), F.array().cast("array<string>").alias("notes"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("1."), "source", F.lit("操作手册_V2.pdf")).alias("name"), F.lit("h").alias("sha256"), F.size(F.split(text.text_of("text"), "\n")).alias("pages"))


_NAV = f"""{_LINES}, c as (select *, (source_id + page) % 4 as k from lines),
    cc as (select *, case when source_id % 4 = 0 and page = 2 then '流程名称 乙' || source_id || ' 手册' || chr(10) || text else text end as said from c),
    src as (select doc_id as source_id, len(string_split(coalesce(text, ''), chr(10))) as n_pages, '1.' || source || '操作手册_V2.pdf' as source_name, source || '操作手册' as topic from documents),
    nm as (select source_id, case when source_id % 6 = 0 then '甲' || source_id || '业务流程' end as a, case when source_id % 4 = 0 and n_pages >= 2 then '乙' || source_id || '手册' end as b, topic, n_pages, source_name from src),
    al as (select *, list_filter([a, b], lambda x: x is not null) as given from nm),
    names as (select *, coalesce(given[1], topic) as title, list_concat(given, [topic]) as known from al),
    shorts as (select *, list_filter(list_transform(known, lambda x: regexp_replace(x, '(业务流程|操作手册|用户手册|流程)$', '')), lambda x: length(x) >= 3) as short from names),
    aliased as (select *, list_concat(known, list_filter(short, lambda x: not list_contains(known, x))) as aliases from shorts),
    outl as (select source_id, count(*) as entries from c group by all),
    prim as (select cc.source_id, page, trim(said, {_BLANKS}) as t, length(trim(said, {_BLANKS})) + case when page = 1 and cc.source_id % 6 = 0 then length('流程名称： | 甲' || cc.source_id || '业务流程') + length('xy | ') else 0 end as size from cc where k = 0 and (trim(said, {_BLANKS}) <> '' or (page = 1 and cc.source_id % 6 = 0))),
    fall as (select cc.source_id, page, said as t, length(said) as size from cc join outl using (source_id) where k = 1 and length(trim(said, {_BLANKS})) >= 30 and entries <= 12 and source_id not in (select source_id from prim)),
    ev as (select *, true as main, row_number() over (partition by source_id order by page) as no from prim union all select *, false, row_number() over (partition by source_id order by page) from fall)"""
_KEPT = """kept as (
        select source_id, no, page, t, size, main, size <= 10000 as ok, case when size <= 10000 then size else 0 end as total from ev where no = 1
        union all select e.source_id, e.no, e.page, e.t, e.size, e.main, k.total + e.size <= 10000, case when k.total + e.size <= 10000 then k.total + e.size else k.total end from kept k join ev e on e.source_id = k.source_id and e.no = k.no + 1
    )"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return navigation.records(_sources(spark, d), _chunks(spark, d))


@query(f"""with recursive {_NAV}, {_KEPT}, e as (select source_id, count(*) filter (where ok) as n_evidence, bool_and(ok) as complete, bool_or(main) as described, max(total) as chars from kept group by all),
    dg as (select source_id, list(path order by page, i) as paths from (select source_id, page, i, i || '/' || (page % 6) as path, row_number() over (partition by source_id, i, page % 6 order by page) as again from c, range(1, 3) t(i) where k = 3) where again = 1 group by all),
    dm as (select source_id, array_to_string(list_sort(list(distinct case when (source_id + page) % 3 = 0 then 'funds' else 'finance' end)), ',') as domains from c group by all)
    select cast(x.source_id as varchar) as key, title, array_to_string(aliases, '|') as aliases, case when len(given) > 0 then 'cover' else 'filename' end as name_basis, cast(len(given) as integer) as n_names, cast(entries as integer) as entries, cast(coalesce(n_evidence, 0) as integer) as n_evidence, coalesce(complete, true) as complete,
        coalesce(described, false) as described, coalesce(array_to_string(list_transform(paths[1:2], lambda p: 'assets/' || p), ','), '') as images, domains from aliased x join outl using (source_id) join dm using (source_id) left join e using (source_id) left join dg using (source_id)""")
def nav_records(spark: SparkSession, d: str) -> DataFrame:
    """One record a source: names, outline, evidence within its budget, pictures of diagrams, domains."""
    r = _records(spark, d)
    return r.select("key", "title", F.array_join("aliases", "|").alias("aliases"), "name_basis", F.size("name_evidence").alias("n_names"), F.size("outline").alias("entries"), F.size("overview_evidence").alias("n_evidence"), F.col("evidence_complete").alias("complete"), F.col("has_process_description").alias("described"), F.array_join(F.transform("images", lambda m: m["path"]), ",").alias("images"), F.array_join("domains", ",").alias("domains"))


@query(f"""with recursive {_NAV}, {_KEPT},
    q as (select source_id, string_agg('来源：' || source_name || '，PDF 第' || page || '页' || chr(10) || t || case when main and page = 1 and source_id % 6 = 0 then chr(10) || '原页表格逐行文本（跨页/合并关系仍需核对）：' || chr(10) || '流程名称： | 甲' || source_id || '业务流程' || chr(10) || 'xy | ' else '' end, chr(10) order by no) filter (where ok) as quoted, bool_and(ok) as complete, bool_or(main) as main from kept join src using (source_id) group by all),
    o as (select source_id, string_agg({list(_TITLES)}[k + 1] || '｜来源：' || source_name || '，PDF 第' || page || '页', chr(10) order by page) as entries from c join src using (source_id) group by all),
    dm as (select source_id, array_to_string(list_transform(list_sort(list(distinct case when (source_id + page) % 3 = 0 then 'funds' else 'finance' end)), lambda x: case x when 'funds' then '资金与预算' else '财务核算' end), '、') as domains from c group by all)
    select cast(x.source_id as varchar) as key, md5('流程/手册导航：' || title || chr(10) || '可识别名称：' || array_to_string(aliases, '；') || chr(10) || '原始资料：' || source_name || '；共' || n_pages || '页。业务主题：' || domains || chr(10) || '资料适用版本待确认；业务复核待完成。本卡是原始资料的导航和摘录，不是新增操作规范。' || chr(10)
        || case when len(given) > 0 then coalesce('原文流程名称：' || a || '。来源：' || source_name || '，PDF 第1页' || chr(10), '') || coalesce('原文流程名称：' || b || '。来源：' || source_name || '，PDF 第2页' || chr(10), '') || '封面流程名可能被多份分册复用；实际范围以文件主题和下列目录为准。' else '原文未提取到明确“流程名称”字段；本卡名称取自文件名，不冒充原文正式流程名称。' end || chr(10)
        || '全书章节导航（顺序为原书章节顺序，不代表所有环节必须依次执行；条件分支保持独立）：' || chr(10) || entries || chr(10)
        || case when quoted is null then '本卡没有抽取到独立的完整流程步骤说明。可以按上述章节给出覆盖范围/简要环节，并追问用户想展开哪一部分；不得因此声称原手册缺少正文。' else case when main then '原文流程说明及步骤表摘录（需要保留条件分支与原文编号）：' else '原文操作说明摘录（需要保留条件分支与原文编号；不把局部操作声称为全部流程）：' end || chr(10) || quoted end || chr(10)
        || case when coalesce(complete, true) then '' else '步骤说明摘录未覆盖全部说明章节；只能作为概览，详细操作需进入对应章节。' || chr(10) end || '用户只给流程名称时，先给有依据的概览并列出可展开部分；目录不能伪装成逐项必做的全流程。') as digest
    from aliased x join o using (source_id) join dm using (source_id) left join q using (source_id)""")
def nav_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs that show each record."""
    return _records(spark, d).select("key", F.md5(F.array_join(navigation.paragraphs(), "\n").cast("binary")).alias("digest"))


@query(f"""with {_NAV}, dm as (select source_id, array_to_string(list_transform(list_sort(list(distinct case when (source_id + page) % 3 = 0 then 'funds' else 'finance' end)), lambda x: case x when 'funds' then '资金与预算' else '财务核算' end), '、') as domains from c group by all)
    select source_id || ' | ' || domains || ' | 文件主题：' || topic || ' | 封面/别称：' || array_to_string(aliases, '；') as line from aliased join dm using (source_id)""")
def nav_selection_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line a source, by which a reader chooses it."""
    return catalog.selection_lines(_records(spark, d))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every two lines an export row; every ninth is retired."""
    rows = _chunks(spark, d).groupBy("source_id", F.floor((F.col("section_index") - 1) / 2).cast("int").alias("n")).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_list("section_index")).alias("pages"))
    state = F.when((F.col("source_id").cast("long") + F.col("n")) % 9 == 0, "retired").otherwise("unconfirmed")
    meta = F.create_map(F.lit("section_title"), F.concat(F.lit("s"), F.col("n").cast("string")), F.lit("validity_status"), state)
    return rows.select(F.format_string("%s-%03d", "source_id", "n").alias("key"), "source_id", F.lit("f.pdf").alias("source_name"), F.lit("finance").alias("domain"), "pages", F.lit(1).alias("image_count"), meta.alias("metadata"), "chunk_ids")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return documents.documents(_manifest(spark, d), _chunks(spark, d).withColumn("regions", F.transform("regions", lambda r: F.struct(r["page"].alias("page"), r["text"].alias("text"), F.array().cast("array<struct<rows:array<array<string>>>>").alias("tables"), F.transform(r["images"], lambda m: F.struct(m["image_id"].alias("image_id"), F.lit("").alias("text"))).alias("images")))), _records(spark, d).filter("cast(source_id as bigint) % 5 <> 0"))


_DOCS = f"""{_NAV}, dd as (select source_id, (page - 1) // 2 as n, string_agg({list(_TITLES)}[k + 1] || chr(10) || chr(10) || '来源：f.pdf，PDF 第' || page || '页' || chr(10) || said, chr(10) || chr(10) order by page) as content, array_to_string(list(page order by page), ',') as pages, cast(coalesce(sum(case when k = 3 then 2 end), 0) as integer) as images from cc group by all)"""


@query(f"""with {_DOCS} select printf('%s-%03d', cast(dd.source_id as varchar), n) as doc_id, 's' || n as title, case when dd.source_id % 5 <> 0 then x.topic else 'f.pdf' end as topic, pages, images, md5(content) as digest from dd join aliased x using (source_id) where (dd.source_id + n) % 9 <> 0""")
def docs_details(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the manifest that are not retired, with the topic of their source's record, else its name."""
    out = _documents(spark, d).filter("kind = 'detail'")
    return out.select("doc_id", "title", "topic", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.size("images").alias("images"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""with recursive {_DOCS}, {_KEPT},
    o as (select source_id, string_agg({list(_TITLES)}[k + 1] || '（PDF 第 ' || page || ' 页）', chr(10) order by page) as entries, array_to_string(list(page order by page), ',') as pages from c group by all),
    q as (select source_id, string_agg('PDF 第 ' || page || ' 页：' || chr(10) || t || chr(10) || case when main and page = 1 and source_id % 6 = 0 then '流程名称： | 甲' || source_id || '业务流程' || chr(10) || 'xy | ' else '' end, chr(10) order by no) filter (where ok) as quoted from kept group by all)
    select 'nav-' || x.source_id as doc_id, title, topic, pages, md5('流程名称：' || title || chr(10) || '原文名称别称：' || array_to_string(aliases, '；') || chr(10) || '资料主题：' || topic || chr(10) || '原文目录：' || chr(10) || entries || coalesce(chr(10) || quoted, '')) as digest
    from aliased x join o using (source_id) left join q using (source_id) where x.source_id % 5 <> 0""")
def docs_overviews(spark: SparkSession, d: str) -> DataFrame:
    """Overviews of the sources, in the same table as the sections."""
    out = _documents(spark, d).filter("kind = 'overview'")
    return out.select("doc_id", "title", "topic", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""with {_DOCS} select distinct 'i' || i || '-' || (page % 6) as image_id from c, range(1, 3) t(i) where k = 3 and (source_id + (page - 1) // 2) % 9 <> 0
    union select 'i' || i || '-' || (page % 6) from (select page, i, row_number() over (partition by source_id order by first, i) as r from (select source_id, i, page % 6 as p6, min(page) as first, min(page) as page from c, range(1, 3) t(i) where k = 3 and source_id % 5 <> 0 group by source_id, i, page % 6)) where r <= 2""")
def docs_allowed_assets(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that documents refer to."""
    return documents.allowed_assets(_documents(spark, d))


@query(f"""with {_NAV} select printf('%s-%03d', cast(source_id as varchar), (page - 1) // 2) as key, 'finance' as domain, 's' || ((page - 1) // 2) as title, cast(count(*) as integer) as n_pages from c group by source_id, (page - 1) // 2
    union all select cast(x.source_id as varchar), 'process_navigation', title, cast(count(*) as integer) from aliased x join c using (source_id) group by x.source_id, title""")
def docs_listing(spark: SparkSession, d: str) -> DataFrame:
    """Both manifests as a reader sees them."""
    out = documents.listing(_manifest(spark, d), navigation.manifest(_records(spark, d)))
    return out.select("key", "domain", "title", F.size("pages").alias("n_pages"))


@query(f"""with {_LINES}, w as (select source_id, page, 1 + (page - 1) // 3 as a, (page - 1) % 3 as b, text from lines),
    h as (select source_id, page, case when b = 0 then cast(a as varchar) else a || '.' || b end as num, case when (page + source_id) % 4 = 0 then '内部' else '普通' end as word from w),
    up as (select c.source_id, c.page, p.num || ' ' || p.word as t, p.page as above, p.word, p.num from h c join h p on p.source_id = c.source_id and p.page < c.page and starts_with(c.num, p.num || '.')),
    latest as (select source_id, page, num, arg_max(t, above) as t, arg_max(word, above) as word from up group by all)
    select source_id, page as pos, arg_max(t, length(num)) as context from latest where word = '内部' group by all""")
def catalog_heading_context(spark: SparkSession, d: str) -> DataFrame:
    """The nearest numbered heading above whose latest title has a condition."""
    a, b = 1 + F.floor((F.col("page") - 1) / 3), (F.col("page") - 1) % 3
    number = F.when(b == 0, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("."), b.cast("string")))
    word = F.when((F.col("page") + F.col("source_id")) % 4 == 0, "内部").otherwise("普通")
    return catalog.heading_context(_lines(spark, d).select("source_id", F.col("page").alias("pos"), F.concat(number, F.lit(" "), word).alias("title")))


@query(f"""with {_LINES}, h as (select source_id, page, 1 + (page - 1) // 3 as a, (page - 1) % 3 as b, (page + source_id) % 4 as w from lines),
    t as (select source_id, case when b = 0 then a || case when w < 2 then ' 外部' else ' 普通' end else a || '.' || b || case when w = 0 then '.内部' else ' 步骤' end end as title, case when b = 0 then cast(a as varchar) else a || '.' || b end as num from h)
    select p.source_id, p.num as number, p.title, count(*) as children from t p join t c on c.source_id = p.source_id and starts_with(c.title, p.num || '.') where regexp_matches(p.title, '上市|内部|外部|内修|外修') group by all""")
def graph_scoped_branches(spark: SparkSession, d: str) -> DataFrame:
    """Headings with a condition that have entries below them; a number that ends in a full stop is below itself."""
    a, b, w = (1 + F.floor((F.col("page") - 1) / 3)).cast("string"), (F.col("page") - 1) % 3, (F.col("page") + F.col("source_id")) % 4
    head = F.concat(a, F.when(w < 2, " 外部").otherwise(" 普通"))
    title = F.when(b == 0, head).otherwise(F.concat(a, F.lit("."), b.cast("string"), F.when(w == 0, ".内部").otherwise(" 步骤")))
    return graph.scoped_branches(_lines(spark, d).select("source_id", title.alias("title")))


@query(f"""with {_LINES}, t as (select source_id, page, case when page % 3 = 1 then (page // 3 + 1) || '.2.' || page || ' T' || page || chr(10) || text else text end as body from lines),
    o as (select *, coalesce(sum(length(body) + 1) over (partition by source_id order by page rows between unbounded preceding and 1 preceding), 0) as start from t),
    hd as (select source_id, (page // 3 + 1) || '.2.' || page as number, 'T' || page as title, start as a from o where page % 3 = 1),
    sp as (select *, coalesce(lead(a) over (partition by source_id order by a), (select sum(length(body) + 1) from t where t.source_id = hd.source_id)) as b from hd),
    cut as (select sp.source_id, number, title, o.page, trim(substring(body || chr(10), cast(greatest(a - start, 0) as integer) + 1, cast(least(start + length(body) + 1, b) - greatest(start, a) as integer)), {_BLANKS}) as piece from sp join o on o.source_id = sp.source_id and start < b and start + length(body) + 1 > a)
    select source_id, number, title, count(*) as n_spans, md5(string_agg(piece, '|' order by page)) as digest from cut group by all""")
def catalog_packets(spark: SparkSession, d: str) -> DataFrame:
    """Procedures across pages: a heading's span reaches to the next heading."""
    head = F.concat((F.floor(F.col("page") / 3) + 1).cast("string"), F.lit(".2."), F.col("page").cast("string"), F.lit(" T"), F.col("page").cast("string"), F.lit("\n"), "text")
    pages = _lines(spark, d).select("source_id", "page", F.when(F.col("page") % 3 == 1, head).otherwise(F.col("text")).alias("text"))
    out = catalog.packets(pages)
    return out.select("source_id", "number", "title", F.size("spans").cast("long").alias("n_spans"), F.md5(F.array_join(F.transform("spans", lambda s: s["text"]), "|").cast("binary")).alias("digest"))


@query(f"""with {_LINES}, t as (select source_id, page, case when page % 3 = 1 then '1.5.' || (page % 9) || ' T' || page || chr(10) || text else text end as body from lines),
    o as (select *, coalesce(sum(length(body) + 1) over (partition by source_id order by page rows between unbounded preceding and 1 preceding), 0) as start from t),
    hd as (select source_id, '1.5.' || (page % 9) as number, 'T' || page as title, start as a from o where page % 3 = 1),
    sp as (select *, coalesce(lead(a) over (partition by source_id order by a), (select sum(length(body) + 1) from t where t.source_id = hd.source_id)) as b from hd),
    cut as (select sp.source_id, number, title, o.page, trim(substring(body || chr(10), cast(greatest(a - start, 0) as integer) + 1, cast(least(start + length(body) + 1, b) - greatest(start, a) as integer)), {_BLANKS}) as piece from sp join o on o.source_id = sp.source_id and start < b and start + length(body) + 1 > a)
    select 'procedure-' || left(cast(source_id as varchar), 8) || '-' || replace(number, '.', '-') as packet_id, title, string_agg(page, ',' order by page) as pages, md5(string_agg(piece, '|' order by page)) as digest from cut where number in ('1.5.2', '1.5.3', '1.5.4', '1.5.5', '1.5.6', '1.5.7') group by source_id, number, title""")
def catalog_procedures(spark: SparkSession, d: str) -> DataFrame:
    """Packets of the exported procedures alone; a span still ends at the next heading, exported or not."""
    head = F.concat(F.lit("1.5."), (F.col("page") % 9).cast("string"), F.lit(" T"), F.col("page").cast("string"), F.lit("\n"), "text")
    pages = _lines(spark, d).select("source_id", "page", F.when(F.col("page") % 3 == 1, head).otherwise(F.col("text")).alias("text"))
    out = catalog.procedures(pages)
    return out.select("packet_id", "title", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.md5(F.array_join(F.transform("spans", lambda s: s["text"]), "|").cast("binary")).alias("digest"))


@query("""with p as (select p_partkey as k, ['a/公共数据管理标准/x', 'a/主数据管理/x', 'a/核算模块/x', 'a/预算模块/x', 'a/内部交易模块/x', 'a/油气销售/x', 'a/物资管理/x', 'a/科技项目/x', 'a/设备管理/x'][case when p_partkey % 9 = 8 and p_partkey % 5 <> 0 and p_partkey % 7 <> 0 then 1 else cast(p_partkey % 9 as integer) + 1 end] as path, case when p_partkey % 5 = 0 then '财务模块常见问题.pdf' when p_partkey % 7 = 0 then '设备管理操作手册.pdf' else 'n.pdf' end as name, cast(p_partkey % 60 as integer) as page from part)
    select k, case when name = '财务模块常见问题.pdf' then case when page in (16, 17) then 'projects' when page = 18 then 'equipment' when page = 9 or (page >= 50 and page <= 55) then 'internal' when page >= 27 and page <= 48 then 'funds' else 'finance' end
            when path like '%公共数据管理标准/%' then 'master_rules' when path like '%/主数据管理/%' then 'master_ops' when path like '%/核算模块/%' then 'finance' when path like '%/预算模块/%' then 'funds' when path like '%/内部交易模块/%' then 'internal' when path like '%/油气销售/%' then 'oilgas' when path like '%/物资管理/%' then 'procurement' when name like '%设备管理操作手册%' then 'equipment' when path like '%科技项目%' then 'projects' end as by_page,
        case when path like '%公共数据管理标准/%' then 'master_rules' when path like '%/主数据管理/%' then 'master_ops' when path like '%/核算模块/%' or name = '财务模块常见问题.pdf' then 'finance' when path like '%/预算模块/%' then 'funds' when path like '%/内部交易模块/%' then 'internal' when path like '%/油气销售/%' then 'oilgas' when path like '%/物资管理/%' then 'procurement' when path like '%设备管理%' or name like '%设备管理%' then 'equipment' when path like '%科技项目%' then 'projects' end as by_path from p""")
def corpus_classify_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules for pages of the corpus and those for uploaded files; the last path fits the corpus only by the file's name."""
    parts = ("a/公共数据管理标准/x", "a/主数据管理/x", "a/核算模块/x", "a/预算模块/x", "a/内部交易模块/x", "a/油气销售/x", "a/物资管理/x", "a/科技项目/x", "a/设备管理/x")
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "财务模块常见问题.pdf").when(k % 7 == 0, "设备管理操作手册.pdf").otherwise("n.pdf")
    at = F.when((k % 9 == 8) & (k % 5 != 0) & (k % 7 != 0), 1).otherwise(k % 9 + 1)
    rows = table(spark, d, "part").select(k.alias("k"), F.element_at(F.array(*map(F.lit, parts)), at.cast("int")).alias("path"), name.alias("name"), (k % 60).cast("int").alias("page"))
    return rows.select("k", metadata.classify_page(F.col("path"), F.col("name"), F.col("page")).alias("by_page"), metadata.classify_path(F.col("path"), F.col("name")).alias("by_path"))


@query("select doc_id as source_id, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) as page, len(string_split(coalesce(text, ''), chr(10))) as total_pages from documents where lang <> 'de' or lang is null")
def corpus_page_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A task for each page of every source that can be read."""
    src = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("h").alias("sha256"), F.lit("p").alias("path"), F.lit("n").alias("name"), F.size(F.split(text.text_of("text"), "\n")).alias("pages"), F.when(F.col("lang") == "de", "error").otherwise("ok").alias("status"))
    return inventory.page_tasks(src).select("source_id", F.col("page").cast("long").alias("page"), F.col("total_pages").cast("long").alias("total_pages"))


@query(f"""with {_LINES}, t as (select source_id, page, 's' || (page % 3) as sig from lines), r as (select source_id, page, case when page % 5 = 0 then 'failed' else 'complete' end as status, 's' || (source_id % 3) as sig from lines where source_id % 2 = 0)
    select t.source_id, t.page, coalesce(r.status = 'complete' and r.sig = t.sig, false) as reuse from t left join r on r.source_id = t.source_id and r.page = t.page""")
def corpus_reusable(spark: SparkSession, d: str) -> DataFrame:
    """Results of the same run are used again."""
    rows = _lines(spark, d)
    sig = lambda c: F.concat(F.lit("s"), (F.col(c) % 3).cast("string")).alias("run_signature")
    done = rows.filter("source_id % 2 = 0").select("source_id", "page", F.when(F.col("page") % 5 == 0, "failed").otherwise("complete").alias("status"), sig("source_id"))
    return inventory.reusable(rows.select("source_id", "page", sig("page")), done, ["source_id", "page"]).select("source_id", "page", "reuse")


@query("""with recursive g as (select coalesce(source, '-') as id, count(*) as size from documents group by all), o as (select *, row_number() over (order by size desc, id) as no from g),
    r as (select 0::bigint as no, ''::varchar as id, 0::bigint as size, 0 as shard, [0, 0, 0, 0]::bigint[] as loads
        union all select o.no, o.id, o.size, list_position(r.loads, list_min(r.loads)) - 1, list_transform(r.loads, lambda x, i: case when i = list_position(r.loads, list_min(r.loads)) then x + o.size else x end) from r join o on o.no = r.no + 1)
    select id, size, cast(shard as integer) as shard from r where no > 0""")
def corpus_shards(spark: SparkSession, d: str) -> DataFrame:
    """Longest first to the shard that has least."""
    groups = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("-")).alias("source")).count()
    return inventory.shards(groups, "source", "count")


@query(f"""with {_LINES}, x as (select source_id, page, text as a, 'E' || page || '，' || text as b from lines)
    select source_id, page, coalesce(case when regexp_matches(a, '^[0-9]+(\\.[0-9]+)*[.、[:space:]]') then regexp_extract(a, '^([0-9]+(?:\\.[0-9]+)*)', 1) end, '') as number, [20.0, page * 1.0, 60.0, page + 30.0][2] as mid from x""")
def text_heading_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers at the start of lines, and the box of a polygon."""
    rows = _lines(spark, d)
    poly = F.array(*[F.array(F.lit(x), F.col("page") + F.lit(y)) for x, y in ((20.0, 30.0), (60.0, 0.0), (40.0, 10.0))])
    return rows.select("source_id", "page", text.heading_number(F.col("text")).alias("number"), geometry.polygon_box(poly)[1].alias("mid"))
