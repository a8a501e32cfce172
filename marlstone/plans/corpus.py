"""Corpus and catalogue queries: documents as sources, their lines as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds, geometry, text
from ..operators import audit, catalog, corpus, inventory, metrics
from .base import query, table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """source_id, page, text: every line of a document as a page."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split(text.text_of("text"), "\n")).alias("i", "text")).select("source_id", (F.col("i") + 1).alias("page"), "text")


_LINES = "lines as (select doc_id as source_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as page from documents)"


@query("select count(doc_id) as file_count, cast(sum(n_chars) as bigint) as total_bytes, count(distinct sha256(text)) as unique_contents, count(doc_id) = count(distinct sha256(text)) as all_unique from documents")
def corpus_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    return inventory.summary(docs, "doc_id", "n_chars", "sha")


@query("select doc_id, case when first <> doc_id then first end as same_as from (select doc_id, min(doc_id) over (partition by sha256(text)) as first from documents)")
def corpus_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return inventory.duplicates(docs, "sha", "doc_id").select("doc_id", "same_as")


_AUTO = "case when lang = 'de' then 'finance' when source in ('src1', 'src2') then 'projects' when source like 'src1_' then 'funds' end"


def _auto() -> F.Column:
    return F.when(F.col("lang") == "de", "finance").when(F.col("source").isin("src1", "src2"), "projects").when(F.col("source").rlike("^src1.$"), "funds")


@query(f"select doc_id, {_AUTO} as domain, case when {_AUTO} is null then 'needs_review' else 'automatic' end as status from documents")
def corpus_classify(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "doc_id long, domain string")
    return inventory.with_overrides(table(spark, d, "documents").select("doc_id", "lang", "source"), none, "doc_id", _auto()).select("doc_id", "domain", "status")


@query(f"""select d.doc_id, coalesce(case when l.quality = 1 then 'equipment' end, {_AUTO}) as domain, case when l.quality = 1 then 'confirmed' when {_AUTO} is null then 'needs_review' else 'automatic' end as status
    from documents d left join labels l on d.doc_id = l.doc_id""")
def corpus_classify_override(spark: SparkSession, d: str) -> DataFrame:
    confirmed = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit("equipment").alias("domain"))
    return inventory.with_overrides(table(spark, d, "documents").select("doc_id", "lang", "source"), confirmed, "doc_id", _auto()).select("doc_id", "domain", "status")


_PAGES = f"""{_LINES}, p as (select source_id, page, trim(text) as title from lines where trim(text, E' \\t\\n\\x0b\\x0c\\r') <> '' and not regexp_full_match(trim(text), '[0-9\\s.,，、:：;；\\-—_()/（）]+')),
    b as (
        select source_id, page, substring(title, 1, 120) as title from (select source_id, page, title, lag(title) over (partition by source_id order by page) as before from p) where page > 1 and (before is null or before <> title)
        union all select distinct source_id, 1, '资料说明与适用范围' from lines
    )"""


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.repeated_title_boundaries(_lines(spark, d))


@query(f"with {_PAGES} select source_id, page, title from b")
def corpus_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Slide decks: a section starts where the title (here a line) changes; titles are compared whole and shown up to 120 characters."""
    return _bounds(spark, d).select("source_id", "page", "title")


@query(f"""with {_PAGES}, n as (select source_id, max(page) as pages from lines group by all),
    s as (select b.source_id, row_number() over w as section_index, b.page, coalesce(lead(b.page) over w, n.pages + 1) as stop from b join n using (source_id) window w as (partition by b.source_id order by b.page))
    select s.source_id, cast(section_index as integer) as section_index, count(*) as n_pages, min(l.page) as first_page, max(l.page) as last_page from s join lines l on l.source_id = s.source_id and l.page >= s.page and l.page < s.stop group by all""")
def corpus_sections_range_join(spark: SparkSession, d: str) -> DataFrame:
    sizes = _lines(spark, d).groupBy("source_id").agg(F.max("page").alias("pages")).withColumn("height", F.lit(100.0))
    cut = corpus.sections(_bounds(spark, d), sizes)
    return cut.groupBy("source_id", "section_index").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("""with x as (select l_orderkey as source_id, l_linenumber as page, l_quantity as y0, l_quantity + l_tax * 100 as y1 from lineitem),
    s as (select source_id, page, band, band * 20.0 as top, band * 20.0 + 20.0 as bottom from (select distinct source_id, page from x), range(0, 3) t(band))
    select s.source_id, s.page, cast(s.band as integer) as band, count(*) as n from s join x on s.source_id = x.source_id and s.page = x.page and (y0 + y1) / 2 >= top and (y0 + y1) / 2 < bottom group by all""")
def corpus_regions_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """Boxes go to the band that holds their middle."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page"), F.array(F.lit(0.0), F.col("l_quantity"), F.lit(1.0), F.col("l_quantity") + F.col("l_tax") * 100).alias("bbox"))
    bands = x.select("source_id", "page").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"top": F.col("band") * 20.0, "bottom": F.col("band") * 20.0 + 20.0})
    return corpus.place_boxes(bands, x).groupBy("source_id", "page", "band").agg(F.count("*").alias("n"))


@query("""with recursive i as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
    f as (
        select doc_id, pos, 1 as grp, length(line) as size, 1 as n, length(line) as len from i where pos = 1
        union all
        select i.doc_id, i.pos, case when f.size + length(i.line) <= 600 and f.n + 1 <= 10 then f.grp else f.grp + 1 end, case when f.size + length(i.line) <= 600 and f.n + 1 <= 10 then f.size + length(i.line) else length(i.line) end,
            case when f.size + length(i.line) <= 600 and f.n + 1 <= 10 then f.n + 1 else 1 end, length(i.line) from f join i on i.doc_id = f.doc_id and i.pos = f.pos + 1
    )
    select doc_id, grp as "group", count(*) as n_lines, cast(sum(len) as bigint) as n_chars from f group by all""")
def corpus_chunks_packed(spark: SparkSession, d: str) -> DataFrame:
    """Lines packed into groups of at most 600 characters and ten lines."""
    docs = table(spark, d, "documents").select("doc_id", F.split(text.text_of("text"), "\n").alias("ls"))
    groups = folds.pack_groups(F.transform("ls", lambda x: F.struct(F.length(x).cast("long").alias("size"), F.lit(1).cast("long").alias("count"))), 600, 10)
    rows = docs.select("doc_id", F.explode(F.arrays_zip("ls", groups.alias("g"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.g").alias("group")).agg(F.count("*").alias("n_lines"), F.sum(F.length("x.ls")).alias("n_chars"))


@query("""select d.source, count(*) as pages, count(l.doc_id) as complete, count(*) > count(l.doc_id) as pending from documents d left join labels l on d.doc_id = l.doc_id and l.quality = 1 group by all""")
def corpus_pending_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source is pending while one of its pages is not complete."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"), F.lit("x").alias("sha256"))
    done = docs.join(table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("page")), "page").withColumn("status", F.lit("complete"))
    sources = docs.groupBy("source_id", "sha256").agg(F.count("*").alias("pages"))
    built = corpus.build_status(sources, done)
    n = done.groupBy("source_id").agg(F.count("*").alias("complete"))
    return built.join(n, "source_id", "left").select(F.col("source_id").alias("source"), "pages", F.coalesce("complete", F.lit(0)).alias("complete"), (~F.col("built")).alias("pending"))


@query(f"""with {_LINES}, c as (select source_id, page // 4 as section_index, page, text from lines)
    select source_id, section_index, array_to_string(list_sort(list(distinct page)), ',') as pages, count(*) as n_chunks from c where trim(text, E' \\t\\n\\x0b\\x0c\\r') <> '' and regexp_matches(text, '[A-Za-zÀ-ÿ]') group by all""")
def catalog_outline(spark: SparkSession, d: str) -> DataFrame:
    chunks = _lines(spark, d).filter(F.col("text").rlike("[A-Za-zÀ-ÿ]")).select("source_id", F.floor(F.col("page") / 4).alias("section_index"), F.array("page").alias("pages"), F.col("text").alias("title"), F.format_string("c%06d", "page").alias("chunk_id"))
    out = catalog.outline(chunks)
    return out.select("source_id", "section_index", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.size("chunk_ids").cast("long").alias("n_chunks"))


@query("""with p as (select distinct o_custkey as k, o_orderkey // 8 as page from orders), i as (select k, page, page - row_number() over (partition by k order by page) as g from p)
    select k as custkey, min(page) as first_page, max(page) as last_page from i group by k, g""")
def catalog_page_runs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.floor(F.col("o_orderkey") / 8).alias("page"))
    return catalog.page_runs(pages, "custkey")


@query("""with g as (select md5(text) as q, list(doc_id order by doc_id) as ids, list(source order by doc_id) as ss, list(lang order by doc_id) as ls from documents group by all)
    select ids[1] as card_id, len(ids) as n_sources, case when len(ids) > 1 then len(ids) else 0 end as n_branches, case when len(ids) > 1 then array_to_string(list_transform(range(1, len(ids) + 1), lambda i: '原文第 ' || ids[i] || ' 页的情形：' || chr(10) || ss[i]), chr(10) || chr(10)) else ss[1] end as answer, array_to_string(flatten(list_transform(range(1, len(ids) + 1), lambda i: [ls[i], ss[i]])), ',') as images from g""")
def catalog_cards_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("question"), F.col("doc_id").alias("page"), F.col("doc_id").alias("card_id"), F.col("source").alias("answer"), F.col("source").alias("source"), F.array(F.lit("f")).alias("flags"), F.col("lang").alias("evidence"), F.array("lang", "source").alias("images"))
    out = catalog.merge_cards(rows)
    return out.select("card_id", F.size("sources").cast("long").alias("n_sources"), F.size("branches").cast("long").alias("n_branches"), "answer", F.array_join("images", ",").alias("images"))


@query("""with recursive i as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as pos from documents),
    f as (
        select source, pos, doc_id, n_chars <= 10000 as ok, case when n_chars <= 10000 then n_chars else 0 end as total from i where pos = 1
        union all select i.source, i.pos, i.doc_id, f.total + i.n_chars <= 10000, case when f.total + i.n_chars <= 10000 then f.total + i.n_chars else f.total end from f join i on i.source = f.source and i.pos = f.pos + 1
    )
    select source, array_to_string(list(doc_id order by pos) filter (where ok), ',') as kept, bool_and(ok) as complete from f group by all""")
def catalog_overview_budget(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"), F.col("doc_id").cast("string").alias("block"))
    return catalog.overview(blocks).select(F.col("source_id").alias("source"), F.array_join("kept", ",").alias("kept"), "complete")


@query("""select user_id, count(*) as n, round(avg(value), 6) as mean, count(*) filter (where value < 20) as low, round(count(*) filter (where value < 20) / count(*), 6) as low_share,
    list_sort(list(value))[cast(least(floor(count(*) * 0.1), count(*) - 1) as bigint) + 1] as p10, list_sort(list(value))[cast(least(floor(count(*) * 0.9), count(*) - 1) as bigint) + 1] as p90 from events where value is not null group by all""")
def metrics_confidence(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.confidence(table(spark, d, "events").filter("value is not null"), ["user_id"], "value", 20)
    return out.select("user_id", "n", F.round("mean", 6).alias("mean"), "low", F.round("low_share", 6).alias("low_share"), "p10", "p90")


@query("select event_type, count(*) as n, round(count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 60), 6) as per_minute, median(value) as median_value from events group by all")
def metrics_throughput(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), metrics.median("value").alias("median_value"))
    as_ts = lambda c: F.col(c).cast("timestamp")
    return rows.select("event_type", "n", F.round(metrics.throughput(F.col("n"), as_ts("a"), as_ts("b")), 6).alias("per_minute"), "median_value")


@query("select source as top, count(*) as n from documents group by all order by n desc, top limit 8")
def metrics_group_top8(spark: SparkSession, d: str) -> DataFrame:
    return inventory.top_groups(table(spark, d, "documents"), "source")


@query("""with w as (select distinct l_orderkey as k, l_linenumber as page from lineitem), h as (select distinct l_orderkey as k, l_linenumber as page from lineitem where l_returnflag <> 'R')
    select w.k as orderkey, count(*) as expected, count(*) filter (where h.k is null) as missing from w left join h on w.k = h.k and w.page = h.page group by all""")
def audit_page_coverage(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return audit.coverage(items, items.filter("l_returnflag <> 'R'"), "orderkey", "page")


@query("""with r as (select d.doc_id, d.n_chars, length(d.text) as len, l.quality, e.vec_id from documents d left join labels l on d.doc_id = l.doc_id left join embeddings e on e.vec_id = d.doc_id)
    select doc_id as key, 'too_long' as error from r where not coalesce(n_chars <= 10000, false) union all select doc_id, 'length_differs' from r where not coalesce(n_chars = len, false)
    union all select doc_id, 'not_reviewed' from r where not coalesce(quality = 1, false) union all select doc_id, 'no_vector' from r where vec_id is null""")
def audit_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("len"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    return audit.violations(rows, "doc_id", {"too_long": F.col("n_chars") <= 10_000, "length_differs": F.col("n_chars") == F.col("len"), "not_reviewed": F.col("quality") == 1, "no_vector": F.col("vec_id").isNotNull()})


@query("select l_orderkey as orderkey, l_linenumber as line, case when l_quantity - 10 < 30 and l_tax < 0.05 then 'kept' else 'empty' end as box from lineitem")
def corpus_box_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Boxes are cut to the page; those that are outside are gone."""
    box = geometry.clamp_box(F.col("l_quantity") - 10, F.col("l_tax"), F.lit(30.0), F.lit(0.05), F.lit(100.0), F.lit(200.0))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.when(box.isNotNull(), "kept").otherwise("empty").alias("box"))
