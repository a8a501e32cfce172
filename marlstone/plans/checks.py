"""Queries of audits, evaluations, metadata rules, exports, workflow graphs and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import audit, catalog, corpus, evaluation, graph, inventory, metadata, metrics, retrieval, sync
from ..operators.scratch import stash
from ..operators.sizing import broadcast_if_small
from ..sources import reports, sinks
from . import sql
from .base import query, table
from .corpus import _LINES, _lines
from .retrieval import ASKS, DOC_TEXTS, _lexical, _order, asks


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cards: issues, flags and reviews by number."""
    k = F.col("p_partkey")
    some = lambda n, name: F.when(k % n == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(k.alias("card_id"), some(3, "issue").alias("validation_issues"), some(5, "flag").alias("review_flags"), F.when(k % 2 == 0, "approved").otherwise("pending").alias("business_review"), F.col("p_name").alias("text"))


@query("select p_partkey as card_id, p_partkey % 3 <> 0 and p_partkey % 5 <> 0 and p_partkey % 2 = 0 as included, case when p_partkey % 3 = 0 then 'issue' else '' end as issues, case when p_partkey % 5 = 0 then 'flag' else '' end as flags, case when p_partkey % 2 = 0 then 'approved' else 'pending' end as review from part")
def export_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which cards are exported, and what kept the others out."""
    out = sinks.export_decisions(_flags(spark, d))
    return out.select("card_id", "included", F.array_join("validation_issues", ",").alias("issues"), F.array_join("review_flags", ",").alias("flags"), F.col("business_review").alias("review"))


@query("select 'pilot_only' as usage, count(*) filter (where p_partkey % 3 <> 0 and p_partkey % 5 <> 0) as count, count(*) filter (where p_partkey % 3 = 0 or p_partkey % 5 = 0) as excluded, max(length(p_name)) filter (where p_partkey % 3 <> 0 and p_partkey % 5 <> 0) as max_card_chars from part")
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    return sinks.export_summary(_flags(spark, d), "text", drafts=True)


@query("""select doc_id from documents where lang = 'en' and source <> 'src1' and contains(source, 'src1') and length(coalesce(text, '')) > 0""")
def filter_metadata_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A list of conditions that a document's metadata meets all."""
    ask = lambda n, op, v="": {"name": n, "comparison_operator": op, "value": v}
    hits = metadata.predicate([ask("lang", "is", "en"), ask("source", "is not", "src1"), ask("source", "contains", "src1"), ask("lang", "contains", ""), ask("text", "not empty")])
    return table(spark, d, "documents").filter(hits).select("doc_id")


@query("""select doc_id, lang in ('en', 'fr') and starts_with(source, 'src1') and doc_id % 3 = 0 as inside, doc_id % 4 <> 0 as live from documents""")
def filter_scope(spark: SparkSession, d: str) -> DataFrame:
    """The scope of a search, and documents that are not retired."""
    kind = F.when(F.col("doc_id") % 3 == 0, "detail").otherwise("overview")
    docs = table(spark, d, "documents").select("doc_id", F.array("lang").alias("domains"), kind.alias("kind"), F.lit("s").alias("source_id"), F.col("source").alias("section_title"), F.when(F.col("doc_id") % 4 == 0, "retired").when(F.col("doc_id") % 4 == 1, "unconfirmed").alias("state"))
    return docs.select("doc_id", retrieval.scope(["en", "fr"], "s", "detail", "src1").alias("inside"), retrieval.not_retired(F.col("state")).alias("live"))


@query("select p_partkey as k, p_type not like '%STANDARD%' and length(trim(p_name)) between 1 and 50 as valid from part")
def filter_category_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that files can have: without a slash, a reserved name, or a dot at the end."""
    name = F.when(F.col("p_type").contains("STANDARD") & (F.col("p_partkey") % 3 == 0), F.concat("p_name", F.lit("."))).when(F.col("p_type").contains("STANDARD") & (F.col("p_partkey") % 3 == 1), "Con.txt").when(F.col("p_type").contains("STANDARD"), F.concat(F.lit("a/"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), metadata.valid_category_name(name).alias("valid"))


@query("""select page_id, case page_id % 5 when 0 then 'dir/' || page_id || '.pdf' when 1 then 'dir/' || page_id || '.PDF' end as relative, case when page_id % 2 = 0 then 'upload:up:' || lower('Dir/' || page_id) else lower('C:/Dir/' || page_id) end as identity from pages""")
def filter_upload_paths(spark: SparkSession, d: str) -> DataFrame:
    """Upload paths that stay below their folder, and the key of a source across scans."""
    k = F.col("page_id")
    n = k.cast("string")
    path = F.when(k % 5 == 0, F.concat(F.lit("dir\\"), n, F.lit(".pdf"))).when(k % 5 == 1, F.concat(F.lit("dir/"), n, F.lit(".PDF"))).when(k % 5 == 2, F.concat(F.lit("../"), n, F.lit(".pdf"))).when(k % 5 == 3, F.concat(F.lit("C:\\"), n, F.lit(".pdf"))).otherwise(F.concat(F.lit("dir/"), n, F.lit(".txt")))
    identity = text.source_identity(F.concat(F.lit("C:\\Dir\\"), n), F.when(k % 2 == 0, "UP"), F.concat(F.lit("Dir\\"), n))
    return table(spark, d, "pages").select("page_id", text.safe_relative(path).alias("relative"), identity.alias("identity"))


_CHECKED = "select l_orderkey || '-' || l_linenumber as key, l_quantity as q, l_linenumber as n, l_returnflag as f from lineitem"


@query(f"""with x as ({_CHECKED}) select key, unnest(list_filter([case when f = 'R' then 'stale_source' end, case when n = 6 then 'stale_version' end, case when n = 5 then 'missing_file' end, case when n <> 5 and q > 45 then 'file_too_large' end, case when q < 3 then 'image_count_differs' end, case when f = 'A' and n = 1 then 'source_name_missing' end, case when q > 40 then 'too_many_images' end, case when n = 2 and q > 30 then 'image_too_large' end], lambda e: e is not null)) as error from x""")
def audit_corpus_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each export row: one row for every check that it fails."""
    q, n, f = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_returnflag")
    big = F.lit(audit.MAX_FILE_BYTES)
    images = F.when(q > 40, audit.MAX_IMAGES + 1).otherwise(3)
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("key"),
        F.lit("a").alias("sha256"),
        F.when(f == "R", "b").otherwise("a").alias("source_sha256"),
        (n != 6).alias("version_ok"),
        F.when(n != 5, F.when(q > 45, big + 1).otherwise(big)).alias("file_bytes"),
        images.alias("image_count"),
        (images + F.when(q < 3, 1).otherwise(0)).alias("shown_images"),
        (~((f == "A") & (n == 1))).alias("name_shown"),
        F.when((n == 2) & (q > 30), audit.MAX_IMAGE_BYTES).otherwise(audit.MAX_IMAGE_BYTES - 1).alias("largest_image"),
    )
    return audit.violations(rows, "key", audit.corpus_checks())


@query(f"""with x as ({_CHECKED}) select key, unnest(list_filter([case when f = 'R' then 'hash_differs' end, case when n = 6 or q > 45 then 'not_completed' end, case when n = 5 then 'metadata_differs' end, case when q < 3 then 'page_not_mentioned' end, case when n = 2 then 'image_count_differs' end, case when f = 'A' and n = 1 then 'anchor_differs' end, case when q > 40 then 'parents_not_one' end], lambda e: e is not null)) as error from x""")
def audit_remote_checks(spark: SparkSession, d: str) -> DataFrame:
    """What differs between each remote document and its manifest row."""
    q, n, f = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("key"),
        F.lit("h").alias("hash"),
        F.when(f == "R", "x").otherwise("h").alias("content_hash"),
        F.when(n == 6, "waiting").otherwise("completed").alias("status"),
        (q <= 45).alias("enabled"),
        F.lit("m").alias("metadata"),
        F.when(n != 5, "m").alias("remote_metadata"),
        F.array(F.lit(1), F.lit(2)).alias("pages"),
        F.when(q < 3, "来源：f，PDF 第1页").otherwise("来源：f，PDF 第1页\nPDF 第2页").alias("content"),
        F.lit(1).alias("image_count"),
        F.when(n == 2, 2).otherwise(1).alias("remote_images"),
        F.when(~((f == "A") & (n == 1)), "a").alias("remote_anchor"),
        F.lit("a").alias("anchor"),
        F.when(q > 40, 2).otherwise(1).alias("parents"),
    )
    return audit.violations(rows, "key", audit.remote_checks())


@query("select s_nationkey as nation, bool_and(s_acctbal > 0 and s_suppkey % 7 <> 0) as ready from supplier group by all")
def audit_all_pass(spark: SparkSession, d: str) -> DataFrame:
    """A setting is ready if all of its rows pass all checks."""
    rows = table(spark, d, "supplier").withColumn("ok", F.when(F.col("s_suppkey") % 7 != 0, F.lit(True)))
    return audit.all_pass(rows, "s_nationkey", [F.col("s_acctbal") > 0, F.col("ok")]).withColumnRenamed("s_nationkey", "nation")


@query("""with m as (select 'f' || s_suppkey as path, s_suppkey as bytes, 'h' as sha256 from supplier where s_suppkey % 10 <> 1), f as (select 'f' || s_suppkey as path, s_suppkey + case when s_suppkey % 10 = 3 then 1 else 0 end as bytes, case when s_suppkey % 10 = 4 then 'x' else 'h' end as sha256 from supplier where s_suppkey % 10 <> 2)
    select coalesce(m.path, f.path) as path, case when f.path is null then 'missing' when m.path is null then 'unlisted' when m.bytes <> f.bytes then 'size' else 'content' end as error from m full join f on m.path = f.path where m.path is null or f.path is null or m.bytes <> f.bytes or m.sha256 <> f.sha256""")
def audit_bundle_differences(spark: SparkSession, d: str) -> DataFrame:
    """A bundle against its manifest: missing, unlisted, of other size or content."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("k"), F.concat(F.lit("f"), k.cast("string")).alias("path"))
    m = rows.filter("k % 10 <> 1").select("path", F.col("k").alias("bytes"), F.lit("h").alias("sha256"))
    f = rows.filter("k % 10 <> 2").select("path", (F.col("k") + F.when(F.col("k") % 10 == 3, 1).otherwise(0)).alias("bytes"), F.when(F.col("k") % 10 == 4, "x").otherwise("h").alias("sha256"))
    return audit.differences(m, f)


@query("select n_regionkey as region, n_name as name from nation where (n_regionkey, substring(n_name, 1, 1)) in (select n_regionkey, substring(n_name, 1, 1) from nation group by all having count(*) > 1)")
def audit_ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that several remote documents of a set have."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.concat_ws("/", F.col("n_regionkey").cast("string"), F.substring("n_name", 1, 1)).alias("short"))
    return n.join(sync.ambiguous(n, "short").select("short"), "short", "left_semi").select("region", "name")


@query("""with e as (select l_orderkey as chunk, count(*) as n, count(*) filter (where l_quantity > 45) as big from lineitem group by all)
    select 'c' || chunk as chunk_id, 'too many images' as error from e where n > 5 union all select 'c' || chunk, 'image too large' from e, range(0, big) t""")
def audit_image_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with too many pictures, and pictures that are too large."""
    images = table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("chunk_id"), F.col("l_linenumber").cast("string").alias("image_id"), F.when(F.col("l_quantity") > 45, 2 * 1024 * 1024).otherwise(2 * 1024 * 1024 - 1).alias("bytes"))
    return reports.image_bundle_errors(images, per_chunk=5)


@query("""with f as (select distinct user_id, event_type || '-' || (event_id % 3) as name from events where event_type = 'error' or event_type = 'view'),
    r as (select *, row_number() over (partition by user_id order by name) as i from f), n as (select user_id, count(*) as n from events where event_type = 'error' or event_type = 'view' group by all)
    select user_id as job, string_agg(name, '、' order by name) filter (where i <= 5) as names, n from r join n using (user_id) group by user_id, n""")
def audit_error_names(spark: SparkSession, d: str) -> DataFrame:
    """The first five names that failed in each job, and how many failed."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin("error", "view")).select(F.col("user_id").alias("job"), F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string")).alias("name"))
    return reports.error_names(rows, "job", "name")


@query("""with f as (select source as folder, sha256(source || '/' || doc_id || chr(31) || sha256(coalesce(text, ''))) as line from documents), g as (select sha256(string_agg(line, '' order by line)) as f, folder || '/' as d from f group by folder)
    select sha256(string_agg(d || chr(31) || f, '' order by d || chr(31) || f)) as fingerprint from g""")
def metrics_tree_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of a file tree that no order of rows changes."""
    rows = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(text.text_of("text"), 256).alias("sha"))
    return metrics.tree_fingerprint(rows, "path", "sha")


@query("select cast(sum(l_linenumber) as bigint) as done, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as skipped, count(*) filter (where l_quantity > 49) as failures from lineitem")
def metrics_merge_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of workers added up, with all their failures."""
    none = F.array().cast("array<string>")
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("done"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("skipped"), F.when(F.col("l_quantity") > 49, F.array(F.lit("x"))).otherwise(none).alias("failures"))
    out = metrics.merge_reports(rows)
    return out.select("done", "skipped", F.col("failed").alias("failures"))


@query("select event_type, count(*) filter (where value < 60) as low, count(*) filter (where value < 75) as under from events group by all")
def metrics_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Recognised lines below a score, per picture added up."""
    lines = F.array(F.struct(F.lit("x").alias("text"), (F.col("value") / 100).alias("score")))
    rows = table(spark, d, "events").select("event_type", geometry.low_confidence(lines, 0.6).alias("low"), geometry.low_confidence(lines).alias("under"))
    return rows.groupBy("event_type").agg(F.sum("low").alias("low"), F.sum("under").alias("under"))


_TOP = f"{sql.bm25(DOC_TEXTS, ASKS)}, {sql.ranked('bm25', 'top', 6)}"


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The six best documents of every item, with the source as name and the text as content."""
    top = retrieval.rank(_lexical(spark, d, 6), ["query_id"], 6, _order())
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("content"), F.col("lang").alias("section_title"))
    # six rows a query
    return broadcast_if_small(stash(top.select("query_id", "doc_id", "rank"), "top")).join(docs, "doc_id")


@query(f"""with {_TOP}, h as (select qid, min(r) as first_rank from top join documents d on d.doc_id = top.id where contains(d.source, 'src' || (qid % 10)) or contains(d.source, 'src1' || (qid % 3)) group by all)
    select item_id as query_id, cast(first_rank as integer) as first_rank, coalesce(first_rank <= 6, false) as hit from benchmark left join h on h.qid = item_id""")
def eval_source_recall(spark: SparkSession, d: str) -> DataFrame:
    """First result from an expected source, by parts of names."""
    q = F.col("query_id")
    expected = asks(spark, d).select("query_id", F.array(F.concat(F.lit("src"), (q % 10).cast("string")), F.concat(F.lit("src1"), (q % 3).cast("string"))).alias("expected"))
    return evaluation.source_recall(_results(spark, d), expected)


@query(f"""with {_TOP}, c as (select item_id, substring(text, 1, 2) as code, 'src' || (item_id % 3) as key from benchmark)
    select c.item_id as query_id, coalesce(bool_or(contains(d.source, c.key) and contains(d.text, c.code)), false) as passed from c left join top on top.qid = c.item_id left join documents d on d.doc_id = top.id group by all""")
def eval_graded(spark: SparkSession, d: str) -> DataFrame:
    """Whether a result has the right name and all codes of the operation."""
    cases = asks(spark, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 3).cast("string")).alias("key"), F.array(F.substring("query", 1, 2)).alias("codes"))
    return evaluation.graded(_results(spark, d), cases)


@query(f"""with {_TOP} select qid as query_id, id as doc_id from top join documents d on d.doc_id = top.id where starts_with(d.lang, case when qid % 2 = 0 then 'e' else 'fr' end)""")
def eval_isolated(spark: SparkSession, d: str) -> DataFrame:
    """Results in sections that their query forbids."""
    forbidden = asks(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "e").otherwise("fr").alias("forbidden_prefix"))
    return evaluation.isolated(_results(spark, d), forbidden).select("query_id", "doc_id")


@query(f"""with {_TOP}, g as (select qid, list(distinct source) as names from top join documents d on d.doc_id = top.id group by all)
    select qid as query_id, len(list_filter(names, lambda x: x not in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5'))) = 0 as within from g""")
def eval_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether all results of a query come from allowed sources."""
    allowed = F.array(*[F.lit(f"src{i}") for i in range(6)])
    return _results(spark, d).groupBy("query_id").agg(F.collect_set("name").alias("names")).select("query_id", evaluation.within(F.col("names"), allowed).alias("within"))


@query("""with s as (select l_orderkey as q, l_suppkey % 3 = 0 as dev, case when l_linenumber <= 4 then l_linenumber end as hit, l_quantity as ms from lineitem)
    select case when dev then 'dev' else 'holdout' end as split, count(*) as cases, round(avg(case when hit <= 1 then 1.0 else 0.0 end), 6) as hit_at_1, round(avg(case when hit <= 5 then 1.0 else 0.0 end), 6) as hit_at_5, round(avg(coalesce(1.0 / hit, 0)), 6) as mrr_at_5, round(median(ms), 6) as median_ms from s group by all""")
def eval_summary_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates, reciprocal rank and median time of each split."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, "dev").otherwise("holdout").alias("split"), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).alias("hit_rank"), F.col("l_quantity").alias("ms"))
    out = evaluation.summary(rows, ["split"])
    return out.select("split", "cases", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "mrr_at_5", "median_ms")])


@query("""with c as (select p_partkey as card_id, p_size as a, p_size + 1 as b from part), x as (select page, arg_min(card_id, card_id) as card from (select a as page, card_id from c union all select b, card_id from c) group by all)
    select item_id as query_id, card as expected_card_id from benchmark left join x on x.page = item_id""")
def eval_expected_cards(spark: SparkSession, d: str) -> DataFrame:
    """The first card with a source on a case's page."""
    cards = table(spark, d, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_partkey").alias("pos"), F.array("p_size", F.col("p_size") + 1).alias("pages"))
    return evaluation.expected_cards(asks(spark, d).select("query_id", F.col("query_id").alias("page")), cards).select("query_id", "expected_card_id")


@query("select doc_id, contains(coalesce(text, ''), 'th') and contains(coalesce(text, ''), lang) as ok from documents")
def eval_must_contain(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record has every substring that is asked for."""
    docs = table(spark, d, "documents").select("doc_id", text.text_of("text").alias("text"), F.array(F.lit("th"), F.col("lang")).alias("needles"))
    return evaluation.must_contain(docs, "text", "needles").select("doc_id", "ok")


@query("""with a as (select distinct lang as d from documents where lang is not null), n as (select case d when 'en' then 'finance' when 'fr' then 'projects' when 'es' then 'equipment' when 'de' then 'tech' else d end as d from a),
    singles as (select d as route, d as members from n), pairs as (select x || '_' || y as route, x || ',' || y as members from (values ('projects', 'finance'), ('equipment', 'finance'), ('equipment', 'projects'), ('procurement', 'finance'), ('funds', 'finance')) t(x, y) where x in (select d from n) and y in (select d from n))
    select route, members from singles union all select route, members from pairs union all select 'clarify', ''""")
def graph_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the languages' domains: singles, pairs whose members are all there, and the question back."""
    known = {"en": "finance", "fr": "projects", "es": "equipment", "de": "tech"}
    langs = [r["lang"] for r in table(spark, d, "documents").filter("lang is not null").select("lang").distinct().collect()]  # a handful
    return graph.routes(spark, [known.get(x, x) for x in langs]).select("route", F.array_join("members", ",").alias("members"))


@query("select cast(n_nationkey as varchar) as domain, n_name as label from nation where n_nationkey in (select c_nationkey from customer)")
def graph_used_categories(spark: SparkSession, d: str) -> DataFrame:
    """Configured categories that some document has: nations with customers."""
    configured = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("domain"), F.col("n_name").alias("label"))
    return graph.used_categories(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("domain")), configured)


def _flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A flow with a route for every nation; those of the first region choose a section."""
    n = table(spark, d, "nation")
    routes = n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("route"), F.array("n_name").alias("members"))
    scoped = [r["n_name"] for r in n.filter("n_regionkey = 0").select("n_name").collect()]  # a handful
    return graph.localize(*graph.workflow(routes, scoped))


@query("""with b as (select n_name as b, n_regionkey = 0 as c, n_name as r from nation union all select n_name || '-scoped', true, n_name from nation where n_regionkey = 0)
    select 'start' as id, 'start' as kind union all select 'classify', 'classifier' union all select 'clarify-answer', 'answer' union all select 'select-' || n_name, 'select' from nation where n_regionkey = 0
    union all select 'retrieve-' || b, 'http-request' from b union all select 'gate-' || b, 'if-else' from b union all select 'unavailable-' || b, 'answer' from b union all select 'llm-' || b, 'llm' from b union all select 'answer-' || b, 'answer' from b""")
def graph_flow_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a local flow: requests, gates, copies for chosen sections."""
    return _flow(spark, d)[0].select("id", "kind")


@query("""with b as (select n_name as b, n_name as r, n_regionkey = 0 as c, 'all' as h from nation union all select n_name || '-scoped', n_name, true, 'scoped' from nation where n_regionkey = 0)
    select 'start' as source, 'classify' as target, 'source' as handle union all select 'classify', 'clarify-answer', 'clarify' union all select 'classify', 'select-' || n_name, n_name from nation where n_regionkey = 0
    union all select case when c then 'select-' || r else 'classify' end, 'retrieve-' || b, case when c then h else r end from b union all select 'retrieve-' || b, 'gate-' || b, 'source' from b union all select 'gate-' || b, 'llm-' || b, 'ready' from b
    union all select 'gate-' || b, 'unavailable-' || b, 'false' from b union all select 'llm-' || b, 'answer-' || b, 'source' from b""")
def graph_flow_edges(spark: SparkSession, d: str) -> DataFrame:
    return _flow(spark, d)[1]


@query("select 'loose edge' as kind, 'llm-' || n_name as id from nation where n_regionkey = 1 union all select 'out of reach', 'answer-' || n_name from nation where n_regionkey = 1")
def graph_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a flow that lost the answering nodes of a region."""
    nodes, edges = _flow(spark, d)
    lost = table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("llm-"), "n_name").alias("id"))
    return graph.invariants(nodes.join(lost, "id", "left_anti"), edges.join(lost.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target", "handle"))


@query("""select n_name || case when n_nationkey % 3 = 0 then '：given' else '：' || lower(n_name) || '相关业务资料。' end as line from nation""")
def graph_route_options(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a prompt for the routes that can be chosen, those given and those made of labels."""
    n = table(spark, d, "nation")
    routes = n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("route"), F.array("n_name").alias("members"))
    lines = n.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("pos"), F.concat("n_name", F.lit("：given")).alias("line"))
    gone = lines.select((F.col("pos") + 500).alias("pos"), F.lit("NOWHERE：x").alias("line"))
    return graph.route_options(lines.unionByName(gone), routes, n.select(F.col("n_name").alias("route"), F.lower("n_name").alias("label"))).select("line")


@query("""with x as (select doc_id, string_split(coalesce(text, ''), chr(10))[1] as a, lang as b, doc_id % 4 as k from documents)
    select doc_id, case k when 3 then '' else trim(replace('q' || a, chr(10), '')) end as question, case k when 1 then 'second ' || b else b || '。' || chr(10) || '1、x' end as answer, case k when 2 then b else '' end as cause from x""")
def text_faq_fields(spark: SparkSession, d: str) -> DataFrame:
    """Labelled fields in any order: soft breaks closed, breaks after full stops kept, the last of equal labels taken."""
    a, b, k = F.split(text.text_of("text"), "\n")[0], F.col("lang"), F.col("doc_id") % 4
    lit = F.lit
    question = F.when(k == 3, "").otherwise(F.concat(lit("核算常见问题问题描述： q"), a, lit(" \n")))
    answer = F.concat(lit("解决办法:"), b, lit("。\n1、x"), F.when(k == 1, F.concat(lit("\n解决办法 ：second\n "), b)).otherwise(lit("")))
    cause = F.when(k == 2, F.concat(lit("\n问题原因："), b)).otherwise(lit(""))
    fields = text.faq_fields(F.when(k == 0, F.concat(answer, lit("\n"), question)).otherwise(F.concat(question, answer, cause)))
    of = lambda name: F.coalesce(F.try_element_at(F.col("f"), lit(name)), lit(""))
    return table(spark, d, "documents").select("doc_id", fields.alias("f")).select("doc_id", of("问题描述").alias("question"), of("解决办法").alias("answer"), of("问题原因").alias("cause"))


@query("""select doc_id, case when doc_id % 2 = 0 then lang else 'none' end as lang, coalesce(source, 'none') as source, 'kept' as other, case when doc_id % 3 = 0 then 'second' else 'first' end as last from documents""")
def text_maps(spark: SparkSession, d: str) -> DataFrame:
    """Settings over defaults, and lists of metadata as maps."""
    lit = F.lit
    given = F.when(F.col("doc_id") % 2 == 0, F.create_map(lit("lang"), "lang", lit("source"), "source")).otherwise(F.create_map(lit("source"), "source"))
    merged = text.with_defaults(F.map_filter(given, lambda k, v: v.isNotNull()), F.create_map(lit("lang"), lit("none"), lit("source"), lit("none"), lit("other"), lit("kept")))
    entry = lambda v: F.struct(lit("x").alias("name"), lit(v).alias("value"))
    listed = text.metadata_map(F.when(F.col("doc_id") % 3 == 0, F.array(entry("first"), entry("second"))).otherwise(F.array(entry("first"))))
    return table(spark, d, "documents").select("doc_id", merged.alias("m"), listed.alias("l")).select("doc_id", "m.lang", "m.source", "m.other", F.col("l.x").alias("last"))


@query(r"""select page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as links, md5(array_to_string(list_transform(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda u: case when u = '' then '' else u end), ' ')) as digest, contains(html, '%%%') or contains(html, '***') as marked from pages""")
def text_url_links(spark: SparkSession, d: str) -> DataFrame:
    """Links are written as Markdown pictures and read back."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)
    md = F.array_join(F.transform(links, lambda u: F.concat(F.lit("![x]("), u, F.lit(")"))), " ")
    back = text.markdown_images(md)
    return table(spark, d, "pages").select("page_id", F.size(back).alias("links"), F.md5(F.array_join(back, " ").cast("binary")).alias("digest"), text.contains_any(F.col("html"), ("%%%", "***")).alias("marked"))


@query("""with s as (select page_id, 1 + page_id % 7 as a, 3 + page_id % 5 as b from pages), r as (select page_id, unnest(list_concat(list_concat(range(a, a + b), [a]), [a + b + 1])) as page from s)
    select page_id, array_to_string(list_sort(list(distinct page)), ',') as pages from r group by all""")
def text_parse_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lists of pages and ranges."""
    a, b = 1 + F.col("page_id") % 7, 3 + F.col("page_id") % 5
    spec = F.concat(a.cast("string"), F.lit("-"), (a + b - 1).cast("string"), F.lit(","), a.cast("string"), F.lit(","), (a + b + 1).cast("string"))
    return table(spark, d, "pages").select("page_id", F.array_join(text.parse_pages(spec, F.lit(40)).cast("array<string>"), ",").alias("pages"))


@query(f"""with {_LINES}, x as (select source_id, page, case page % 4 when 0 then '目录' when 1 then '谢谢' when 2 then text else '版本信息 ' || page end as t from lines)
    select source_id, page, case page % 4 when 0 then true when 1 then true when 2 then not regexp_matches(t, '[A-Za-zÀ-ÿ]') else false end as ignored, page % 4 <> 3 and page <= 2 as starts from x""")
def text_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings that name no section, and outline entries that start one."""
    t = F.when(F.col("page") % 4 == 0, " 目 录").when(F.col("page") % 4 == 1, "谢谢").when(F.col("page") % 4 == 2, F.col("text")).otherwise(F.concat(F.lit("版本信息 "), F.col("page").cast("string")))
    toc = F.when(F.col("page") % 4 == 3, "1. 操作步骤").otherwise("x")
    return _lines(spark, d).select("source_id", "page", text.ignored_heading(t).alias("ignored"), text.toc_heading(toc, F.col("page")).alias("starts"))


@query("""with b as (select l_orderkey as source_id, l_linenumber as page, l_quantity as y, l_tax > 0.04 as xyz from lineitem where l_linenumber <= 2 or l_linenumber > 2),
    r as (select source_id, page, case when xyz then greatest(0.0, least(800.0, 795 - y)) else 0.0 end as top, 't' || page as title from b where page % 3 <> 0)
    select source_id, cast(page as bigint) as page, top, arg_max(title, pos) as title from (select source_id, page, top, title, page + 1 as pos from r union all select distinct source_id, 1, 0.0, '资料说明与适用范围', 0 from b) group by all""")
def corpus_toc_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Sections that an outline's entries of the first two levels start; the last at a place counts."""
    n = F.col("l_linenumber")
    toc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), n.alias("pos"), n.alias("page"), F.concat(F.lit("t"), n.cast("string")).alias("title"), F.when(n % 3 == 0, 3).otherwise(2).alias("level"), F.lit(800.0).alias("height"), F.col("l_quantity").alias("view_y"), (F.col("l_tax") > 0.04).alias("is_xyz"))
    return corpus.toc_boundaries(toc)


@query(f"""with {_LINES}, x as (select source_id, page, text, ['', 'q' || page][1 + (page % 2)::integer] as asked from lines)
    select source_id, page, 0.0 as top, case when page = 1 then '资料说明与适用范围' when asked <> '' then asked when regexp_matches(text, '[^[:space:]]') then text || ' / z' else ' / z' end as title from x where page <> 28""")
def corpus_faq_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """A section for each page of a file of questions, titled by the question or by its second and third line."""
    page = F.col("page")
    body = F.when(page % 2 == 1, F.concat(F.lit("h\n问题描述：q"), page.cast("string"), F.lit("\nx"))).otherwise(F.concat(F.lit("h\n"), F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(""), F.lit("\nz\ny")))
    return corpus.faq_boundaries(_lines(spark, d).select("source_id", "page", body.alias("text"), F.lit("f.pdf").alias("name")))


@query("""with x as (select doc_id, lang, source, doc_id % 6 as k from documents)
    select doc_id, case k when 0 then null when 1 then '检索主题：上市 x / ' || lang || '。资料主题：' || source || '。' when 2 then '检索主题：甲主数据；创建：IR01 查询：IR03。资料主题：' || source || '。' when 3 then '显示工单；创建订单。事务码 ' || lang || '。' || source || '。' when 4 then source || '。' || lang || '。' else '检索主题：' || lang || '。' end as anchor from x""")
def catalog_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Short texts that lead a search to a section, in all their forms."""
    k, lit = F.col("doc_id") % 6, F.lit
    none = F.array().cast("array<string>")
    title = F.when(k == 0, " 目录").when(k == 2, "设备管理主数据").when(k == 3, F.concat(lit("事务码 "), "lang")).otherwise(F.col("lang"))
    name = F.when(k == 5, F.concat(lit("常见问题"), "source", lit(".pdf"))).otherwise(F.concat(lit("x MDG.1.2_"), "source", lit("_V2.1.pdf")))
    domain = F.when((k == 2) | (k == 3), "equipment").when(k == 4, "funds").otherwise("finance")
    labels = F.when(k == 2, catalog.native_labels(F.array(lit("设备管理主数据\n甲主数据\n•\n创建：IR01 查询：IR03\n别的")))).otherwise(none)
    lines = F.array(*[F.struct(lit(t).alias("text"), lit(s).alias("score")) for t, s in (("创建订单", 0.95), ("修改订单", 0.5), ("显示", 0.99))])
    region = F.array(F.struct(lit("事务码 1\n显示工单\n12 34\n业务流程操作").alias("text"), F.array(F.struct(lines.alias("lines"))).alias("images")))
    screen = F.when(k == 3, catalog.transaction_labels(region)).otherwise(none)
    return table(spark, d, "documents").select("doc_id", catalog.anchor_text(title, name, domain, F.when(k == 1, "上市 x"), labels, screen).alias("anchor"))


@query("""with x as (select doc_id, doc_id % 5 as k, lang, source from documents)
    select doc_id, case k when 0 then '' when 1 then 'missing_question_or_answer,missing_sources,question_not_extractively_grounded' when 2 then 'answer_not_extractively_grounded' when 3 then 'cause_not_extractively_grounded' else '' end as issues from x""")
def catalog_card_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with cards; merged ones are held against their branches."""
    k, lit = F.col("doc_id") % 5, F.lit
    evidence = F.concat(lit("问题描述：q "), "lang", lit("\n解决办法：a "), "source")
    question, answer = F.concat(lit("q "), "lang"), F.concat(lit("a "), "source")
    merged = F.concat(lit("原文第 1 页的情形：\n"), answer)
    branch = F.struct(answer.alias("answer"), evidence.alias("evidence"))
    branches = F.when(k == 4, F.array(branch)).when(k == 2, F.array(branch, F.struct(lit("z").alias("answer"), evidence.alias("evidence"))))
    shown = F.when(k == 1, "").when((k == 4) | (k == 2), merged).otherwise(answer)
    issues = catalog.card_issues(question, shown, F.when(k == 3, "why").otherwise(""), F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(evidence)), branches)
    return table(spark, d, "documents").select("doc_id", F.array_join(issues, ",").alias("issues"))


@query("""with x as (select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) as n from documents)
    select source || '-' || lang || '-' || lpad(cast(n as varchar), 3, '0') as key, case when doc_id % 3 = 0 then 'V2.1' else 'unknown' end as version, case when doc_id % 2 = 0 then '科技项目' else 'not_applicable' end as project, 2 as images from x where source is not null and lang is not null""")
def corpus_export_documents(spark: SparkSession, d: str) -> DataFrame:
    """Export rows of chunks, numbered within source and domain."""
    k = F.col("doc_id")
    image = F.array(F.struct(F.lit("i").alias("image_id")), F.struct(F.lit("j").alias("image_id")))
    docs = table(spark, d, "documents").select(k.cast("string").alias("one"), "doc_id", "source", "lang")
    chunks = docs.select(F.concat_ws("/", "source", F.lit("x")).alias("drop"), F.col("source").alias("source_id"), F.col("lang").alias("domain"), F.format_string("%012d", "doc_id").alias("chunk_id"), F.lit("t").alias("title"), F.array(F.lit(1)).alias("pages"), F.array().cast("array<string>").alias("notes"), F.array(F.struct(F.lit(1).alias("page"), F.lit("x").alias("text"), image.alias("images"))).alias("regions"), "doc_id").drop("drop")
    one = chunks.select("source_id").distinct().select("source_id", F.lit("n").alias("name"), F.lit("p").alias("relative_path"), F.lit("h").alias("sha256"))
    out = corpus.export_documents(chunks, one).select("key", "chunk_id", "image_count")
    names = docs.select(F.format_string("%012d", "doc_id").alias("c"), F.when(k % 3 == 0, "手册_V2.1.pdf").otherwise("手册.pdf").alias("name"), F.when(k % 2 == 0, "科技项目/投资").otherwise("x").alias("path"))
    return out.join(names, F.col("chunk_id") == F.col("c")).select("key", text.document_version(F.col("name")).alias("version"), text.project_type(F.col("path")).alias("project"), F.col("image_count").alias("images"))


@query("""select l_orderkey as source_id, l_linenumber as page from lineitem l where not exists (select 1 from lineitem r where r.l_orderkey = l.l_orderkey and r.l_linenumber = l.l_linenumber and r.l_returnflag <> 'R')""")
def corpus_missing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that no chunk covers."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return corpus.missing_pages(rows, rows.filter("l_returnflag <> 'R'"), "source_id")
