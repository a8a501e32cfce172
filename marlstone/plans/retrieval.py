"""Retrieval queries: the benchmark's texts ask, documents and embeddings answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, retrieval
from ..operators.scratch import stash
from ..operators.sizing import broadcast_if_small
from . import sql
from .base import query, table

DOC_TEXTS = "select doc_id as id, text as txt from documents"
ASKS = "select item_id as qid, text as txt from benchmark"


def asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _order(score: str = "score", then: str = "doc_id") -> list:
    return [F.desc(F.round(score, 6)), F.col(then)]


def _lexical(spark: SparkSession, d: str, k: int, within: DataFrame | None = None) -> DataFrame:
    """What can be among the best ``k`` by ``_order``."""
    docs = table(spark, d, "documents")
    return retrieval.bm25_best(docs, asks(spark, d), "doc_id", "text", k, 6, within=within).withColumnRenamed("id", "doc_id")


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    q = vecs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.dense(vecs, q, k, 6).select("query_id", "doc_id", "score")


def _channels(spark: SparkSession, d: str, k: int = 60) -> tuple[DataFrame, DataFrame]:
    # written once: fusion, reserved heads and reranking read them again
    return tuple(stash(retrieval.rank(x, ["query_id"], k, _order()), "channel") for x in (_lexical(spark, d, k), _dense(spark, d, k)))


@query(f"""with {sql.bm25(DOC_TEXTS, ASKS)}, {sql.ranked('bm25', 'top', 5)}
    select qid as item_id, id as doc_id, cast(r as integer) as rank, round(s, 5) as score from top""")
def retr_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.rank(_lexical(spark, d, 5), ["query_id"], 5, _order())
    return top.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 5).alias("score"))


@query(f"""with {sql.bm25("select doc_id as id, source || ' ' || source || ' ' || text as txt from documents", ASKS)}, {sql.ranked('bm25', 'top', 5, 5)}
    select qid as item_id, id as card_id, cast(r as integer) as rank, round(s, 5) as score from top""")
def retr_bm25_weighted_fields(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "documents").select(F.col("doc_id").alias("card_id"), F.col("source").alias("question"), F.lit(None).cast("string").alias("cause"), F.col("text").alias("answer"))
    return retrieval.rank_cards(cards, asks(spark, d), 5).select(F.col("query_id").alias("item_id"), "card_id", "rank", "score")


@query(f"""with {sql.bm25(DOC_TEXTS, ASKS)}, scoped as (select * from bm25 where id in (select doc_id from documents where lang = 'en' and source in ('src1', 'src2', 'src3'))), {sql.ranked('scoped', 'top', 5)}
    select qid as item_id, id as doc_id, cast(r as integer) as rank, round(s, 5) as score from top""")
def retr_bm25_filtered_global_stats(spark: SparkSession, d: str) -> DataFrame:
    """The scope is put on scores; statistics stay those of all documents."""
    inside = table(spark, d, "documents").filter("lang = 'en' and source in ('src1', 'src2', 'src3')").select("doc_id")
    top = retrieval.rank(_lexical(spark, d, 5, inside), ["query_id"], 5, _order())
    return top.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 5).alias("score"))


@query(f"""with {sql.cosine()}, {sql.ranked('cos', 'top', 5)}
    select qid as item_id, id as vec_id, cast(r as integer) as rank, round(s, 5) as score from top""")
def retr_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.rank(_dense(spark, d, 5), ["query_id"], 5, _order())
    return top.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("vec_id"), "rank", F.round("score", 5).alias("score"))


#: Blocks that items without an inner word are dealt into.
_BLOCKS = 8
_CHANNELS = f"{sql.bm25(DOC_TEXTS, ASKS)}, {sql.cosine()}, {sql.ranked('bm25', 'lex', 60)}, {sql.ranked('cos', 'sem', 60)}"


@query(f"""with {_CHANNELS}, {sql.RRF}, o as (select qid, id, f, row_number() over (partition by qid order by round(f, 9) desc, id) as r from rrf)
    select qid as item_id, id as doc_id, cast(r as integer) as rank, round(f, 9) as rrf from o where r <= 10""")
def retr_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.rrf(list(_channels(spark, d))).withColumn("rrf", F.round("rrf", 9))
    return retrieval.rank(fused, ["query_id"], 10, [F.desc("rrf"), F.col("doc_id")]).select(F.col("query_id").alias("item_id"), "doc_id", "rank", "rrf")


_CANDIDATES = f"""{_CHANNELS}, {sql.RRF},
    head as (select qid, id from lex where r <= 3 union select qid, id from sem where r <= 3),
    c as (select rrf.qid, rrf.id, round(f, 9) as f, row_number() over (partition by rrf.qid order by case when head.id is null then 1 else 0 end, round(f, 9) desc, rrf.id) as place
        from rrf left join head on rrf.qid = head.qid and rrf.id = head.id)"""


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lex, sem = _channels(spark, d)
    fused = retrieval.rrf([lex, sem]).withColumn("rrf", F.round("rrf", 9))
    return lex, sem, retrieval.candidates(fused, lex, sem, 24)


@query(f"with {_CANDIDATES} select qid as item_id, id as doc_id, cast(place as integer) as place from c where place <= 24")
def retr_reserved_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)[2].select(F.col("query_id").alias("item_id"), "doc_id", "place")


_OVERLAP = f"len(list_intersect(list_distinct({sql.TOKENS.format('b.text')}), {sql.TOKENS.format('t.text')})) / greatest(len(list_distinct({sql.TOKENS.format('b.text')})), 1)"


@query(f"""with {_CANDIDATES}, s as (select c.qid, c.id, f, {_OVERLAP} as x from c join benchmark b on b.item_id = c.qid join documents t on t.doc_id = c.id where place <= 24),
    o as (select *, row_number() over (partition by qid order by x desc, f desc, id) as r from s)
    select qid as item_id, id as doc_id, cast(r as integer) as rank, round(x, 6) as rerank from o where r <= 5""")
def retr_hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    lex, sem, cands = _candidates(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    with_passage = lambda r: r.withColumn("passage_id", F.col("doc_id"))
    scored = retrieval.rerank(cands, with_passage(lex), with_passage(sem), texts, asks(spark, d))
    top = retrieval.rank(scored, ["query_id"], 5, [F.desc("rerank"), F.desc("rrf"), F.col("doc_id")])
    return top.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("rerank", 6).alias("rerank"))


@query(f"""with {_CHANNELS}, lx as (select qid, id, case when max(s) over q > min(s) over q then (s - min(s) over q) / (max(s) over q - min(s) over q) else 1.0 end as u from lex window q as (partition by qid)),
    m as (select coalesce(sem.qid, lx.qid) as qid, coalesce(sem.id, lx.id) as id, round(0.7 * coalesce(s, 0) + (1 - 0.7) * coalesce(u, 0), 6) as w from sem full join lx on sem.qid = lx.qid and sem.id = lx.id),
    o as (select *, row_number() over (partition by qid order by w desc, id) as r from m)
    select qid as item_id, id as doc_id, cast(r as integer) as rank, w as score from o where r <= 6""")
def retr_weighted_hybrid(spark: SparkSession, d: str) -> DataFrame:
    lex, sem = _channels(spark, d)
    return retrieval.weighted(lex, sem, 6).select(F.col("query_id").alias("item_id"), "doc_id", "rank", "score")


_WINDOWS = """w as (select doc_id, source, lang, text, unnest(range(0, cast(greatest(ceil((length(text) - 300) / 240.0), 0) * 240 + 1 as bigint), 240)) as o from (select doc_id, source, lang, coalesce(text, '') as text from documents))"""


def _passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("topic"), F.col("lang").alias("title"), F.col("text").alias("content"))
    return retrieval.passages(docs)


@query(f"""with {_WINDOWS} select doc_id, cast(o as integer) as "offset", md5(source || ' / ' || lang || chr(10) || substring(text, cast(o as integer) + 1, 300)) as digest from w""")
def text_passages(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("doc_id", "offset", F.md5(F.col("text").cast("binary")).alias("digest"))


_PASSAGE_TEXTS = f"""select doc_id * 1000000 + o as id, source || ' / ' || lang || chr(10) || substring(text, cast(o as integer) + 1, 300) as txt from w"""


@query(f"""with {_WINDOWS}, {sql.bm25(_PASSAGE_TEXTS, ASKS)},
    best as (select qid, id // 1000000 as doc, id, s, row_number() over (partition by qid, id // 1000000 order by round(s, 6) desc, id) as n from bm25),
    o as (select qid, doc, id, s, row_number() over (partition by qid order by round(s, 6) desc, id) as r from best where n = 1)
    select qid as item_id, doc as doc_id, cast(r as integer) as rank, cast(id % 1000000 as integer) as "offset", round(s, 6) as score from o where r <= 5""")
def retr_parent_child(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d).select(F.struct("doc_id", "offset").alias("pid"), "text")
    scores = retrieval.bm25_best(rows, asks(spark, d), "pid", "text", 5, 6, "id.doc_id").select("query_id", F.col("id.doc_id").alias("doc_id"), F.col("id").alias("passage_id"), F.round("score", 6).alias("score"))
    top = retrieval.parents(scores, 5, True)
    return top.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.col("passage_id.offset").cast("int").alias("offset"), "score")


@query(f"""with {sql.bm25(DOC_TEXTS, ASKS)}, {sql.ranked('bm25', 'top', 5)},
    truth as (select b.item_id, d.doc_id from benchmark b, documents d where contains(d.text, b.text)),
    cases as (select distinct item_id from truth),
    h as (select c.item_id, min(t.r) as hit from cases c left join (select top.qid, top.r from top join truth on truth.item_id = top.qid and truth.doc_id = top.id) t on t.qid = c.item_id group by all)
    select count(*) as cases, round(avg(case when hit <= 1 then 1.0 else 0.0 end), 6) as hit_at_1, round(avg(case when hit <= 5 then 1.0 else 0.0 end), 6) as hit_at_5, round(avg(coalesce(1.0 / hit, 0.0)), 6) as mrr_at_5 from h""")
def eval_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Which documents hold an item's text is the truth that ranks are held against."""
    results = retrieval.rank(_lexical(spark, d, 5), ["query_id"], 5, _order())
    # candidates share the item's rarest word: an equi-join; only then is the whole text looked for
    words = lambda c: F.array_distinct(text.tokens(c))
    inner = lambda q: F.slice(text.tokens(q), 2, F.greatest(F.size(text.tokens(q)) - 2, F.lit(0)))
    asked = asks(spark, d)
    wanted = asked.select("query_id", "query", F.explode_outer(F.array_distinct(inner("query"))).alias("token"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(words("text")).alias("token")).join(broadcast_if_small(wanted.select("token").distinct()), "token", "left_semi")
    held = stash(held, "held-words")
    rare = held.groupBy("token").count().join(wanted, "token").groupBy("query_id").agg(F.min_by(F.struct("token", "query"), F.struct("count", "token")).alias("t")).select("query_id", "t.token", "t.query")
    near = held.join(rare, "token").select("query_id", "doc_id", "query").join(docs, "doc_id")
    # items without an inner word (fewer than three tokens) are looked for in every text, a block of them at a time
    short = asked.filter(F.size(inner("query")) == 0).select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(_BLOCKS)).alias("b"))
    blocks = short.groupBy("b").agg(F.collect_list(F.struct("query_id", "query")).alias("qs"))
    every = docs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1)))).join(blocks, "b") if not short.isEmpty() else None
    near = near.filter(F.contains("text", F.col("query"))).select("query_id", "doc_id")
    if every is not None:
        hits = every.select("doc_id", F.explode(F.filter("qs", lambda q: F.contains(F.col("text"), q["query"]))).alias("q"))
        near = near.unionByName(hits.select("q.query_id", "doc_id"))
    truth = near.groupBy("query_id").agg(F.collect_set("doc_id").alias("expected"))
    out = evaluation.summary(evaluation.first_hit(results, truth), [])
    return out.select("cases", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "mrr_at_5")])


@query(f"select lang, cast(sum(len({sql.TOKENS.format('text')})) as bigint) as n_tokens, cast(sum(len(list_distinct({sql.TOKENS.format('text')}))) as bigint) as n_distinct from documents group by all")
def text_tokens_count(spark: SparkSession, d: str) -> DataFrame:
    toks = text.tokens("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(toks)).alias("n_tokens"), F.sum(F.size(F.array_distinct(toks))).alias("n_distinct"))
