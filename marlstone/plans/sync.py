"""Synchronisation queries: orders as a manifest, order lines as receipts and remote documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory, sync
from .base import query, table

_MANIFEST = "m as (select o_orderkey as key, 'n' || o_orderkey as name, o_orderpriority as domain, 'h' || (o_orderkey % 7) as content_hash, case when o_orderkey % 3 <> 0 then 'a' || o_orderkey end as anchor from orders)"
_RECEIPTS = "r as (select l_orderkey as key, l_orderkey * 10 as document_id, 'h' || (case when min(l_quantity) < 10 then (l_orderkey + 1) % 7 else l_orderkey % 7 end) as hash, max(l_discount) > 0.05 as metadata_applied, case when l_orderkey % 9 = 0 then 1 end as retired_at from lineitem where l_orderkey % 13 <> 0 group by l_orderkey)"
_REMOTE = "x as (select 'n' || l_orderkey as name, l_orderkey * 10 + case when l_orderkey % 17 = 0 then 1 else 0 end as document_id, case when max(l_tax) > 0.04 then 'available' else 'queuing' end as status, case when max(l_tax) > 0.06 then 'completed' else 'waiting' end as indexing_status, l_orderkey % 11 <> 0 as enabled from lineitem where l_orderkey % 5 <> 0 group by l_orderkey)"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("key"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.col("o_orderpriority").alias("domain"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("content_hash"), F.when(k % 3 != 0, F.concat(F.lit("a"), k.cast("string"))).alias("anchor"))


manifest = _manifest


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_orderkey % 13 <> 0").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_quantity").alias("q"), (F.max("l_discount") > 0.05).alias("metadata_applied"))
    shift = F.when(F.col("q") < 10, 1).otherwise(0)
    return rows.select("key", (F.col("key") * 10).alias("document_id"), F.concat(F.lit("h"), ((F.col("key") + shift) % 7).cast("string")).alias("hash"), "metadata_applied", F.when(F.col("key") % 9 == 0, 1).alias("retired_at"))


def _remote(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").filter("l_orderkey % 5 <> 0").groupBy("l_orderkey").agg(F.max("l_tax").alias("t"))
    return rows.select(
        F.concat(F.lit("n"), k.cast("string")).alias("name"),
        (k * 10 + F.when(k % 17 == 0, 1).otherwise(0)).alias("document_id"),
        F.when(F.col("t") > 0.04, "available").otherwise("queuing").alias("status"),
        F.when(F.col("t") > 0.06, "completed").otherwise("waiting").alias("indexing_status"),
        (k % 11 != 0).alias("enabled"),
    )


#: Remote documents with their datasets: some names are in two of them, some in another one than the item's alone.
_BY_DATASET = "y as (select x.*, o_orderpriority as domain from x join orders on x.name = 'n' || o_orderkey where o_orderkey % 10 <> 3 union all select x.*, 'elsewhere' from x join orders on x.name = 'n' || o_orderkey where o_orderkey % 10 >= 3)"


def _remote_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    owned = _remote(spark, d).join(_manifest(spark, d).select("key", "name", "domain"), "name")
    other = owned.filter("key % 10 >= 3").withColumn("domain", F.lit("elsewhere"))
    return owned.filter("key % 10 <> 3").unionByName(other).drop("key")


@query(f"""with {_MANIFEST}, {_RECEIPTS}, {_REMOTE}, {_BY_DATASET}
    select m.key, x.document_id, case
            when r.hash = m.content_hash and r.document_id is not distinct from x.document_id and r.metadata_applied and r.retired_at is null then 'skip'
            when x.document_id is not null and r.hash is distinct from m.content_hash and x.status <> 'available' then 'defer'
            when r.hash = m.content_hash and r.document_id is not distinct from x.document_id then 'metadata'
            when x.document_id is not null then 'update' else 'create' end as action
    from m left join r on m.key = r.key left join y x on m.name = x.name and m.domain = x.domain""")
def sync_upload_plan(spark: SparkSession, d: str) -> DataFrame:
    """Documents are found by name within the item's dataset; the same name in another one is none of its own."""
    return sync.upload_plan(_manifest(spark, d), _receipts(spark, d), _remote_by_dataset(spark, d))


def _counts(name: str, cur: str, ready: str) -> str:
    return f"count(*) as total, count(*) filter (where {cur}) as submitted_current, count(*) filter (where {ready}) as ready, count(*) filter (where wanted) as anchor_required, count(*) filter (where wanted and {ready}) as anchor_ready, count(*) filter (where wanted and {ready} and anchored) as anchors_current from {name} group by all"


_READY = f"""{_MANIFEST}, {_RECEIPTS}, {_REMOTE}, f as (
        select m.key, m.domain, m.anchor is not null as wanted, x.document_id is not null and coalesce(r.hash = m.content_hash and r.metadata_applied, false) and r.retired_at is null as cur, coalesce(x.indexing_status = 'completed' and x.enabled, false) as up, m.key % 2 = 0 and m.key % 8 <> 0 as anchored
        from m left join r on m.key = r.key left join x on r.document_id = x.document_id)"""


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of every second item; one in four of them hangs on a document that is gone."""
    m = _manifest(spark, d).filter("key % 2 = 0 and anchor is not null")
    return m.select("key", (F.col("key") * 10 + F.when(F.col("key") % 8 == 0, 5).otherwise(0)).alias("document_id"), sync.anchor_fingerprint().alias("fingerprint"))


#: What a store has been sent after all runs of the upload plan.
SEND_SQL = f"""with {_MANIFEST}, {_RECEIPTS}, {_REMOTE}, {_BY_DATASET}, p as (
        select m.key, m.content_hash, x.document_id, r.hash is not distinct from m.content_hash and r.document_id is not distinct from x.document_id as same, r.metadata_applied and r.retired_at is null as done, coalesce(x.status, '') as status
        from m left join r on m.key = r.key left join y x on m.name = x.name and m.domain = x.domain)
    select key, cast(case when same then 0 else 1 end as bigint) as puts, cast(1 as bigint) as described, content_hash as hash, true as metadata_applied, document_id is not null as had
    from p where not (same and coalesce(done, false)) and (same or document_id is null or status = 'available' or exists (select 1 from r where r.key = p.key and r.hash = p.content_hash))"""


def _readiness(spark: SparkSession, d: str) -> DataFrame:
    return sync.readiness(_manifest(spark, d), _receipts(spark, d), _remote(spark, d), _anchors(spark, d))


@query(f"with {_READY} select domain, {_counts('f', 'cur', '(cur and up)')}")
def sync_readiness(spark: SparkSession, d: str) -> DataFrame:
    return _readiness(spark, d)


@query(f"""with {_READY}, s as (select {_counts('f', 'cur', '(cur and up)')}) select total, submitted_current, ready, anchor_required, anchors_current, greatest(total - ready, 0) as left_over,
    case when submitted_current < total then 'upload' when ready < total then 'wait' when anchors_current < anchor_required then 'anchor' else 'retire' end as step from s""")
def sync_next_step(spark: SparkSession, d: str) -> DataFrame:
    """Counts over all domains decide what a sync does next."""
    return sync.next_step(_readiness(spark, d), F.lit(True)).withColumn("left_over", F.greatest(F.col("total") - F.col("ready"), F.lit(0)))


@query("select distinct l_orderkey as key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')")
def sync_retire_plan(spark: SparkSession, d: str) -> DataFrame:
    receipts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit(None).cast("timestamp").alias("retired_at")).distinct()
    kept = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("key"))
    return sync.retire_plan(receipts, kept, complete=True).select("key")


@query("""select distinct o_custkey as identity, o_orderkey as key from orders where o_custkey in (select o_custkey from orders where o_orderstatus = 'O') and o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')""")
def sync_replacement_plan(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("identity"), F.col("o_orderkey").alias("key"), "o_orderstatus")
    return sync.replacement_plan(orders.select("identity", "key"), orders.filter("o_orderstatus = 'O'").select("identity", "key"))


@query("""select d.doc_id, case when l.doc_id is not null and l.quality = 0 then 'finance' when d.lang = 'fr' then 'projects' end as domain,
        case when l.doc_id is not null and l.quality = 0 then 'confirmed' when d.lang = 'fr' then 'automatic' else 'needs_review' end as status, d.n_chars from documents d left join labels l on d.doc_id = l.doc_id""")
def sync_upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that had a domain keep it, confirmed, over a new scan."""
    old = table(spark, d, "labels").select("doc_id", F.lit(0).cast("long").alias("n_chars"), F.when(F.col("quality") == 0, "finance").alias("domain"), F.lit("needs_review").alias("status"))
    auto = F.when(F.col("lang") == "fr", "projects")
    new = table(spark, d, "documents").select("doc_id", "n_chars", auto.alias("domain"), F.when(auto.isNotNull(), "automatic").otherwise("needs_review").alias("status"))
    return inventory.upsert_files(old, new, ["doc_id"], ["n_chars"]).select("doc_id", "domain", "status", "n_chars")


@query("select distinct doc_id from documents where doc_id not in (select vec_id from embeddings)")
def sync_missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return sync.missing(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(f"""with {_RECEIPTS}, {_REMOTE}, old as (select distinct l_orderkey as key from lineitem where l_orderkey % 4 = 1)
    select r.key, r.document_id, coalesce(x.enabled, false) as disable from r join old using (key) left join x on r.document_id = x.document_id where r.retired_at is null""")
def sync_retire_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Documents of replaced keys are disabled where they are still there, and their receipts retired."""
    old = table(spark, d, "lineitem").filter("l_orderkey % 4 = 1").select(F.col("l_orderkey").alias("key"))
    return sync.retire_replaced(old, _receipts(spark, d), _remote(spark, d))


@query("""with w as (select o_orderkey as key, o_custkey as parent_id, 'a' || (o_orderkey % 50) as text, case when o_orderkey % 6 = 0 then o_orderkey end as had from orders),
    c as (select c_custkey as parent_id, min(c_custkey * 100 + c_custkey % 50) as child_id, 'a' || (c_custkey % 50) as content from customer group by all)
    select w.key, coalesce(had, c.child_id) as child_id, case when had is null and c.child_id is null then 'create' else 'refresh' end as action from w left join c on w.parent_id = c.parent_id and w.text = c.content""")
def sync_reconcile_anchors(spark: SparkSession, d: str) -> DataFrame:
    """An anchor is refreshed where a receipt or its exact text is found, and created only where neither is."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    wanted = table(spark, d, "orders").select(k.alias("key"), F.col("o_custkey").alias("parent_id"), F.concat(F.lit("a"), (k % 50).cast("string")).alias("text"), F.when(k % 6 == 0, k).alias("child_id"))
    children = table(spark, d, "customer").select(c.alias("parent_id"), (c * 100 + c % 50).alias("child_id"), F.concat(F.lit("a"), (c % 50).cast("string")).alias("content"))
    return sync.reconcile(wanted, children)


@query("select o_orderkey as key from orders where o_orderpriority not like '%HIGH%' and o_orderpriority not like '%LOW%'")
def sync_owned_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of another server are left out; those that name none stay."""
    p = F.col("o_orderpriority")
    url = F.when(p.contains("HIGH"), "http://other/v1").when(p.contains("LOW"), "http://here/v2").when(p.contains("MEDIUM"), "http://here/v1//").when(p.contains("URGENT"), "http://here/v1")
    return sync.owned(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), url.alias("base_url")), "http://here/v1/").select("key")


@query(f"""with {_MANIFEST}, {_RECEIPTS}
    select m.key, m.anchor as text, case when m.key % 4 <> 0 then 'ready' else 'waiting' end as state from m join r on m.key = r.key and r.hash = m.content_hash and metadata_applied where m.anchor is not null and (m.key % 2 <> 0 or m.key % 8 = 0)""")
def sync_anchor_plan(spark: SparkSession, d: str) -> DataFrame:
    m, r = _manifest(spark, d), _receipts(spark, d)
    available = r.filter("key % 4 <> 0").select("document_id")
    return sync.anchor_plan(m, r, available, _anchors(spark, d))


@query("""select n_name as domain, case when n_nationkey % 4 = 0 then n_nationkey * 100 when n_nationkey % 4 = 1 then n_nationkey * 10 when n_nationkey % 4 = 2 then n_nationkey end as dataset_id,
    case n_nationkey % 4 when 0 then 'mapping' when 1 then 'previous' when 2 then 'name' else 'create' end as how from nation""")
def sync_resolve_datasets(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("domain"), F.col("n_nationkey").alias("id"), F.concat(F.lit("set-"), F.col("n_name")).alias("name"))
    part = lambda i, f: n.filter(f"id % 4 = {i}").select("domain", (F.col("id") * f).alias("dataset_id"))
    return sync.resolve_datasets(n.select("domain", "name"), part(0, 100), part(1, 10), n.filter("id % 4 = 2").select(F.col("id").alias("dataset_id"), "name"))
