"""Operators against literal cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.operators import audit, catalog, control, corpus, graph, inventory, metadata, metrics, retrieval, sync
from marlstone.plans import registry


def test_rank_cards(spark):
    cards = spark.createDataFrame([("a", "项目结转如何取消", None, "使用CJ88"), ("b", "维修工单结转如何取消", None, "使用KO8G")], "card_id string, question string, cause string, answer string")
    asked = spark.createDataFrame([(1, "KO8G取消结转")], "query_id int, query string")
    assert [r["card_id"] for r in retrieval.rank_cards(cards, asked).orderBy("rank").collect()] == ["b", "a"]


def test_reserved_candidates(spark):
    lex = spark.createDataFrame([(1, i, i + 1) for i in range(60)], "query_id int, doc_id int, rank int")
    sem = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate([999, *range(59)])], "query_id int, doc_id int, rank int")
    fused = retrieval.rrf([lex, sem])
    order = [r["doc_id"] for r in fused.orderBy(F.desc("rrf"), "doc_id").collect()]
    assert order.index(999) >= 24
    got = {r["doc_id"] for r in retrieval.candidates(fused, lex, sem, 24).collect()}
    assert len(got) == 24 and {999, 0, 1, 2} <= got


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame(
        [("a", "1.1.普通结转", "项目", "普通项目结转", "sa", ["projects"], "detail", "1.1.普通结转"), ("b", "1.2.维修冲销", "设备", "维修工单结算后撤销", "sb", ["equipment"], "detail", "1.2.维修冲销")],
        "doc_id string, title string, topic string, content string, source_id string, domains array<string>, kind string, section_title string",
    )
    rows = retrieval.passages(docs)
    vecs = rows.select("doc_id", "passage_id", F.when(F.col("text").contains("维修"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    asked = spark.createDataFrame([(1, "普通项目结转", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    return docs, rows, vecs, asked


def _search(small, mode, where=None):
    docs, rows, vecs, asked = small
    scorer = lambda q, t: F.when(t.contains("维修"), 6.0).otherwise(-2.0)
    out = retrieval.search(docs, rows, vecs, asked.select("query_id", "query"), asked.select("query_id", "vector"), mode, 5, where, scorer)
    return [r["doc_id"] for r in out.orderBy("rank").collect()]


def test_modes(small):
    assert _search(small, "bm25")[0] == "a"
    assert _search(small, "vector") == ["b", "a"]
    assert set(_search(small, "fusion")) == {"a", "b"}
    assert _search(small, "hybrid")[0] == "b"


@pytest.mark.parametrize("mode", retrieval.MODES)
def test_scopes_never_widen(small, mode):
    assert _search(small, mode, retrieval.scope(source_id="missing")) == []
    assert _search(small, mode, retrieval.scope(domains=["projects"], section_prefix="1.1.")) == ["a"]


def test_query_checks():
    for args in (("", 5), (" ", 5), ("x" * 1001, 5), ("x", 0), ("x", 21), ("x", 5, "other")):
        with pytest.raises(ValueError):
            retrieval.check_query(*args)


def test_classify(spark):
    rows = [
        ("ERP/核算模块/月结.pdf", "finance"),
        ("ERP/预算模块/预算.pdf", "funds"),
        ("ERP/物资管理/采购.pdf", "procurement"),
        ("培训/设备管理操作手册.pdf", "equipment"),
        ("ERP/主数据管理/物料.pdf", "master_ops"),
        ("ERP/主数据管理/公共数据管理标准/编码.pdf", "master_rules"),
        ("其他/完全未知.pdf", None),
    ]
    df = spark.createDataFrame([(p, p.split("/")[-1], d) for p, d in rows], "path string, name string, want string")
    assert [(r["got"], r["want"]) for r in df.withColumn("got", metadata.classify_path(F.col("path"), F.col("name"))).collect()] == [(d, d) for _, d in rows]
    pages = spark.createDataFrame([(17,), (18,), (30,), (52,), (24,)], "page int")
    got = pages.select(metadata.classify_page(F.lit("x/财务模块常见问题.pdf"), F.lit("财务模块常见问题.pdf"), F.col("page")).alias("d")).collect()
    assert [r["d"] for r in got] == ["projects", "equipment", "funds", "internal", "finance"]
    for path in ("其他/未知.pdf", "x/设备管理/y.pdf", "核算模块/y.pdf"):  # the corpus takes paths as they are, and only the manual's name
        with pytest.raises(PySparkException):
            pages.select(metadata.classify_page(F.lit(path), F.lit(path.split("/")[-1]), F.col("page"))).collect()
    one = lambda c: spark.range(1).select(c.alias("d")).first()["d"]
    assert one(metadata.classify_path(F.lit("x/设备管理/y.pdf"), F.lit("y.pdf"))) == "equipment"
    assert one(metadata.classify_path(F.lit("核算模块\\y.pdf"), F.lit("y.pdf"))) == "finance"
    assert one(metadata.classify_path(F.lit("主数据管理/财务模块常见问题.pdf"), F.lit("财务模块常见问题.pdf"))) == "master_ops"
    assert one(metadata.classify_page(F.lit("x/设备管理操作手册.pdf"), F.lit("设备管理操作手册.pdf"), F.lit(1))) == "equipment"


def test_predicate(spark):
    df = spark.createDataFrame([("a", "x1"), ("b", None)], "domain string, title string")
    ask = lambda *c: [r["domain"] for r in df.filter(metadata.predicate([dict(zip(("name", "comparison_operator", "value"), x, strict=False)) for x in c])).collect()]
    assert ask(("domain", "is", "a")) == ["a"]
    assert ask(("domain", "is not", "a")) == ["b"]
    assert ask(("title", "contains", "")) == ["a", "b"]
    assert ask(("title", "not empty"), ("title", "contains", "1")) == ["a"]


def test_slide_boundaries(spark):
    rows = [("s", 1, "采购培训\n1"), ("s", 2, "6、退料申请操作\n79 79"), ("s", 3, "80 80"), ("s", 4, "81 / 81"), ("s", 5, "7、退货流程\n82")]
    got = corpus.repeated_title_boundaries(spark.createDataFrame(rows, "source_id string, page int, text string")).orderBy("page").collect()
    assert [(r["page"], r["title"]) for r in got] == [(1, "资料说明与适用范围"), (2, "6、退料申请操作"), (5, "7、退货流程")]


def test_chunks_lose_nothing(spark):
    image = lambda p, i: {"image_id": f"{p}-{i}"}
    regions = [(p, f"text {p}", [image(p, i) for i in range(7)]) for p in (1, 2, 3)]
    schema = "source_id string, section_index int, title string, regions array<struct<page:int,text:string,images:array<struct<image_id:string>>>>"
    got = corpus.chunks(spark.createDataFrame([("s", 1, "t", regions)], schema)).orderBy("part").collect()
    assert [(r["chunk_id"], r["pages"], r["parts"], len(r["notes"])) for r in got] == [(f"s-s0001-p0{i}", [i], 3, 1) for i in (1, 2, 3)]
    assert sum(len(x["images"]) for r in got for x in r["regions"]) == 21
    many = [(1, "t", [image(1, i) for i in range(25)])]
    got = corpus.chunks(spark.createDataFrame([("s", 1, "t", many)], schema)).orderBy("part").collect()
    assert [len(r["regions"][0]["images"]) for r in got] == [10, 10, 5]


def test_outline(spark):
    rows = [(1, "2.维修工单结转", [24, 25], "a"), (1, "2.维修工单结转", [26, 27], "b"), (2, "3.项目成本结转", [41], "c"), (3, "目录", [2], "d")]
    df = spark.createDataFrame([("s", *r) for r in rows], "source_id string, section_index int, title string, pages array<int>, chunk_id string")
    got = catalog.outline(df).orderBy("section_index").collect()
    assert [(r["pages"], r["chunk_ids"]) for r in got] == [([24, 25, 26, 27], ["a", "b"]), ([41], ["c"])]


def test_heading_context_uses_the_latest(spark):
    rows = [("s", 1, "1 上市流程"), ("s", 2, "1 普通流程"), ("s", 3, "1.1 步骤"), ("s", 4, "2 内部"), ("s", 5, "2.1.1 步骤")]
    got = {r["pos"]: r["context"] for r in catalog.heading_context(spark.createDataFrame(rows, "source_id string, pos int, title string")).collect()}
    assert got == {5: "2 内部"}  # the number 1 was given again to a heading without a condition


def test_card_issues(spark):
    df = spark.createDataFrame([("如何修改", "使用FB08", "", ["问题描述：如何修改\n解决办法：使用FB02"])], "q string, a string, c string, e array<string>")
    got = df.select(catalog.card_issues(F.col("q"), F.col("a"), F.col("c"), F.col("e")).alias("i")).first()["i"]
    assert got == ["answer_not_extractively_grounded"]
    evidence = ["问题描述：如何修改\n解决办法：甲", "问题描述：如何修改\n解决办法：乙"]
    rows = spark.createDataFrame([("如何修改", p, f"c{p}", a, "s", ["f"], e, [f"i{p}"]) for p, a, e in ((1, "甲", evidence[0]), (2, "乙", evidence[1]))], "question string, page long, card_id string, answer string, source string, flags array<string>, evidence string, images array<string>")
    card = catalog.merge_cards(rows)
    merged = card.first()
    assert merged["images"] == ["i1", "i2"] and [b["evidence"] for b in merged["branches"]] == evidence and merged["answer"].startswith("原文第 1 页的情形：\n甲")
    issues = lambda df: df.select(catalog.card_issues(F.col("question"), F.col("answer"), F.lit(""), F.array(*map(F.lit, evidence)), F.col("branches")).alias("i")).first()["i"]
    assert issues(card) == []
    wrong = card.withColumn("branches", F.transform("branches", lambda b: b.withField("answer", F.lit("丙"))))
    assert issues(wrong) == ["answer_not_extractively_grounded"]


def test_anchors(spark):
    none = F.array().cast("array<string>")
    ask = lambda title, name, domain="finance", labels=none: spark.range(1).select(catalog.anchor_text(F.lit(title), F.lit(name), F.lit(domain), F.lit(None).cast("string"), labels, none).alias("t")).first()["t"]
    assert ask("项目结转后如何取消结转", "财务模块常见问题.pdf") == "检索主题：项目结转后如何取消结转。"
    assert ask("目录", "x.pdf") is None
    labels = spark.createDataFrame([(["设备管理主数据\n工作中心主数据\n•\n•\n创建：IR01 查询：IR03\n可复制可不复制\n13"],)], "r array<string>").select(catalog.native_labels(F.col("r")).alias("l")).first()["l"]
    assert labels == ["工作中心主数据", "创建：IR01 查询：IR03"]
    got = ask("设备管理主数据", "设备.pdf", "equipment", F.array(*map(F.lit, labels)))
    assert "IR01" in got and "工作中心主数据" in got


def test_packets(spark):
    pages = [("s", 1, "前言\n1.5.2 甲\n一"), ("s", 2, "二\n1.5.3 乙\n三")]
    got = catalog.packets(spark.createDataFrame(pages, "source_id string, page int, text string")).orderBy("number").collect()
    assert [(r["number"], r["title"], [(s["page"], s["text"]) for s in r["spans"]]) for r in got] == [("1.5.2", "甲", [(1, "1.5.2 甲\n一"), (2, "二")]), ("1.5.3", "乙", [(2, "1.5.3 乙\n三")])]


def test_upsert(spark):
    schema = "source_id string, pages int, domain string, status string"
    old = spark.createDataFrame([("s", 1, "finance", "confirmed")], schema)
    new = spark.createDataFrame([("s", 2, None, "needs_review"), ("t", 3, None, "needs_review")], schema)
    got = {r["source_id"]: (r["pages"], r["domain"], r["status"]) for r in inventory.upsert_files(old, new, ["source_id"], ["pages"]).collect()}
    assert got == {"s": (2, "finance", "confirmed"), "t": (3, None, "needs_review")}


def test_pending_counts_only_what_is_left(spark):
    tasks, done = spark.range(10).withColumnRenamed("id", "page"), spark.range(4).withColumnRenamed("id", "page")
    assert [r["page"] for r in inventory.pending(tasks, done, ["page"], ["page"], 3).collect()] == [4, 5, 6]


def test_sync(spark):
    manifest = spark.createDataFrame([("k", "a.docx", "new", "d", "t")], "key string, name string, content_hash string, domain string, anchor string")
    receipt = lambda h="old", doc="doc", applied=True, retired=None: spark.createDataFrame([("k", doc, h, applied, retired)], "key string, document_id string, hash string, metadata_applied boolean, retired_at string")
    remote = lambda s, *names: spark.createDataFrame([("doc", s, "completed", True, n) for n in names or ("a.docx",)], "document_id string, status string, indexing_status string, enabled boolean, name string")
    plan = lambda r, x: sync.upload_plan(manifest, r, x).first()["action"]
    assert plan(receipt(), remote("queuing")) == "defer"
    assert plan(receipt(), remote("available")) == "update"
    assert plan(receipt("new"), remote("queuing")) == "skip"
    assert plan(receipt("new", applied=False), remote("queuing")) == "metadata"  # the content is current: only metadata is sent
    assert plan(receipt("new", retired="then"), remote("available")) == "metadata"  # a retired one is submitted again
    assert plan(receipt("new", doc="gone"), remote("available")) == "update"
    assert plan(receipt().limit(0), remote("available")) == "update"  # found by name, without a receipt
    assert plan(receipt().limit(0), remote("available", "b.docx")) == "create"
    with pytest.raises(PySparkException):
        sync.upload_plan(manifest, receipt(), remote("available", "a.docx", "a.docx")).collect()
    none = spark.createDataFrame([], "key string, document_id string, fingerprint string")
    ready = lambda r, x, a=none: tuple(sync.readiness(manifest, r, x, a).select("submitted_current", "ready", "anchors_current").first())
    assert ready(receipt(), remote("available")) == (0, 0, 0)
    assert ready(receipt("new"), remote("available")) == (1, 1, 0)
    assert ready(receipt("new", doc="gone"), remote("available")) == (0, 0, 0) and ready(receipt("new", retired="then"), remote("available")) == (0, 0, 0)
    print_of = manifest.select("key", F.lit("doc").alias("document_id"), sync.anchor_fingerprint().alias("fingerprint"))
    assert ready(receipt("new"), remote("available"), print_of) == (1, 1, 1)
    assert ready(receipt("new"), remote("available"), print_of.withColumn("document_id", F.lit("other"))) == (1, 1, 0)
    receipts = receipt()
    with pytest.raises(ValueError):
        sync.retire_plan(receipts, manifest, complete=False)
    names = spark.createDataFrame([("a", 1), ("a", 2)], "name string, id int")
    with pytest.raises(PySparkException):
        sync.one_per_name(names).collect()
    before = spark.createDataFrame([("m", "old"), ("m", "retained"), ("n", "x")], "identity string, key string")
    now = spark.createDataFrame([("m", "new")], "identity string, key string")
    assert {r["key"] for r in sync.replacement_plan(before, now).collect()} == {"old", "retained"}


def test_percentiles_take_the_element_at_floor(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(20)], "g int, v double")
    r = metrics.element_percentiles(df, ["g"], "v", {"p10": 0.1, "p90": 0.9}).first()
    assert (r["p10"], r["p90"]) == (2.0, 18.0)


STORIES = [
    ("ready pause resume claim complete cancel", "completed"),
    ("ready cancel resume", "cancelled"),
    ("ready claim review pause", "paused"),
    ("ready claim review resume_unresolved", "needs_review"),
    ("ready claim review resume", "queued"),
    ("pause ready", "paused"),
    ("cancel pause ready", "cancelled"),
    ("pause", "preparing"),
    ("ready claim pause", "running"),
    ("ready claim pause stage", "paused"),
    ("ready claim cancel pause stage", "cancelled"),
    ("ready claim pause stage resume claim stage complete", "completed"),
    ("ready claim fail pause resume", "queued"),
    ("ready claim pause recover claim", "queued"),
    ("claim ready resume", "queued"),
]


def test_control(spark):
    jobs = spark.createDataFrame([(1, "running", "b", False, False), (2, "queued", "a", False, True), (3, "queued", "c", False, False)], "job_id int, status string, created_at string, cancel_requested boolean, pause_requested boolean")
    assert [r["job_id"] for r in control.claimable(jobs).collect()] == [3]
    after, events = control.recover(jobs)
    assert [r["status"] for r in after.orderBy("job_id").collect()] == ["queued"] * 3 and [r["job_id"] for r in events.collect()] == [1]
    lives = STORIES
    steps = [(j, i, r) for j, (story, _) in enumerate(lives) for i, r in enumerate(story.split())]
    got = {r["job_id"]: r["state"] for r in control.fold_states(spark.createDataFrame(steps, "job_id int, event_id int, request string")).collect()}
    assert got == {j: end for j, (_, end) in enumerate(lives)}
    log = spark.range(206).withColumnRenamed("id", "event_id").withColumn("job", F.lit(1))
    assert control.recent(log, "job", "event_id").count() == 200
    assert [r["event_id"] for r in control.after(log, "event_id", 204).collect()] == [205]


def test_graph(spark):
    rows = graph.routes(spark, ["projects", "finance", "custom_tech"])
    assert [r["route"] for r in rows.orderBy("pos").collect()] == ["finance", "projects", "custom_tech", "projects_finance", "clarify"]
    nodes, edges = graph.workflow(rows)
    assert graph.invariants(nodes, edges).count() == 0
    loose = spark.createDataFrame([("x", "nowhere", "source")], edges.schema)
    assert {r["kind"] for r in graph.invariants(nodes, edges.unionByName(loose)).collect()} == {"loose edge"}
    with pytest.raises(ValueError):
        graph.route_domains("nope")


def test_reachable_has_no_last_round(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(66)] + [(500, 501), (66, 0)], "source long, target long").coalesce(1)
    got = graph.reachable(edges, spark.createDataFrame([(0,)], "node long").coalesce(1))
    assert {r["node"] for r in got.collect()} == set(range(67))
    assert graph.reachable(edges, spark.createDataFrame([], "node long")).count() == 0


def test_bundle_differences(spark):
    want = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, bytes int, sha256 string")
    have = spark.createDataFrame([("a", 1, "x"), ("b", 2, "n"), ("d", 1, "q")], "path string, bytes int, sha256 string")
    assert {(r["path"], r["error"]) for r in audit.differences(want, have).collect()} == {("b", "content"), ("c", "missing"), ("d", "unlisted")}


def test_every_query_has_its_sql():
    assert set(registry.queries) == set(registry.oracle_sql)


def test_small_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    empty, some = F.array().cast("array<string>"), F.array(F.lit("x"))
    ok = lambda *a, **k: one(metadata.exportable(*a, **k))
    assert ok(empty, empty, F.lit("approved")) and not ok(empty, empty, F.lit("pending")) and ok(empty, empty, F.lit(None), drafts=True) and not ok(some, empty, F.lit("approved"))
    assert one(metadata.available_routes(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"), F.lit("c"))))
    assert one(catalog.overview_kind(F.lit("1 业务流程简介"))) == "primary" and one(catalog.overview_kind(F.lit("操作"))) == "fallback" and one(catalog.overview_kind(F.lit("目录"))) is None
    assert one(corpus.evidence_title(F.lit("t"), F.array(F.lit("目 录\nx"), F.lit("\n目录")))) == "目录"
    assert one(corpus.evidence_title(F.lit("t"), F.array(F.lit("目录"), F.lit("x")))) == "t" and one(corpus.evidence_title(F.lit("t"), empty)) == "t"


def test_region_text(spark):
    schema = "r struct<page:int,text:string,tables:array<struct<rows:array<array<string>>>>,images:array<struct<text:string>>>"
    row = ((2, "正文\x01", [([["a", None], ["b\nc", "d"]],)], [("",), ("识别",)]),)
    got = spark.createDataFrame([row], schema).select(corpus.region_text(F.lit("f.pdf"), F.col("r")).alias("t")).first()["t"].split("\n")
    assert got[0] == "来源：f.pdf，PDF 第2页" and got[1] == "正文�" and got[3:5] == ["a | ", "b / c | d"] and got[-1] == "识别" and len(got) == 7


def test_reuse_and_status(spark):
    tasks = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "page int, run_signature string")
    results = spark.createDataFrame([(1, "complete", "s"), (2, "failed", "s"), (3, "complete", "old")], "page int, status string, run_signature string")
    assert {r["page"]: r["reuse"] for r in inventory.reusable(tasks, results, ["page"]).collect()} == {1: True, 2: False, 3: False}
    sources = spark.createDataFrame([("a", "h", 2), ("b", "h", 1)], "source_id string, sha256 string, pages int")
    pages = spark.createDataFrame([("a", "h", 1, "complete"), ("a", "old", 2, "complete"), ("b", "h", 1, "complete")], "source_id string, sha256 string, page int, status string")
    assert {r["source_id"]: r["built"] for r in corpus.build_status(sources, pages).collect()} == {"a": False, "b": True}
    names = spark.createDataFrame([("a", 10), ("b", 9), ("c", 5), ("d", 1)], "source_id string, pages int")
    assert {r["id"]: r["shard"] for r in inventory.shards(names, "source_id", "pages", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    more = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 4), ("e", 2)], "source_id string, pages int")
    assert {r["id"]: r["shard"] for r in inventory.shards(more, "source_id", "pages", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_toc_and_export(spark):
    toc = spark.createDataFrame([("s", 0, 2, "甲", 1, 800.0, 700.0, True), ("s", 1, 2, "1. 操作步骤", 2, 800.0, 100.0, True), ("s", 2, 3, "乙", 3, 800.0, 0.0, False), ("s", 3, None, "丙", 1, 800.0, 0.0, False), ("s", 4, 2, "丁", 2, 800.0, 700.0, True)], "source_id string, pos int, page int, title string, level int, height double, view_y double, is_xyz boolean")
    got = corpus.toc_boundaries(toc).orderBy("page").collect()
    assert [(r["page"], r["top"], r["title"]) for r in got] == [(1, 0.0, "资料说明与适用范围"), (2, 95.0, "丁")]
    rows = spark.createDataFrame([("s", 1, "标题", [(1, "x", [])])], "source_id string, section_index int, title string, regions array<struct<page:int,text:string,images:array<struct<image_id:string>>>>")
    names = spark.createDataFrame([("s", "手册_V2.1.pdf", "科技项目/手册_V2.1.pdf", "h")], "source_id string, name string, relative_path string, sha256 string")
    r = corpus.export_documents(corpus.chunks(rows).withColumn("domain", F.lit("finance")), names).first()
    assert r["key"] == "s-finance-001" and r["metadata"]["document_version"] == "V2.1" and r["metadata"]["project_type"] == "科技项目" and r["image_count"] == 0


def test_scoped_branches(spark):
    rows = [("s", "1.1 内部"), ("s", "1.1.1 步骤"), ("s", "1.2 外部"), ("s", "2 上市"), ("s", "2.1 步骤"), ("s", "2.2 步骤")]
    got = {(r["title"], r["children"]) for r in graph.scoped_branches(spark.createDataFrame(rows, "source_id string, title string")).collect()}
    assert got == {("1.1 内部", 1), ("2 上市", 2)}


def test_used_categories(spark):
    configured = spark.createDataFrame([("a", "A"), ("b", "B")], "domain string, label string")
    docs = lambda *ds: spark.createDataFrame([(x,) for x in ds], "domain string")
    assert [tuple(r) for r in graph.used_categories(docs("b", "b"), configured).collect()] == [("b", "B")]
    assert graph.used_categories(docs(), configured).count() == 0
    for bad in ("c", None):
        with pytest.raises(Exception, match="no receipt: "):
            graph.used_categories(docs("a", bad), configured, "no receipt: ").collect()


def test_best_rows_are_cut_by_task_and_agree_with_all_pairs(spark):
    """Small batches, copies and ties: what tasks leave out is not among the best, and no more than k rows a query and task are moved."""
    words = ["ab", "cd", "ef", "gh", "ij"]
    rows = [((i % 97, i), " ".join(words[j % 5] for j in range(i % 7, i % 7 + 1 + i % 4))) for i in range(1500)] + [((98, 9999), None)]
    texts = spark.createDataFrame(rows, "id struct<doc_id:long,n:long>, text string").repartition(3)
    asked = spark.createDataFrame([(1, "ab cd"), (2, "ef zz"), (3, "zz"), (4, None)], "query_id long, query string")
    allowed = spark.range(0, 99, 2).withColumnRenamed("id", "doc_id")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        for within in (None, allowed):
            for digits in (9, 1):
                every = retrieval.bm25(texts, asked, "id", "text").withColumn("doc_id", F.col("id.doc_id"))
                every = every.join(allowed, "doc_id", "left_semi") if within is not None else every
                few = retrieval.bm25_best(texts, asked, "id", "text", 4, digits, "id.doc_id", within).withColumn("doc_id", F.col("id.doc_id"))
                found = [sorted(map(tuple, retrieval.parents(x.select("query_id", "doc_id", F.col("id").alias("passage_id"), F.round("score", digits).alias("score")), 4, True).collect())) for x in (every, few)]
                assert found[0] == found[1] and found[0]
                assert few.count() <= 2 * 4 * few.rdd.getNumPartitions()
        v = spark.range(2000).select((F.col("id") % 300).alias("doc_id"), F.col("id").alias("passage_id"), F.array((F.col("id") % 11).cast("double"), F.lit(1.0)).alias("vector")).repartition(2)
        q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
        few = retrieval.dense(v, q, 3)
        found = [sorted(map(tuple, retrieval.parents(x, 3, False).collect())) for x in (retrieval.dense(v, q), few)]
        assert found[0] == found[1] and few.count() <= 2 * 3 * few.rdd.getNumPartitions()
    finally:
        spark.conf.set(key, old)


def test_retrieval_holds_few_texts_at_once(spark):
    """A worker held Arrow batches of 10,000 whole texts, however long these were."""
    from marlstone.operators.sizing import BATCH_ROWS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    docs = spark.range(1500).selectExpr("id as doc_id", "concat('w', id % 7, ' w', id % 300) as text", "array(1.0D + id % 11, 1.0D, 2.0D) as vector").coalesce(1)
    asked = spark.createDataFrame([(1, "w3 w5")], "query_id int, query string")
    vecs = docs.selectExpr("doc_id", "doc_id as passage_id", "vector")
    try:
        for run in (lambda: retrieval.bm25_best(docs, asked, "doc_id", "text", 5), lambda: retrieval.dense(vecs, spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id int, vector array<double>"), 5)):
            spark.conf.set(key, "10000")
            rows = run().count()
            assert rows == 5 and int(spark.conf.get(key)) == BATCH_ROWS
        spark.conf.set(key, "100")  # a smaller value of the session stays
        retrieval.bm25_best(docs, asked, "doc_id", "text", 5).count()
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, kept)
