"""Sources, sinks, snapshots and streams on temporary folders."""

import hashlib
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.operators import retrieval
from marlstone.sources import files, remote, sinks, snapshots
from marlstone.streaming import events


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def pages(content):
        if content == b"bad":
            raise ValueError("broken")
        return 3

    got = {r["relative_path"]: r for r in files.scan(spark, str(tmp_path), page_count=pages).collect()}
    assert set(got) == {"d/a.PDF", "b.pdf"}
    assert (got["d/a.PDF"]["pages"], got["d/a.PDF"]["status"]) == (3, "ok")
    assert got["b.pdf"]["status"] == "error" and "broken" in got["b.pdf"]["error"]
    assert got["d/a.PDF"]["source_id"] == got["d/a.PDF"]["sha256"][:16]
    assert files.directory_size(spark, str(tmp_path)).first()["files"] == 3


def test_json_and_docx(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"a": 1}), encoding="utf-8-sig")
    assert [r["a"] for r in files.read_json(spark, str(tmp_path), "a int").collect()] == [1]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w" xmlns:a="a"><w:t>he</w:t><w:t>llo</w:t><a:blip/></w:d>')
    assert files.docx_text((tmp_path / "d.docx").read_bytes()) == ("hello", 1)


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "t", "one"), ("b", "t", "t", "two")], "doc_id string, topic string, title string, content string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def encode(texts):
        for t in texts:
            (calls / str(abs(hash(t)))).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    root = str(tmp_path / "index")
    first = snapshots.build_index(docs, retrieval.passages(docs), encode, root)
    assert (first["passages"], first["embedded"], first["dimension"]) == (2, 2, 2)
    again = snapshots.build_index(docs, retrieval.passages(docs), encode, root)
    assert again["unchanged"] and again["snapshot"] == first["snapshot"]
    less = docs.filter("doc_id = 'b'")
    second = snapshots.build_index(less, retrieval.passages(less), encode, root)
    assert (second["passages"], second["embedded"]) == (1, 0)
    with pytest.raises(snapshots.StaleIndex):
        snapshots.open_index(spark, root, docs=docs)

    def broken(texts):
        return []

    more = docs.withColumn("content", F.concat("content", F.lit("!")))
    with pytest.raises(PySparkException):
        snapshots.build_index(more, retrieval.passages(more), broken, root)
    assert snapshots.current(spark, root)["snapshot"] == second["snapshot"]
    assert snapshots.open_index(spark, root, docs=less)[1].count() == 1


def test_bundles_of_any_length_are_files(spark, tmp_path):
    """A bundle was one row, which ends at 2 GB."""
    rows = [("m", 2, "b"), ("m", 1, "ä"), ("m", None, "first"), ("m", 3, None), ("m", 2, "a"), (None, 1, "x"), ("void", 1, None), ("e", 1, ""), ("e", 2, "z")]
    rows += [("long", i, f"{i} " * 50) for i in range(700)]
    cards = spark.createDataFrame(rows, "module string, pos int, text string").repartition(5)
    got = sinks.write_bundles(cards, f"file://{tmp_path}/b", "module", "pos", "text")
    assert got.columns == ["module", "path", "bytes", "md5"]
    want = {r["module"]: r["bundle"] for r in sinks.bundles(cards, "module", "pos", "text").collect()}
    found = got.collect()
    assert len(found) == len(want) == 5
    for r in found:
        content = Path(r["path"]).read_bytes()
        assert content.decode() == want[r["module"]]
        assert (r["bytes"], r["md5"]) == (len(content), hashlib.md5(content).hexdigest())
    bad = spark.createDataFrame([("m", 1, sinks.SEPARATOR)], cards.schema)
    with pytest.raises(PySparkException):
        sinks.write_bundles(bad, f"file://{tmp_path}/c", "module", "pos", "text")


def test_sinks(spark, tmp_path):
    cards = spark.createDataFrame([("m", 2, "b"), ("m", 1, "a")], "module string, pos int, text string")
    assert sinks.bundles(cards, "module", "pos", "text").first()["bundle"] == f"a\n{sinks.SEPARATOR}\nb"
    bad = spark.createDataFrame([("m", 1, sinks.SEPARATOR)], cards.schema)
    with pytest.raises(PySparkException):
        sinks.bundles(bad, "module", "pos", "text").collect()
    sinks.package({"x/one.docx": b"1"}, str(tmp_path / "p.zip"))
    assert zipfile.ZipFile(tmp_path / "p.zip").namelist() == ["x/one.docx"]
    with pytest.raises(ValueError):
        sinks.package({"../x": b""}, str(tmp_path / "q.zip"))
    assert sinks.server_bundle({"a": b"1"}, str(tmp_path / "b.tgz"))[0][:2] == ("a", 1)
    assert "&lt;b&gt;" in sinks.html_report(spark.createDataFrame([("<b>",)], "x string"), "t")
    link = sinks.signed_link("http://h", "a b.png", "key", now=100)
    sign = link.split("signature=")[1]
    assert sinks.link_holds("a b.png", 3700, sign, "key", now=200) and not sinks.link_holds("a b.png", 3700, sign, "key", now=4000)
    rows = spark.createDataFrame([("finance", "x/one.docx"), ("nav", "flow.docx")], "domain string, path string")
    assert [r["package_path"] for r in sinks.portable_paths(rows, {"finance": "财务核算"}).collect()] == ["财务核算/one.docx", "资料导航/flow.docx"]


def test_paged_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("page=")[1].split("&")[0])
            body = json.dumps({"data": [{"id": f"i{page}", "name": "n"}], "has_more": page < 3}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(remote.PagedSource)
    got = spark.read.format("paged_rest").option("urls", f"http://127.0.0.1:{server.server_port}/x").load()
    assert sorted(r["id"] for r in got.collect()) == ["i1", "i2", "i3"]
    server.shutdown()


def test_event_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    log = spark.range(206).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("info").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    log.filter("event_id < 200").write.mode("append").parquet(src)
    events.append(events.read(spark, src), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 200
    log.filter("event_id >= 200").write.mode("append").parquet(src)
    events.append(events.read(spark, src), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 206


def test_job_state_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    from test_operators import STORIES

    steps = [(j, i, r) for j, (story, _) in enumerate(STORIES) for i, r in enumerate(story.split())]
    spark.createDataFrame(steps, "job_id long, event_id long, request string").write.parquet(src)
    stream = events.job_states(spark.readStream.schema("job_id long, event_id long, request string").parquet(src))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["job_id"], r["state"]) for r in spark.table("states").collect()} == {(j, end) for j, (_, end) in enumerate(STORIES)}


def test_follow_ends_with_a_short_batch(spark, tmp_path):
    src, ck, seen = str(tmp_path / "src"), str(tmp_path / "ck"), []
    log = spark.range(250).select(F.col("id").alias("event_id"))
    log.filter("event_id < 200").write.parquet(src)
    stream = events.after_cursor(spark.readStream.schema("event_id long").parquet(src), 49)
    state = iter([False, True])

    def terminal():
        done = next(state)
        if done:
            log.filter("event_id >= 200").write.mode("append").parquet(src)
        return done

    events.follow(stream, terminal, lambda df, i: seen.extend(r["event_id"] for r in df.collect()), ck, batch=100, poll=0)
    assert sorted(seen) == list(range(50, 250))


def test_office_files(spark, tmp_path):
    from marlstone.sources import office

    docs = spark.createDataFrame([("k", ["标题 <1>", "a\nb & c"])], "key string, paragraphs array<string>")
    content = office.render(docs).first()["content"]
    assert files.docx_text(bytes(content)) == ("标题 <1>ab & c", 0)
    book = office.xlsx(["key", "n"], [("a<b", 1), (None, 2.5)])
    (tmp_path / "m.xlsx").write_bytes(book)
    sheet = zipfile.ZipFile(tmp_path / "m.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and "a&lt;b" in sheet and 'autoFilter ref="A1:B3"' in sheet


def test_sqlite(spark, tmp_path):
    import sqlite3

    from marlstone.sources import database

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table jobs (id integer, name text, share real)")
        db.execute("insert into jobs values (1, 'a', 0.5), (2, null, null)")
    spark.dataSource.register(database.SqliteSource)
    got = spark.read.format("sqlite").option("path", str(tmp_path / "x.db")).option("table", "jobs").load().orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 0.5), (2, None, None)]


def test_reports(spark):
    from marlstone.operators import graph
    from marlstone.sources import reports

    assert "| 财务核算 | 2 | 3 |" in reports.upload_guide(spark.createDataFrame([("finance", 1), ("finance", 2)], "domain string, image_count int"))
    assert "retrieve-finance" in reports.workflow_yaml(*graph.workflow(graph.routes(spark, ["finance"])))
    images = spark.createDataFrame([("c", str(i), 1) for i in range(11)] + [("d", "x", None), ("d", "y", 9**9)], "chunk_id string, image_id string, bytes long")
    assert {tuple(r) for r in reports.image_bundle_errors(images).collect()} == {("c", "too many images"), ("d", "missing image"), ("d", "image too large")}
    names = spark.createDataFrame([("j", f"n{i}") for i in range(7)], "job string, name string")
    assert tuple(reports.error_names(names, "job", "name").first()) == ("j", "n0、n1、n2、n3、n4", 7)
    js, md = reports.figures(total=names.groupBy("job").count())
    assert '"count": 7' in js and "count: 7" in md


def test_models(spark):
    from marlstone.operators import models

    df = spark.createDataFrame([("a b",), ("c",)], "text string")
    v = [r["v"] for r in df.select(models.encoder(models.hashed_encoder(8))("text").alias("v")).collect()]
    assert len(v) == 2 and len(v[0]) == 8
    with pytest.raises(PySparkException):
        df.select(models.encoder(lambda: lambda t: [[0.0]] * len(t))("text")).collect()
    score = models.reranker(lambda: lambda q, p: [float(len(x)) for x in p])
    assert sorted(r["s"] for r in df.select(score(F.lit("q"), "text").alias("s")).collect()) == [1.0, 3.0]
    with pytest.raises(PySparkException):
        df.select(models.reranker(lambda: lambda q, p: [float("nan")] * len(p))("text", "text")).collect()
    images = spark.createDataFrame([("i", bytearray(b"x"))], "image_id string, content binary")
    lines = models.read_images(images, lambda: lambda c: [{"text": "t", "score": 0.5, "polygon": [[0, 1], [2, 3]]}]).first()["lines"]
    assert lines[0]["bbox"] == [0.0, 1.0, 2.0, 3.0]


def test_categories(spark):
    from marlstone.operators import categories

    none = spark.createDataFrame([], "id string, name string")
    one = categories.create(spark, none, " 新类 ")
    assert categories.all_categories(spark, one).count() == 10
    for bad in ("", "a/b", "CON", "新类", "财务核算", "x" * 51):
        with pytest.raises(ValueError):
            categories.create(spark, one, bad)
    key = one.first()["id"]
    assert categories.rename(spark, one, key, "别名").first()["name"] == "别名"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, domain string")
    assert [r["domain"] for r in categories.set_value(rows, {"id": 2}, domain="c").orderBy("id").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        categories.set_value(rows, {"id": 2}, nope="c")
    assert [r["id"] for r in categories.delete(rows, rows.filter("id = 1"), "id").collect()] == [2]


def test_command_line(spark, tmp_path, capsys):
    from marlstone.__main__ import main

    docs = spark.createDataFrame([("a", "t", "one", "alpha beta", "s", "detail", ["d"], "one"), ("b", "t", "two", "gamma", "s", "detail", ["e"], "two")], "doc_id string, topic string, title string, content string, source_id string, kind string, domains array<string>, section_title string")
    docs.write.parquet(f"{tmp_path}/docs")
    main(["index", f"{tmp_path}/docs", f"{tmp_path}/index"])
    main(["search", f"{tmp_path}/index", "gamma", "--engine", "bm25"])
    assert "gamma" in capsys.readouterr().out


def test_command_line_steps(spark, tmp_path, capsys):
    from marlstone.__main__ import main

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    def run(command, *args):
        main([command, *args, "--out", f"{tmp_path}/out-{command}"])
        return spark.read.parquet(f"{tmp_path}/out-{command}").collect()

    sources = table("sources", [("s", "h", "p", "n", 3, "ok"), ("t", "h", "p", "n", 2, "error")], "source_id string, sha256 string, path string, name string, pages int, status string")
    assert [r["page"] for r in run("plan", sources)] == [1, 2, 3]
    pages = table("pages", [("s", 1, "n", "m", "问题描述：q\n解决办法：a"), ("s", 2, "n", "m", "1.1.1 甲\n一")], "source_id string, page int, name string, module string, text string")
    assert [r["card_id"] for r in run("cards", pages)] == ["faq-s-p001"] and [r["number"] for r in run("procedures", pages)] == ["1.1.1"]
    cards = table("cards", [("c", [], [], "pending")], "card_id string, validation_issues array<string>, review_flags array<string>, business_review string")
    assert [r["included"] for r in run("export", cards)] == [False] and [r["included"] for r in run("export", cards, "--include-drafts")] == [True]
    manifest = table("manifest", [("k", "a.docx", "h")], "key string, name string, content_hash string")
    receipts = table("receipts", [], "key string, document_id string, hash string, metadata_applied boolean, retired_at string")
    remote = table("remote", [], "name string, document_id string, status string")
    assert [r["action"] for r in run("sync", manifest, receipts, remote)] == ["create"]
    results = table("results", [(1, "a", 1), (2, "b", 2)], "query_id int, doc_id string, rank int")
    expected = table("expected", [(1, ["a"]), (2, ["b"])], "query_id int, expected array<string>")
    assert [(r["hit_at_1"], r["mrr_at_5"]) for r in run("evaluate", results, expected)] == [(0.5, 0.75)]
    main(["report", results])
    assert "<th>query_id</th>" in capsys.readouterr().out


def test_settings_and_waiting():
    from marlstone.operators import metadata, sync

    values = metadata.updated_settings({"api_key": "k", "x": "1"}, {"api_key": " ", "x": "", "base_url": "http://h/ "})
    assert values == {"api_key": "k", "base_url": "http://h"} and metadata.public_settings(values) == {"base_url": "http://h", "api_key_configured": True}
    answers = iter([False, False, True])
    assert sync.wait_until(lambda: next(answers), lambda: None, 5, 0.01)
    assert not sync.wait_until(lambda: False, lambda: None, 0.05, 0.01)

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sync.wait_until(lambda: False, stop, 5, 1)


def test_single_file_uploads_and_clashes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    assert [(r["name"], r["relative_path"]) for r in files.scan(spark, str(tmp_path / "a.pdf")).collect()] == [("a.pdf", "a.pdf")]
    good = spark.createDataFrame([("x\\a.PDF",)], "name string")
    assert files.uploads(good).first()["relative"] == "x/a.PDF"
    for bad in ("../a.pdf", "/a.pdf", "a.txt"):
        with pytest.raises(PySparkException):
            files.uploads(spark.createDataFrame([(bad,)], "name string")).collect()
    clash = spark.createDataFrame([("finance", "x/one.docx"), ("finance", "y/one.docx")], "domain string, path string")
    with pytest.raises(PySparkException):
        sinks.portable_paths(clash, {"finance": "财务核算"}).collect()
    (tmp_path / ".env").write_text("# no\nMARLSTONE_A = 'x y'\nMARLSTONE_B=2\n")
    assert files.load_env(str(tmp_path / ".env")) == {"MARLSTONE_A": "x y", "MARLSTONE_B": "2"}
    (tmp_path / "cases.yaml").write_text("cases:\n- [a, dev, answer, 3, q, []]\n- {id: b, split: holdout, query: r, expected: [x]}\n")
    assert [(r["id"], r["page"], r["expected"]) for r in files.load_cases(spark, str(tmp_path / "cases.yaml")).collect()] == [("a", 3, []), ("b", None, ["x"])]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from marlstone.operators import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(master="spark://h:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        scratch.shared_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_bundle_parts(spark):
    rows = [(g, i // 2, "x" * (i * 7 % 23)) for g in ("a", None) for i in range(200)] + [("b", 1, "y" * 500), ("b", 2, None), ("b", 3, "z"), ("c", None, "")]
    cards = spark.createDataFrame(rows, "module string, pos int, text string")
    parts = sinks.bundle_parts(cards.repartition(5), "module", "pos", "text", 100).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r["module"] or "", r["part"])):
        whole.setdefault(r["module"], []).append(r["bundle"])
        assert len(whole[r["module"]]) == r["part"]
    mark = f"\n{sinks.SEPARATOR}\n"
    for g, found in whole.items():
        want = [t or "" for _, _, t in sorted(((x[0], -1 if x[1] is None else x[1], x[2] or "") for x in rows if x[0] == g), key=lambda x: x[1:])]
        assert mark.join(found).split(mark) == want
        assert all(sum(map(len, f.split(mark)[:-1])) <= 100 for f in found)
    assert len(whole["b"]) == 2 and set(whole) == {"a", "b", "c", None}
    assert sinks.bundle_parts(cards.limit(0), "module", "pos", "text", 100).count() == 0
    with pytest.raises(Exception, match="reserved separator"):
        sinks.bundle_parts(spark.createDataFrame([("a", 1, sinks.SEPARATOR)], "module string, pos int, text string"), "module", "pos", "text", 10).collect()


def test_decoded_rows_of_many_files_and_of_a_large_one(spark):
    """Rows of small files share a batch, those of a large file take several; broken and missing contents are a row each."""

    def many(content):
        if content is None or content.startswith(b"."):
            raise ValueError("broken")
        return [{"text": str(i), "width": 1, "images": [{"bbox": [0, 1, 2, 3], "content": content}]} for i in range(int(content))]

    rows = [(f"s{i}", str(i % 4).encode()) for i in range(900)] + [("big", b"2500"), ("bad", b"."), ("none", None)]
    made = files.decode_pages(spark.createDataFrame(rows, "source_id string, content binary").coalesce(1), many)
    found = {r[0]: tuple(r)[1:] for r in made.groupBy("source_id").agg(F.count("*"), F.max("page"), F.max("status"), F.max(F.col("images")[0]["bbox"][3])).collect()}
    assert len(found) == 675 + 3
    assert found["big"] == (2500, 2500, "complete", 3.0) and found["s7"] == (3, 3, "complete", 3.0)
    assert found["bad"] == found["none"] == (1, None, "failed", None)
