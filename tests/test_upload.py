"""Sending with receipts: retried tasks, broken runs, changed contents."""

import os
import subprocess
import sys
import time

import pytest

from pyspark import cloudpickle
from pyspark.sql import functions as F

from marlstone.sources import upload

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLAN = "key string, action string, document_id string, name string, domain string, content_hash string"


class DiesOnce(upload.FolderStore):
    """Creates the document of a key and is gone before it can say so: the worker ends, once."""

    def put(self, row):
        out = super().put(row)
        mark = f"{self.root}/died-{row['key']}"
        if row["key"] in ("k07", "k33") and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(3)
        return out


def plan(spark, n=60, hash_="h1"):
    return spark.createDataFrame([(f"k{i:02d}", "create", None, f"n{i}", "d", hash_) for i in range(n)] + [("k98", "skip", None, "x", "d", "h"), ("k99", "defer", None, "y", "d", "h")], PLAN)


def puts(root):
    return sorted(os.listdir(f"{root}/store/puts"))


RETRY = """
import sys
import time
sys.path[:0] = [{repo!r}, {tests!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pyspark import cloudpickle
from pyspark.sql import functions as F
import test_upload as t
cloudpickle.register_pickle_by_value(t)
t.upload.send(t.plan(spark), t.DiesOnce({root!r} + "/store"), {root!r} + "/journal", workers=2)
print("RECEIPTS", t.upload.receipts(spark, {root!r} + "/journal").filter("metadata_applied").count())
print("RUNS", [tuple(r)[1:] for r in t.upload.runs(spark, {root!r} + "/journal").collect()])
"""


def test_a_task_that_dies_sends_nothing_twice(tmp_path):
    """Task retries need a master that allows them, so this runs in a process of its own."""
    here = os.path.dirname(os.path.abspath(__file__))
    code = RETRY.format(repo=os.path.dirname(here), tests=here, root=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "RECEIPTS 60" in out.stdout, out.stderr[-2000:]
    assert len(puts(tmp_path)) == 60 and all(p.endswith("-0.json") for p in puts(tmp_path))
    assert os.path.exists(tmp_path / "store/died-k07") and os.path.exists(tmp_path / "store/died-k33")
    assert "'committed', 2" in out.stdout


class Refuses(upload.FolderStore):
    def put(self, row):
        if row["key"] in ("k05", "k06"):
            raise ConnectionError("busy")
        return super().put(row)


def test_a_broken_run_keeps_receipts_and_is_resumed(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Exception, match="busy"):
        upload.send(plan(spark), Refuses(f"{root}/store"), f"{root}/journal", workers=1)
    first = len(puts(root))
    assert 18 <= first < 60 and upload.receipts(spark, f"{root}/journal").count() == first
    upload.send(plan(spark), upload.FolderStore(f"{root}/store"), f"{root}/journal")
    assert len(puts(root)) == 60 and all(p.endswith("-0.json") for p in puts(root))
    assert [(r["state"]) for r in upload.runs(spark, f"{root}/journal").orderBy("run").collect()] == ["aborted", "committed"]
    # all is proven: nothing is sent; new content replaces the documents that receipts name
    upload.send(plan(spark), upload.FolderStore(f"{root}/store"), f"{root}/journal")
    assert len(puts(root)) == 60
    upload.send(plan(spark, 3, "h2"), upload.FolderStore(f"{root}/store"), f"{root}/journal")
    told = {r["key"]: r for r in upload.receipts(spark, f"{root}/journal").collect()}
    assert len(puts(root)) == 63 and told["k01"]["hash"] == "h2" and told["k10"]["hash"] == "h1" and all(r["metadata_applied"] for r in told.values())


class Undescribed(upload.FolderStore):
    def describe(self, document_id, row):
        raise TimeoutError("no answer")


def test_metadata_alone_is_sent_again(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Exception, match="no answer"):
        upload.send(plan(spark, 5), Undescribed(f"{root}/store"), f"{root}/journal", workers=1)
    told = upload.receipts(spark, f"{root}/journal").collect()
    assert len(told) == 5 and not any(r["metadata_applied"] for r in told)
    upload.send(plan(spark, 5), upload.FolderStore(f"{root}/store"), f"{root}/journal")
    assert len(puts(root)) == 5 and len(os.listdir(f"{root}/store/described")) == 5


def test_what_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="one to four"):
        upload.send(plan(spark), upload.FolderStore(str(tmp_path)), str(tmp_path), workers=5)
    empty = spark.createDataFrame([], PLAN)
    upload.send(empty, upload.FolderStore(f"{tmp_path}/s"), f"{tmp_path}/j")
    assert upload.receipts(spark, f"{tmp_path}/j").count() == 0


class RefusesEarly(upload.FolderStore):
    """Refuses one document at once; all others take their time."""

    def put(self, row):
        if row["key"] == "k05":
            raise ConnectionError("busy")
        time.sleep(0.01)
        return super().put(row)


def test_nothing_is_sent_beside_the_run_that_follows_a_broken_one(spark, tmp_path):
    root = str(tmp_path)
    rows = plan(spark, 1200)
    with pytest.raises(Exception, match="busy"):
        upload.send(rows, RefusesEarly(f"{root}/store"), f"{root}/journal", workers=4)
    upload.send(rows, upload.FolderStore(f"{root}/store"), f"{root}/journal", workers=4)
    assert len(puts(root)) == 1200 and all(p.endswith("-0.json") for p in puts(root))
    assert [r["state"] for r in upload.runs(spark, f"{root}/journal").orderBy("run").collect()] == ["aborted", "committed"]


def files(root):
    return [os.path.join(d, x) for d, _, names in os.walk(root) for x in names]


def test_a_journal_is_merged_and_says_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upload, "MERGE", 28)
    journal = upload.Journal(str(tmp_path), "000001-a", 0, 1)
    told = {}
    for i in range(0, 1000, 5):
        keys = [f"k{j:03d}" for j in range(i, i + 5)]
        journal.write("asked", [{"key": k} for k in keys])
        for applied in (False, True):
            sure = [k for k in keys if not k.endswith("7") and not (applied and k.endswith("3"))]
            journal.write("receipt", [{"key": k, "document_id": f"d{k}", "hash": "h", "metadata_applied": applied} for k in sure])
            told |= {k: (f"d{k}", applied) for k in sure}
    assert len(files(tmp_path)) < 60  # of 600 notes
    unsure = {f"k{i:03d}" for i in range(7, 1000, 10)}
    again = upload.Journal(str(tmp_path), "000001-a", 0, 2)
    assert again.before() == (told, unsure)
    # a merge that was broken off leaves notes beside the merged file, or half of one under another name
    kept = {path: open(path, "rb").read() for path in journal.small}
    journal.merge()
    assert not journal.small and again.before() == (told, unsure)
    for path, data in kept.items():
        with open(path, "wb") as f:
            f.write(data)
    with open(f"{journal.folder}/_1-999.json.gz", "wb") as f:
        f.write(b"\x1f\x8b half")
    assert kept and again.before() == (told, unsure)
    rows = upload.receipts(spark, str(tmp_path)).collect()
    assert {r["key"]: (r["document_id"], r["metadata_applied"]) for r in rows} == told


class RefusesOne(upload.LedgerStore):
    """Refuses one document until it is told otherwise."""

    def put(self, row):
        if row["key"] == "k600" and not os.path.exists(f"{self.root}/open"):
            raise ConnectionError("busy")
        return super().put(row)


def test_many_documents_take_few_files(spark, tmp_path):
    root = str(tmp_path)
    store = RefusesOne(f"{root}/store")
    store.create()
    rows = plan(spark, 1200)
    with pytest.raises(Exception, match="busy"):
        upload.send(rows, store, f"{root}/journal")
    open(f"{root}/store/open", "w").close()
    upload.send(rows, store, f"{root}/journal")
    sent = [line for path in files(f"{root}/store/puts") for line in open(path)]
    described = [line for path in files(f"{root}/store/described") for line in open(path)]
    assert len(sent) == len(set(sent)) == 1200 and len(described) == len(set(described)) == 1200
    assert upload.receipts(spark, f"{root}/journal").filter("metadata_applied").count() == 1200
    # before: a file for each put and each description, and three for every twenty
    assert len([x for x in files(root) if x.endswith((".json", ".json.gz"))]) < 200
    # what a task of the broken run left is shared by all of the next
    last = max(os.listdir(f"{root}/journal/receipts"))
    assert len(os.listdir(f"{root}/journal/receipts/{last}")) > 1


def test_a_ledger_tells_what_a_dead_worker_put(tmp_path):
    row = {"key": "1", "name": "n", "domain": "d", "action": "create", "document_id": None, "content_hash": "h"}
    dead = upload.LedgerStore(str(tmp_path))
    for i in range(30_000):
        dead._add(f"puts/{upload._document(row)[1]}", {"document_id": f"x{i:060d}"})
    assert upload.LedgerStore(str(tmp_path)).find(row) is None
    assert dead.put(row) == upload.LedgerStore(str(tmp_path)).find(row)  # nothing was closed
    assert upload.LedgerStore(str(tmp_path)).find(row | {"name": "other"}) is None


def test_a_written_plan_gives_its_shuffles_back(spark, tmp_path):
    from marlstone.operators.scratch import swept

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in str(disk.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    kept = names()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with swept(spark):
        assert spark.conf.get(setting) == "true"
        rows.write.parquet(f"{tmp_path}/a")
    assert spark.conf.get(setting) == "false"
    for _ in range(50):
        if names() <= kept:
            break
        time.sleep(0.1)
    assert names() <= kept
    rows.write.parquet(f"{tmp_path}/b")  # the same rows again
    assert spark.read.parquet(f"{tmp_path}/b").count() == 7 and not names() <= kept
