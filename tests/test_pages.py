"""The page source: split files, pushed filters, broken files and pages."""

import os
import sys

import pytest
from pyspark import cloudpickle

from marlstone.sources import pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counted(pages.LinePages):
    """Leaves a file behind for every file opened and every page decoded."""

    log = None

    def __init__(self, file):
        super().__init__(file)
        self.first = super().__getitem__(0)["text"].split(":")[0]
        open(f"{self.log}/open-{self.first}-{os.getpid()}-{id(self)}", "w").close()

    def __getitem__(self, i):
        open(f"{self.log}/page-{self.first}-{i + 1}", "x").close()  # a page that is decoded twice fails
        out = super().__getitem__(i)
        if out["text"].endswith("bad"):
            raise ValueError("unreadable")
        return out


@pytest.fixture
def folder(tmp_path):
    os.makedirs(tmp_path / "in/sub")
    for name, n in (("a.txt", 100), ("sub/b.txt", 40), ("sub/C.TXT", 3)):
        (tmp_path / "in" / name).write_text("".join(f"{name.rpartition('/')[2]}:{i}{'bad' if i == 7 else ''}\n" for i in range(n)))
    (tmp_path / "in/broken.txt").write_text(".x\n")
    (tmp_path / "in/other.bin").write_text("x\n")
    (tmp_path / "log").mkdir()
    return tmp_path


def counted(folder):
    return type("Decoder", (Counted,), {"log": str(folder / "log")})


def test_all_pages_and_failures(spark, folder, monkeypatch):
    monkeypatch.setattr(pages, "SPLIT_BYTES", 200)  # a.txt is split into several partitions
    df = pages.read(spark, str(folder / "in"), counted(folder), ".txt")
    assert df.rdd.getNumPartitions() > 3
    got = {(r["relative_path"], r["page"]): r for r in df.collect()}
    assert len(got) == 100 + 40 + 3 + 1 and got["broken.txt", None]["error"] == "ValueError: broken"
    bad = {k for k, r in got.items() if r["status"] == "failed"}
    assert bad == {("broken.txt", None), ("a.txt", 8), ("sub/b.txt", 8)} and got["a.txt", 8]["error"] == "ValueError: unreadable"
    assert got["a.txt", 50]["text"] == "a.txt:49" and got["a.txt", 50]["pages"] == 100 and got["sub/C.TXT", 3]["name"] == "C.TXT"


def test_filters_are_pushed(spark, folder, monkeypatch, capsys):
    monkeypatch.setattr(pages, "SPLIT_BYTES", 200)
    df = pages.read(spark, str(folder / "in"), counted(folder), ".txt")
    asked = df.filter("relative_path = 'a.txt' and page in (3, 50) and page < 60 and width > 0")
    # what the reader takes over is no filter of the plan any more; the rest is
    plan = asked._jdf.queryExecution().executedPlan().toString()
    kept = "\n".join(x for x in plan.splitlines() if "Filter (" in x)
    assert "width" in kept and "relative_path" not in kept and "page" not in kept.replace("pages", "")
    assert sorted((r["page"], r["text"]) for r in asked.collect()) == [(3, "a.txt:2"), (50, "a.txt:49")]
    done = os.listdir(folder / "log")
    assert sorted(x for x in done if x.startswith("page")) == ["page-a.txt-3", "page-a.txt-50"]
    assert all("a.txt" in x for x in done)


def test_bounds_and_nothing(spark, folder):
    df = pages.read(spark, str(folder / "in"), pages.LinePages, ".txt")
    assert df.filter("page >= 39 and page <= 41 and name in ('a.txt', 'b.txt')").count() == 5
    assert df.filter("page is null").count() == 1
    assert df.filter("page = 0 or page = 1000").count() == 0 and df.filter("page > 5 and page < 5").count() == 0
    os.makedirs(folder / "none")
    assert pages.read(spark, str(folder / "none"), pages.LinePages, ".txt").count() == 0
