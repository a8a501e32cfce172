"""Fill-in-middle against a plain version, for texts in one batch and for long ones in chunks."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import fim


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    rng = random.Random(3)
    parts = ["ab", "P", "<", "<P", ">", "é", "日", "😀", " ", "Zz", "\n", "word", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 63, 64, 65, 200, 2000])))) for i in range(300)]
    rows += [(None, None), (None, "abc <P x"), (7, "x" * 70000), (8, "é" * 70000), (9, "a b " * 40000), (9, "a b " * 40000), (11, "z z " * 30000 + "<M>")]
    # a sentinel and a run of letters across the ends of chunks
    return rows + [(12, "<S" * 40000 + "M>"), (13, "." * 1023 + "<P>" + "." * 80000), (14, "." * 1000 + "run" * 30000 + " end")]


@pytest.mark.parametrize("giant", [1 << 9, 1 << 16, 1 << 20])
def test_against_plain(spark, monkeypatch, giant):
    monkeypatch.setattr(fim, "CHUNK", 1 << 10)
    monkeypatch.setattr(fim, "GIANT", giant)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "own f", "own key") for r in rows], "doc_id long, text string, f string, key string").repartition(3)
    out = fim.transform(df.withColumn("fim", F.lit("old")))
    assert out.columns == [*df.columns, "fim"]
    got = out.withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert Counter((r["doc_id"], r["text"], *r["fim"]) for r in got) == Counter((i, t, *plain(i, t)) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") and r["f"] == "own f" and r["key"] == "own key" for r in got)
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    out = fim.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "fim"]


def test_composition_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (fim.functions(rng.integers(0, 6, (50, 7)).astype(np.uint8)) for _ in range(3))
    left, right = a.then(b).then(c), a.then(b.then(c))
    assert (left.to == right.to).all() and (left.count == right.count).all()


def test_functions_are_what_a_walk_counts():
    text = "ab<P>c <S <M> x<<S>"
    found = fim.functions(fim.classes(text)[None, :])
    assert found.count[0, fim.OUTSIDE] % fim.SENTINEL == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
    assert found.count[0, fim.OUTSIDE] // fim.SENTINEL == 3
    # entered behind "<P", a ">" ends a sentinel; entered in a run, its letters start nothing
    assert fim.functions(fim.classes("> a")[None, :]).count[0, fim.MARKED] // fim.SENTINEL == 1
    assert fim.functions(fim.classes("abc")[None, :]).count[0].tolist() == [1, 0, 1, 0]
