"""Encoding by pieces against the library and against merging step by step."""

import hashlib
import random

import pytest
from oracle import TABLES
from pyspark.sql import functions as F

from marlstone.llm import packing, pieces, registry


@pytest.fixture(scope="module")
def path():
    return packing.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder(path):
    return pieces.Encoder(path)


def stepwise(encoder, text):
    """The whole text as one row of symbols: in each step the best pair, of equal ones the leftmost."""
    if not text:
        return []
    symbols = list("▁" + text.replace(" ", "▁"))
    while True:
        found = [(encoder.ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in encoder.ranks]
        if not found:
            break
        i = min(found)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    out = []
    for s in symbols:
        out += [encoder.ids[s]] if s in encoder.ids else [encoder.bytes[b] for b in s.encode()]
    return out


def texts():
    rng = random.Random(11)
    parts = ["hello", "world", " ", "  ", "▁", "\n", "\t", "é", "é", "日本語", "😀", "a", "aaaa", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "'", "1234567", "Ａ", "ﬁ", "​", "﻿", "ß", "don't", "\r\n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return ["", " ", "  ", "   ", "▁", " a", "a ", "ab" * 400, "日" * 3000, " " * 100, *made]


def test_against_stepwise_and_library(encoder):
    for t in texts():
        want = encoder.library.encode(t)
        got, agrees = encoder.batch([t])
        assert got == [want] and agrees == [True], repr(t)
        if len(t) < 300:
            assert stepwise(encoder, t) == want, repr(t)
            whole = "▁" + t.replace(" ", "▁") if t else ""
            # one agenda over the whole text, uncut
            assert [i for s in encoder.merged(whole) for i in encoder.spelled(s)] == want, repr(t)
            assert not t or encoder.merged_together([whole]) == [tuple(want)], repr(t)


def test_rows(spark, path, encoder):
    rows = [(None, None), (1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "word " * 60000), *((10 + i, t) for i, t in enumerate(texts()))]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, ids string").withColumn("pieces", F.lit("old"))
    out = pieces.encode(df, path)
    assert out.columns == df.columns
    for r in out.collect():
        want = encoder.library.encode(r["text"] or "")
        assert (r["pieces"]["ids"], r["pieces"]["decoded"], r["pieces"]["agrees"], r["ids"]) == (want, encoder.library.decode(want), True, "own")
    back = pieces.decode(spark.createDataFrame([([15043],), ([],), (None,)], "ids array<int>"), path)
    assert [r["decoded"] for r in back.collect()] == [encoder.library.decode([15043]), "", None]
    assert pieces.encode(df.limit(0), path).count() == 0


def test_units_are_forgotten(monkeypatch, encoder):
    monkeypatch.setattr(pieces, "KEPT", 20)
    encoder.clear()
    for i in range(30):
        words = [f"w{i}{j}" for j in range(10)]
        t = " ".join(words)
        assert encoder.batch([t])[0] == [encoder.library.encode(t)]
    assert len(encoder.units.young) <= 31 and len(encoder.units.old) <= 31
    encoder.clear()


def test_a_wrong_unit_is_told(encoder, monkeypatch):
    encoder.clear()
    monkeypatch.setattr(encoder, "merged_together", lambda parts: [tuple(encoder.ids.get(c, 0) for c in p) for p in parts])  # no merges at all
    assert encoder.batch(["hello there", "q"])[1] == [False, False] and encoder.batch(["hello"])[1] == [False]
    encoder.clear()


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
def test_query_against_library(spark, encoder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["op11_pieces"](spark, str(TABLES)).collect()
    assert len(got) == len(docs) and all(r["agrees"] for r in got)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = encoder.library.encode(docs[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(encoder.library.decode(ids)))


def test_short_parts_are_numbered_together():
    """Characters of short parts were looked up one by one, and the library was asked for its size for each part."""
    e = pieces.Encoder(packing.vocabulary("piece_bpe_32k.model"))
    asked = []

    class Counted(dict):
        def get(self, *args):
            asked.append(args)
            return dict.get(self, *args)

    e.number = Counted(e.number)
    texts = ["plain words, in short parts", "Ünïcode 漢字 😀 \x00 tail", "", " ", "a" * 23, "zz\U0010ffff", "x  y   "]
    ids, agrees = e.batch(texts)
    assert ids == [list(e.library.encode(t)) for t in texts] and all(agrees)
    assert not asked
    assert list(map("".join, e.cut(["▁ab,cd", "▁", "▁漢字"]))) == ["▁ab,cd", "▁", "▁漢字"] and e.cut([]) == []
