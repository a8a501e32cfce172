"""Odd tables: nulls, repeated rows, very long texts, empty tables, and columns whose names the operators use themselves."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import chat, mixing, packing, quality, secretscan, topk

NAMES = ["d", "n", "k", "y", "b", "c", "v", "rank", "score", "leaf", "of", "id", "epochs", "cut", "key", "stratum", "s", "base_failed", "mix_copies", "secrets", "keys", "shard", "formatted", "examples", "__key", "__one", "__toxicity", "__leaf", "a.b"]


def wide(df):
    """``df`` with columns of clashing names."""
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES if c not in df.columns])


def test_top_k_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5 * i]) for i in range(40)] + [(3, [3.0, 1.0, -1.5])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = "id % 10 = 0"
    plain = sorted(topk.top_k(df, df.filter(asked)).collect())
    other = df.select("*", *[F.lit("x").alias(c) for c in NAMES if c != "id"])
    assert sorted(topk.top_k(other, other.filter(asked)).collect()) == plain and len(plain) == 20


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary("word_bpe_49k.json")
    rows = [(None, "a b c"), (1, "same text"), (1, "same text"), (2, "word " * 30000), (3, None)]
    got = packing.pack(wide(spark.createDataFrame(rows, "doc_id long, text string")), path).collect()
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want and set(got[0].asDict()) == set(packing._COLUMNS)


def test_quality_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en"), (1, text, "en"), (None, None, None), (2, "a b c " * 40000, "en")]
    got = quality.judge(wide(spark.createDataFrame(rows, "doc_id long, text string, lang string")), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_repeat_words"], r["kept"]) for r in got) == [(0, 0, 0, False), (1, 60, 0, True), (1, 60, 0, True), (2, 120000, 120000, False)]


def test_mixture_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "en", f"src{i % 3}") for i in range(60)] + [(7, "x y", "en", "src1"), (None, "z", None, None), (99, "w " * 50000, "de", "src2")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = wide(plain)
    out = mixing.copies(docs, mixing.plan(docs))
    assert out.columns == [c for c in docs.columns if c != "mix_copies"] + ["mix_copies"]
    count = lambda df: sorted((r["doc_id"] or -1, r["text"], r["mix_copies"]) for r in df.collect())
    assert count(out) == count(mixing.copies(plain, mixing.plan(plain)))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert len(got) == sum(r["mix_copies"] for r in out.collect()) and all(r[c] == f"own {c}" for r in got for c in NAMES)


def test_secrets_of_odd_rows(spark):
    long = "x " * 200000 + "password=hunter2222"
    rows = [(1, long), (2, "secret=abcdef"), (2, "secret=abcdef"), (None, None)]
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string"))
    out = secretscan.scan(docs)
    assert set(out.columns) == set(docs.columns)
    assert sorted((r["doc_id"] or 0, r["secrets"]["spans"]) for r in out.collect()) == [(0, ""), (1, "assign:400000:400019"), (2, "assign:0:13"), (2, "assign:0:13")]
    assert secretscan.scan(docs.limit(0)).count() == 0 and secretscan.redacted(docs.limit(0)).count() == 0
    assert secretscan.redacted(docs).columns == docs.columns


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "q " * 100000), (1, 1, "assistant", "a <|x|> " * 20000), (1, 1, "assistant", "a <|x|> " * 20000), (None, 0, "assistant", "z")]
    out = chat.format_conversations(wide(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert got[1]["loss_chars"] == 2 * 8 * 20000 and got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1
    texts = [r["text"] for r in chat.materialize(out).collect()]
    assert sum(map(len, texts)) == got[1]["formatted_chars"] + got[None]["formatted_chars"] and len(texts) == 3
    # the last turn is the user's: nothing is trained on it, but it is read back
    tail = spark.createDataFrame([(5, 0, "assistant", "x"), (5, 1, "user", "bye")], "conv_id long, turn long, role string, text string")
    rows = chat.expand(chat.format_conversations(tail)).orderBy("whole").collect()
    assert [(r["target"], r["whole"]) for r in rows] == [(0, False), (None, True)] and "bye" in rows[1]["text"] and "bye" not in rows[0]["text"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, stage):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    rows = [(i, text(40), "en", "src1", 1) for i in range(30)] + [(None, None, None, None, None), (None, "a b", None, None, None), (40, "", "en", "src1", 0), (41, text(60000), "de", "src2", 1), (3, "other text of an id", "en", "src1", 1)]
    rows += [rows[5], rows[5]]
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == out.columns
    if stage is corpus_pipeline.pack_sequences:
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in NAMES)
    assert {(r["doc_id"], r["text"]) for r in got} <= {(r[0], r[1]) for r in rows}
    if stage is corpus_pipeline.drop_near_duplicates:
        assert len(got) == len(rows) - 2 and len(re.findall(r"\S+", max(r["text"] or "" for r in got))) > 0
