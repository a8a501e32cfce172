"""The pipeline on a small table: every stage takes effect and keeps clean documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    text = lambda n=60: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(900):
        t = text()
        if i % 3 == 0:
            t = t.replace(" ", " nasty vile ", 2)
        rows.append((i, t, "en", f"src{i % 5}"))
    rows += [(2000 + i, rows[1][1], "en", "src0") for i in range(5)] + [(3000, text() + " password=hunter2222", "de", "src1"), (3001, None, None, None), (3001, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == docs.columns
    ids = {n: [r["doc_id"] for r in df.select("doc_id").collect()] for n, df in seen.items()}
    toxic = {i for i in range(0, 900, 3)}
    assert len(toxic & set(ids["toxicity"])) < 15 and len(set(range(900)) - toxic - set(ids["toxicity"])) < 15
    assert set(ids["near_dedup"]) == set(ids["toxicity"]) - {2000 + i for i in range(5)} and ids["near_dedup"].count(3001) == 1
    assert seen["secrets"].filter("doc_id = 3000").first()["text"].endswith(" [SECRET]")
    assert ids["secrets"] and set(ids["mixing"]) <= set(ids["secrets"]) and set(ids["packing"]) == set(ids["mixing"])
    total = seen["packing"].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count("*"))
    used = {r["doc_id"]: r["c"] for r in seen["mixing"].groupBy("doc_id").agg(F.count("*").alias("c")).collect()}
    assert all(r["n"] == r["doc_tokens"] * used[r["doc_id"]] for r in total.collect())


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_keep_their_texts(spark, tmp_path):
    rng = random.Random(7)
    a, b, c = (" ".join(rng.choice([f"word{i}" for i in range(400)]) for _ in range(80)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, b), (9, b), (9, c), (10, None), (10, ""), (10, None), (None, b)]
    docs = spark.createDataFrame([(*r, "en", "src0", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(str(t) for i, t in got if i is not None) == sorted(["", "None", a, b, c])
    assert set(got) <= set(rows) and (None, b) in got
