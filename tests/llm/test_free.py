"""Toxicity, top-k, URL filters, packing, near-dedup, LM scores and secrets against brute force."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import components, lmscore, neardup, packing, secretscan, topk, toxicity, urlfilter


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1600):
        bad = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(40)]
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(40), rng.choice(["nasty", "vile"]))
        rows.append((i, " ".join(text), "zz"))
        labels.append((i, int(bad)))
    rows += [(None, "nasty", None), (7001, None, None), (7002, "", None), (3, rows[3][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string").drop("toxicity")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    got = [(r["doc_id"], r["toxicity"]) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    truth = dict(labels)
    held = [(s >= 0.3, truth[d]) for d, s in got if d in truth and zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(a == bool(b) for a, b in held) / len(held) > 0.97
    empty = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["toxicity"] for r in toxicity.score(docs, empty).collect()} == {0.0}


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_topk(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(50)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (None, rows[0][1]), (903, [0.0] * 8), (904, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.filter("id % 50 = 0 or id = 903"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in ints if i % 50 == 0 or i == 903]:
        s = sorted((-max(min(sum(a * b for a, b in zip(ints[q], v, strict=False)), 2**63 - 1), -(2**63)), i) for i, v in ints.items() if i != q)
        assert got[q] == [(i, -x) for x, i in s[:5]]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    v = rng.integers(-5, 5, (4000, 4)).astype(float)
    v[17] = 500
    block = topk.Block(np.arange(4000), v)
    rows, scores = block.threshold(np.array([1.0, 2.0, 1.0, 1.0]), own=-1, k=1)
    assert block.ids[rows].tolist() == [17] and scores.tolist() == [2500.0]


@pytest.mark.parametrize("n", [1, 3, 300, 3000])
def test_threshold_walks_until_it_is_decided(n):
    rng = np.random.default_rng(2)
    v = rng.integers(-256, 256, (n, 64)).astype(float)
    block = topk.Block(np.arange(n), v)
    for q in [*v[:5], np.zeros(64)]:
        rows, scores = block.threshold(q, own=0, k=5)
        want = sorted((-s, i) for i, s in enumerate(v @ q) if i)[:5]
        assert list(zip(block.ids[rows], scores, strict=True)) == [(i, -s) for s, i in want]


def test_bloom_and_filter(spark):
    listed = spark.createDataFrame([(f"bad{i}.example.com/x",) for i in range(2000)] + [("evil.org/",), (None,)], "key string")
    filt = urlfilter.bloom(listed.filter("key is not null"))
    import xxhash

    h = lambda ks: np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in ks], np.uint64)
    assert urlfilter.may_hold(filt, h([f"bad{i}.example.com/x" for i in range(2000)])).all()
    assert urlfilter.may_hold(filt, h([f"good{i}" for i in range(20000)])).mean() < 0.02
    urls = ["http://a.bad5.example.com/x/y?q", "https://bad5.example.com/z", "HTTP://Sub.EVIL.org:80/any#f", "nope", None, "http://", "http://example.org/en/12", "http://x.de.com/de/1", "http://com/fr/", "http://a.org"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h"), (0, urls[0], "h")], "page_id long, url string, host string").drop("host")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, listed).collect()]
    assert len(got) == 12
    by = {r[0]: r[1:] for r in got if r[0] is not None}
    assert by[0] == ("a.bad5.example.com", "/x/y", None, "block")
    assert by[1] == ("bad5.example.com", "/z", None, "allow")
    assert by[2] == ("sub.evil.org:80", "/any", None, "block")
    assert by[3] == by[4] == by[5] == ("", "", None, "allow")
    assert by[6] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[7] == ("x.de.com", "/de/1", "com/de/", "block") and by[8] == ("com", "/fr/", "com/fr/", "allow") and by[9] == ("a.org", "", None, "allow")
    assert urlfilter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((6, 10)), np.maximum(rng.normal(size=10), 0)
        got = packing.nnls(a, a @ x)
        assert got.min() >= 0 and np.allclose(a @ got, a @ x, atol=1e-6)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary("word_bpe_49k.json")
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " ", "İstanbul ΣΑΣ.", "a.b c,, d . e", "don't it's", "<|startoftext|> x", "\t\x85　y", "3.5 1,000.", "日本語。 x,"]
    texts += [" ".join(word() + rng.choice(["", "", ".", ",", "!"]) for _ in range(rng.randint(1, 900))) for _ in range(150)] + ["w " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(df, path).collect()
    tok, of, seqs = Tokenizer.from_file(path), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(of[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(df.limit(0), path).count() == 0


def near(texts, k, percent):
    table = {65 + i: 97 + i for i in range(26)}
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 8)])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(k)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    star = [word() for _ in range(200)]  # copies that are near to their source but hardly to each other
    for _ in range(60):
        copy = list(star)
        for _ in range(4):
            copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    for _ in range(60):
        copy = list(rng.choice(base))
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [" ".join(base[0])] * 30 + [None, "", "one", "ONE", "one two", " ".join(star), "é É", "é é"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, "x", 0)], "doc_id long, text string, rep int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, k, percent).collect()}
    assert got.pop(None)[2] is True
    want = near(rows, k, percent)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_near_duplicates_shared_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "p q r s t u"), (2, "a b c d e f"), (9, "p q r s t u"), (7, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, 5, 80).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7)}
    assert neardup.near_duplicates(df.limit(0), 5, 80).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 50), (100, 70), (70, 60), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 70: 50, 100: 50}


def test_deep_list_entries_block(spark):
    listed = spark.createDataFrame([("a.b.c.d.e.f.net/",), ("h.net/1/2/3/4/5/6",)], "key string")
    urls = ["https://x.y.a.b.c.d.e.f.net/p", "https://b.c.d.e.f.net/p", "https://h.net/1/2/3/4/5/6/7/8", "https://h.net/1/2/3/4/5", "https://w.h.net/1/2/3/4/5/6/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, listed, rules=()).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "block"}


def test_lm(spark):
    rng = random.Random(8)
    chain = {w: [f"t{(i * 3 + j) % 40}" for j in range(2)] for i, w in enumerate(f"t{i}" for i in range(40))}

    def text(n=200):
        w = ["t0"]
        for _ in range(n):
            w.append(rng.choice(chain[w[-1]]))
        return w

    rows = [(i, " ".join(text())) for i in range(400)]
    mixed = text()
    shuffled = list(mixed)
    rng.shuffle(shuffled)
    probe = [(1000, " ".join(mixed)), (1001, " ".join(shuffled)), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["lm"] for r in lmscore.score(docs, lmscore.train(docs)).collect()}
    assert got[1000]["mean_log_prob"] > got[1001]["mean_log_prob"] + 0.3
    assert got[1000]["log_likelihood"] == pytest.approx(got[1000]["mean_log_prob"] * got[1000]["n_tokens"])
    assert tuple(got[1002]) == tuple(got[1003]) == (0, 0.0, 0.0)
    none = docs.limit(0)
    assert lmscore.score(none, lmscore.train(none)).count() == 0


def test_lm_tells_words_of_a_length_apart(spark):
    common = " ".join(f"w{i:04d} " * 9 for i in range(1100))
    rows = [(1, common), (2, "w0001 qzxj w0002"), (3, "w0001 eeee w0002"), (4, "w0001 eeee w0002 " * 2), (5, "w1099 w0001"), (6, "w1099 w1099 w1098")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words, p = lmscore.train(docs)
    got = {r["doc_id"]: r["lm"] for r in lmscore.score(docs, (words, p)).collect()}
    assert len(words.hashes) == 1100  # grows beyond the network's 1,008 words
    assert got[2]["log_likelihood"] != got[3]["log_likelihood"]
    # all words of two bytes: the listed share and the spelled rest make a distribution
    every = [bytes([a, b]) for a in range(256) for b in range(256)]
    chosen = lmscore.spelling(words, [w for w in every if 32 not in w])
    blank = np.exp(lmscore.spelling(words, [b"ab"]) - words.pairs[[32 * 256 + 97, 97 * 256 + 98]].sum())
    assert 0 < np.exp(chosen).sum() <= blank[0] + 1e-9 <= 1 + 1e-9


def test_lm_scores_do_not_depend_on_where_words_are_looked_up(spark, monkeypatch):
    """Words beyond those that go to workers keep their share: their least count followed the corpus's size."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 20))) for _ in range(6000)]
    weights = [(k + 1) ** -0.5 for k in range(6000)]
    texts = [" ".join(rng.choices(words, weights, k=400)) for _ in range(150)] + ["", None, "once alone " + words[0]]
    rows = [(i, t, "x") for i, t in enumerate(texts + texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lm string").repartition(3)
    ours, p = lmscore.train(docs)
    assert ours.table is None
    want = {r["doc_id"]: r["lm"] for r in lmscore.score(docs, (ours, p)).collect()}
    monkeypatch.setattr(lmscore, "LISTED", 3000)
    fewer, q = lmscore.train(docs)
    assert lmscore.VOCAB <= len(fewer.hashes) <= 3000
    assert len(ours.hashes) == len(fewer.hashes) + fewer.table.count()
    assert np.array_equal(p, q)
    scored = lmscore.score(docs, (fewer, q))
    assert scored.columns == ["doc_id", "text", "lm"]
    got = {r["doc_id"]: r["lm"] for r in scored.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    for k, w in want.items():
        assert got[k]["n_tokens"] == w["n_tokens"]
        assert got[k]["log_likelihood"] == pytest.approx(w["log_likelihood"], abs=2e-6)
        assert got[k]["mean_log_prob"] == pytest.approx(w["mean_log_prob"], abs=2e-6)


def test_lm_trains_on_every_position(spark):
    texts = ["a b c d e", "b a", "", None]
    words, p = lmscore.train(spark.createDataFrame([(x,) for x in texts], "text string"))
    t = lmscore.Trainer(p)
    t.texts(texts, lmscore.Lookup(words))
    assert t.tokens == 7


def test_lm_words_of_batches_are_those_of_texts():
    """All words of an Arrow batch are cut and looked up at once, bytes as they are, wherever the batch was sliced."""
    rng = random.Random(2)
    bits = [b"Ab", b"  ", b"\xc3\x84z", b"\xff", b"\x0b", b"\n", b"\x1c", b"q" * 40, b" x "]
    texts = [None, b"", b" \t ", *[b"".join(rng.choices(bits, k=rng.randrange(3000))) for _ in range(60)], None]
    every = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
    for first, last in ((0, 64), (1, 20), (17, 64), (40, 41), (5, 5)):
        found, sizes = lmscore.words_of(every[first:last])
        want = [lmscore.split(t) for t in texts[first:last]]
        assert found.cast(pa.large_binary()).to_pylist() == [w for ws in want for w in ws]
        assert sizes.tolist() == [len(ws) for ws in want]


@pytest.mark.parametrize("listed", [1 << 20, 1024])
def test_lm_takes_texts_that_are_no_utf8(spark, monkeypatch, listed):
    monkeypatch.setattr(lmscore, "LISTED", listed)
    common = " ".join(f"w{i:04d} " * (5 + i % 7) for i in range(1200))
    rows = [(1, common.encode()), (2, b"w0001 \xff\xfe W0002"), (3, b"\xff"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    model = lmscore.train(docs)
    assert (model[0].table is None) == (listed > 1200)
    got = {r["doc_id"]: r["n_tokens"] for r in lmscore.score(docs, model).select("doc_id", "lm.*").collect()}
    assert got == {1: len(common.split()), 2: 3, 3: 1, 4: 0}


def test_lm_is_a_distribution():
    ids, share = lmscore.vocabulary(np.arange(lmscore.BUCKETS))
    p = lmscore.initial(share)
    row = np.full(lmscore.VOCAB * 5, 3, np.int32)
    at = np.arange(lmscore.VOCAB) * 5 + 2
    row[at] = np.arange(lmscore.VOCAB)
    assert np.exp(lmscore.log_probs(p, row, at)).sum() == pytest.approx(1.0, abs=1e-3)


SECRETS = [
    None,
    "",
    "password = hunter22, PASSWD:'abc', token=\"x/y+z_1\"",
    "secret=secret=aaaaaa token: short api_key:abcdef12",
    "toKen=abcdef1 ſecret=abcdef1 İ token=abcdef1",
    "AKIA" + "A1" * 8 + " akia" + "A1" * 8 + " AKIAABC",
    "x" + "0123456789abcdef" * 2 + "G " + "a" * 23 + " " + "b" * 24,
    "apikey=AKIA" + "Z" * 16 + "0" * 24,
    "passwordpassword=abcdef",
]


def base_spans(t):
    out = []
    for k, (p, ok) in enumerate(
        (
            (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        )
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t or "") if ok(m)]
    return sorted(out)


def test_secrets(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = f"ghp_{body}{secretscan.base62_crc(body)}", f"ghp_{body}000000"
    texts = [*SECRETS, f"see {good} and {bad}."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["secrets"] for r in secretscan.scan(df).orderBy("doc_id").collect()]
    names = ("assign", "access", "hex")
    for t, r in zip(texts, got, strict=True):
        spans = base_spans(t)
        assert tuple(r[:3]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    assert got[-1]["spans"] == f"github:4:{4 + len(good)}"
    clean = [r["text"] for r in secretscan.redacted(df.withColumn("n_chars", F.length("text"))).orderBy("doc_id").collect()]
    assert clean[0] is None and clean[-1] == f"see [SECRET] and {bad}." and clean[2].startswith("[SECRET], PASSWD:'abc', [SECRET]")


def test_word_cache_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    tok = packing.WordTokenizer(packing.vocabulary("word_bpe_49k.json"))
    rng = random.Random(9)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "of", "and", f"x{rng.randrange(500)}", f"w{rng.randrange(9)}é."]) for _ in range(30)) for _ in range(3)] + [""]
        assert [x.tolist() for x in tok.encode_batch(texts)] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(tok.number) < 200


def test_listed_urls_are_made_canonical(spark):
    listed = spark.createDataFrame([("HTTP://Bad.COM:8080/a/b/?q#f",), ("plain.net",), ("other.org//x//",), ("",), (None,)], "key string")
    assert {r["key"] for r in listed.select(urlfilter.canonical(F.col("key")).alias("key")).collect()} == {"bad.com/a/b", "plain.net/", "other.org/x", None}
    urls = ["https://w.bad.com/a/b/c", "https://bad.com/a", "http://PLAIN.net:1/z", "http://other.org/x", "http://long.net/" + "d/" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "hits", "listed", "key", "says")})
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, listed, rules=()).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "block", 4: "allow"}


def test_list_and_lookup_share_one_form(spark):
    listed = spark.createDataFrame([("h.net/a//b",), ("x.example.net./p",), ("http://user:pw@U.org:443//d/",), ("single",), ("deep.org/%61/B",)], "key string")
    urls = {
        "http://h.net/a//b": "block", "http://h.net/a//b/c": "block", "http://h.net/a/b/c?q": "block", "http://h.net/a/c": "allow",
        "http://x.example.net/p/q": "block", "http://w.x.example.net.:80/p/": "block", "http://x.example.net/pq": "allow",
        "http://u.org/d/e": "block", "http://me@v.u.org/d": "block", "http://u.org@evil.net/d": "allow", "http://single/x": "block", "http://a.single/x": "allow",
        "http://deep.org/%61/B/c": "block", "http://deep.org/a/B/c": "allow", "http://deep.org/%61/b": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, listed, rules=()).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["component"] for r in components.components(links).collect()} == {0}


def _plain_model(p, row, place):
    """Hidden units, class and member probabilities of one place, one number at a time."""
    hidden = []
    for u in range(lmscore.HIDDEN):
        x = 0.0
        for i, d in enumerate(d for d in range(-lmscore.REACH, lmscore.REACH + 1) if d):
            x += float(p[i * (lmscore.VOCAB + 1) + row[place + d]][u])
        hidden.append(np.tanh(x))

    def shares(first, n):
        z = [sum(float(p[first + j][u]) * hidden[u] for u in range(lmscore.HIDDEN)) + float(p[first + j][lmscore.HIDDEN]) for j in range(n)]
        e = [np.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    per = lmscore.VOCAB // lmscore.CLASSES
    first = 2 * lmscore.REACH * (lmscore.VOCAB + 1)
    cls = int(row[place]) // per
    return hidden, shares(first, lmscore.CLASSES), cls, shares(first + lmscore.CLASSES + cls * per, per), int(row[place]) % per


def test_lm_against_plain_loops():
    rng = np.random.default_rng(3)
    p = rng.normal(0, 0.3, (lmscore._ROWS, lmscore.HIDDEN + 1)).astype(np.float32)
    row = rng.integers(0, lmscore.VOCAB, 40).astype(np.int32)
    row[:2] = row[-2:] = lmscore.VOCAB
    row[10:14] = 7
    at = np.arange(2, 38)

    def loss(p, places=at):
        out = []
        for x in places:
            _, classes, c, members, m = _plain_model(p, row, x)
            out.append(np.log(classes[c]) + np.log(members[m]))
        return np.array(out)

    assert lmscore.log_probs(p, row, at) == pytest.approx(loss(p), abs=2e-4)
    out, emb, rows = lmscore.Trainer(p).gradient(row, at)
    full = np.zeros((lmscore._ROWS, lmscore.HIDDEN + 1))
    full[rows], full[lmscore._EMB :] = emb, out
    q = p.astype(np.float64)
    some = [(int(row[10]), 3), (lmscore.VOCAB + 1 + int(row[20]), 0), (lmscore._EMB + 2, 5), (lmscore._EMB + 1, lmscore.HIDDEN), (lmscore._EMB + lmscore.CLASSES + 7, 4), (lmscore._EMB + lmscore.CLASSES + int(row[30]), lmscore.HIDDEN)]
    for r, c in some:  # slope of the plain loss
        up, down = q.copy(), q.copy()
        up[r, c] += 1e-4
        down[r, c] -= 1e-4
        assert full[r, c] == pytest.approx(-(loss(up).mean() - loss(down).mean()) / 2e-4, abs=2e-5)
    t = lmscore.Trainer(p)
    t.step(row, at)
    seen = 1e-3 + full**2
    assert t.p == pytest.approx(p - lmscore.RATE * full / np.sqrt(seen), abs=1e-3) and t.tokens == len(at)


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "COPY_TOKENS", 500)
    rng = random.Random(4)
    rows = [(i % 70, " ".join(rng.choice(["a", "b", "c d", "eé", "nine9"]) for _ in range(rng.randint(0, 40))), "x") for i in range(120)] + [(None, "a b", "x"), (None, None, "x"), (5, "long " * 20000, "x"), (5, "long " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lm string")

    def scores(parts):
        df = docs.repartition(parts)
        return sorted((r["doc_id"] or -1, r["text"] or "", tuple(r["lm"])) for r in lmscore.score(df, lmscore.train(df)).collect())

    one = scores(1)
    assert len(one) == len(rows) and one == scores(5)


def test_lm_values_do_not_depend_on_the_texts_around(monkeypatch):
    rng = np.random.default_rng(8)
    p = rng.normal(0, 0.3, (lmscore._ROWS, lmscore.HIDDEN + 1)).astype(np.float32)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 90, n)) for n in (3, 1, 700, 50, 5000, 17)]
    known = sorted({(lmscore.word_hash(b"w%d" % x), x) for x in range(60)})
    words = lmscore.Words(np.array([h for h, _ in known], np.uint64), np.array([x for _, x in known], np.int32), np.zeros(60), np.zeros(16), np.zeros(65536), np.zeros(2))

    def each(some):
        row, at, sizes, _ = lmscore._lay_out(some, lmscore.Lookup(words, spell=True))
        return np.split(lmscore.log_probs(p, row, at), np.cumsum(sizes)[:-1])

    together = each(texts)
    for chunk in (1 << 14, 1000):
        monkeypatch.setattr(lmscore, "_CHUNK", chunk)
        for t, got in zip(texts, together, strict=True):
            assert (each([t])[0] == got).all()
            assert (each(["w1 w70", t, "w3"])[1] == got).all()


def test_lm_hashes_words_of_a_batch_together(monkeypatch):
    """CPU of op6: every distinct word was hashed by a call of its own; now those of 32 bytes or more are."""
    rng = random.Random(7)
    every = [rng.randbytes(n) for n in range(70) for _ in range(20)]
    rng.shuffle(every)
    plain, called = lmscore.word_hash, []
    some = sorted({plain(w) for w in every[::2] if w})
    look = lmscore.Lookup(lmscore.Words(np.array(some, np.uint64), np.arange(len(some), dtype=np.int32), np.zeros(len(some)), np.zeros(16), np.zeros(65536), np.zeros(2)))
    monkeypatch.setattr(lmscore, "word_hash", lambda w: called.append(w) or plain(w))
    found = [w for w in every if w]
    known = {h: i for i, h in enumerate(some)}
    ids, _ = look(pa.array(found, pa.binary()))
    assert ids.tolist() == [known.get(plain(w), lmscore.VOCAB - lmscore.LENGTHS - 1 + min(len(w), lmscore.LENGTHS)) for w in found]
    assert called and min(map(len, called)) == 32
    row, at, sizes, _ = lmscore._lay_out([], look)  # nor do batches without texts fail
    assert len(lmscore.log_probs(np.zeros((lmscore._ROWS, lmscore.HIDDEN + 1), np.float32), row, at)) == len(sizes) == 0
    for first, last in ((0, len(every)), (3, 50), (9, 9)):
        h, sizes = lmscore.word_hashes(pa.array(every, pa.large_binary())[first:last])
        assert h.tolist() == [plain(w) for w in every[first:last]] and sizes.tolist() == [len(w) for w in every[first:last]]


@pytest.mark.parametrize("n", [0, 1, 5000, 1 << 20, (1 << 20) + 3])
def test_lm_order_of_places(n):
    key = (np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)
    assert np.array_equal(lmscore._mixed(n), np.argsort(key, kind="stable"))


@pytest.mark.parametrize("more", [200, -200])
def test_lm_steps_with_large_values(more):
    """Softmax does not depend on what is added to all values, though their exponentials pass the range."""
    rng = np.random.default_rng(9)
    p = rng.normal(0, 0.3, (lmscore._ROWS, lmscore.HIDDEN + 1)).astype(np.float32)
    row = rng.integers(0, lmscore.VOCAB, 604).astype(np.int32)
    row[:2] = row[-2:] = lmscore.VOCAB
    at = np.arange(2, 514)
    q = p.copy()
    q[lmscore._EMB :, lmscore.HIDDEN] += more
    t, u = lmscore.Trainer(p), lmscore.Trainer(q)
    for ours, theirs in zip(t.gradient(row, at), u.gradient(row, at), strict=True):
        assert ours == pytest.approx(theirs, abs=1e-5)
    grown = p.copy()
    grown[lmscore._EMB :] *= 20  # from within the range to beyond it
    t = lmscore.Trainer(grown)
    for _ in range(60):
        t.step(row, at)
        assert np.isfinite(t.p).all() and (np.abs(t.top).sum(axis=1).max() <= t.most + 1e-3)


def test_ftrl_against_a_plain_version():
    from marlstone.llm.ftrl import Ftrl

    rng = random.Random(1)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.4, 0.7
    model, z, n, zb, nb = Ftrl(6, alpha, beta, l1, l2), [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(400):
        x = sorted(rng.sample(range(64), rng.randint(0, 9)))
        y = int(rng.random() < (0.9 if 3 in x else 0.2))
        bias = -zb / ((beta + nb**0.5) / alpha)
        w = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-(sum(w.values()) + bias)))
        assert model.update(np.array(x, np.uint32), y) == pytest.approx(p)
        for i in x:
            rate = ((n[i] + (p - y) ** 2) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += (p - y) - rate * w[i]
            n[i] += (p - y) ** 2
        zb += (p - y) - ((nb + (p - y) ** 2) ** 0.5 - nb**0.5) / alpha * bias
        nb += (p - y) ** 2
    index, values = model.sparse()
    assert dict(zip(index.tolist(), values, strict=True)) == pytest.approx({i: weight(i) for i in range(64) if abs(z[i]) > l1})
    assert 0 < len(index) < 64 and model.bias() == pytest.approx(-zb / ((beta + nb**0.5) / alpha))


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30)) + (" vile" if i % 2 else ""), "x") for i in range(300)]
    rows += [(1, "zz " * 30000, "x"), (1, "zz " * 30000, "x"), (301, "vile " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string").withColumns({c: F.lit("x") for c in ("k", "y", "h", "__k", "__h")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(2, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == docs.columns and got.count() == len(rows)
    scores = {r["doc_id"]: r["toxicity"] for r in got.collect()}
    assert scores[301] > 0.3 and np.mean([scores[i] > 0.3 for i in range(5, 300, 2)]) > 0.9
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert again.index.tolist() == model.index.tolist() and again.weight == pytest.approx(model.weight)


def test_near_duplicates_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4096)
    rng = random.Random(12)
    long = [f"w{rng.randrange(10**6)}" for _ in range(30000)]
    other = long[:15000] + ["new"] + long[15001:]
    rows = [(i, " ".join(long[i * 50 : i * 50 + 200])) for i in range(30)]
    rows += [(100, " ".join(long)), (101, " ".join(other)), (102, " ".join(other)), (102, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rep", "key", "comp", "sig", "size", "c1", "n_shingles")})
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 5, 80).collect()]
    assert sorted(got) == sorted([(i, i, True) for i in range(30)] + [(100, 100, True), (101, 100, False), (102, 100, False), (102, 100, False)])


def test_threshold_bound_holds_and_stops():
    rng = np.random.default_rng(7)
    # components fall off, as those of learned vectors in the order of their spread do
    v = np.floor(256 * rng.normal(size=(5000, 48)) * 0.7 ** np.arange(48))
    block = topk.Block(np.arange(5000), v)
    for q in v[:60]:
        rows, scores = block.threshold(q, own=-1, k=5)
        best = np.sort(v @ q)[::-1][:5]
        assert scores.tolist() == best.tolist()
        a, b = np.abs(q[q != 0]), np.sort(np.abs(rng.normal(200, 100, (q != 0).sum())))
        inside = (np.sign(q[q != 0]) * v[:, q != 0] <= b).all(axis=1)
        assert not inside.any() or block.bound(a, b) >= (v[inside] @ q).max() - 1e-6
    assert block.asked == 60 and block.stopped > 45 and block.met < 0.6 * 60 * 5000


def test_word_tokenizer_starts_no_threads():
    """Tasks keep the cores busy; threads of the library's own took a sixth more CPU seconds."""
    code = """
import os
from marlstone.llm import packing
tok = packing.WordTokenizer(packing.vocabulary("word_bpe_49k.json"))
before = len(os.listdir("/proc/self/task"))
tok.encode_batch([f"word{i} w{i * 7919} some, more. text {i}" for i in range(5000)])
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    root = str(Path(__file__).parents[2])
    env["PYTHONPATH"] = os.pathsep.join([root, env.get("PYTHONPATH", "")])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd=root, check=True)
    assert out.stdout.strip() == "0"
