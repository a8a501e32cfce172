"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

1. One pass over whole texts gives each document's number of distinct word
   shingles, a 128-bit fingerprint of the set, its band keys and a short
   signature (one byte of each minimum).
2. Documents with equal sets form a class; only its smallest id goes on.
3. Classes that share a band key are candidates.  Buckets that hold several
   components are cut into blocks of bounded size, and each pair of blocks is
   compared by itself: pairs of different components whose signatures agree
   enough are verified on full sets, best first, as long as their ends are
   still apart.  Only links that join components leave a block.
4. Components of the links by large-star and small-star.

Steps 3 and 4 run twice: over the first ``WAVE`` bands, which join most groups,
and over the rest, where few buckets are still apart.  A link can be missed only
if no band key of its pair is equal (chance below ``MISS`` at the threshold) or
signatures agree five deviations less than expected; what a link would join is
joined anyway if other links do.

Sets are made again from the texts of candidates alone (picked by a Bloom filter
of bounded size).  No group is gathered in one task and no pairs are emitted.

Defined results: null texts and texts without words have no shingles and are
linked with nothing; texts with fewer words than a shingle are one shingle; rows
that share an id are one document; rows with a null id are linked with nothing
and kept; of equal sets the smallest id stands for all, ties cannot occur; very
long texts are compared whole (a block's sets are bounded in bytes; one that is
larger is a block of its own); other columns, whatever their names, are left out;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, per_worker, small_batches, stash
from .components import components
from .urlfilter import bloom, may_hold

MISS = 1e-6
MAX_HASHES = 192
#: Members of a bucket's block, and bytes of their sets, on average at most: pairs of blocks are compared by themselves.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Bands of the first of two passes.
WAVE = 6
_CACHE_LIMIT = 200_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def plan_bands(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold is missed with a chance below ``MISS``."""
    for rows in range(8, 1, -1):
        bands = int(np.ceil(np.log(MISS) / np.log1p(-(threshold**rows))))
        if bands * rows <= MAX_HASHES:
            return bands, rows
    return MAX_HASHES // 2, 2


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULT[5]
    x = (x ^ (x >> np.uint64(29))) * _MULT[6]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``k`` words (A-Z lower-cased)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: blanks and case of ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(per_worker("shingle-words", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = (x ^ h[i : len(h) - width + 1 + i]) * _MULT[i % 5] + _MULT[7]
        x ^= x >> np.uint64(31)
    return np.unique(_mix(x))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """Least values of ``n`` universal (multiply-add) hashes over the set."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, n, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, n, 16):
        for s in range(0, len(x), 4096):
            part = a[at : at + 16, None] * x[None, s : s + 4096] + b[at : at + 16, None]
            np.minimum(out[at : at + 16], part.min(axis=1), out=out[at : at + 16])
    return out


def sketch(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (fingerprint), bands (array of keys), sig (bytes); null fingerprint for empty sets."""
    n = bands * rows
    order = np.arange(bands, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                x = shingle_set(text, k)
                if not len(x):
                    out.append((0, None, None, None, None))
                    continue
                m = minima(x, n)
                key = order * _MULT[4]
                for col in m.reshape(bands, rows).T:
                    key = _mix(key ^ (col.astype(np.uint64) * _MULT[0]))
                c1, c2 = x.sum(dtype=np.uint64).astype(np.int64), _mix(x ^ _MULT[1]).sum(dtype=np.uint64).astype(np.int64)
                out.append((len(x), int(c1), int(c2), key.astype(np.int64), (m >> np.uint32(24) ^ m & np.uint32(255)).astype(np.uint8).tobytes()))
            cols = ["n_shingles", "c1", "c2", "bands", "sig"]
            frame = pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="Int64" if i < 3 else object) for i, c in enumerate(cols)})
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame
        give_back()

    small_batches(documents.sparkSession)
    ids = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInPandas(run, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sig binary")


def _runs(members: DataFrame, work, out_schema: str) -> DataFrame:
    """``work`` on runs of rows that share ``g``: a frame, its columns as arrays and the runs' (start, end) in; a frame or None out.

    Rows are dealt by ``g`` and read as they come; a run is held whole.  ``g``
    stands for a pair of blocks, so a run has at most about 2 * ``BLOCK`` rows, and sets of about 2 * ``BLOCK_BYTES``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cols = {c: frame[c].to_numpy() for c in frame.columns}
            g = cols["g"]
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(g)], strict=True) if b - a > 1]
            if spans and (found := work(frame, cols, spans)) is not None:
                yield found

        for batch in batches:
            if not len(batch):
                continue
            last = batch["g"].iloc[-1]
            if batch["g"].iloc[0] == last and (not held or held[0]["g"].iloc[0] == last):
                held.append(batch)
                continue
            frame = pd.concat([*held, batch], ignore_index=True) if held else batch
            upto = int((frame["g"] != last).sum())  # rows are sorted by g
            yield from done(frame.iloc[:upto])
            held = [frame.iloc[upto:]]
        if held:
            yield from done(pd.concat(held, ignore_index=True))
        give_back()

    return members.repartition("g").sortWithinPartitions("g").mapInPandas(run, out_schema)


_MEMBER = "g long, blk int, rep long, comp long, sig binary"


def _pairs_to_test(cols: dict, start: int, end: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), counted from the run's start, of a run's pairs that are of different components and agree in ``least`` places, best first."""
    s = np.frombuffer(b"".join(cols["sig"][start:end]), np.uint8).reshape(end - start, -1)
    comp, blk = cols["comp"][start:end], cols["blk"][start:end]
    across = blk.min() != blk.max()  # a pair of blocks: pairs inside one are another run's
    found = []
    for i in range(len(s) - 1):
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((blk[i + 1 :] != blk[i]) | (not across))) + i + 1
        agree = (s[j] == s[i]).sum(axis=1, dtype=np.int16)
        j, agree = j[agree >= least], agree[agree >= least]
        if len(j):
            found.append((agree, np.full(len(j), i, np.int32), j.astype(np.int32)))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    agree, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.argsort(-agree, kind="stable")
    return i[best], j[best]


def _may_link(members: DataFrame, least: int) -> DataFrame:
    """Members (rows of ``_MEMBER``, cut into blocks) that have a pair to test, runs of the same members once.

    ``members``: key, size, shingles (sums of its bucket), rep, comp, sig.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.ceil(F.col("shingles") * 8 / BLOCK_BYTES), F.col("size"))).cast("int")
    cut = members.withColumn("blk", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("g"), "blk", "rep", "comp", "sig")

    def some(frame: pd.DataFrame, cols: dict, spans: list) -> pd.DataFrame | None:
        keep, names = [], []
        for start, end in spans:
            i, j = _pairs_to_test(cols, start, end, least)
            if len(i):
                rows = np.unique(np.concatenate([i, j])) + start
                rows = rows[np.argsort(cols["rep"][rows], kind="stable")]
                # a run is named by what is in it: near copies share most of their buckets, and need to be compared once
                name = xxhash.xxh64_intdigest(cols["rep"][rows].tobytes() + cols["blk"][rows].tobytes())
                keep.append(rows)
                names.append(np.full(len(rows), name, np.uint64).astype(np.int64))
        return frame.take(np.concatenate(keep)).assign(g=np.concatenate(names)) if keep else None

    return _runs(cut, some, _MEMBER).dropDuplicates(["g", "rep"])


def _links(members: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """a, b: verified links that join the runs' components.

    Inside a run pairs are tried in the order of their agreement, and only while
    their ends are in different components; each try compares full sets.
    """

    def linked(cols: dict, start: int, end: int) -> list[tuple]:
        rep, comp = cols["rep"][start:end], cols["comp"][start:end].tolist()
        up = {c: c for c in comp}

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        out = []
        apart = len(up)
        for i, j in zip(*_pairs_to_test(cols, start, end, least), strict=True):
            if apart == 1:
                break
            ci, cj = root(comp[i]), root(comp[j])
            if ci != cj:
                x, y = (np.frombuffer(cols["set"][start + k], np.uint64) for k in (i, j))
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    continue  # sizes alone rule it out
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    up[ci] = cj
                    apart -= 1
                    out.append((rep[i], rep[j]))
        return out

    def links(frame: pd.DataFrame, cols: dict, spans: list) -> pd.DataFrame | None:
        out = [x for start, end in spans for x in linked(cols, start, end)]
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return _runs(members.join(sets, "rep"), links, "a long, b long").distinct()


def _sets(ids: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """rep, set of the documents whose ids (rep) a Bloom filter of bounded size lets through."""
    sent = documents.sparkSession.sparkContext.broadcast(bloom(ids.select(F.col("rep").alias("key")).distinct()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[may_hold(sent.value, batch["h"].to_numpy())]
            yield pd.DataFrame({"rep": batch["doc_id"].to_numpy(), "set": [shingle_set(t, k).tobytes() for t in batch["text"]]})
        give_back()

    rows = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInPandas(run, "rep long, set binary")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    bands, rows = plan_bands(percent / 100)
    n = bands * rows
    s = percent / 100
    least = int(np.floor(n * max(0.0, s - 5 * np.sqrt(s * (1 - s) / n))))
    sketches = stash(sketch(documents, k, bands, rows), "sketches")
    # written first: joined from the aggregation itself, a class of very many copies could not be split
    classes = stash(sketches.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    own = F.col("doc_id") == F.col("rep")
    members = stash(
        sketches.filter("n_shingles > 0").join(classes, ["c1", "c2"]).select("doc_id", "n_shingles", "rep", F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("sig")).alias("sig")),
        "members",
    )
    reps = members.filter(F.col("sig").isNotNull())
    sigs = reps.select("rep", "sig")
    # rows that share an id but not their set are one document
    split = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    links = split.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(members.join(split, "doc_id").filter("rep > lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")))
    comp = documents.sparkSession.createDataFrame([], "node long, component long")
    for first, past in ((0, min(WAVE, bands)), (min(WAVE, bands), bands)):
        if first == past:
            break
        keys = reps.select("rep", "n_shingles", F.explode(F.slice("bands", first + 1, past - first)).alias("key"))
        ends = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
        ends = stash(ends.filter("lo < hi").select("key", "size", "shingles"), "ends")
        shared = stash(_named(keys.join(ends, "key").select("key", "size", "shingles", "rep"), comp, "rep"), "buckets")
        torn = stash(shared.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key"), "torn")
        open_ = stash(_may_link(shared.join(torn, "key", "left_semi").join(sigs, "rep"), least), "open")
        sets = stash(_sets(open_, documents, k), "sets")
        found = stash(_links(open_, sets, least, percent), "links")
        discard(ends, shared, torn, open_, sets)
        links = links.unionAll(found)
        comp = stash(components(links), "components")

    slim = members.select("doc_id", "n_shingles", "rep")
    lone = sketches.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    found = _named(slim.unionAll(lone), comp, "rep").select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    nameless = documents.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionAll(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named(df: DataFrame, comp: DataFrame, node: str) -> DataFrame:
    """``df`` with the component of ``node`` (itself, if it has no link) in ``comp``."""
    return df.join(comp.select(F.col("node").alias("__n"), F.col("component").alias("__c")), F.col(node) == F.col("__n"), "left").withColumn("comp", F.coalesce("__c", node)).drop("__n", "__c")
