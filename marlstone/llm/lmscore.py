"""LM scoring: masked pseudo-likelihood of a bidirectional window network.

Vocabulary: words are counted over all documents.  The network knows the most
frequent words and, for the others, their length; it predicts each token from
``REACH`` tokens on both sides: position-wise embeddings, tanh, and a softmax in
two steps (class, then member of the class).  A word that stands behind a length
is then told apart from all others of it: listed words (at least ``MIN_COUNT``
occurrences, whatever the corpus's size) by their share of the length's tokens, the
rest by spelling (byte after byte, from the pairs of bytes of all
such words).  The network is trained in numpy: documents are dealt by a hash of
id and text into shards of about ``COPY_TOKENS`` tokens, every shard trains a
copy on all positions of all its texts, and the copies are averaged by the number
of tokens trained (one aggregation of parameter rows, in whole numbers).  The
number of shards follows from the corpus alone, and a token's score does not depend
on the texts that share a batch (``log_probs``), so partitions do not change scores.  A text's score is the sum of the conditional log-probabilities of all
its tokens, to ``PLACES`` places, and its mean is that sum by the number of tokens.

The network has a fixed size.  Listed words are known by their 64-bit hashes: those of
the most frequent, ``LISTED`` at most, and their counts come to the driver, and workers
look words up in sorted arrays of them (20 bytes a word), each distinct word of a batch once.  Listed words beyond these stay in a table, which is joined to the
texts' words: which way a word is looked up does not change a score.  (Only if more
than ``LISTED`` words were as frequent, within a factor of two, as the network's own
would it know fewer of these.)  What is summed
over the corpus (counts, parameter copies) grows with it; tasks add up their own first.

Defined results: null and empty texts have no tokens, a sum and a mean of 0.0;
rows with a null id are trained on and scored like others; repeated rows are
scored each; texts of any length are scored whole (a task holds a few texts at
once); a column ``lm`` of the input is replaced; an empty table trains nothing
and gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, small_batches, stash

#: Pairs of bytes, by which rare words are spelled.
BUCKETS = 1 << 16
MIN_COUNT, LISTED = 5, 1 << 20
VOCAB, CLASSES, LENGTHS = 1024, 16, 16
REACH, HIDDEN = 2, 16
STEP, RATE = 512, 0.15
#: Tokens of a shard, about, and texts laid out at once in it.
COPY_TOKENS, BLOCK_TEXTS = 1 << 20, 256
#: Parameters are summed as whole multiples of this, times sixteenths of tokens.
GRAIN = 2.0**-16
_MEMBERS = VOCAB // CLASSES
#: Words that a task holds before it counts them.
_COUNTED = 1 << 21
#: Places that are ordered together.
_TOGETHER = 1 << 13
#: Tokens scored at once, and the grain of the numbers that are multiplied; places of a score.
_CHUNK, _EXACT, PLACES = 1 << 12, 2.0**-20, 6
#: Corrections by the table of listed words are summed as whole multiples of this.
_FINE = 2.0**-32
#: Values up to which exponentials can be summed as they are.
_SAFE = 80
#: Of XXH64.
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_OFFSETS = [d for d in range(-REACH, REACH + 1) if d]
#: Parameter rows: embeddings by position (one more for beyond the text's ends), classes, members; the last column is a bias.
_EMB = len(_OFFSETS) * (VOCAB + 1)
_ROWS = _EMB + CLASSES + VOCAB


class Words(NamedTuple):
    """What is known of words."""

    #: Of each listed word, in the order of hashes: its hash, token id and log P(word | token).
    hashes: np.ndarray
    ids: np.ndarray
    extra: np.ndarray
    #: log P(spelled | length class), log P(byte | byte before), log P(a word of LENGTHS bytes or more ends, goes on).
    spelled: np.ndarray
    pairs: np.ndarray
    ends: np.ndarray
    #: Listed words that the arrays do not hold (h, delta: what their log P is above the spelled one, in ``_FINE``), if there are any.
    table: DataFrame | None = None

    def sent(self) -> tuple:
        """What goes to workers."""
        return tuple(self._replace(table=None))


word_hash = xxhash.xxh64_intdigest


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a ``large_binary`` array, and where each value begins and the last ends in them."""
    if not len(words):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of words (``large_binary``), and their sizes; those of less than 32 bytes are hashed together."""
    body, ends = _bytes_of(words)
    at, size = ends[:-1].copy(), np.diff(ends)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(body) + 1, "V8", padded, strides=(1,))  # from any byte on
    h = size.astype(np.uint64) + _PRIMES[4]

    def mix(some: np.ndarray, x: np.ndarray, by: int, times: np.uint64, plus: np.uint64) -> None:
        h[some] = _turned(h[some] ^ x, by) * times + plus

    for first in (0, 8, 16):
        some = np.flatnonzero(size >= first + 8)
        mix(some, _turned(eight[at[some] + first].view("<u8") * _PRIMES[1], 31) * _PRIMES[0], 27, _PRIMES[0], _PRIMES[3])
    at += size - size % 8
    some = np.flatnonzero(size % 8 >= 4)
    mix(some, (eight[at[some]].view("<u8") & np.uint64(0xFFFFFFFF)) * _PRIMES[0], 23, _PRIMES[1], _PRIMES[2])
    at[some] += 4
    for i in range(3):
        some = np.flatnonzero(size % 4 > i)
        mix(some, padded[at[some] + i] * _PRIMES[4], 11, _PRIMES[0], np.uint64(0))
    h ^= h >> np.uint64(33)
    h *= _PRIMES[1]
    h ^= h >> np.uint64(29)
    h *= _PRIMES[2]
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = word_hash(words[i].as_py())
    return h, size


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


class Lookup:
    """Token ids, and with ``spell`` log P(word | token), of words; each distinct word of a call is looked up once."""

    def __init__(self, words: Words, spell: bool = False):
        self.words, self.spell = words, spell

    def __call__(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded, w = found.dictionary_encode(), self.words
        new = coded.dictionary.cast(pa.large_binary())
        h, size = word_hashes(new)
        ids = (VOCAB - LENGTHS - 1 + np.minimum(size, LENGTHS)).astype(np.int32)
        known = np.zeros(len(new), bool)
        at = np.zeros(len(new), np.int64)
        if len(w.hashes):
            # looked up in order: neighbours in the arrays are read together
            order = np.argsort(h)
            at[order] = np.minimum(np.searchsorted(w.hashes, h[order]), len(w.hashes) - 1)
            known = w.hashes[at] == h
            ids[known] = w.ids[at[known]]
        where = coded.indices.to_numpy()
        if not self.spell:
            return ids[where], np.empty(0)
        extra = np.zeros(len(new))
        extra[known] = w.extra[at[known]]
        extra[~known] = spelling(w, new.filter(pa.array(~known)).to_numpy(zero_copy_only=False).tolist())
        return ids[where], extra[where]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``split`` gives for all texts, one after the other, and the number of words of each."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    body, ends = _bytes_of(texts)
    # pyarrow's own ascii_lower (23.0) takes a slice's bytes from the wrong place
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(body.tobytes().lower())))
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    found = lists.flatten()
    some = pc.greater(pc.binary_length(found), 0)
    if not pc.all(some).as_py():  # blanks at a text's ends leave empty words
        kept = some.to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        found = found.filter(some)
    return found, sizes


def split(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _byte_pairs(words: list[bytes]) -> np.ndarray:
    """Every byte with the one before it; a blank comes before the first."""
    joined = np.frombuffer(b" " + b" ".join(words), np.uint8).astype(np.int64)
    at = np.flatnonzero(joined[1:] != 32)
    return joined[at] * 256 + joined[at + 1]


def count_words(documents: DataFrame) -> DataFrame:
    """w, n: occurrences of every word in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            found = pc.value_counts(pa.concat_arrays(held))
            parts = [found.field("values").cast(pa.large_binary()).cast(pa.binary()), found.field("counts")]
            for s in range(0, len(found), _CHUNK):
                yield pa.RecordBatch.from_arrays([x.slice(s, _CHUNK) for x in parts], ["w", "n"])

        for batch in batches:
            held.append(words_of(batch["text"])[0])
            rows += len(held[-1])
            if rows >= _COUNTED:
                yield from counted()
                held, rows = [], 0
        if held:
            yield from counted()
        give_back()

    return documents.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def list_words(documents: DataFrame) -> tuple[Words, np.ndarray, int]:
    """The words of all documents, the log share of each token id, and the number of tokens."""
    counts = stash(count_words(documents), "lm-words")
    steps = [MIN_COUNT << j for j in range(48)]
    tokens, *words_from = counts.agg(F.sum("n"), *[F.count_if(F.col("n") >= x) for x in steps]).first()
    tokens = tokens or 0
    # words from here on come to the driver; those between stay in a table
    least = next(x for x, words in zip(steps, words_from, strict=True) if words <= LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pairs of bytes; words not listed by length class; bytes beyond LENGTHS; listed words of the table by length class
        total = np.zeros(BUCKETS + 2 * LENGTHS + 1, np.int64)

        def count(held: list[pa.RecordBatch]) -> None:
            words = pa.concat_arrays([b["w"].cast(pa.large_binary()) for b in held])
            n = np.concatenate([b["n"].to_numpy(zero_copy_only=False) for b in held])
            body, ends = _bytes_of(words)
            size, body = np.diff(ends), body.astype(np.int64)
            before = np.roll(body, 1)
            before[ends[:-1][size > 0]] = 32
            np.add.at(total, before * 256 + body, np.repeat(n, size))
            np.add.at(total, BUCKETS + np.minimum(size, LENGTHS) - 1, n)
            total[BUCKETS + LENGTHS] += (np.maximum(size - LENGTHS, 0) * n).sum()

        held, rows = [], 0
        for batch in batches:
            often = pc.greater_equal(batch["n"], least)
            known = batch.filter(often)
            if len(known):
                h, size = word_hashes(known["w"].cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(size, LENGTHS) - 1), known["n"], pa.array(np.ones(len(h), bool))], ["h", "b", "n", "listed"])
            between = batch.filter(pc.and_(pc.greater_equal(batch["n"], MIN_COUNT), pc.invert(often)))
            if len(between):
                size = np.minimum(pc.binary_length(between["w"]).to_numpy(zero_copy_only=False), LENGTHS).astype(np.int64)
                np.add.at(total, BUCKETS + LENGTHS + size, between["n"].to_numpy(zero_copy_only=False))
            held.append(batch.filter(pc.less(batch["n"], MIN_COUNT)))
            rows += len(held[-1])
            if rows >= _CHUNK:
                count(held)
                held, rows = [], 0
        if held:
            count(held)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int64)), pa.array(some), pa.array(total[some]), pa.array(np.zeros(len(some), bool))], ["h", "b", "n", "listed"])

    # words of one hash and length class count as one
    rows = counts.mapInArrow(run, "h long, b long, n long, listed boolean").groupBy("listed", "h", "b").agg(F.sum("n").alias("n")).toArrow()
    rows = {c: rows[c].to_numpy() for c in rows.column_names}
    other = ~rows["listed"]
    total = np.zeros(BUCKETS + 2 * LENGTHS + 1, np.int64)
    total[rows["b"][other]] = rows["n"][other]
    h, length, n = (rows[c][~other] for c in ("h", "b", "n"))
    h = h.view(np.uint64)
    order = np.lexsort((h, -n))
    h, length, n = h[order], length[order], n[order]
    rest, tabled = total[BUCKETS : BUCKETS + LENGTHS], total[BUCKETS + LENGTHS + 1 :]
    ids, log_share = vocabulary(n, int(rest.sum() + tabled.sum()))
    tail = ids < 0
    of_length = np.bincount(length[tail], n[tail], LENGTHS) + tabled + rest + 1
    extra = np.where(tail, np.log(n / of_length[length]), 0.0)
    ids = np.where(tail, VOCAB - LENGTHS + length, ids).astype(np.int32)
    pairs = total[:BUCKETS].reshape(256, 256) + 1
    ends = np.array([rest[-1] + 1, total[BUCKETS + LENGTHS] + 1])
    log_pairs = np.log(pairs / pairs.sum(axis=1, keepdims=True)).ravel()
    by_hash = np.argsort(h)
    words = Words(h[by_hash], ids[by_hash], extra[by_hash], np.log((rest + 1) / of_length), log_pairs, np.log(ends / ends.sum()))
    if tabled.any():
        words = words._replace(table=stash(_tabled(counts.filter((F.col("n") >= MIN_COUNT) & (F.col("n") < least)), words, of_length), "lm-listed"))
    discard(counts)
    return words, log_share, tokens


def _tabled(counts: DataFrame, words: Words, of_length: np.ndarray) -> DataFrame:
    """h, delta of listed words (w, n) that workers take for spelled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = batch["w"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False)
            if w:
                h, size = word_hashes(batch["w"].cast(pa.large_binary()))
                delta = np.log(n / of_length[np.minimum(size, LENGTHS) - 1]) - spelling(words, w)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.rint(delta / _FINE).astype(np.int64))], ["h", "delta"])

    return counts.mapInArrow(run, "h long, delta long")


def vocabulary(counts: np.ndarray, rest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Token id of each word (-1: by length) and the log share of each token id; ``rest`` counts words that are not listed."""
    top = np.argsort(-counts, kind="stable")[: VOCAB - LENGTHS]
    top = top[counts[top] > 0]
    ids = np.full(len(counts), -1, np.int32)
    ids[top] = np.arange(len(top))
    share = np.ones(VOCAB)
    share[: len(top)] += counts[top]
    share[VOCAB - LENGTHS :] += (counts.sum() - counts[top].sum() + rest) / LENGTHS
    return ids, np.log(share / share.sum())


def initial(log_share: np.ndarray) -> np.ndarray:
    """Parameters whose biases are the tokens' shares."""
    p = np.random.default_rng(5).normal(0, 0.1, (_ROWS, HIDDEN + 1)).astype(np.float32)
    p[:_EMB, -1] = 0
    share = np.exp(log_share).reshape(CLASSES, _MEMBERS)
    p[_EMB : _EMB + CLASSES, -1] = np.log(share.sum(axis=1))
    p[_EMB + CLASSES :, -1] = np.log(share / share.sum(axis=1, keepdims=True)).ravel()
    return p


def _lay_out(texts, look: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of many texts in one row with ``REACH`` blanks between; the tokens' places; the texts' sizes; if ``look`` spells, log P(word | token) of each."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([t and t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
    found, sizes = words_of(texts)
    ids, extra = look(found)
    row = np.full(REACH * (len(sizes) + 1) + len(ids), VOCAB, np.int32)
    # a text's tokens stand behind all tokens before it and a gap for each text
    at = np.arange(len(ids)) + REACH * (1 + np.repeat(np.arange(len(sizes)), sizes))
    row[at] = ids
    return row, at, sizes, extra


def spelling(words: Words, rare: list[bytes]) -> np.ndarray:
    """log P(word | its length class) of words that are not listed."""
    if not rare:
        return np.empty(0)
    size = np.fromiter(map(len, rare), np.int64, len(rare))
    long = np.where(size >= LENGTHS, words.ends[0] + (size - LENGTHS) * words.ends[1], 0.0)
    return words.spelled[np.minimum(size, LENGTHS) - 1] + long + np.add.reduceat(words.pairs[_byte_pairs(rare)], np.cumsum(size) - size)


class _Places:
    """Places to predict, ordered by the class of their token: embedding rows of both sides, classes, members."""

    def __init__(self, order: np.ndarray, rows: np.ndarray, cls: np.ndarray, member: np.ndarray, ends: list[int]):
        self.order, self.rows, self.cls, self.member = order, rows, cls, member
        #: (class, first place, place after the last).
        self.spans = [(c, a, b) for c, (a, b) in enumerate(pairwise(ends)) if a < b]

    @classmethod
    def cut(cls, row: np.ndarray, at: np.ndarray, size: int) -> Iterator[_Places]:
        """``size`` places at a time; they are ordered some steps together."""
        if not len(at):
            return
        some, width = max(1, _TOGETHER // size), len(_OFFSETS)
        # embedding rows of both sides of every place of the row, which are read together
        beside = np.empty((len(row) - 2 * REACH, width), np.uint16)
        for i, d in enumerate(_OFFSETS):
            np.add(row[REACH + d : len(row) - REACH + d], i * (VOCAB + 1), out=beside[:, i], casting="unsafe")
        beside, row = beside.view(f"V{2 * width}").ravel(), row.astype(np.uint16)
        for s in range(0, len(at), some * size):
            here = at[s : s + some * size]
            n = -(-len(here) // size)
            token = row.take(here)
            key = np.repeat(np.arange(n, dtype=np.uint16), size)[: len(here)] * CLASSES + token // _MEMBERS
            order = np.argsort(key, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n * CLASSES))])
            token = token.take(order)
            of = token // _MEMBERS
            member, of = (token - of * _MEMBERS).astype(np.intp), of.astype(np.intp)
            rows = np.ascontiguousarray(beside.take(here.take(order) - REACH).view(np.uint16).reshape(-1, width).T)
            rows = rows.astype(np.intp)
            for i in range(n):
                a, b = i * size, min((i + 1) * size, len(here))
                yield cls(order[a:b] - a, rows[:, a:b].ravel(), of[a:b], member[a:b], (ends[i * CLASSES : (i + 1) * CLASSES + 1] - a).tolist())

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The embedding rows that occur, where each begins in the third array, and there the places of each, in order."""
        n = len(self.cls)
        bits = np.uint32(n.bit_length())
        # row and place are sorted as one number
        both = (self.rows.astype(np.uint32).reshape(-1, n) << bits | np.arange(n, dtype=np.uint32)).ravel()
        both.sort()
        rows = both >> bits
        first = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
        return rows[first].astype(np.intp), first, (both & np.uint32((1 << int(bits)) - 1)).astype(np.intp)

    def hidden(self, embeddings: np.ndarray) -> np.ndarray:
        """Hidden units of each place."""
        h = embeddings.take(self.rows, axis=0).reshape(len(_OFFSETS), -1, HIDDEN).sum(axis=0)
        return np.tanh(h, out=h)


def log_probs(p: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(token | both sides) at the places ``at``.

    Hidden units and weights are rounded to multiples of ``_EXACT``, so that their
    sums of products are exact in double precision: what a place gets does not
    depend on the order in which they are summed, nor on the places around it.
    """
    out, embeddings = np.empty(len(at), np.float64), np.ascontiguousarray(p[:_EMB, :HIDDEN])
    # units are held as whole multiples of the grain, so weights are multiplied by it once more
    exact = np.rint(p[_EMB:] * np.float32(1 / _EXACT)).astype(np.float64) * _EXACT**2
    heads, body = exact[:CLASSES], np.split(exact[CLASSES:], CLASSES)
    room = np.empty(_MEMBERS * _CHUNK)
    for s, x in zip(range(0, len(at), _CHUNK), _Places.cut(row, at, _CHUNK), strict=True):
        h = x.hidden(embeddings)
        h *= np.float32(1 / _EXACT)
        t = np.empty((HIDDEN + 1, len(h)))
        t[:HIDDEN], t[HIDDEN] = np.rint(h, out=h).T, 1 / _EXACT
        members = np.empty((_MEMBERS, len(h)), np.float32)
        for c, a, b in x.spans:
            members[:, a:b] = np.dot(body[c], t[:, a:b], out=room[: _MEMBERS * (b - a)].reshape(_MEMBERS, -1))
        total = np.zeros(len(h))
        for z, chosen in (((heads @ t).astype(np.float32), x.cls), (members, x.member)):
            z -= z.max(axis=0)
            total += z.ravel().take(chosen * len(h) + np.arange(len(h)))
            total -= np.log(np.exp(z, out=z).sum(axis=0))
        out[s + x.order] = total
    return out


class Trainer:
    """One copy of the network, trained by Adagrad in small steps."""

    def __init__(self, start: np.ndarray):
        #: Embeddings, whose biases are never used; classes and members with their biases; what each has seen.
        self.emb, self.top = start[:_EMB, :HIDDEN].copy(), start[_EMB:].copy()
        self.unused = start[:_EMB, HIDDEN:]
        self.seen_emb, self.seen_top = np.full(self.emb.shape, 1e-3, np.float32), np.full(self.top.shape, 1e-3, np.float32)
        self.tokens, self.most = 0, np.inf
        #: Views of what a step reads and writes, and room that steps use again.
        self.heads, self.body_t = self.top[:CLASSES], [b.T for b in np.split(self.top[CLASSES:], CLASSES)]
        self.weights = self.top[:, :HIDDEN].copy()
        self.body = np.split(self.weights[CLASSES:], CLASSES)
        self.out, self.room = np.empty_like(self.top), np.empty_like(self.top)
        self.body_out = np.split(self.out[CLASSES:], CLASSES)
        self.emb_rows, self.seen_rows = _whole_rows(self.emb), _whole_rows(self.seen_emb)
        self.h = np.ones((STEP, HIDDEN + 1), np.float32)
        self.members, self.ones, self.at = np.empty((STEP, _MEMBERS), np.float32), np.ones(_MEMBERS, np.float32), np.arange(STEP)
        self.back, self.more = np.empty((STEP, HIDDEN), np.float32), np.empty((STEP, HIDDEN), np.float32)

    @property
    def p(self) -> np.ndarray:
        return np.concatenate([np.concatenate([self.emb, self.unused], axis=1), self.top])

    def gradient(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean loss at the places, ``STEP`` at most: for classes and members; for embeddings, and their rows."""
        out, emb, rows = self._gradient(next(_Places.cut(row, at, STEP)))
        return out, np.pad(emb, ((0, 0), (0, 1))), rows

    def _gradient(self, x: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x.cls)
        h, members, back, more, out = self.h[:n], self.members[:n], self.back[:n], self.more[:n], self.out
        h[:, :HIDDEN] = units = x.hidden(self.emb)
        for c, a, b in x.spans:
            np.dot(h[a:b], self.body_t[c], out=members[a:b])
        classes = np.dot(self.heads, h.T)
        safe = self._safe()
        # softmax less what is right, of the mean loss
        for z, axis, right in ((classes, 0, x.cls * n + self.at[:n]), (members, 1, self.at[:n] * _MEMBERS + x.member)):
            if not safe:
                z -= z.max(axis=axis, keepdims=True)
            np.exp(z, out=z)
            total = z.sum(axis=0) if axis == 0 else (z @ self.ones)[:, None]
            z *= 1 / (total * n)
            z.ravel()[right] -= np.float32(1 / n)
        out.fill(0)
        np.dot(classes, h, out=out[:CLASSES])
        np.dot(classes.T, self.weights[:CLASSES], out=back)
        for c, a, b in x.spans:
            z = members[a:b]
            np.dot(z.T, h[a:b], out=self.body_out[c])
            np.dot(z, self.body[c], out=more[a:b])
        back += more
        units *= units
        back *= np.subtract(1, units, out=units)
        rows, first, places = x.by_row()
        # two numbers are added at a time
        emb = np.add.reduceat(back.view(np.complex64).take(places, axis=0), first, axis=0).view(np.float32)
        return out, emb, rows

    def _safe(self) -> bool:
        """Whether no value of the next step is beyond ``_SAFE``: units are 1 at most, and a step moves no weight by more than ``RATE``."""
        if self.most > _SAFE:
            self.most = np.abs(self.top).sum(axis=1).max()
        safe = self.most <= _SAFE
        self.most += RATE * (HIDDEN + 1)
        return safe

    def step(self, row: np.ndarray, at: np.ndarray) -> None:
        self._step(next(_Places.cut(row, at, STEP)))

    def _step(self, x: _Places) -> None:
        out, emb, rows = self._gradient(x)
        _adagrad(self.top, self.seen_top, out, self.room)
        self.weights[:] = self.top[:, :HIDDEN]
        p, seen = self.emb.take(rows, axis=0), self.seen_emb.take(rows, axis=0)
        _adagrad(p, seen, emb, np.empty_like(emb))
        self.emb_rows[rows], self.seen_rows[rows] = _whole_rows(p), _whole_rows(seen)
        self.tokens += len(x.cls)

    def texts(self, texts, look: Lookup) -> None:
        row, at, _, _ = _lay_out(texts, look)
        for x in _Places.cut(row, at[_mixed(len(at))], STEP):
            self._step(x)


def _whole_rows(x: np.ndarray) -> np.ndarray:
    """Rows of a matrix as single values, which are written faster."""
    return x.view(f"V{x.itemsize * x.shape[1]}").ravel()


def _adagrad(p: np.ndarray, seen: np.ndarray, slope: np.ndarray, room: np.ndarray) -> None:
    """A step of ``p`` against ``slope``; ``room`` is written over."""
    np.multiply(slope, slope, out=room)
    seen += room
    np.sqrt(seen, out=room)
    np.divide(slope, room, out=room)
    room *= RATE
    p -= room


def _mixed(n: int) -> np.ndarray:
    """An order of n places by the high bits of a hash of each, equal ones as they come."""
    low, at = np.uint64(20), np.arange(n, dtype=np.uint64)
    key = at * np.uint64(0xD6E8FEB86659FD93) >> low
    if n > 1 << 20:
        return np.argsort(key, kind="stable")
    both = key << low | at  # sorted as one number, which is faster
    both.sort()
    return (both & np.uint64((1 << 20) - 1)).astype(np.intp)


_COLS = [f"p{i}" for i in range(HIDDEN + 1)]


def train(documents: DataFrame) -> tuple[Words, np.ndarray]:
    """The words, and the parameters.  ``documents``: text, and doc_id where there is one."""
    spark = documents.sparkSession
    small_batches(spark)
    words, log_share, tokens = list_words(documents)
    start = initial(log_share)
    sent = spark.sparkContext.broadcast((words.sent(), start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = sent.value
        look = Lookup(Words(*known))
        total, weight = np.zeros((_ROWS, HIDDEN + 1), np.int64), 0
        shard, held, rows, t = None, [], 0, Trainer(start)

        def close() -> None:
            nonlocal total, weight
            if held:
                t.texts(pa.concat_arrays(held), look)
            if t.tokens:
                share = -(-t.tokens // 16)
                total += np.rint(t.p.astype(np.float64) * (share / GRAIN)).astype(np.int64)
                weight += share

        for batch in batches:
            shards = batch["shard"].to_numpy()
            first = 0
            while first < len(shards):
                if shards[first] != shard:
                    close()
                    shard, held, rows, t = shards[first], [], 0, Trainer(start)
                # those of the shard come one after the other
                some = batch["text"].slice(first, min(np.searchsorted(shards, shard, "right") - first, BLOCK_TEXTS - rows))
                held.append(some.cast(pa.large_string(), safe=False))
                first, rows = first + len(some), rows + len(some)
                if rows == BLOCK_TEXTS:
                    t.texts(pa.concat_arrays(held), look)
                    held, rows = [], 0
        close()
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_ROWS)), pa.array(np.full(_ROWS, weight)), *map(pa.array, total.T.copy())], ["r", "n", *_COLS])
        give_back()

    shards = max(1, -(-tokens // COPY_TOKENS))
    named = documents.select(F.col("doc_id") if "doc_id" in documents.columns else F.lit(None).alias("doc_id"), "text")
    key = F.xxhash64("doc_id", "text")
    dealt = named.select("doc_id", "text", key.alias("h"), F.pmod(key, F.lit(shards)).alias("shard"))
    # a task streams through its shards and adds them up: no more tasks than keep the cluster busy
    tasks = min(2 * shards, max(512, 4 * spark.sparkContext.defaultParallelism))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "doc_id", "text")
    parts = dealt.select("shard", "text").mapInArrow(run, "r long, n long, " + ", ".join(f"{c} long" for c in _COLS))
    rows = parts.groupBy("r").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _COLS]).toPandas().sort_values("r")
    if len(rows):
        start = (rows[_COLS].to_numpy() / rows[["n"]].to_numpy() * GRAIN).astype(np.float32)
    return words, start


def score(documents: DataFrame, model: tuple[Words, np.ndarray]) -> DataFrame:
    """``documents`` with a struct column ``lm``: n_tokens, log_likelihood (the sum) and mean_log_prob."""
    small_batches(documents.sparkSession)
    words = model[0]
    sent = documents.sparkSession.sparkContext.broadcast((words.sent(), model[1]))
    tabled = words.table is not None

    @F.arrow_udf("n_tokens long, log_likelihood double, mean_log_prob double")
    def lm(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, p = sent.value
        look = Lookup(Words(*known), spell=True)
        for batch in texts:
            row, at, sizes, extra = _lay_out(batch, look)
            each = log_probs(p, row, at) + extra
            total, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
            if len(some):
                total[some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
            if not tabled:
                total = np.round(total, PLACES)
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(total), pa.array(total / np.maximum(sizes, 1))], ["n_tokens", "log_likelihood", "mean_log_prob"])
        give_back()

    if not tabled:
        return documents.withColumn("lm", lm("text"))
    return _corrected(documents, lm("text"), words.table, sent)


def _corrected(documents: DataFrame, lm: Column, table: DataFrame, sent) -> DataFrame:
    """``documents`` with ``lm``, where words of ``table`` have their share in place of their spelling.

    Equal texts are corrected together: what their words add is summed in whole numbers
    over all copies and divided by the number of these.
    """

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = sent.value[0][0]
        for batch in batches:
            for key, found in zip(batch["__key"], batch["text"], strict=True):
                some = Counter(split(found))
                h, _ = word_hashes(pa.array(list(some), pa.large_binary()))
                n = np.fromiter(some.values(), np.int64, len(some))
                new = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] != h if len(hashes) else np.ones(len(h), bool)
                if new.any():
                    yield pd.DataFrame({"__key": key, "h": h[new].view(np.int64), "n": n[new]})

    keyed = documents.withColumn("__key", F.md5(F.col("text").cast("binary")))
    texts = keyed.select("__key", F.col("text").cast("binary").alias("text")).filter("text is not null")
    sums = texts.mapInPandas(met, "__key string, h long, n long").join(table, "h").groupBy("__key").agg(F.sum(F.col("n") * F.col("delta")).alias("__sum"))
    copies = texts.groupBy("__key").agg(F.count("*").alias("__copies"))
    more = sums.join(copies, "__key").select("__key", (F.expr("__sum div __copies") * F.lit(_FINE)).alias("__more"))
    total = F.round(F.col("lm.log_likelihood") + F.coalesce("__more", F.lit(0.0)), PLACES)
    whole = F.struct(F.col("lm.n_tokens").alias("n_tokens"), total.alias("log_likelihood"), (total / F.greatest("lm.n_tokens", F.lit(1))).alias("mean_log_prob"))
    return keyed.withColumn("lm", lm).join(more, "__key", "left").withColumn("lm", whole).select(*[c for c in keyed.columns if c not in ("__key", "lm")], "lm")
