"""Packing token sequences into windows with counts from non-negative least squares.

Documents are tokenized whole and cut into windows of ``WINDOW`` tokens; what is
left of each is a piece shorter than a window.  Blocks of documents are packed
in one pass, where they are read: the pieces' lengths, in units of ``UNIT``
tokens, give a histogram; combinations of at most ``DEPTH`` lengths that fill a
window are enumerated once; non-negative least squares finds how often to repeat
each so that the histogram is used up; counts are rounded down and the
combinations filled with real pieces.  Pieces that a rounded plan leaves over
are packed greedily: they fill the gaps that rounding lengths leaves in the
windows, then windows of their own, cut where a window ends.  What is left in
the end is carried to the next block, and at the end of a partition cut into
sequences of powers of two, so no sequence is padded.

Nothing is shuffled or collected and memory is bounded by a block, whatever the
partition holds.  Sequence ids are unique: partition number and a counter.

Defined results: null and empty texts are the end token alone; a null id stays
null; repeated rows are packed each; very long texts are cut into windows, and
their ids are held once (a block ends with the text that fills it); columns
beyond doc_id and text are left out, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back, per_worker, small_batches

WINDOW, UNIT, DEPTH = 4096, 128, 6
END_ID = 2
#: Bounds of a block: documents and tokens held at once.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 2_000_000
#: Bounds of a worker's memory of words: words, and token ids.
CACHE_WORDS, CACHE_IDS = 300_000, 3_000_000


class WordTokenizer:
    """Token ids of texts for tokenizers that lower-case, drop blanks and never join across them.

    Ids are looked up by blank-separated chunk and only new chunks go through
    the tokenizer, words of letters many at a time: each ends at its only token
    with the mark of a word's end.  To have fewer chunks, texts are lower-cased
    first and full stops and commas set apart, unless a text has letters or
    punctuation for which that could matter.
    """

    def __init__(self, path: str):
        # tasks keep the cores busy; threads inside each only cost more
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the chunks that were met more than once since the last time; all go if these are many themselves."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > CACHE_WORDS // 2:
            self.clear()
            return
        words = list(self.number)
        flat, sizes = self._join(keep), self.sizes[keep]
        self.clear()
        for i in keep:
            self.number[words[i]] = len(self.number)
        self.flat, self.sizes, self.starts, self.uses = flat, sizes, np.cumsum(sizes) - sizes, np.ones(len(keep), np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        sizes = np.zeros(len(new), np.int64)
        plain = [i for i, c in enumerate(new) if c.isalpha()]
        other = [i for i, c in enumerate(new) if not c.isalpha()]
        parts = self._encode([" ".join([new[i] for i in plain[at : at + 1000]]) for at in range(0, len(plain), 1000)])
        plain_ids = np.fromiter(chain.from_iterable(parts), np.uint32)
        last = np.flatnonzero(self.ends[plain_ids])
        if len(last) != len(plain) or (len(plain) and last[-1] != len(plain_ids) - 1):
            plain, other, plain_ids, last = [], list(range(len(new))), plain_ids[:0], last[:0]
        rest = self._encode([new[i] for i in other])
        sizes[plain] = np.diff(last, prepend=-1)
        sizes[other] = [len(x) for x in rest]
        order = np.array(plain + other, np.int64)
        starts = np.zeros(len(new), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order] + len(self.flat)
        self.flat = np.concatenate([self.flat, plain_ids, np.fromiter(chain.from_iterable(rest), np.uint32)])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self._forget()
        look = self.number.__getitem__
        rows = []
        for t in texts:
            if _PLAIN.fullmatch(t) and is_normalized("NFC", t):
                t = t.lower()
                if _stops_end_words(t):
                    t = t.replace(".", " .").replace(",", " ,")
                chunks = t.split()
            else:
                chunks = _BLANK.split(t)
            rows.append(np.fromiter(map(look, chunks), np.int64, len(chunks)))
        if self.number.new:
            self._learn()
        if rows:
            met = np.bincount(np.concatenate(rows), minlength=len(self.number))
            met[: len(self.uses)] += self.uses
            self.uses = met
        return [self._join(k) for k in rows]

    def _join(self, k: np.ndarray) -> np.ndarray:
        size = self.sizes[k]
        ends = np.cumsum(size)
        out = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[k] - ends + size, size)
        return self.flat[out]


class _Numbers(dict):
    """chunk -> its number, in order of first look-up; ``new`` has those not yet learned."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


_BLANK = re.compile("[ \n]+")
#: Characters whose lower case is the same alone and in a word, to be sure, and no blanks but the usual.
_PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
#: A full stop or comma that is not just after a word and before a blank.
_MIXED = re.compile(r"[.,][^ \n]|[^\w \n][.,]|[ \n][.,]|^[.,]")


def _stops_end_words(t: str) -> bool:
    """Whether every full stop and comma stands just after a word and before a blank."""
    if _SIMPLE.fullmatch(t):
        for c in ".,":
            n = t.count(c)
            if n and (n != t.count(c + " ") + t.count(c + "\n") + t.endswith(c) or t.count(" " + c) + t.count("\n" + c) + t.startswith(c)):
                return False
        return True
    return not _MIXED.search(t)


#: Small letters, blanks, full stops and commas.
_SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f \n.,]*")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def combinations() -> np.ndarray:
    """Columns: how many pieces of 1, 2, ... units each way to fill a window takes (``DEPTH`` pieces at most)."""
    return per_worker("combinations", _enumerate)


def _enumerate() -> np.ndarray:
    total, out = WINDOW // UNIT, []

    def grow(left: int, most: int, parts: list[int]) -> None:
        if left == 0:
            out.append(np.bincount(parts, minlength=total + 1)[1:])
        elif len(parts) < DEPTH:
            for p in range(min(left, most), 0, -1):
                if p * (DEPTH - len(parts)) < left:
                    break
                grow(left - p, p, [*parts, p])

    grow(total, total, [])
    return np.array(out, np.float64).T


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative x with least |ax - b| (active set method)."""
    x, passive, w = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), a.T @ b
    tol = 1e-9 * max(1.0, np.abs(w).max(initial=0.0))
    for _ in range(rounds):
        free = np.where(passive, -np.inf, w)
        j = int(free.argmax())
        if free[j] <= tol:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0.0
                x[p] = s
                break
            low = s <= 0
            step = np.min(x[p][low] / np.maximum(x[p][low] - s[low], 1e-300))
            x[p] += step * (s - x[p])
            passive[p[x[p] <= 1e-10]] = False
            x[~passive] = 0.0
            if not passive.any():
                break
        w = a.T @ (b - a @ x)
    return x


class Packer:
    """Packs blocks of (doc_id, ids) and yields rows of pieces."""

    def __init__(self, first_id: int):
        self.next_id = first_id
        self.loose: deque = deque()  # pieces (doc_id, ids, start, length) to fill gaps with
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length in pieces:
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), self.next_id, offset))
            offset += length
        self.next_id += 1

    def _fill(self, pieces: list[tuple], goal: int) -> bool:
        """Cut or extend ``pieces`` to ``goal`` tokens and emit them; False if there is too little."""
        room, out = goal, []
        source = deque(pieces)
        if sum(p[3] for p in pieces) + self._loose_tokens() < goal:
            self.loose.extend(pieces)
            return False
        while room:
            doc_id, ids, start, length = (source or self.loose).popleft()
            take = min(room, length)
            out.append((doc_id, ids, start, take))
            if take < length:
                self.loose.appendleft((doc_id, ids, start + take, length - take))
            room -= take
        self._emit(out)
        self.loose.extend(source)
        return True

    def _loose_tokens(self) -> int:
        total = 0
        for p in self.loose:
            total += p[3]
            if total >= WINDOW:
                break
        return total

    def block(self, docs: list[tuple]) -> list[tuple]:
        bins: list[list[tuple]] = [[] for _ in range(WINDOW // UNIT + 1)]
        for doc_id, ids in docs:
            whole = len(ids) // WINDOW * WINDOW
            for start in range(0, whole, WINDOW):
                self._emit([(doc_id, ids, start, WINDOW)])
            if len(ids) > whole:
                piece = (doc_id, ids, whole, len(ids) - whole)
                bins[max(1, round(piece[3] / UNIT))].append(piece)
        a = combinations()
        x = nnls(a, np.array([len(b) for b in bins[1:]], np.float64))
        counts = np.floor(x + 1e-6).astype(int)
        plan = [(np.repeat(np.arange(1, len(bins)), a[:, c].astype(int)), counts[c]) for c in np.argsort(-x, kind="stable") if counts[c]]
        chosen = []
        for parts, n in plan:
            need = np.bincount(parts, minlength=len(bins))
            for _ in range(n):
                if any(len(bins[p]) < need[p] for p in set(parts.tolist())):
                    break
                chosen.append([bins[p].pop() for p in parts])
        for b in reversed(bins):
            self.loose.extend(b)
        for pieces in chosen:
            self._fill(pieces, WINDOW)
        while self._fill([], WINDOW):
            pass
        return self._take()

    def end(self) -> list[tuple]:
        left = self._loose_tokens()
        for bit in reversed(range(WINDOW.bit_length())):
            if left >> bit & 1:
                self._fill([], 1 << bit)
        return self._take()

    def _take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = per_worker(tokenizer_path, lambda: WordTokenizer(tokenizer_path))
        packer = Packer(TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], np.uint32)
        docs: list[tuple] = []
        held = 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in _COLUMNS})

        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for doc_id, ids in zip(batch["doc_id"].array, tok.encode_batch(texts), strict=True):
                docs.append((None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, end])))
                held += len(ids)
                if len(docs) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield frame(packer.block(docs))
                    docs, held = [], 0
        yield frame(packer.block(docs) + packer.end())
        give_back()

    return documents.select("doc_id", "text").mapInPandas(run, SCHEMA)
