"""SentencePiece encoding and decoding for vocabularies of merge type.

A text is normalized as such vocabularies ask for (a leading blank, blanks as ``▁``)
and its symbols, at first single characters, are merged by an agenda: the adjacent
pair whose union is the piece of the highest score goes first, of equal ones the
leftmost; a merge puts the pairs with its new neighbours on the agenda.  What is left
and is no piece is spelled by byte pieces.

No piece of the vocabulary goes on after a character into the next ``▁``, so merges
never cross such a place, and a text is cut there into units that are merged by
themselves; so is a unit between characters that stand side by side in no piece, as
most words and the marks behind them do.  Units and parts are kept, in two
generations, by each worker; short parts of a batch are merged together, a row of a
matrix and an agenda each, longer ones by a heap.  Every unit that is encoded is also
encoded by the sentencepiece library, those of an Arrow batch in one call, and
compared; ids are decoded by the library.

Defined results: null texts are empty; an empty text has no ids and decodes to an
empty one; other texts, of any length, are encoded whole; repeated rows are encoded
each; other columns, whatever their names, stay, but for ``pieces``, which is
replaced; an empty table gives no rows.  A vocabulary of another type, with another
normalization, with unused pieces or with pieces across units raises.
"""

from __future__ import annotations

import gc
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, per_worker, small_batches

BLANK = "▁"
#: Units that a generation holds, and characters up to which a unit is kept; characters of parts that are merged together.
KEPT, KEPT_CHARS, TOGETHER = 200_000, 48, 24
#: Behind all places of an agenda.
NEVER = 1 << 40
_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*")
_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("agrees", pa.bool_())])


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class _Kept:
    """Units, or parts of units, with their ids; those of the generation before are taken over when they are met again."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: Those of this batch that are too long to be kept.
        self.long: list[str] = []

    def unknown(self, keys: set[str]) -> list[str]:
        new, young, old = keys.difference(self.young), self.young, self.old
        again = new & old.keys() if old else ()
        for k in again:
            young[k] = old[k]
        out = list(new.difference(again))
        self.long = [k for k in out if len(k) > KEPT_CHARS]
        return out

    def turn(self) -> None:
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young


class Encoder:
    """Of one vocabulary file, with the units a worker has met."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(lib.vocab_size())
        if lib.normalize(" a  b\t é​ ") != "▁▁a▁▁b\t▁é​▁":
            raise ValueError(f"{path}: the vocabulary does not keep texts as they are, behind a blank")
        if any(map(lib.is_unused, size)):
            raise ValueError(f"{path}: the vocabulary has unused pieces")
        #: piece -> its id.
        self.ids = {lib.id_to_piece(i): i for i in size if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError(f"{path}: the vocabulary has pieces that go on behind a blank")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len(set(self.bytes)) < 256:
            raise ValueError(f"{path}: the vocabulary has no pieces for bytes")
        place = {s: k for k, s in enumerate(sorted({-lib.get_score(i) for i in self.ids.values()}))}
        #: piece -> its place on an agenda, the same for the same score.
        self.ranks = {p: place[-lib.get_score(i)] for p, i in self.ids.items()}
        #: Pairs of characters that stand side by side in a piece, as numbers.
        self.joins = np.array(sorted({(ord(x) << 21) + ord(y) for p in self.ids for x, y in pairwise(p)}), np.int64)
        #: Number of each symbol that can be merged: pieces by id, then characters that are no pieces; the last is of none.
        alone = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.number = self.ids | {c: len(size) + k for k, c in enumerate(alone)}
        self.none, self.size = len(size) + len(alone), len(size)
        #: Number of each code point.
        self.of_char = np.full(sys.maxunicode + 1, self.none, np.int32)
        for c, k in self.number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        unions = {}
        for p, rank in self.ranks.items():
            for k in range(1, len(p)):
                x, y = self.number.get(p[:k]), self.number.get(p[k:])
                if x is not None and y is not None:
                    unions[x * (self.none + 1) + y] = (rank, self.ids[p])
        #: Pairs of symbols that make a piece, sorted, with its place on an agenda and its id.
        self.pairs = np.array(sorted(unions), np.int64)
        self.pair_rank, self.pair_id = (np.array([unions[k][j] for k in self.pairs.tolist()], np.int64) for j in (0, 1))
        self.clear()

    def clear(self) -> None:
        self.units, self.parts, self.wrong = _Kept(), _Kept(), set()

    def merged(self, part: str) -> list[str]:
        """Symbols that are left when the agenda is empty."""
        symbols, n = list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, bits = self.ranks.get, max(20, n.bit_length())
        # an entry: rank of the union, place of the left symbol, length of the union, in one whole number
        agenda = []
        for i in range(n - 1):
            rank = ranks(symbols[i] + symbols[i + 1])
            if rank is not None:
                agenda.append((rank << bits | i) << bits | 2)
        heapq.heapify(agenda)
        low = (1 << bits) - 1
        while agenda:
            top = heapq.heappop(agenda)
            size, a = top & low, top >> bits & low
            b = after[a]
            if b >= n:
                continue
            left = symbols[a]
            union = left + symbols[b]
            if not left or len(union) != size:
                continue  # one of the two has been merged since
            symbols[a], symbols[b] = union, ""
            after[a] = c = after[b]
            p = before[a]
            if c < n:
                before[c] = a
            for x, y in ((p, a), (a, c)):
                if x >= 0 and y < n:
                    other = symbols[x] + symbols[y]
                    rank = ranks(other)
                    if rank is not None:
                        heapq.heappush(agenda, (rank << bits | x) << bits | len(other))
        return [s for s in symbols if s]

    def spelled(self, symbol: str) -> list[int]:
        found = self.ids.get(symbol)
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")] if found is None else [found]

    def _unions(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place on the agenda (``NEVER`` for no piece) and id of the union of each pair of symbols."""
        key = x * (self.none + 1) + y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER), self.pair_id[at]

    def merged_together(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Ids of many short parts: a row of symbols and an agenda by place for each, one merge a row and round."""
        out: list = [None] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        wide = int(lengths.max(initial=0)) + 1
        symbols = np.full((len(parts), wide), self.none, np.int64)
        symbols[np.arange(wide) < lengths[:, None]] = self.of_char[_codes(parts)]
        agenda = np.full((len(parts), wide), NEVER, np.int64)
        agenda[:, :-1] = self._unions(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())[0].reshape(len(parts), -1)
        #: where each symbol starts in its part, to spell those that are no pieces
        starts = np.tile(np.arange(wide), (len(parts), 1))
        rows, left, places = np.arange(len(parts)), lengths.copy(), np.arange(wide)
        while True:
            best = agenda.argmin(axis=1)  # the leftmost of equal ones
            some = np.arange(len(rows))
            done = agenda[some, best] == NEVER
            ended = np.flatnonzero(done)
            spelled = ((symbols[ended] >= self.size) & (places < left[ended, None])).any(axis=1)
            for i, ids, n, some in zip(ended.tolist(), symbols[ended].tolist(), left[ended].tolist(), spelled.tolist(), strict=True):
                part, ids = parts[rows[i]], ids[:n]
                if some:
                    ends = [*starts[i, 1:n].tolist(), len(part)]
                    ids = list(chain.from_iterable(self.spelled(part[s:e]) for s, e in zip(starts[i, :n].tolist(), ends, strict=True)))
                out[rows[i]] = tuple(ids)
            go = np.flatnonzero(~done)
            if not len(go):
                return out
            rows, left, best = rows[go], left[go] - 1, best[go]
            some = np.arange(len(rows))
            union = self._unions(symbols[go, best], symbols[go, best + 1])[1]
            # close the gap behind the pair
            shift = np.minimum(places + (places > best[:, None]), wide - 1)
            symbols, agenda, starts = (np.take_along_axis(m[go], shift, 1) for m in (symbols, agenda, starts))
            symbols[:, -1], agenda[:, -1] = self.none, NEVER
            symbols[some, best] = union
            agenda[some, best] = self._unions(union, symbols[some, np.minimum(best + 1, wide - 1)])[0]
            inner = np.flatnonzero(best > 0)
            agenda[inner, best[inner] - 1] = self._unions(symbols[inner, best[inner] - 1], union[inner])[0]

    def cut(self, units: list[str]) -> list[list[str]]:
        """Parts of units: no piece has the two characters at a cut side by side."""
        if not units:
            return []
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = _codes(units).astype(np.int64)
        key = (codes[:-1] << 21) + codes[1:]
        apart = np.ones(len(codes), bool)
        apart[:-1] = self.joins[np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)] != key
        ends = np.cumsum(lengths)
        apart[ends - 1] = True  # a unit's end is a part's end
        cuts = np.flatnonzero(apart) + 1
        every = "".join(units)
        parts = [every[a:b] for a, b in pairwise([0, *cuts.tolist()])]
        return [parts[a:b] for a, b in pairwise([0, *(np.searchsorted(cuts, ends) + 1).tolist()])]

    def learn(self, units: set[str]) -> None:
        """Encode the units that are not known, and compare them with what the library says."""
        new = self.units.unknown(units)
        cut = self.cut(new)
        parts = self.parts.unknown(set(chain.from_iterable(cut)))
        # by length, so that the rows of a matrix are filled
        short = sorted((p for p in parts if len(p) <= TOGETHER), key=len)
        known = self.parts.young
        for s in range(0, len(short), 2048):
            some = short[s : s + 2048]
            known.update(zip(some, self.merged_together(some), strict=True))
        for p in parts:
            if len(p) > TOGETHER:
                known[p] = tuple(chain.from_iterable(map(self.spelled, self.merged(p))))
        ids = [known[c[0]] if len(c) == 1 else tuple(chain.from_iterable(map(known.__getitem__, c))) for c in cut]
        self.units.young.update(zip(new, ids, strict=True))
        # the library puts the first blank of a unit before it by itself
        told = self.library.encode([u[1:] or BLANK for u in new], num_threads=1) if new else []
        if BLANK in units and BLANK in new:
            told[new.index(BLANK)] = self._alone(told[new.index(BLANK)])
        if list(map(list, ids)) != told:
            self.wrong.update(u for u, own, theirs in zip(new, ids, told, strict=True) if list(own) != theirs)

    def batch(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the library encodes its units alike."""
        for kept in (self.units, self.parts):
            kept.turn()
        cut = [_UNIT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        every = set(chain.from_iterable(cut))
        self.learn(every)
        look = self.units.young.__getitem__
        ids = [list(chain.from_iterable(map(look, units))) for units in cut]
        agrees = [not self.wrong or self.wrong.isdisjoint(units) for units in cut]
        for kept in (self.units, self.parts):
            for k in kept.long:
                del kept.young[k]
            kept.long = []
        return ids, agrees

    def _alone(self, theirs: list[int]) -> list[int]:
        """A single blank cannot be asked for (an empty text has no ids): two blanks are asked, whose ids are known to be those of the piece or of each."""
        pair, one = self.ids.get(BLANK * 2), [self.ids[BLANK]]
        return one if theirs == ([pair] if pair else one * 2) else theirs


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with a struct ``pieces``: ids, decoded (by the library, from the ids) and agrees (with the library's encoding)."""
    small_batches(documents.sparkSession)

    @F.arrow_udf("struct<ids: array<int>, decoded: string, agrees: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = per_worker(f"pieces:{path}", lambda: Encoder(path))
        gc.disable()  # the many small tuples that are kept hold no cycles
        for batch in batches:
            ids, agrees = encoder.batch([t or "" for t in batch.to_pylist()])
            decoded = encoder.library.decode(ids, num_threads=1) if ids else []
            offsets = pa.array([0, *accumulate(map(len, ids))], pa.int32())
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], fields=list(_ARROW))
        gc.enable()
        give_back()

    kept = [F.col(f"`{c}`") for c in documents.columns if c != "pieces"]
    return documents.select(*kept, run(F.col("text")).alias("pieces"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (a column ``ids``) with a column ``decoded``: the library's text of the ids; null for null."""
    small_batches(rows.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = per_worker(f"pieces:{path}", lambda: Encoder(path)).library
        for batch in batches:
            yield pa.array([None if ids is None else library.decode(ids) for ids in batch.to_pylist()], pa.string())
        give_back()

    return rows.withColumn("decoded", run(F.col("ids")))
