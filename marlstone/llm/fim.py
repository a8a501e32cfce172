"""Fill-in-middle transformation: cuts between tokens found by a parallel automaton scan.

Tokens are runs of letters A-Z, a-z and single other code points.  One automaton of
four states (``NEXT``, ``EMIT``) counts token starts and sentinels.  A text is cut
into rows of ``WIDTH`` code points; each row gives its transition function: for
every state it may be entered in, the state it is left in and what is counted.
Functions compose associatively, so prefix compositions give each row's entry state
and the counts before it, and the row that holds a cut's token is selected and
walked from its entry state.

Texts of up to ``GIANT`` code points are scanned by the rows of their Arrow batch.
Longer ones are written once in chunks of ``CHUNK`` code points, which are dealt
over the cluster: every chunk gives its function (one small row), a text's functions
are composed, and only the one or two chunks that hold its cuts are read again.
Results do not depend on the path.

Defined results: null texts are empty; an empty text and one with a sentinel are
plain, as is a share of the others; a null id counts as an empty one; repeated rows
are transformed each, alike; texts are as long as a row may be (2 GB); other columns
of the input stay, but for a column ``fim``, which is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, stash

P, S, M = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
WIDTH, CHUNK, GIANT = 64, 1 << 14, 1 << 16

#: Classes of code points: letters P, S, M; other letters; "<"; ">"; others; none (behind a text's end).
MARK_LETTER, LETTER, OPEN, CLOSE, OTHER, NONE = range(6)
#: States: outside a run of letters, inside one, behind "<", behind "<" and P, S or M.
OUTSIDE, INSIDE, OPENED, MARKED = range(4)
NEXT = np.array(
    [
        [INSIDE, INSIDE, OPENED, OUTSIDE, OUTSIDE, OUTSIDE],
        [INSIDE, INSIDE, OPENED, OUTSIDE, OUTSIDE, INSIDE],
        [MARKED, INSIDE, OPENED, OUTSIDE, OUTSIDE, OPENED],
        [INSIDE, INSIDE, OPENED, OUTSIDE, OUTSIDE, MARKED],
    ]
)
#: What a step counts: a token that starts, in the lower half; a sentinel that ends, in the upper.
SENTINEL = 1 << 32
EMIT = np.array([[1, 1, 1, 1, 1, 0], [0, 0, 1, 1, 1, 0], [1, 1, 1, 1, 1, 0], [0, 0, 1, 1 + SENTINEL, 1, 0]])
STATES = len(NEXT)

_ASCII = np.full(129, OTHER, np.uint8)
_ASCII[[*range(65, 91), *range(97, 123)]] = LETTER
_ASCII[[ord(c) for c in "PSM"]] = MARK_LETTER
_ASCII[ord("<")], _ASCII[ord(">")] = OPEN, CLOSE


def classes(text: str) -> np.ndarray:
    return _ASCII[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


class Functions(NamedTuple):
    """Of each row: the state it is left in and its counts, by the state it is entered in."""

    to: np.ndarray
    count: np.ndarray

    def then(self, other: Functions) -> Functions:
        return Functions(np.take_along_axis(other.to, self.to, 1), self.count + np.take_along_axis(other.count, self.to, 1))


def functions(rows: np.ndarray) -> Functions:
    """Transition functions of rows of classes, for all states at once."""
    to = np.tile(np.arange(STATES), (len(rows), 1))
    count = np.zeros_like(to)
    step, emit = NEXT.T.ravel(), EMIT.T.ravel()
    for column in rows.T:
        at = to + STATES * column[:, None].astype(np.intp)
        count += emit[at]
        to = step[at]
    return Functions(to, count)


def compose(f: Functions, first: np.ndarray) -> Functions:
    """For each row the composition of all from the first of its group to itself; ``first``: index of the group's first row."""
    place = np.arange(len(first)) - first
    reach, f = 1, Functions(*f)
    while reach <= place.max(initial=0):
        late = np.flatnonzero(place >= reach)
        both = Functions(f.to[late - reach], f.count[late - reach]).then(Functions(f.to[late], f.count[late]))
        f.to[late], f.count[late] = both
        reach *= 2
    return f


def before(f: Functions, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry state and counts before each row, from composed functions; groups start outside."""
    state, count = np.full(len(first), OUTSIDE), np.zeros(len(first), np.int64)
    late = np.flatnonzero(np.arange(len(first)) > first)
    state[late], count[late] = f.to[late - 1, OUTSIDE], f.count[late - 1, OUTSIDE]
    return state, count


def find_start(rows: np.ndarray, state: np.ndarray, k: np.ndarray) -> np.ndarray:
    """In each row, entered in its state, the place where the token number k (from 0) of the row starts."""
    place, seen = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
    for i, column in enumerate(rows.T):
        starts = EMIT[state, column] % SENTINEL
        place[(starts == 1) & (seen == k)] = i
        seen += starts
        state = NEXT[state, column]
    return place


def lay_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``WIDTH`` classes, each part beginning a row of its own; rows of each part; index of its first row."""
    size = np.array([max(1, -(-len(p) // WIDTH)) for p in parts], np.int64)
    first = np.cumsum(size) - size
    rows = np.full((size.sum(), WIDTH), NONE, np.uint8)
    flat = rows.reshape(-1)
    for p, at in zip(parts, first * WIDTH, strict=True):
        flat[at : at + len(p)] = p
    return rows, size, first


def cuts(texts: list[str], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, sentinels, and the ends in code points of prefix and middle."""
    parts = [classes(t) for t in texts]
    rows, size, first = lay_out(parts)
    group = np.repeat(first, size)
    f = compose(functions(rows), group)
    state, count = before(f, group)
    total = f.count[first + size - 1, OUTSIDE]
    n, marks = total % SENTINEL, total // SENTINEL
    ends = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        end = np.array([len(p) for p in parts], np.int64)
        inner = np.flatnonzero(k < n)
        # the last row whose tokens before are not more than k, among the rows of the text
        ranked = count % SENTINEL + np.repeat(np.arange(len(parts)), size) * SENTINEL
        row = np.searchsorted(ranked, k[inner] + inner * SENTINEL, side="right") - 1
        end[inner] = (row - first[inner]) * WIDTH + find_start(rows[row], state[row], k[inner] - count[row] % SENTINEL)
        ends.append(end)
    return n, marks, *ends


def _cuts(text: Column, h1: Column, h2: Column) -> Column:
    """``cuts`` over the texts of Arrow batches."""

    @F.pandas_udf("n long, marks long, cut1 long, cut2 long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, a, b in batches:
            found = cuts(list(texts), a.to_numpy(np.int64), b.to_numpy(np.int64)) if len(texts) else [[]] * 4
            yield pd.DataFrame(dict(zip(("n", "marks", "cut1", "cut2"), found, strict=True)))
        give_back()

    return run(text, h1, h2)


def draws(doc_id: Column) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the hex SHA-256 of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long") for i in range(4)]


def _chunks(giants: DataFrame) -> DataFrame:
    """key, no, chunk of long texts, dealt over the cluster and written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                for s in range(0, len(text), CHUNK * 16):
                    part = [text[i : i + CHUNK] for i in range(s, min(s + CHUNK * 16, len(text)), CHUNK)]
                    yield pd.DataFrame({"key": key, "no": np.arange(len(part)) + s // CHUNK, "chunk": part})
        give_back()

    return stash(giants.mapInPandas(run, "key long, no long, chunk string").repartition("key", "no"), "fim-chunks")


def _chunk_functions(chunks: DataFrame) -> DataFrame:
    """key, no, size and the chunk's function: arrays ``to`` and ``count`` by the state of entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size, first = lay_out([classes(c) for c in batch["chunk"]])
            whole = compose(functions(rows), np.repeat(first, size))
            last = first + size - 1
            yield pd.DataFrame({"key": batch["key"], "no": batch["no"], "size": batch["chunk"].map(len), "to": list(whole.to[last]), "count": list(whole.count[last])})
        give_back()

    return chunks.mapInPandas(run, "key long, no long, size long, to array<long>, count array<long>")


def _resolve(made: DataFrame, giants: DataFrame) -> DataFrame:
    """key, no, state, n, marks, size (of the text), k1, k2: entry states of chunks, and the tokens at which the text's cuts lie, counted from the chunk's start."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        first = np.zeros(len(group), np.int64)
        f = compose(Functions(np.stack(group["to"]), np.stack(group["count"])), first)
        state, count = before(f, first)
        n, own = f.count[-1, OUTSIDE] % SENTINEL, count % SENTINEL
        held = f.count[:, OUTSIDE] % SENTINEL - own
        out = pd.DataFrame({"key": group["key"], "no": group["no"], "state": state, "n": n, "marks": f.count[-1, OUTSIDE] // SENTINEL, "size": group["size"].sum()})
        at = sorted(group[h].iloc[0] % (n + 1) for h in ("h1", "h2"))
        for name, k in zip(("k1", "k2"), at, strict=True):
            out[name] = np.where((own <= k) & (k < own + held), k - own, -1)
        return out[(out["no"] == 0) | (out["k1"] >= 0) | (out["k2"] >= 0)]

    drawn = giants.select("key", "h1", "h2")
    return made.join(drawn, "key").groupBy("key").applyInPandas(run, "key long, no long, state long, n long, marks long, size long, k1 long, k2 long")


def _select(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """key, n, marks, cut1, cut2: the chunks that hold a cut are walked from their entry state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["key", "n", "marks", "size"]].copy()
            for name, k in (("cut1", "k1"), ("cut2", "k2")):
                ends = []
                for text, no, state, k_own in zip(batch["chunk"], batch["no"], batch["state"], batch[k], strict=True):
                    if k_own < 0:
                        ends.append(None)
                        continue
                    rows, _, first = lay_out([classes(text)])
                    group = np.zeros(len(rows), np.int64)
                    made = functions(rows)
                    made.to[0], made.count[0] = made.to[0, state], made.count[0, state]  # entered as the chunk is
                    entry, count = before(compose(made, group), group)
                    entry[0] = state
                    row = np.searchsorted(count % SENTINEL, k_own, side="right") - 1
                    ends.append(no * CHUNK + row * WIDTH + find_start(rows[row : row + 1], entry[row : row + 1], k_own - count[row : row + 1] % SENTINEL)[0])
                out[name] = pd.array(ends, "Int64")
            yield out
        give_back()

    found = resolved.join(chunks, ["key", "no"]).mapInPandas(run, "key long, n long, marks long, size long, cut1 long, cut2 long")
    ends = found.groupBy("key").agg(F.max("n").alias("n"), F.max("marks").alias("marks"), F.max("size").alias("size"), F.max("cut1").alias("cut1"), F.max("cut2").alias("cut2"))
    # a cut behind the last token lies at the text's end
    return ends.select("key", "n", "marks", F.coalesce("cut1", "size").alias("cut1"), F.coalesce("cut2", "size").alias("cut2"))


def transform(documents: DataFrame) -> DataFrame:
    """``documents`` with a struct ``fim``: n, form, prefix_chars, middle_chars and output (the transformed text)."""
    small_batches(documents.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "fim"])
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    rows = documents.select(kept.alias("row"), F.coalesce("text", F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    giant = F.length("text") > GIANT
    small = rows.filter(~giant).withColumn("f", _cuts(F.col("text"), F.col("h1"), F.col("h2")))
    # ids are made when the rows are written, so later reads agree on them
    giants = stash(rows.filter(giant).withColumn("key", F.monotonically_increasing_id()), "fim-giants")
    chunks = _chunks(giants)
    found = _select(chunks, _resolve(_chunk_functions(chunks), giants))
    large = giants.join(found.select("key", F.struct("n", "marks", "cut1", "cut2").alias("f")), "key").select(*small.columns)
    return small.unionByName(large).select("row.*", _assemble().alias("fim"))


def _assemble() -> Column:
    plain = (F.col("text") == "") | (F.col("f.marks") > 0) | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = F.col("f.cut1").cast("int"), F.col("f.cut2").cast("int")
    text = F.col("text")
    prefix, middle, suffix = text.substr(F.lit(1), a), text.substr(a + 1, b - a), text.substr(b + 1, F.length(text) - b)
    psm, spm = F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle), F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle)
    output = F.when(plain, text).when(F.col("h4") % 100 < SPM_BELOW, spm).otherwise(psm)
    return F.struct(
        F.col("f.n").alias("n"),
        form.alias("form"),
        F.when(~plain, F.col("f.cut1")).alias("prefix_chars"),
        F.when(~plain, F.col("f.cut2") - F.col("f.cut1")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text, from a transformed one and its form: no sentinel but the form's own is in it."""
    body = output.substr(F.lit(4), F.length(output))
    middle = F.substring_index(body, M, -1)
    head = F.substring_index(body, M, 1)
    first, second = (lambda mark: F.substring_index(head, mark, 1)), (lambda mark: F.substring_index(head, mark, -1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first(S), middle, second(S))).otherwise(F.concat(second(P), middle, first(P)))
