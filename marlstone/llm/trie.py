"""Conversation prefix trie: every distinct sequence of first turns, with what lies below it.

A node (depth d, its first d turns) belongs to the smallest conversation that starts
with it.  A conversation that owns depth d owns all its greater depths, so what it
owns is a chain, and the chains make the tree: below the depth ``pos`` a chain hangs
from the chain of the owner at that depth.

Prefixes have digests that are sums over turns (of hashes of turn and depth), so a
running sum gives them.  An aggregation by depth and digest gives the minima (owner,
members, words).  ``pos`` is found by binary search, from large steps to small: in
the round of step 2^k a conversation asks for the depth pos + 2^k, whose number ends
in k zero bits, so a round joins only prefixes and minima of that level and all
rounds together read each of them once.  Totals of chains are summed bottom-up by
doubling: a chain gives its sums to its ancestor 2^k above.

Windows of positions, digests and sums along a chain run over blocks of ``BLOCK``
turns, with the sums of earlier blocks joined on, so a conversation with very many
turns is spread over tasks.  The members that end at a node are joined into strings
by blocks of ids; since SHA-256 reads its input in order, the strings of one node go
through one task, which holds one Arrow batch of them at a time.

Defined results: rows with a null conv_id are left out; turns go by ``turn``, null
first, ties by the SHA-256 of role and text; null roles and texts are empty; repeated
rows are turns of their own; texts of any length are reduced to that digest and a
number of words before anything is moved; other columns, whatever their names, are
left out; without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, give_back, small_batches, stash

#: Turns, depths or ids to a block: a power of two.
BLOCK_BITS = 12
#: Conversations take the first turns of the first of their ``GROUP``, fewer than ``SHARED``.
GROUP, SHARED = 20, 4
_BELOW = ("leaves", "saved")


def running(rows: DataFrame, keys: list[str], at: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums (the row itself included) in ``order`` within ``keys``; ``at``: a whole number that ``order`` goes by first."""
    blocked = rows.withColumn("b", F.shiftright(at, BLOCK_BITS))
    by = [*keys, "b"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*by).agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    one = next(iter(sums))
    # the first block has none before it, most keys have one block
    offsets = totals.select(*by, *[F.sum(s).over(earlier).alias(f"{s}_before") for s in sums]).filter(F.col(f"{one}_before").isNotNull())
    local = blocked.select("*", *[F.sum(c).over(inside).alias(s) for s, c in sums.items()])
    joined = local.join(offsets, by, "left")
    return joined.select(*rows.columns, *[(F.col(s) + F.coalesce(f"{s}_before", F.lit(0))).alias(s) for s in sums])


def number_turns(turns: DataFrame) -> DataFrame:
    """c, no (from 1), said (digest of role and text) and words of every turn; texts are reduced to these before anything is moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    placed = running(rows, ["c"], F.coalesce("turn", F.lit(-(1 << 62))), [F.col("turn").asc_nulls_first(), F.col("said")], {"no": F.lit(1)})
    return placed.select("c", "no", "said", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first conversation of their group.

    Of conversation c these are the first crc32(c) modulo ``SHARED`` turns; its own
    follow from there.  ``turns``: of ``number_turns``.  Returns (c, d, said, words) and
    (c, size).
    """
    first = F.when(F.col("no") < SHARED, F.struct("no", "said", "words"))
    # a list of fewer than SHARED turns for each conversation
    convs = turns.groupBy("c").agg(F.max("no").alias("n"), F.sort_array(F.collect_list(first)).alias("head"))
    asked = convs.select("c", "n", (F.col("c") - F.col("c") % GROUP).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).alias("h"))
    shared = F.least(F.col("h"), F.when(F.col("head").isNull(), 0).otherwise(F.size("head")))
    plan = asked.join(convs.select(F.col("c").alias("base"), "head"), "base", "left").select("c", "n", "h", F.slice("head", 1, shared.cast("int")).alias("head"), shared.alias("s"))
    plan = stash(plan, "trie-plan")
    taken = plan.filter("s > 0").select("c", F.posexplode("head")).select("c", (F.col("pos") + 1).cast("long").alias("d"), "col.said", "col.words")
    own = turns.join(plan.select("c", "h", "s"), "c").filter("no > h").select("c", (F.col("no") - F.col("h") + F.col("s")).alias("d"), "said", "words")
    return taken.unionByName(own), plan.select("c", (F.col("s") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """c, d, key (digest of the first d turns), words of the last of them, last (the conversation ends there), level (zero bits at the end of d)."""
    halves = []
    for salt in (1, 2):
        x = F.xxhash64(F.lit(salt), "said", "d")
        halves += [x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)]
    # sums of 32 bits: no overflow below 2^31 turns
    summed = running(turns, ["c"], F.col("d"), [F.col("d")], {f"s{i}": h for i, h in enumerate(halves)})
    key = F.unhex(F.md5(F.concat_ws(",", *[f"s{i}" for i in range(4)]).cast("binary")))
    d = F.col("d")
    level = F.bit_count(d.bitwiseAND(-d) - 1)
    return summed.join(convs, "c").select("c", "d", key.alias("key"), "words", (d == F.col("size")).alias("last"), level.alias("level"))


def minima(found: DataFrame) -> DataFrame:
    """d, key, owner, last (of the owner), n_convs, words, level of every distinct prefix."""
    per = found.groupBy("d", "key").agg(F.min(F.struct("c", "last")).alias("top"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("level").alias("level"))
    return per.select("d", "key", F.col("top.c").alias("owner"), F.col("top.last").alias("last"), "n_convs", "words", "level")


def search(convs: DataFrame, found: DataFrame, least: DataFrame, root: int, longest: int) -> DataFrame:
    """c, size, pos (the greatest depth that c does not own), below (the owner there)."""
    state = convs.select("c", "size", F.lit(0).cast("long").alias("pos"), F.lit(root).cast("long").alias("below"))
    old = None
    for k in range(longest.bit_length() - 1, -1, -1):
        asks = F.col("pos") + (1 << k) <= F.col("size")
        asked = state.filter(asks).withColumn("d", F.col("pos") + (1 << k))
        keys = asked.join(found.filter(F.col("level") == k).select("c", "d", "key"), ["c", "d"])
        told = keys.join(least.filter(F.col("level") == k).select("d", "key", "owner"), ["d", "key"])
        other = F.col("owner") != F.col("c")
        after = told.select("c", "size", F.when(other, F.col("d")).otherwise(F.col("pos")).alias("pos"), F.when(other, F.col("owner")).otherwise(F.col("below")).alias("below"))
        state = stash(after.unionByName(state.filter(~asks)), "trie-search")
        if old is not None:
            discard(old)
        old = state
    return state


def ends_digest(ends: DataFrame) -> DataFrame:
    """owner, d, ends_sha256 from (owner, d, c): the SHA-256 of the ids, ascending and joined by commas."""
    block = F.shiftright("c", BLOCK_BITS)
    # at most 2^BLOCK_BITS ids to a string
    parts = ends.groupBy("owner", "d", block.alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for owner, d, ids in zip(batch["owner"], batch["d"], batch["ids"], strict=True):
                if (owner, d) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (owner, d), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["owner", "d", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["owner", "d", "ends_sha256"])
        give_back()

    return parts.repartition("owner", "d").sortWithinPartitions("owner", "d", "b").select("owner", "d", "ids").mapInPandas(run, "owner long, d long, ends_sha256 string")


def chain_totals(chains: DataFrame, root: int) -> DataFrame:
    """x, leaves, saved summed over the chain and all that hang below it, by doubling.  ``chains``: x, up (the chain it hangs from, null for the root's) and its own sums."""
    state = stash(chains, "trie-chains")
    while not state.filter("up is not null").isEmpty():
        given = state.filter("up is not null").groupBy(F.col("up").alias("x")).agg(*[F.sum(c).alias(f"{c}_more") for c in _BELOW])
        # the root's chain has nothing above it: what hangs from it is not joined with it
        higher = state.filter(F.col("up") != root).join(state.select(F.col("x").alias("up"), F.col("up").alias("next")), "up").select("x", F.col("next").alias("up"), *_BELOW)
        top = state.filter(F.col("up").isNull() | (F.col("up") == root)).select("x", F.lit(None).cast("long").alias("up"), *_BELOW)
        new = higher.unionByName(top).join(given, "x", "left").select("x", "up", *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in _BELOW])
        new = stash(new, "trie-chains")
        discard(state)
        state = new
    return state.select("x", *_BELOW)


_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: c, d (from 1, without gaps), said, words; ``convs``: c, size (number of
    turns), one row for each conversation.
    """
    spark = turns.sparkSession
    small_batches(spark)
    convs = stash(convs, "trie-convs")
    root, members, longest = convs.agg(F.min("c"), F.count("*"), F.max("size")).first()
    if not members:
        return spark.createDataFrame([], _SCHEMA)
    found = stash(prefixes(turns, convs), "trie-prefixes", by="level")
    least = stash(minima(found), "trie-minima", by="level")
    searched = search(convs, found, least, root, longest)
    is_root = F.col("c") == root
    placed = stash(searched.select("c", "size", "pos", "below", ((F.col("pos") < F.col("size")) | is_root).alias("owns")), "trie-placed")

    ends = ends_digest(placed.select(F.when(F.col("owns"), F.col("c")).otherwise(F.col("below")).alias("owner"), F.col("size").alias("d"), "c"))
    top = convs.filter(is_root).select(F.lit(0).cast("long").alias("d"), F.col("c").alias("owner"), (F.col("size") == 0).alias("last"), F.lit(members).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = least.select("d", "owner", "last", "n_convs", "words").unionByName(top)
    saved = (F.col("n_convs") - 1) * F.col("words")

    hung = placed.filter(F.col("owns") & ~is_root).select(F.col("c").alias("x"), F.col("below").alias("up"), "pos")
    own = placed.filter("owns").select(F.col("c").alias("x"), F.col("c").alias("owner"), F.col("size").alias("d"), F.when(~is_root, F.col("below")).alias("up"))
    busy = hung.select(F.col("up").alias("owner"), F.col("pos").alias("d")).distinct().withColumn("busy", F.lit(1))
    lone = own.join(busy, ["owner", "d"], "left").select("x", "up", F.when(F.col("busy").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    sums = nodes.groupBy(F.col("owner").alias("x")).agg(F.sum(saved).alias("saved"))
    totals = chain_totals(lone.join(sums, "x").select("x", "up", *_BELOW), root)

    at = hung.join(totals, "x").groupBy(F.col("up").alias("owner"), F.col("pos").alias("d")).agg(F.count("*").alias("hung"), *[F.sum(c).alias(c) for c in _BELOW])
    n_hung = F.coalesce("hung", F.lit(0))
    here = nodes.join(at, ["owner", "d"], "left").select(
        "owner",
        "d",
        "n_convs",
        (n_hung + F.when(F.col("last"), 0).otherwise(1)).alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + F.when(F.col("last") & (n_hung == 0), 1).otherwise(0)).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + saved).alias("saved"),
    )
    below = running(stash(here, "trie-nodes"), ["owner"], -F.col("d"), [F.col("d").desc()], {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})
    heads = hung.select(F.col("x").alias("owner"), (F.col("pos") + 1).alias("d"), "up")
    out = below.join(heads, ["owner", "d"], "left").join(ends, ["owner", "d"], "left")
    parent = F.when(F.col("d") > 0, F.coalesce("up", "owner"))
    return out.select(
        F.col("owner").alias("conv_id"),
        F.col("d").alias("depth"),
        parent.alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
