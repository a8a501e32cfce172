"""Order-dependent folds over arrays: greedy packing and budgets.

A fold's state holds where groups start, not an entry for each item, so it is
copied when a group starts and not at every step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(starts: Column, n: Column, value) -> Column:
    """Array of ``n`` items: ``value(number)`` (from 0) of the last start at or before each; ``starts`` are positions from 0."""
    return F.transform(
        F.array(starts),
        lambda s: F.flatten(F.transform(s, lambda at, i: F.array_repeat(value(i), (F.coalesce(F.get(s, i + 1), n) - at).cast("int")))),
    )[0]


def _groups(items: Column, closes) -> Column:
    """Group number (from 1) of each item; ``closes(size, count, item)``: whether a group that holds so much ends before the item."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("count"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["at"] == 0) | closes(acc["size"], acc["count"], x)
        keep = lambda name: (F.when(new, F.lit(0)).otherwise(acc[name]) + x[name]).cast("long")
        return F.struct(F.when(new, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"), (acc["at"] + 1).alias("at"), keep("size").alias("size"), keep("count").alias("count"))

    return _spread(F.aggregate(items, start, step, lambda acc: acc["starts"]), F.size(items), lambda i: i + 1)


def pack_groups(items: Column, max_size: int, max_count: int) -> Column:
    """Group number (from 1) of each item of an array of (size, count) structs.

    A group is closed before an item that would take it beyond either bound; an
    item beyond a bound by itself has a group of its own.
    """
    return _groups(items, lambda size, count, x: (size + x["size"] > max_size) | (count + x["count"] > max_count))


def within_budget(sizes: Column, budget: int) -> Column:
    """Whether each item is kept when items are taken in order as long as they fit; later, smaller ones may still fit."""
    start = F.struct(F.array().cast("array<int>").alias("turns"), F.lit(0).alias("at"), F.lit(False).alias("kept"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, size: Column) -> Column:
        fits = acc["total"] + size <= budget
        turn = (acc["at"] == 0) | (fits != acc["kept"])
        return F.struct(F.when(turn, F.concat(acc["turns"], F.array(acc["at"]))).otherwise(acc["turns"]).alias("turns"), (acc["at"] + 1).alias("at"), fits.alias("kept"), (acc["total"] + F.when(fits, size).otherwise(0)).cast("long").alias("total"))

    first = F.get(sizes, F.lit(0)) <= budget
    return _spread(F.aggregate(sizes, start, step, lambda acc: acc["turns"]), F.size(sizes), lambda i: (i % 2 == 0) == first)


def split_images(regions: Column, limit: int = 10) -> Column:
    """Regions with more images than ``limit`` cut into parts of at most so many; every part keeps the region's other fields and text length."""
    cut = lambda r: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(r["images"]) / limit).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(r["page"].alias("page"), r["text"].alias("text"), F.slice(r["images"], i * limit + 1, limit).alias("images"), (i > 0).alias("overflow"), F.size(r["images"]).alias("all_images")),
    )
    return F.flatten(F.transform(regions, cut))


def chunk_regions(parts: Column, lengths: Column, max_size: int = 10_000, max_images: int = 10) -> Column:
    """Group number of each part made by ``split_images``; overflow parts always open a group and count their text again."""
    items = F.zip_with(parts, lengths, lambda p, n: F.struct(n.cast("long").alias("size"), F.size(p["images"]).cast("long").alias("count"), p["all_images"].alias("all"), p["overflow"].alias("new")))
    # whether a region's first part fits is asked of all the region's images
    return _groups(items, lambda size, count, x: x["new"] | (size + x["size"] > max_size) | (count + x["all"] > max_images))
