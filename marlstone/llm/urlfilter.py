"""URL filters: rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

A listed URL stands for its host with all subdomains, and for all that its path holds.
List and look-up use one canonical form (``canonical``), and a page's look-up keys are
its shorter forms: every suffix of the host with two labels or more, each with every
directory of the path, as far as the list's deepest host and path go.  The keys' hashes are tested against a blocked Bloom filter
(256-bit blocks, one bit in each of eight words) of the listed keys; only
possible hits go on to an exact join with the list, which removes false
positives.  The filter is built by an aggregation and its size is bounded by
``MAX_BLOCKS``: a longer list makes it pass more to the exact join, never less.

Defined results: urls that are null or have no ``://`` have empty host and path,
no rule and the verdict allow; of rules that fit, the longest wins, and no two of
one length fit alike; repeated rows are judged each; very long URLs have as many
keys as the list's deepest entry asks for; columns beyond page_id and url are
left out; an empty list blocks nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 19
#: Odd 31-bit multipliers that choose a bit of each word.
_SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
#: (host and path, verdict); the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of, _, tail = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def plain_host(host: Column) -> Column:
    """A host (A-Z lower-cased) without what stands before an ``@``, without port and without dots at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def path_parts(path: Column) -> Column:
    """What stands between a path's slashes, without what is empty."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _key(host: Column, parts: Column) -> Column:
    return F.concat(host, F.lit("/"), F.array_join(parts, "/"))


def canonical(url: Column) -> Column:
    """Form in which URLs are listed and looked up: ``plain_host``, a slash, and ``path_parts`` with a slash between them.

    A url without ``://`` counts as one that starts with its host; query and fragment
    go; percent codes and the case of the path stay as they are written; null without
    a host.
    """
    host, path = split_url(F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("://"), url)))
    bare = plain_host(host)
    return F.when(bare != "", _key(bare, path_parts(path)))


def deepest(listed: DataFrame) -> tuple[int, int]:
    """Most labels of a host and most directories of a path in a column ``key``."""
    host = F.substring_index("key", "/", 1)
    dirs = F.filter(F.split(F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"), "/"), lambda p: p != "")
    labels, most = listed.agg(F.max(F.size(F.split(host, r"\."))), F.max(F.size(dirs))).first()
    return labels or 0, most or 0


def lookup_keys(host: Column, path: Column, max_labels: int, max_dirs: int) -> Column:
    """Array of canonical forms under which a URL may be listed; empty for an empty host.

    Shorter forms are made up to the labels and directories of the list's deepest entries: no longer one can be listed.
    """
    bare, parts = plain_host(host), path_parts(path)
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(0), F.least(F.greatest(n - 2, F.lit(0)), F.lit(max(max_labels - 2, 0)))), lambda i: F.array_join(F.slice(labels, F.greatest(n - 1 - i, F.lit(1)), n), "."))
    hosts = F.array_union(F.array(bare), hosts)
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(max_dirs))), lambda i: F.slice(parts, 1, i))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(above, lambda p: _key(h, p))))))


def _words(h: np.ndarray) -> np.ndarray:
    """The bit that each of the eight words must have, from the hash's low half."""
    low = h.astype(np.uint64).astype(np.uint32)
    return np.stack([np.uint32(1) << ((low * np.uint32(s)) >> np.uint32(27)) for s in _SALTS], axis=1)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h.astype(np.uint64) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bloom(keys: DataFrame) -> np.ndarray:
    """Filter (blocks x 8 words) of a column ``key``: one aggregation, at most ``MAX_BLOCKS`` rows to the driver."""
    n = keys.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_KEY // 256)))
    h = F.xxhash64("key")
    block = F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * blocks, 32)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bit = [F.pow(F.lit(2.0), F.shiftrightunsigned((low * s).bitwiseAND(F.lit(0xFFFFFFFF)), 27)).cast("long") for s in _SALTS]
    rows = keys.select(block.alias("b"), *[x.alias(f"w{i}") for i, x in enumerate(bit)]).groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toPandas()
    out = np.zeros((blocks, 8), np.uint32)
    if len(rows):
        out[rows["b"].to_numpy()] = rows.iloc[:, 1:].to_numpy().astype(np.uint32)
    return out


def may_hold(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    want = _words(h)
    return ((filt[_block(h, len(filt))] & want) == want).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; ``listed`` has URLs in ``key``, with or without a scheme."""
    spark = pages.sparkSession
    listed = listed.select(canonical(F.col("key")).alias("key")).filter(F.col("key").isNotNull()).distinct()
    sent = spark.sparkContext.broadcast(bloom(listed))

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = [k for keys in batch["keys"] for k in keys]
            # the hash of Spark's xxhash64
            hit = may_hold(sent.value, np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in flat], np.uint64)) if flat else []
            passed, hits, at = np.flatnonzero(hit), [], 0
            for end in np.cumsum([len(keys) for keys in batch["keys"]]):
                upto = np.searchsorted(passed, end)
                hits.append([flat[i] for i in passed[at:upto]])
                at = upto
            yield batch.drop(columns="keys").assign(hits=hits)

    host, path = split_url(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "says": says})
    keys = F.when(F.col("says").isNull(), lookup_keys(F.col("host"), F.col("path"), *deepest(listed))).otherwise(F.array().cast("array<string>"))
    keyed = ruled.withColumn("keys", keys)
    kind = pages.schema["page_id"].dataType
    tested = keyed.select(F.col("page_id").cast("string"), "host", "path", "rule", "says", "keys").mapInPandas(possible, "page_id string, host string, path string, rule string, says string, hits array<string>")
    # written: pages are parsed and tested once, and read three times below without their texts
    tested = stash(tested.withColumn("page_id", F.col("page_id").cast(kind)), "tested-urls")
    hits = tested.select("host", "path", F.explode("hits").alias("key"))
    # few rows: urls whose keys passed the filter
    blocked = hits.distinct().join(listed, "key", "left_semi").select(F.col("host").alias("h"), F.col("path").alias("p")).distinct().withColumn("listed", F.lit(True))
    quiet = tested.filter(F.size("hits") == 0).select("page_id", "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"))
    loud = tested.filter(F.size("hits") > 0).join(blocked, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    loud = loud.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"))
    return quiet.unionAll(loud)
