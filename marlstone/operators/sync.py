"""Synchronisation with a remote store, as plans: what to create, update, skip, defer and retire."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ambiguous(remote: DataFrame, name: str = "name") -> DataFrame:
    """Names that several remote documents of a dataset (``domain``, where there is one) have: an error, never a choice."""
    return remote.groupBy(*_place(remote, name)).count().filter("count > 1")


def _place(remote: DataFrame, name: str = "name") -> list[str]:
    """What finds a remote document: its name, within its dataset where that is told."""
    return ["domain", name] if "domain" in remote.columns else [name]


def one_per_name(remote: DataFrame, name: str = "name") -> DataFrame:
    """``remote`` by name (within ``domain``, where there is one); raises when a name that is used is ambiguous."""
    by = _place(remote, name)
    cols = [c for c in remote.columns if c not in by]
    rows = remote.groupBy(*by).agg(F.count("*").alias("__n"), F.max(F.struct(*cols)).alias("__r"))
    ok = F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.concat(F.lit("duplicate remote name: "), F.col(name).cast("string"))))
    return rows.select(*by, ok.alias("__r")).select(*by, "__r.*")


def upload_plan(manifest: DataFrame, receipts: DataFrame, remote: DataFrame) -> DataFrame:
    """key, action (skip, create, update, metadata, defer), document_id for every item.

    ``manifest``: key, name, content_hash, domain; ``receipts``: key, document_id, hash,
    metadata_applied, retired_at; ``remote``: name, document_id, status, domain (the
    dataset; without that column all are of one).  An item's document is found by name
    within its dataset: one name may be in several datasets, and raises if two of one
    dataset have it.  An item is done if its receipt has its hash and that document, is
    applied and not retired; new content for a document that is not available yet
    waits; where hash and document fit, the metadata alone is sent again.
    """
    r = receipts.select(F.col("key").alias("__k"), F.col("document_id").alias("__had"), "hash", "metadata_applied", "retired_at")
    by = _place(remote)
    used = remote.select(*by, "document_id", "status").join(manifest.select(*by), by, "left_semi")
    x = one_per_name(used).select(*[F.col(c).alias(f"__{c}") for c in by], "document_id", "status")
    found = reduce(and_, [F.col(c) == F.col(f"__{c}") for c in by])
    rows = manifest.select("key", "content_hash", *by).join(r, F.col("key") == F.col("__k"), "left").join(x, found, "left")
    same_hash = F.coalesce(F.col("hash") == F.col("content_hash"), F.lit(False))
    same = same_hash & F.col("__had").eqNullSafe(F.col("document_id"))
    there = F.col("document_id").isNotNull()
    action = (
        F.when(same & F.coalesce("metadata_applied", F.lit(False)) & F.col("retired_at").isNull(), "skip")
        .when(there & ~same_hash & (F.coalesce("status", F.lit("")) != "available"), "defer")
        .when(same, "metadata")
        .when(there, "update")
        .otherwise("create")
    )
    return rows.select("key", action.alias("action"), "document_id")


def anchor_fingerprint() -> Column:
    """Of an item's content and anchor text."""
    return F.sha2(F.concat_ws("\x1f", "content_hash", "anchor"), 256)


def readiness(manifest: DataFrame, receipts: DataFrame, remote: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per domain: total, submitted_current, ready, anchor_required, anchor_ready, anchors_current.

    ``manifest``: key, domain, content_hash, anchor (its text or null);
    ``receipts``: key, document_id, hash, metadata_applied, retired_at; ``remote``:
    document_id, indexing_status, enabled; ``anchors``: key, document_id, fingerprint.
    Only what is there with the current content counts.
    """
    r = receipts.select(F.col("key").alias("__rk"), F.col("document_id").alias("__had"), "hash", "metadata_applied", "retired_at")
    x = remote.select(F.col("document_id").alias("__d"), "indexing_status", "enabled")
    a = anchors.select(F.col("key").alias("__ak"), F.col("document_id").alias("__ad"), "fingerprint")
    rows = manifest.join(r, F.col("key") == F.col("__rk"), "left").join(x, F.col("__had") == F.col("__d"), "left").join(a, F.col("key") == F.col("__ak"), "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    current = F.col("__d").isNotNull() & yes((F.col("hash") == F.col("content_hash")) & F.col("metadata_applied")) & F.col("retired_at").isNull()
    ready = current & yes((F.col("indexing_status") == "completed") & F.col("enabled"))
    wanted = F.col("anchor").isNotNull()
    anchored = yes((F.col("__ad") == F.col("__had")) & (F.col("fingerprint") == anchor_fingerprint()))
    return rows.groupBy("domain").agg(
        F.count("*").alias("total"),
        F.count_if(current).alias("submitted_current"),
        F.count_if(ready).alias("ready"),
        F.count_if(wanted).alias("anchor_required"),
        F.count_if(wanted & ready).alias("anchor_ready"),
        F.count_if(wanted & ready & anchored).alias("anchors_current"),
    )


def retire_plan(receipts: DataFrame, manifest: DataFrame, complete: bool, replacements_ready: bool = True) -> DataFrame:
    """Receipts (key, document_id, retired_at) that no item has any more; raises unless the corpus is complete and replacements are ready."""
    if not (complete and replacements_ready):
        raise ValueError("an incomplete corpus retires nothing")
    return receipts.filter("retired_at is null").join(manifest.select("key"), "key", "left_anti")


def replacement_plan(previous: DataFrame, current: DataFrame) -> DataFrame:
    """identity, key: keys that an identity had before and has no more; identities not scanned now keep theirs."""
    scanned = current.select("identity").distinct()
    return previous.join(scanned, "identity", "left_semi").select("identity", "key").distinct().join(current.select("identity", "key"), ["identity", "key"], "left_anti")


def retire_replaced(plan: DataFrame, receipts: DataFrame, remote: DataFrame) -> DataFrame:
    """key, document_id, disable for the keys of a replacement plan whose receipt is not retired; disable: whether the document is there and enabled.

    ``receipts``: key, document_id, retired_at; ``remote``: document_id, enabled.
    """
    live = receipts.filter("retired_at is null").select("key", "document_id").join(plan.select("key").distinct(), "key", "left_semi")
    x = remote.select(F.col("document_id").alias("__d"), "enabled")
    return live.join(x, F.col("document_id") == F.col("__d"), "left").select("key", "document_id", F.coalesce("enabled", F.lit(False)).alias("disable"))


def reconcile(wanted: DataFrame, children: DataFrame) -> DataFrame:
    """key, child_id, action for anchors (key, parent_id, text, child_id of the receipt or null): refresh the child of the receipt, else the one of that text, else create.

    ``children``: parent_id, child_id, content.  A text that two children of a
    parent have raises: an uncertain create is never repeated.
    """
    there = children.groupBy(F.col("parent_id").alias("__p"), F.col("content").alias("__c")).agg(F.count("*").alias("__n"), F.min("child_id").alias("__id"))
    rows = wanted.join(there, (F.col("parent_id") == F.col("__p")) & (F.col("text") == F.col("__c")) & F.col("child_id").isNull(), "left")
    kind = children.schema["child_id"].dataType
    only = F.when(F.col("__n") > 1, F.raise_error(F.lit("several anchor children of one text")).cast(kind)).otherwise(F.col("__id"))
    found = F.coalesce("child_id", only)
    return rows.select("key", found.alias("found")).select("key", F.col("found").alias("child_id"), F.when(F.col("found").isNull(), "create").otherwise("refresh").alias("action"))


def owned(receipts: DataFrame, base_url: str) -> DataFrame:
    """Receipts (base_url, ...) that a server may use: its own, whatever slashes are at the end, and those that name none."""
    own = F.regexp_replace("base_url", "/+$", "") == base_url.rstrip("/")
    return receipts.filter(F.col("base_url").isNull() | (F.col("base_url") == "") | own)


def anchor_plan(manifest: DataFrame, receipts: DataFrame, available: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, text, state for items whose anchor is missing or stale: ready if their document is available, else waiting."""
    fp = anchor_fingerprint()
    r = receipts.filter("metadata_applied").select(F.col("key").alias("__rk"), "document_id", F.col("hash").alias("__h"))
    items = manifest.filter("anchor is not null").withColumn("fingerprint", fp).join(r, (F.col("key") == F.col("__rk")) & (F.col("content_hash") == F.col("__h")))
    stale = items.join(anchors.select("key", "document_id", "fingerprint"), ["key", "document_id", "fingerprint"], "left_anti")
    there = available.select(F.col("document_id").alias("__d"))
    return stale.join(there, F.col("document_id") == F.col("__d"), "left").select("key", F.col("anchor").alias("text"), F.when(F.col("__d").isNotNull(), "ready").otherwise("waiting").alias("state"))


def resolve_datasets(wanted: DataFrame, mapping: DataFrame, previous: DataFrame, remote: DataFrame) -> DataFrame:
    """domain, dataset_id, how: by mapping, else the one before, else the only remote one of the name, else to be created.

    ``wanted``: domain, name; ``mapping``, ``previous``: domain, dataset_id;
    ``remote``: dataset_id, name.  An ambiguous name raises.
    """
    m, p = (df.select(F.col("domain").alias(f"__{n}"), F.col("dataset_id").alias(n)) for df, n in ((mapping, "mapped"), (previous, "earlier")))
    named = remote.groupBy(F.col("name").alias("__name")).agg(F.count("*").alias("__n"), F.min("dataset_id").alias("by_name"))
    rows = wanted.join(m, F.col("domain") == F.col("__mapped"), "left").join(p, F.col("domain") == F.col("__earlier"), "left").join(named, F.col("name") == F.col("__name"), "left")
    only = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate dataset name: "), F.col("name"))).cast(rows.schema["by_name"].dataType)).otherwise(F.col("by_name"))
    how = F.when(F.col("mapped").isNotNull(), "mapping").when(F.col("earlier").isNotNull(), "previous").when(F.col("__n").isNotNull(), "name").otherwise("create")
    return rows.select("domain", F.coalesce("mapped", "earlier", only).alias("dataset_id"), how.alias("how"))


def next_step(status: DataFrame, built: Column) -> DataFrame:
    """What to do next from a readiness roll-up: upload, wait, anchor or retire."""
    s = status.agg(*[F.sum(c).alias(c) for c in ("total", "submitted_current", "ready", "anchor_required", "anchors_current")])
    step = F.when(~built, "build").when(F.col("submitted_current") < F.col("total"), "upload").when(F.col("ready") < F.col("total"), "wait").when(F.col("anchors_current") < F.col("anchor_required"), "anchor").otherwise("retire")
    return s.withColumn("step", step)


def wait_until(ready: Callable[[], bool], stop: Callable[[], None], seconds: float = 12 * 3600, poll: float = 30.0) -> bool:
    """Ask ``ready()`` every ``poll`` seconds until it holds or time is up; ``stop()`` raises to end the wait, and is asked twice a second."""
    end = time.monotonic() + seconds
    while not ready():
        until = min(end, time.monotonic() + poll)
        if time.monotonic() >= end:
            return False
        while time.monotonic() < until:
            stop()
            time.sleep(max(0.0, min(0.5, until - time.monotonic())))
    return True


def missing(needed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are needed and not there."""
    return needed.select(key).distinct().join(there.select(key), key, "left_anti")
