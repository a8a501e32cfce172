"""Writers: tables, delimited bundles, packages, reports, archives."""

from __future__ import annotations

import hashlib
import html
import hmac
import io
import re
import tarfile
import time
import urllib.parse
import uuid
import zipfile
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metadata import exportable
from ..operators.scratch import stash
from ..operators.sizing import small_batches

#: The mark between the cards of a bundle, and the sentences of a card's file.
SEPARATOR = "<OPS_CARD_BOUNDARY>"
CARD_VERSION, CARD_USE = "资料适用版本：待业务确认", "用途：试点验证；不是已通过业务验收的操作规程。"
CARD_LIMIT = "本条存在需核对内容："
CARD_NO_LINK = "（内网图片服务待配置）"


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; with ``mark``, one file that starts with a byte order mark, as spreadsheets expect."""
    if mark:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first).coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet by folders of values."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def bundles(cards: DataFrame, by: str, order: str, text: str, separator: str = SEPARATOR) -> DataFrame:
    """by, bundle: texts in order joined by the separator; raises if a text holds the separator.  A bundle is one row here, so of 2 GB at most; ``write_bundles`` writes longer ones."""
    safe = F.when(F.col(text).contains(separator), F.raise_error(F.lit("reserved separator in content")).cast("string")).otherwise(F.col(text))
    rows = cards.select(by, F.struct(order, safe.alias("t")).alias("x"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), f"\n{separator}\n").alias("bundle"))


def write_bundles(cards: DataFrame, folder: str, by: str, order: str, text: str, separator: str = SEPARATOR) -> DataFrame:
    """by, path, bytes, md5: what ``bundles`` gives, each written as a file below ``folder``, however long.

    A file is one sequence of bytes: one task reads its group, in order, and holds an Arrow
    batch of texts at once, not the bundle.  A try that fails leaves a file that no row names.
    """
    small_batches(cards.sparkSession)
    safe = F.when(F.col(text).contains(separator), F.raise_error(F.lit("reserved separator in content")).cast("string")).otherwise(F.col(text))
    rows = cards.select(F.col(by).alias("g"), F.col(order).alias("o"), safe.cast("binary").alias("t"))
    mark = f"\n{separator}\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        system.create_dir(root)
        kind = None
        pairs = ((b, i) for b in batches for i in range(b.num_rows))
        for key, found in groupby(pairs, lambda x: x[0]["g"][x[1]].as_py()):
            path, digest, size, lead = f"{root}/{uuid.uuid4().hex}", hashlib.md5(), 0, b""
            with system.open_output_stream(path) as out:
                for batch, i in found:
                    kind = batch["g"].type
                    t = batch["t"][i].as_py()
                    for piece in () if t is None else (lead, t):
                        out.write(piece)
                        digest.update(piece)
                        size += len(piece)
                    lead = lead if t is None else mark
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([path]), pa.array([size]), pa.array([digest.hexdigest()])], [by, "path", "bytes", "md5"])

    schema = T.StructType([T.StructField(by, rows.schema["g"].dataType), T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("md5", T.StringType())])
    # written once, when this is called
    return stash(rows.repartition("g").sortWithinPartitions("g", "o", "t").select("g", "t").mapInArrow(run, schema), "bundle-files")


def bundle_parts(cards: DataFrame, by: str, order: str, text: str, max_chars: int, separator: str = SEPARATOR) -> DataFrame:
    """by, part, bundle: what ``bundles`` gives, cut between texts; joined by the separator, a group's parts are its bundle.

    A part holds the texts that start within ``max_chars`` characters of the group, so
    at most that much and one text more, however large its group.  Rows are dealt by
    ranges of group and order; what lies before a range is a sum over the ranges, so no
    task sorts or gathers a group.  Texts that tie in ``order`` go by themselves, null
    groups are one group, null texts count and join as empty ones.
    """
    safe = F.when(F.col(text).contains(separator), F.raise_error(F.lit("reserved separator in content")).cast("string")).otherwise(F.coalesce(F.col(text), F.lit("")))
    rows = cards.select(F.col(by).alias("g"), F.col(order).alias("o"), safe.alias("t")).withColumn("n", F.length("t").cast("long"))
    dealt = stash(rows.repartitionByRange("g", "o", "t").withColumn("p", F.spark_partition_id()), "bundles")
    ranges = dealt.groupBy("g", "p").agg(F.sum("n").alias("s"))
    earlier = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy("p" if c == "s" else "o", *([] if c == "s" else ["t"])).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range of a group
    before = ranges.select(F.col("g").alias("__g"), F.col("p").alias("__p"), earlier("s", "g").alias("before"))
    placed = dealt.join(before, F.col("g").eqNullSafe(F.col("__g")) & (F.col("p") == F.col("__p")))
    parted = placed.withColumn("part", F.floor((F.col("before") + earlier("n", "g", "p")) / F.lit(max_chars)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), f"\n{separator}\n")
    whole = stash(parted.groupBy("g", "part").agg(joined.alias("bundle")), "parts")
    # numbers without gaps, where a long text fills several; only these are brought together by group, not the bundles
    number = F.row_number().over(Window.partitionBy("g").orderBy("part"))
    numbers = whole.select(F.col("g").alias("__g"), F.col("part").alias("__part"), number.alias("number"))
    return whole.join(numbers, F.col("g").eqNullSafe(F.col("__g")) & (F.col("part") == F.col("__part"))).select(F.col("g").alias(by), F.col("number").alias("part"), "bundle")


def export_decisions(cards: DataFrame, drafts: bool = False) -> DataFrame:
    """card_id, included, and what kept a card out: validation_issues, review_flags, business_review.

    Cards with issues or flags never go; others if they are approved, or drafts are wanted.
    """
    return cards.select("card_id", exportable(F.col("validation_issues"), F.col("review_flags"), F.col("business_review"), drafts).alias("included"), "validation_issues", "review_flags", "business_review")


def export_summary(cards: DataFrame, text: str, drafts: bool = False) -> DataFrame:
    """One row: usage, count of included cards, of excluded ones, and the longest included text."""
    goes = exportable(F.col("validation_issues"), F.col("review_flags"), F.col("business_review"), drafts)
    return cards.agg(F.lit("pilot_only" if drafts else "approved_only").alias("usage"), F.count_if(goes).alias("count"), F.count_if(~goes).alias("excluded"), F.coalesce(F.max(F.when(goes, F.length(text))), F.lit(0)).alias("max_card_chars"))


def card_markdown(cards: DataFrame, asset_base: str = "") -> DataFrame:
    """card_id, markdown of question cards (title, module, question, cause, answer, flags, sources, and images (image_id, path) where there are any)."""
    lit = F.lit
    empty = F.array().cast("array<string>")
    block = lambda head, *body: F.array(lit(""), lit(f"## {head}"), *body)
    some = lambda c: F.coalesce(F.size(c), lit(0)) > 0
    sources = F.transform("sources", lambda s: F.concat(lit("- "), s["filename"], lit("，PDF 第 "), s["page"].cast("string"), lit(" 页；source_id="), s["source_id"]))
    parts = [
        F.array(F.concat(lit("# "), "title"), lit(""), F.concat(lit("卡片ID："), "card_id"), F.concat(lit("模块："), "module"), lit(CARD_VERSION), lit(CARD_USE)),
        block("用户问题", F.col("question")),
        F.when(F.coalesce("cause", lit("")) != "", block("原文原因", F.col("cause"))).otherwise(empty),
        block("原文处理说明", F.col("answer")),
        F.when(some(F.col("flags")), block("资料边界", F.concat(lit(CARD_LIMIT), F.array_join("flags", "；")))).otherwise(empty),
        F.concat(block("来源"), sources),
    ]
    if asset_base and "images" in cards.columns:
        link = lambda m: F.concat(lit("- ["), m["image_id"], lit(f"]({asset_base.rstrip('/')}/"), F.regexp_replace(m["path"], "^assets/", ""), lit(")"))
        parts.append(F.when(some(F.col("images")), F.concat(block("配图"), F.transform("images", link))).otherwise(empty))
    return cards.select("card_id", F.concat(F.array_join(F.concat(*parts), "\n"), lit("\n")).alias("markdown"))


def portable_paths(manifest: DataFrame, domain_names: dict[str, str], other: str = "资料导航") -> DataFrame:
    """``manifest`` with package_path: a folder per domain and the file's name; two different files of one package path raise."""
    folder = F.lit(other)
    for d, shown in domain_names.items():
        folder = F.when(F.col("domain") == d, shown).otherwise(folder)
    target = F.concat_ws("/", folder, F.regexp_extract("path", r"([^/\\]*)$", 1))
    files = manifest.select(target.alias("__t"), "path").groupBy("__t").agg(F.countDistinct("path").alias("__n"))
    clash = F.raise_error(F.concat(F.lit("two files of one package path: "), "package_path")).cast("string")
    rows = manifest.withColumn("package_path", target).join(files, F.col("package_path") == F.col("__t"))
    return rows.withColumn("package_path", F.when(F.col("__n") == 1, F.col("package_path")).otherwise(clash)).drop("__t", "__n")


def package(files: dict[str, bytes], target: str) -> None:
    """Zip of a few files that the caller holds, written aside and moved into place; ``archives.write`` packs tables."""
    part = Path(f"{target}.part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in sorted(files.items()):
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"path leaves the package: {name}")
            z.writestr(name, content)
    part.replace(target)


def server_bundle(files: dict[str, bytes], target: str) -> list[tuple[str, int, str]]:
    """tar.gz of a few files that the caller holds; returns the manifest (path, bytes, sha256).  ``archives.write`` packs tables."""
    manifest = [(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in sorted(files.items())]
    with tarfile.open(target, "w:gz") as tar:
        for name, content in sorted(files.items()):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return manifest


def html_report(rows: DataFrame, title: str) -> str:
    """Table of all of a report's rows, escaped; they come to the driver a partition at a time.  A report is an aggregate."""
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape(str('' if x is None else x))}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows.toLocalIterator())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{cells('th', rows.columns)}</tr>{body}</table>"


def signed_link(base: str, path: str, key: str, now: float | None = None, seconds: int = 3600) -> str:
    """Link to an asset that holds for an hour."""
    expires = int((time.time() if now is None else now) + seconds)
    quoted = urllib.parse.quote(path)
    sign = hmac.new(key.encode(), f"{path}\n{expires}".encode(), hashlib.sha256).hexdigest()
    return f"{base.rstrip('/')}/{quoted}?expires={expires}&signature={sign}"


def link_holds(path: str, expires: int, signature: str, key: str, now: float | None = None) -> bool:
    want = hmac.new(key.encode(), f"{path}\n{expires}".encode(), hashlib.sha256).hexdigest()
    return hmac.compare_digest(want, signature) and expires >= (time.time() if now is None else now)


def foreach_upload(plan: DataFrame, send, parallel: int = 4) -> None:
    """Carry out a plan's rows in at most ``parallel`` tasks at once; ``send`` must bear being called again for a row."""

    def part(rows) -> None:
        for r in rows:
            send(r.asDict(recursive=True))

    plan.coalesce(parallel).foreachPartition(part)
