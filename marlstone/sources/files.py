"""Reading files and artifacts: binary scans, digests, JSON, archives."""

from __future__ import annotations

import hashlib
import io
import os
import re
import urllib.parse
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, root: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Files below ``root``: (path) of all, and (path, length, content) of those that are not empty, which are all that Spark's reader gives."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    # the listing is the reader's own; it tells empty files too, in the form of URLs
    listed = pd.DataFrame({"path": [urllib.parse.unquote(p) for p in raw.inputFiles()]}, dtype=object)
    same = lambda p: F.regexp_replace(p, "^file:/+", "file:/")  # noqa: E731  two ways to write a local path
    return spark.createDataFrame(listed, "path string").select(same("path").alias("path")), raw.select(same("path").alias("path"), "length", "content")


def scan(spark: SparkSession, root: str, suffix: str = "pdf", page_count: Callable[[bytes], int] | None = None) -> DataFrame:
    """One row per file below ``root``, empty ones too, or for the one file that it names: source_id, sha256, path, relative_path, name, bytes, pages, status, error.

    ``page_count`` turns a file's bytes into its number of pages; a file that it
    cannot read becomes a row with status error.
    """
    listed, read = _files(spark, root, "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix))
    empty = listed.join(read.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    base = read.unionByName(empty).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages, errors = [], []
            for content in b["content"]:
                try:
                    pages.append(page_count(content) if page_count else None)
                    errors.append(None)
                except Exception as e:  # a broken file is a row, not a failure
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.drop(columns="content").assign(pages=pd.array(pages, "Int64"), error=errors)

    rows = base.mapInPandas(count, "path string, sha256 string, bytes long, pages long, error string")
    home = root.rstrip("/").rpartition("/")[0] if re.search(rf"(?i)\.{re.escape(suffix)}$", root) else root.rstrip("/")
    prefix = F.lit(Path(home).resolve().as_uri().replace("file://", "file:") + "/" if "://" not in root else home + "/")
    return rows.select(
        F.substring("sha256", 1, 16).alias("source_id"),
        "sha256",
        "path",
        F.replace("path", prefix, F.lit("")).alias("relative_path"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
        "bytes",
        "pages",
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
        "error",
    )


def directory_size(spark: SparkSession, root: str) -> DataFrame:
    """files, bytes below ``root``; empty files count, contents are not read."""
    listed, read = _files(spark, root)
    rows = listed.join(read.select("path", "length"), "path", "left")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """Whole-file JSON artifacts of a folder or a file, with a fixed schema; a byte order mark is fine."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)


PAGE = (
    "source_id string, page long, raw_text string, width double, height double, lines array<struct<text:string,top:double,bottom:double>>, "
    "images array<struct<bbox:array<double>,sha256:string,content:binary>>, tables array<struct<bbox:array<double>,rows:array<array<string>>,status:string,error:string>>, "
    "raster binary, status string, error string"
)
#: Decoded rows, and bytes of the files that they come from, that a task passes on at once.
_BATCH_ROWS, _BATCH_BYTES = 1000, 4 << 20
OUTLINE = "source_id string, pos long, page long, title string, level int, height double, view_y double, is_xyz boolean, error string"


def _decoded(files: DataFrame, decoder: Callable[[bytes], list[dict]], schema: str, first: dict, bad: dict) -> DataFrame:
    """A row for each dict that ``decoder`` makes of a file's content; a file that it cannot read is one row with an error."""
    names = [x.split()[0] for x in _split_fields(schema)]
    made = files.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for sid, content in zip(b.column("source_id"), b.column("content"), strict=True):
                sid, content = sid.as_py(), content.as_py()
                try:
                    rows = [{**first, **row, "source_id": sid} for row in decoder(content)]
                except Exception as e:  # a broken file is a row, not a failure
                    rows = [{**bad, "source_id": sid, "error": f"{type(e).__name__}: {e}"}]
                for i, row in enumerate(rows):
                    row.setdefault("page", i + 1) if "pos" not in names else row.setdefault("pos", i)
                held += rows
                size += len(content or b"")
                # rows of small files go together, those of a large one in several batches
                if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                    for at in range(0, len(held), _BATCH_ROWS):
                        yield pa.RecordBatch.from_pylist(held[at : at + _BATCH_ROWS], schema=made)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=made)

    return files.select("source_id", "content").mapInArrow(run, schema)


def _split_fields(schema: str) -> list[str]:
    return re.split(r", (?=[a-z_0-9]+ )", schema)


def decode_pages(files: DataFrame, decoder: Callable[[bytes], list[dict]]) -> DataFrame:
    """Pages (columns ``PAGE``) that ``decoder`` finds in each file's content (source_id, content).

    A decoder returns a dict a page: text (or raw_text), width, height, lines (text, top,
    bottom), images (bbox, sha256, content), tables (bbox, rows, or error), raster.
    What it leaves out is null; a file it cannot read is one row of status failed.
    """

    def pages(content: bytes) -> list[dict]:
        out = []
        for i, p in enumerate(decoder(content), 1):
            tables = [{"bbox": t.get("bbox"), "rows": t.get("rows"), "status": "failed" if t.get("error") else "needs_visual_review", "error": t.get("error")} for t in p.get("tables") or []]
            images = [{"bbox": m["bbox"], "sha256": m.get("sha256") or hashlib.sha256(m.get("content") or b"").hexdigest(), "content": m.get("content")} for m in p.get("images") or []]
            lines = [{"text": x["text"], "top": x["top"], "bottom": x["bottom"]} for x in p.get("lines") or []]
            out.append({"page": i, "raw_text": p.get("raw_text", p.get("text")), "width": p.get("width"), "height": p.get("height"), "lines": lines, "images": images, "tables": tables, "raster": p.get("raster")})
        return out

    return _decoded(files, pages, PAGE, {"status": "complete"}, {"status": "failed", "page": None})


def decode_outline(files: DataFrame, decoder: Callable[[bytes], list[dict]]) -> DataFrame:
    """Outline entries (columns ``OUTLINE``) for ``corpus.toc_boundaries``: a decoder returns dicts of page, title, level, height, view_y, is_xyz in order."""
    return _decoded(files, decoder, OUTLINE, {}, {"pos": None})


def pdf_pages(content: bytes) -> list[dict]:
    """Decoder of PDF text and sizes; needs pypdfium2, which is asked for only here."""
    import pypdfium2

    pdf = pypdfium2.PdfDocument(content)
    try:
        return [{"text": page.get_textpage().get_text_range(), "width": page.get_width(), "height": page.get_height()} for page in pdf]
    finally:
        pdf.close()


def pdf_layout(content: bytes) -> list[dict]:
    """Decoder of positioned text, pictures and tables; needs pdfplumber, which is asked for only here."""
    import pdfplumber

    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            images = [{"bbox": [float(m[k]) for k in ("x0", "top", "x1", "bottom")], "content": m["stream"].get_data()} for m in page.images]
            lines = [{"text": x["text"], "top": float(x["top"]), "bottom": float(x["bottom"])} for x in page.extract_text_lines(x_tolerance=2, y_tolerance=3)]
            try:
                tables = [{"bbox": list(map(float, t.bbox)), "rows": t.extract()} for t in page.find_tables()]
            except Exception as e:  # a table that cannot be read is a row, not a failure
                tables = [{"error": type(e).__name__}]
            out.append({"text": page.extract_text(x_tolerance=2, y_tolerance=3) or "", "width": float(page.width), "height": float(page.height), "lines": lines, "images": images, "tables": tables})
    return out


def pdf_outline(content: bytes) -> list[dict]:
    """Decoder of a PDF's outline; needs pypdfium2, which is asked for only here."""
    import pypdfium2

    pdf = pypdfium2.PdfDocument(content)
    try:
        out = []
        for item in pdf.get_toc():
            xyz = item.view_mode == 1 and len(item.view_pos) >= 2
            page = None if item.page_index is None else item.page_index + 1
            out.append({"page": page, "title": item.title, "level": item.level, "height": None if page is None else pdf[item.page_index].get_height(), "view_y": item.view_pos[1] if xyz else 0.0, "is_xyz": xyz})
        return out
    finally:
        pdf.close()


def uploads(names: DataFrame, column: str = "name") -> DataFrame:
    """``names`` of uploaded files with ``relative``, the path below the job's folder; a name that is absolute, climbs out or is no PDF raises."""
    from ..functions.text import safe_relative

    found = safe_relative(F.col(column))
    return names.withColumn("relative", F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported upload: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")))


def docx_text(content: bytes) -> tuple[str, int]:
    """Text and number of pictures of a word processor file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text = "".join(e.text or "" for e in root.iter() if e.tag.endswith("}t"))
    return text, sum(1 for e in root.iter() if e.tag.endswith("}blip"))


def read_docx(files: DataFrame) -> DataFrame:
    """path, text, images of word processor files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *docx_text(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "images"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, images long")


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file, quotes stripped, comments left out; existing variables win."""
    out = {}
    for raw in Path(path).read_text(encoding="utf-8-sig").splitlines():
        m = re.match(r"\s*([^#=\s][^=]*?)\s*=\s*(.*?)\s*$", raw)
        if m:
            out[m[1]] = m[2].strip("\"'")
            os.environ.setdefault(m[1], out[m[1]])
    return out


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a YAML file as rows, whether given as lists or as mappings."""
    import yaml

    loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    cases = loaded["cases"] if isinstance(loaded, dict) else loaded
    rows = []
    for c in cases:
        if isinstance(c, list):
            rows.append((str(c[0]), c[1], c[2], c[3] if isinstance(c[3], int) else None, c[4], []))
        else:
            rows.append((str(c["id"]), c.get("split"), c.get("kind"), c.get("page"), c["query"], [str(x) for x in c.get("expected", [])]))
    return spark.createDataFrame(rows, "id string, split string, kind string, page int, query string, expected array<string>")
