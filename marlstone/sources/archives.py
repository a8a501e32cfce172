"""tar.gz and zip archives that the executors make.

Each task packs its share of the files into a part of its own, in blocks, and says
in its rows which part that is; parts of tasks that were lost or run twice are in
nobody's rows.  The parts then are copied side by side into the archive, each by the
task that gets it and at its own offset: gzip members that follow each other are one
gzip file, and zip entries may stand anywhere a central directory points to.  The
driver handles a row for each part and the archive's last few bytes.

Archives and the files that go into them lie in folders that are mounted on all
machines; a file that is written at many places at once cannot be on an object store.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import shared_dir, stash

BLOCK = 1 << 20
MANIFEST = "bundle-manifest.jsonl"
_PACKED = "path string, bytes long, sha256 string, part string, first string, files long, body long, index_bytes long, lines long"
_PIECES = "offset long, file string, size long, base long, content binary"


def mounted(path: str) -> str:
    """``path`` as the machines' file system knows it."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"not a mounted folder: {path}")
    return plain


def _blocks(content: bytes | None, file: str | None, size: int) -> Iterator[bytes]:
    if content is not None:
        yield content
        return
    before = os.stat(file)
    read = 0
    with open(file, "rb") as f:
        while block := f.read(BLOCK):
            read += len(block)
            if read > size:
                break
            yield block
    after = os.stat(file)
    if read != size or (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        raise ValueError(f"input changed while packaging: {file}")


def _tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size, info.mode = size, 0o644
    return info.tobuf(tarfile.GNU_FORMAT)


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


class _TarPart:
    """A gzip member of tar entries, and beside it one of their manifest lines."""

    def __init__(self, path: str):
        self.path, self.lines = path, 0
        self.raw, self.raw_index = open(path, "wb"), open(path + ".lines", "wb")
        self.out = gzip.GzipFile("", "wb", 1, self.raw, mtime=0)
        self.index = gzip.GzipFile("", "wb", 1, self.raw_index, mtime=0)

    def add(self, name: str, size: int, blocks: Iterator[bytes]) -> str:
        seen = hashlib.sha256()
        self.out.write(_tar_header(name, size))
        for block in blocks:
            seen.update(block)
            self.out.write(block)
        self.out.write(bytes(-size % 512))
        line = json.dumps({"path": name, "bytes": size, "sha256": seen.hexdigest()}, ensure_ascii=False).encode() + b"\n"
        self.lines += self.index.write(line)
        return seen.hexdigest()

    def close(self) -> tuple[int, int, int]:
        """Bytes of the entries, of the index, and of the lines in it."""
        for f in (self.out, self.index, self.raw, self.raw_index):
            f.close()
        return os.path.getsize(self.path), os.path.getsize(self.path + ".lines"), self.lines


class _ZipPart:
    """A zip of its own, of which the archive takes the entries; its directory is written anew for where they come to stand."""

    def __init__(self, path: str):
        self.path, self.size = path, 0
        self.out = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)

    def add(self, name: str, size: int, blocks: Iterator[bytes]) -> str:
        seen = hashlib.sha256()
        info = zipfile.ZipInfo(name)
        info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
        with self.out.open(info, "w", force_zip64=size >= 1 << 30) as f:
            for block in blocks:
                seen.update(block)
                f.write(block)
        self.size += len(_central(info, 0))
        return seen.hexdigest()

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        return self.out.start_dir, self.size, 0


def _central(info: zipfile.ZipInfo, base: int) -> bytes:
    """Directory record of an entry whose part starts at ``base``, always in the long form, so that its length does not depend on that."""
    name = info.filename.encode()
    extra = struct.pack("<HHQQQ", 1, 24, info.file_size, info.compress_size, base + info.header_offset)
    date = (info.date_time[0] - 1980) << 9 | info.date_time[1] << 5 | info.date_time[2]
    most = 0xFFFFFFFF
    head = struct.pack("<4sBBHHHHHLLLHHHHHLL", b"PK\1\2", 45, 3, 45, info.flag_bits, info.compress_type, 0, date, info.CRC, most, most, len(name), len(extra), 0, 0, 0, info.external_attr, most)
    return head + name + extra


def _zip_end(files: int, size: int, at: int) -> bytes:
    few, most = min(files, 0xFFFF), 0xFFFFFFFF
    return struct.pack("<4sQHHLLQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, files, files, size, at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + size, 1) + struct.pack("<4sHHHHLLH", b"PK\5\6", 0, 0, few, few, most, most, 0)


def _packer(stage: str, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(stage, exist_ok=True)
        name = f"{stage}/{uuid.uuid4().hex}"
        part, last, first, n = None, None, None, 0
        for batch in batches:
            out = []
            for path, content, file in zip(batch["path"], batch["content"], batch["file"]):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"path leaves the archive: {path}")
                if path == last:
                    raise ValueError(f"two files of one path: {path}")
                if part is None:
                    part, first = _ZipPart(name) if kind == "zip" else _TarPart(name), path
                content = b"" if content is None and file is None else content
                size = os.path.getsize(file) if content is None else len(content)
                out.append((path, size, part.add(path, size, _blocks(content, file, size)), name))
                last, n = path, n + 1
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256", "part"]).assign(first=None, files=None, body=None, index_bytes=None, lines=None)
        if part is not None:
            yield pd.DataFrame([(None, None, None, name, first, n, *part.close())], columns=["path", "bytes", "sha256", "part", "first", "files", "body", "index_bytes", "lines"])

    return run


def _copier(target: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                with open(target, "r+b") as out:
                    out.seek(int(p.offset))
                    if p.content is not None:
                        out.write(p.content)
                    elif pd.notna(p.base):
                        with zipfile.ZipFile(p.file) as z:
                            for info in z.infolist():
                                out.write(_central(info, int(p.base)))
                    else:
                        with open(p.file, "rb") as f:
                            left = int(p.size)
                            while left:
                                block = f.read(min(left, BLOCK))
                                if not block:
                                    raise ValueError(f"part is short: {p.file}")
                                out.write(block)
                                left -= len(block)
                    if out.tell() != p.offset + p.size:
                        raise ValueError(f"part of another size: {p.file}")
                yield pd.DataFrame({"written": [int(p.size)]})

    return run


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with open(path, "rb") as f:
                yield pd.DataFrame({"sha256": [hashlib.file_digest(f, "sha256").hexdigest()]})


def _pieces(parts: list, kind: str) -> tuple[list[tuple], int]:
    """What stands where in the archive, and its size."""
    pieces, at = [], 0

    def put(file: str | None, size: int, base: int | None = None, content: bytes | None = None) -> None:
        nonlocal at
        pieces.append((at, file, size, base, content))
        at += size

    bases = []
    for p in parts:
        bases.append(at)
        put(p["part"], p["body"])
    if kind == "zip":
        start = at
        for p, base in zip(parts, bases):
            put(p["part"], p["index_bytes"], base)
        tail = _zip_end(sum(p["files"] for p in parts), at - start, start)
    else:
        lines = sum(p["lines"] for p in parts)
        head = _member(_tar_header(MANIFEST, lines))
        put(None, len(head), content=head)
        for p in parts:
            put(p["part"] + ".lines", p["index_bytes"])
        tail = _member(bytes(-lines % 512 + 1024))
    put(None, len(tail), content=tail)
    return pieces, at


def write(entries: DataFrame, target: str, kind: str = "tar.gz", parts: int | None = None) -> DataFrame:
    """Archive of ``entries`` (path, and content binary or file, the name of a file to read); returns its manifest: path, bytes, sha256.

    Entries of one path, paths that lead out of the archive, files that change while
    they are read, and a target that is there raise, and leave no archive behind.  An
    entry with neither content nor file is empty.  A tar.gz ends with the manifest as
    lines of JSON.  Beside the archive stand its SHA-256 (``.sha256``; read in order
    by one task, as such a digest must be) and where its members start
    (``.members``, for ``read``).  ``parts``: tasks that pack; files are dealt by a hash of the path.
    """
    spark = entries.sparkSession
    if kind not in ("tar.gz", "zip"):
        raise ValueError(f"unknown kind of archive: {kind}")
    target = mounted(target)
    stage = f"{mounted(shared_dir(spark))}/archives/{uuid.uuid4().hex}"
    partial = target + ".partial"
    if os.path.exists(target) or os.path.exists(partial):
        raise FileExistsError(f"output already exists: {target}")
    typed = lambda c, t: (F.col(c) if c in entries.columns else F.lit(None)).cast(t).alias(c)
    n = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = entries.select("path", typed("content", "binary"), typed("file", "string")).repartition(n, "path").sortWithinPartitions("path")
    try:
        packed = stash(dealt.mapInPandas(_packer(stage, kind), _PACKED), "archive")
        made = packed.filter("path is null").orderBy("first").collect()  # a row for each task
        pieces, size = _pieces(made, kind)
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        with open(partial, "xb") as f:
            f.truncate(size)
        copied = spark.createDataFrame(pieces, _PIECES).repartition(min(len(pieces), n)).mapInPandas(_copier(partial), "written long")
        if copied.agg(F.sum("written")).first()[0] != size:
            raise ValueError("archive of another size than its parts")
        sha = spark.createDataFrame([(partial,)], "path string").mapInPandas(_digest, "sha256 string").first()[0]
        with open(target + ".sha256", "w", encoding="utf-8") as f:
            f.write(f"{sha}  {os.path.basename(target)}\n")
        with open(target + ".members", "w", encoding="utf-8") as f:
            json.dump([[at, length] for at, file, length, _, _ in pieces[: len(made)]], f)
        os.replace(partial, target)
    except BaseException:
        if os.path.exists(partial):
            os.remove(partial)
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return packed.filter("path is not null").select("path", "bytes", "sha256")


def read(spark: SparkSession, target: str) -> DataFrame:
    """path, content of a tar.gz that ``write`` made: its members are read by a task each."""
    target = mounted(target)
    with open(target + ".members", encoding="utf-8") as f:
        members = json.load(f)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, length in zip(batch["at"], batch["length"]):
                with open(target, "rb") as f:
                    f.seek(int(at))
                    with tarfile.open(fileobj=_Span(f, int(length)), mode="r|gz") as tar:
                        for info in tar:
                            yield pd.DataFrame({"path": [info.name], "content": [tar.extractfile(info).read()]})

    spans = spark.createDataFrame([tuple(m) for m in members], "at long, length long")
    return spans.repartition(max(len(members), 1)).mapInPandas(run, "path string, content binary")


class _Span:
    """The next ``left`` bytes of a file."""

    def __init__(self, f, left: int):
        self.f, self.left = f, left

    def read(self, n: int) -> bytes:
        out = self.f.read(min(n, self.left))
        self.left -= len(out)
        return out


def read_zip(manifest: DataFrame, target: str) -> DataFrame:
    """path, content of the zip's entries that ``manifest`` names; each task reads the directory and its own entries."""
    target = mounted(target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(target) as z:
            for batch in batches:
                for path in batch["path"]:
                    yield pd.DataFrame({"path": [path], "content": [z.read(path)]})

    return manifest.select("path").mapInPandas(run, "path string, content binary")
