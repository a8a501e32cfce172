"""Pages of document files as a data source that splits files and decodes only what is asked for.

``read`` gives a DataFrame over a Python data source.  A file of more than
``SPLIT_BYTES`` is dealt over several partitions, each of which takes every n-th block
of ``BLOCK`` pages, so no file has to be opened to plan the scan and one large file is
decoded by many tasks; small files share partitions.  Filters on ``page``,
``relative_path`` and ``name`` are taken over by the reader: files that cannot match
are not opened, and pages that are not asked for are not decoded.

A decoder opens a file and gives its pages one by one; what it cannot read is a row of
status failed, as for ``files.decode_pages``: a file that does not open, or a page that
does not decode, is a row and never ends the scan.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SPLIT_BYTES, BLOCK = 32 << 20, 16
#: Bytes and files of small files to a partition.
SHARED_BYTES, SHARED_FILES = 32 << 20, 256
SCHEMA = "relative_path string, name string, bytes long, page int, pages int, text string, width double, height double, content binary, status string, error string"

#: Opens a file (seekable, binary) and gives its pages: ``len`` and access by number from 0, a dict of text, width, height, content each.
Decoder = Callable[[object], Sequence[dict]]


@dataclass
class Wanted:
    """What filters leave: pages, as bounds or a list, and paths and names, as lists; None for all."""

    least: int = 1
    most: int | None = None
    only: set | None = None
    paths: set | None = None
    names: set | None = None
    #: Whether rows without a page (files that do not open) are asked for.
    fileless: bool = True

    def take(self, f) -> bool:
        """Narrow by a filter; whether it is taken over whole."""
        if not hasattr(f, "attribute") or len(f.attribute) != 1:
            return False
        column, value = f.attribute[0], getattr(f, "value", None)
        if isinstance(f, (EqualTo, EqualNullSafe)) and value is not None:
            values = {value}
        elif isinstance(f, In):
            values = {v for v in f.value if v is not None}
        else:
            values = None
        if column in ("relative_path", "name") and values is not None:
            key = "paths" if column == "relative_path" else "names"
            had = getattr(self, key)
            setattr(self, key, values if had is None else had & values)
            return True
        if column != "page":
            return isinstance(f, IsNotNull) and column in ("relative_path", "name")
        if isinstance(f, IsNotNull):
            pass
        elif values is not None:
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            top = value - isinstance(f, LessThan)
            self.most = top if self.most is None else min(self.most, top)
        else:
            return False
        self.fileless = False
        return True

    def file(self, relative_path: str) -> bool:
        name = relative_path.rpartition("/")[2]
        return (self.paths is None or relative_path in self.paths) and (self.names is None or name in self.names)

    def within(self, count: int) -> list[int]:
        """Asked pages of a file of ``count`` pages."""
        top = count if self.most is None else min(count, self.most)
        if self.only is not None:
            return sorted(p for p in self.only if self.least <= p <= top)
        return list(range(self.least, top + 1))


@dataclass
class Part(InputPartition):
    """Blocks ``k``, ``k + n``, ... of each of the files (path, relative path, bytes)."""

    files: list = field(default_factory=list)
    k: int = 0
    n: int = 1


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


class _Reader(DataSourceReader):
    def __init__(self, root: str, suffix: str, decoder: Decoder):
        self.root, self.suffix, self.decoder, self.wanted = root, suffix, decoder, Wanted()

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, root = _system(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        parts, shared, held = [], Part(), 0
        for info in sorted(found, key=lambda i: i.path):
            relative = info.path[len(root) :].lstrip("/")
            if info.type != fs.FileType.File or not relative.lower().endswith(self.suffix.lower()) or not self.wanted.file(relative):
                continue
            n = -(-info.size // SPLIT_BYTES)
            if n > 1:
                parts += [Part(files=[(info.path, relative, info.size)], k=k, n=n) for k in range(n) if self._asks(k, n)]
                continue
            if held + info.size > SHARED_BYTES or len(shared.files) == SHARED_FILES:
                parts.append(shared)
                shared, held = Part(), 0
            shared.files.append((info.path, relative, info.size))
            held += info.size
        return parts + [shared] if shared.files or not parts else parts

    def _asks(self, k: int, n: int) -> bool:
        """Whether a partition can have asked pages; the first also tells files that do not open."""
        w = self.wanted
        if k == 0 and w.fileless or w.only is None:
            return True
        return any((p - 1) // BLOCK % n == k for p in w.only)

    def read(self, part: Part) -> Iterator[tuple]:
        system, _ = _system(self.root)
        w = self.wanted
        for path, relative, size in part.files:
            name = relative.rpartition("/")[2]
            failed = lambda page, pages, e: (relative, name, size, page, pages, None, None, None, None, "failed", f"{type(e).__name__}: {e}")  # noqa: B023, E731
            with system.open_input_file(path) as f:
                try:
                    pages = self.decoder(f)
                    count = len(pages)
                except Exception as e:  # a file that does not open is a row, once
                    if part.k == 0 and w.fileless:
                        yield failed(None, None, e)
                    continue
                for p in w.within(count):
                    if (p - 1) // BLOCK % part.n == part.k:
                        try:
                            d = pages[p - 1]
                            content = d.get("content")
                            yield (relative, name, size, p, count, d.get("text"), d.get("width"), d.get("height"), content, "complete", None)
                        except Exception as e:  # as is a page
                            yield failed(p, count, e)
                if hasattr(pages, "close"):
                    pages.close()


def read(spark: SparkSession, root: str, decoder: Decoder, suffix: str = ".pdf") -> DataFrame:
    """Pages (columns ``SCHEMA``) of the files below ``root``; page from 1, null for a file that does not open.

    Takes part of the filters on the result: see the module.  The session is set to
    offer them to Python data sources, which is off by default.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    given = f"document_pages_{uuid.uuid4().hex[:12]}"

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return given

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(root, suffix, decoder)

    spark.dataSource.register(Pages)
    return spark.read.format(given).load()


class PdfPages(Sequence):
    """Decoder of PDF text, sizes and, with ``raster``, page images at twice the size; needs pypdfium2, which is asked for only here."""

    def __init__(self, file, raster: bool = False):
        import pypdfium2

        self.pdf, self.raster = pypdfium2.PdfDocument(file), raster

    def __len__(self) -> int:
        return len(self.pdf)

    def __getitem__(self, i: int) -> dict:
        page = self.pdf[i]
        out = {"text": page.get_textpage().get_text_range(), "width": page.get_width(), "height": page.get_height()}
        if self.raster:
            import io

            image = io.BytesIO()
            page.render(scale=2.0).to_pil().save(image, "PNG")
            out["content"] = image.getvalue()
        return out

    def close(self) -> None:
        self.pdf.close()


class LinePages(Sequence):
    """Decoder of text files whose lines are their pages, by byte offsets: a page is read when it is asked for."""

    def __init__(self, file):
        self.file, self.starts = file, [0]
        if file.read(1) == b".":
            raise ValueError("broken")
        file.seek(0)
        while chunk := file.read(1 << 20):
            at = file.tell() - len(chunk)
            self.starts += [at + m.end() for m in re.finditer(b"\n", chunk)]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> dict:
        self.file.seek(self.starts[i])
        line = self.file.read(self.starts[i + 1] - self.starts[i])
        return {"text": line.rstrip(b"\n").decode(), "width": float(len(line)), "height": 1.0}
