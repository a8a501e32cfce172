"""Word processor and spreadsheet files from rows, with the standard library alone."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, _HEAD + body)
    return out.getvalue()


def _container(main: str, kind: str, extra: str = "") -> dict[str, str]:
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{main}" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/>{extra}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


def docx(paragraphs: list[str]) -> bytes:
    """A document whose first paragraph is its heading; line breaks inside a paragraph stay."""
    runs = lambda p: "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in p.split("\n")) + "</w:r>"
    style = lambda i: '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if i == 0 else ""
    body = "".join(f"<w:p>{style(i)}{runs(p)}</w:p>" for i, p in enumerate(paragraphs))
    parts = _container("word/document.xml", "wordprocessingml.document")
    parts["word/document.xml"] = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    return _zip(parts)


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def xlsx(columns: list[str], rows: list[tuple], name: str = "manifest") -> bytes:
    """One sheet: header, first row frozen, a filter over all columns, widths by content up to 60."""

    def cell(r: int, c: int, v) -> str:
        at = f"{_column(c)}{r}"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    table = [tuple(columns), *rows]
    data = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(table, 1))
    widths = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(60, max(len(str(row[c])) for row in table) + 2)}" customWidth="1"/>' for c in range(len(columns)))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    extra = '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    parts = _container("xl/workbook.xml", "spreadsheetml.sheet", extra)
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{main}">{pane}<cols>{widths}</cols><sheetData>{data}</sheetData><autoFilter ref="A1:{_column(len(columns) - 1)}{len(table)}"/></worksheet>'
    return _zip(parts)


def render(documents: DataFrame) -> DataFrame:
    """key, content (bytes) of documents (key, paragraphs array)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "content": [docx(list(p)) for p in b["paragraphs"]]})

    return documents.select("key", "paragraphs").mapInPandas(run, "key string, content binary")
