"""Command line: queries over the standard tables, scans, the steps from pages to exports, searches and indexes."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, corpus, evaluation, inventory, navigation, retrieval, sync
from .operators.models import hashed_encoder
from .plans import registry
from .sources import files, sinks, snapshots


def session() -> SparkSession:
    return SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query and write or show its rows")
    q.add_argument("name", choices=sorted(registry.queries))
    q.add_argument("tables", help="folder of the Parquet tables")
    q.add_argument("--out", help="folder to write Parquet to")
    s = sub.add_parser("scan", help="inventory of the PDF files below a folder")
    s.add_argument("root")
    s.add_argument("--out")
    i = sub.add_parser("index", help="build or refresh an index of documents (doc_id, topic, title, content, ...)")
    i.add_argument("documents")
    i.add_argument("index")
    f = sub.add_parser("search", help="ranked evidence for a query")
    f.add_argument("index")
    f.add_argument("query")
    f.add_argument("--top-k", type=int, default=5)
    f.add_argument("--engine", choices=retrieval.MODES, default="hybrid")
    f.add_argument("--domain", action="append", default=[])
    f.add_argument("--source-id", default="")
    f.add_argument("--section-prefix", default="")
    f.add_argument("--kind", default="")
    for name, text, inputs in STEPS:
        step = sub.add_parser(name, help=text)
        for x in inputs:
            step.add_argument(x)
        step.add_argument("--out", help="folder to write Parquet to")
        if name == "export":
            step.add_argument("--include-drafts", action="store_true")
    return p


#: Steps over Parquet tables: name, help, inputs.
STEPS = (
    ("plan", "tasks, one a page, of an inventory", ["sources"]),
    ("native", "pages of the PDF files below a folder (needs pypdfium2)", ["root"]),
    ("process", "decoded pages as evidence", ["pages"]),
    ("cards", "question cards of pages (source_id, page, name, module, text)", ["pages"]),
    ("procedures", "procedures across pages (source_id, page, text)", ["pages"]),
    ("navigation", "navigation records of sources and their chunks", ["sources", "chunks"]),
    ("export", "which cards are exported, and what keeps the others out", ["cards"]),
    ("sync", "what an upload would do (nothing is sent)", ["manifest", "receipts", "remote"]),
    ("evaluate", "hit rates of results against expected documents", ["results", "expected"]),
    ("report", "page of a table's rows", ["table"]),
)


def run_step(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The table that a step makes of its inputs."""
    read = spark.read.parquet
    if a.command == "plan":
        return inventory.page_tasks(read(a.sources))
    if a.command == "native":
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(a.root)
        return files.decode_pages(found.select(F.substring(F.sha2("content", 256), 1, 16).alias("source_id"), "content"), files.pdf_pages)
    if a.command == "process":
        return corpus.parsed_pages(read(a.pages))
    if a.command == "cards":
        return catalog.merge_cards(catalog.card_rows(read(a.pages)))
    if a.command == "procedures":
        return catalog.packets(read(a.pages))
    if a.command == "navigation":
        return navigation.records(read(a.sources), read(a.chunks))
    if a.command == "export":
        return sinks.export_decisions(read(a.cards), a.include_drafts)
    if a.command == "sync":
        return sync.upload_plan(read(a.manifest), read(a.receipts), read(a.remote))
    return evaluation.summary(evaluation.first_hit(read(a.results), read(a.expected)), [])


def show(df: DataFrame, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        df.show(50, truncate=80)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    if a.command in ("query", "scan"):
        df = registry.queries[a.name](spark, a.tables) if a.command == "query" else files.scan(spark, a.root)
        show(df, a.out)
    elif a.command == "report":
        page = sinks.html_report(spark.read.parquet(a.table), a.table)
        if a.out:
            Path(a.out).write_text(page, encoding="utf-8")
        else:
            print(page)
    elif a.command in {name for name, *_ in STEPS}:
        show(run_step(spark, a), a.out)
    elif a.command == "index":
        docs = spark.read.parquet(a.documents)
        print(snapshots.build_index(docs, retrieval.passages(docs), hashed_encoder()(), a.index))
    else:
        retrieval.check_query(a.query, a.top_k, a.engine)
        docs, rows = snapshots.open_index(spark, a.index)
        asked = spark.createDataFrame([(1, a.query, hashed_encoder()()([a.query])[0].tolist())], "query_id int, query string, vector array<double>")
        where = retrieval.scope(a.domain, a.source_id, a.kind, a.section_prefix) if a.domain or a.source_id or a.kind or a.section_prefix else None
        found = retrieval.search(docs, rows, rows.select("doc_id", "passage_id", "vector"), asked, asked, a.engine, a.top_k, where)
        found.orderBy("rank").select("rank", "doc_id", F.round("score", 5).alias("score"), "matched_text").show(a.top_k, truncate=120)


if __name__ == "__main__":
    main()
