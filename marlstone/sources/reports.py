"""Reports: guides, workflow files and figures, from aggregates that are small."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metadata import DOMAINS


def upload_guide(manifest: DataFrame) -> str:
    """Markdown: documents and pictures per domain."""
    rows = manifest.groupBy("domain").agg(F.count("*").alias("n"), F.sum("image_count").alias("images")).orderBy("domain").collect()
    lines = ["# 导入说明", "", "| 主题 | 文档 | 配图 |", "|---|---|---|"]
    return "\n".join(lines + [f"| {DOMAINS.get(r['domain'], r['domain'])} | {r['n']} | {r['images']} |" for r in rows]) + "\n"


def workflow_yaml(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as YAML; a graph is small: a node per route and step."""
    import yaml

    graph = {
        "nodes": [{"id": r["id"], "type": r["kind"], "data": {"members": r["members"]}} for r in nodes.orderBy("id").collect()],
        "edges": [{"source": r["source"], "target": r["target"], "sourceHandle": r["handle"]} for r in edges.orderBy("source", "target").collect()],
    }
    return yaml.safe_dump(graph, allow_unicode=True, sort_keys=False)


def figures(**tables: DataFrame) -> tuple[str, str]:
    """JSON and Markdown of aggregates by name, all of their rows."""
    data = {name: [r.asDict(recursive=True) for r in df.toLocalIterator()] for name, df in tables.items()}
    text = []
    for name, rows in data.items():
        text.append(f"## {name}\n")
        text += [f"- {', '.join(f'{k}: {v}' for k, v in r.items())}" for r in rows]
    return json.dumps(data, ensure_ascii=False, default=str, indent=2), "\n".join(text) + "\n"


def image_bundle_errors(images: DataFrame, per_chunk: int = 10, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """chunk_id, error of picture bundles (chunk_id, image_id, bytes): too many in a chunk, missing or too large."""
    count = images.groupBy("chunk_id").agg(F.count("*").alias("n")).filter(F.col("n") > per_chunk).select("chunk_id", F.lit("too many images").alias("error"))
    size = images.filter(F.col("bytes").isNull() | (F.col("bytes") >= max_bytes)).select("chunk_id", F.when(F.col("bytes").isNull(), "missing image").otherwise("image too large").alias("error"))
    return count.unionByName(size)


def error_names(rows: DataFrame, by: str, name: str, k: int = 5) -> DataFrame:
    """by, names, n: the first ``k`` names that failed, joined, and the number of all."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(name))
    first = rows.select(by, name).distinct().withColumn("__i", place).filter(F.col("__i") <= k)
    shown = first.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), "、").alias("names"))
    return shown.join(rows.groupBy(by).agg(F.count("*").alias("n")), by)
