"""Workflow graphs: routes, nodes and edges, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata import DOMAINS
from .scratch import discard, stash

#: Rounds after which the nodes that were reached are written into one table.
GATHER = 16

#: Pairs of domains that one route may search.
PAIRS = (("projects", "finance"), ("equipment", "finance"), ("equipment", "projects"), ("procurement", "finance"), ("funds", "finance"))


def route_members() -> dict[str, list[str]]:
    """Route -> domains: one each, and pairs."""
    return {d: [d] for d in DOMAINS} | {f"{a}_{b}": [a, b] for a, b in PAIRS}


def route_domains(route: str) -> list[str]:
    """Domains of a route; all for an empty one; ValueError for one that is unknown."""
    if not route:
        return list(DOMAINS)
    try:
        return route_members()[route]
    except KeyError:
        raise ValueError("unknown route") from None


def routes(spark: SparkSession, available: list[str]) -> DataFrame:
    """pos, route, members: known domains in their order, others, pairs whose members are there, and clarify."""
    known = [d for d in DOMAINS if d in available]
    other = [d for d in available if d not in DOMAINS]
    first = [d for d in available if d in DOMAINS and d == "finance"]
    order = first + [d for d in known if d not in first] + other
    rows = [(d, [d]) for d in order] + [(f"{a}_{b}", [a, b]) for a, b in PAIRS if a in available and b in available] + [("clarify", [])]
    return spark.createDataFrame([(i, r, m) for i, (r, m) in enumerate(rows)], "pos int, route string, members array<string>")


def used_categories(documents: DataFrame, configured: DataFrame, missing: str = "unknown category: ") -> DataFrame:
    """Rows of ``configured`` (domain and what belongs to it) whose domain some document has; a document's domain that is not there raises, a null one too.

    The same rule finds the datasets of a job's categories among all receipts of a
    server (``missing`` says what lacks).
    """
    used = documents.select("domain").distinct()
    there = configured.withColumn("__there", F.lit(True)).withColumnRenamed("domain", "__domain")
    name = F.coalesce(F.col("domain").cast("string"), F.lit("null"))
    known = F.when(F.col("__there"), F.col("domain")).otherwise(F.raise_error(F.concat(F.lit(missing), name)).cast("string"))
    return used.join(there, F.col("domain") == F.col("__domain"), "left").withColumn("domain", known).drop("__domain", "__there")


def workflow(route_rows: DataFrame, scoped: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, members) and edges (source, target, handle) of a routed answer flow.

    Routes in ``scoped`` choose between a search of all their documents and, in a
    copy of their branch, one of a chosen section.
    """
    spark = route_rows.sparkSession
    fixed = spark.createDataFrame([("start", "start"), ("classify", "classifier"), ("clarify-answer", "answer")], "id string, kind string").withColumn("members", F.array().cast("array<string>"))
    branches = route_rows.filter("size(members) > 0").select("route", "members", F.col("route").alias("branch"), F.col("route").isin(scoped or []).alias("choice"))
    copies = branches.filter("choice").withColumn("branch", F.concat("route", F.lit("-scoped")))
    every = branches.unionByName(copies)
    step = lambda rows, kind, name="branch": rows.select(F.concat_ws("-", F.lit(kind), name).alias("id"), F.lit(kind).alias("kind"), "members")
    nodes = fixed
    for rows, kind in ((every, "retrieve"), (every, "llm"), (every, "answer"), (branches.filter("choice"), "select")):
        nodes = nodes.unionByName(step(rows, kind))
    name = lambda kind: F.concat_ws("-", F.lit(kind), "branch")
    edge = lambda rows, a, b, h: rows.select(a.alias("source"), b.alias("target"), h.alias("handle"))
    plain, route = F.lit("source"), F.col("route")
    edges = spark.createDataFrame([("start", "classify", "source"), ("classify", "clarify-answer", "clarify")], "source string, target string, handle string")
    chosen = F.concat_ws("-", F.lit("select"), "route")
    for e in (
        edge(branches.filter("not choice"), F.lit("classify"), name("retrieve"), route),
        edge(branches.filter("choice"), F.lit("classify"), chosen, route),
        edge(branches.filter("choice"), chosen, name("retrieve"), F.lit("all")),
        edge(copies, chosen, name("retrieve"), F.lit("scoped")),
        edge(every, name("retrieve"), name("llm"), plain),
        edge(every, name("llm"), name("answer"), plain),
    ):
        edges = edges.unionByName(e)
    return nodes, edges


def localize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flow over a local service: retrieval becomes a request, followed by a gate that answers by itself when the service fails."""
    asked = F.col("kind") == "retrieve"
    rest = F.regexp_replace("id", "^retrieve-", "")
    searches = nodes.filter(asked)
    made = lambda kind, prefix: searches.select(F.concat(F.lit(prefix), rest).alias("id"), F.lit(kind).alias("kind"), "members")
    out = nodes.withColumn("kind", F.when(asked, "http-request").otherwise(F.col("kind"))).unionByName(made("if-else", "gate-")).unionByName(made("answer", "unavailable-"))
    link = lambda a, b, h: searches.select(a.alias("source"), b.alias("target"), F.lit(h).alias("handle"))
    of = lambda prefix: F.concat(F.lit(prefix), rest)
    direct = searches.select(F.col("id").alias("source"), of("llm-").alias("target"))
    kept = edges.join(direct, ["source", "target"], "left_anti").select("source", "target", "handle")
    for e in (link(F.col("id"), of("gate-"), "source"), link(of("gate-"), of("llm-"), "ready"), link(of("gate-"), of("unavailable-"), "false")):
        kept = kept.unionByName(e)
    return out, kept


def route_options(lines: DataFrame, route_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """pos, line of a prompt's options: given lines (pos, line ``route：text``) whose route can be chosen, then one for each other route, by its label (route, label)."""
    given = lines.withColumn("route", F.substring_index("line", "：", 1))
    choices = route_rows.filter("size(members) > 0").select("route", F.col("pos").alias("at"))
    kept = given.join(choices, "route", "left_semi")
    new = choices.join(given.select("route"), "route", "left_anti").join(labels.select("route", "label"), "route")
    return kept.select("pos", "line").unionByName(new.select((F.col("at") + 1_000_000).alias("pos"), F.concat("route", F.lit("："), "label", F.lit("相关业务资料。")).alias("line")))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: all that can be reached from ``roots`` (node), however many hops away.

    A frontier is joined with the edges until it is empty.  Frontiers are tables
    in the shared folder, so no round's plan grows with the rounds before it;
    what has been seen is gathered into one table every ``GATHER`` rounds.
    """
    hops = edges.select(F.col("source").alias("node"), "target").filter("node is not null and target is not null")
    front = stash(roots.select("node").distinct(), "front")
    parts = [front]
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        front = stash(front.join(hops, "node").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            discard(front)
            return seen
        parts.append(front)
        if len(parts) > GATHER:
            parts = [stash(reduce(DataFrame.unionByName, parts), "seen")]


def invariants(nodes: DataFrame, edges: DataFrame, root: str = "start") -> DataFrame:
    """kind, id of what is wrong with a graph: repeated ids, loose edge ends, nodes out of reach."""
    spark = nodes.sparkSession
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.lit("repeated id").alias("kind"), "id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").select(F.lit("loose edge").alias("kind"), "id")
    lost = nodes.select("id").join(reachable(edges, spark.createDataFrame([(root,)], "node string")).select(F.col("node").alias("id")), "id", "left_anti").select(F.lit("out of reach").alias("kind"), "id")
    return twice.unionByName(ends).unionByName(lost)


def scoped_branches(outline: DataFrame) -> DataFrame:
    """Numbered headings with a condition word that have entries below them: source_id, number, title and their number.

    ``outline``: source_id, title.  Below a heading is every entry of its source
    whose title starts with the heading's number and a full stop.
    """
    from ..functions.text import heading_number
    from .catalog import CONDITION

    heads = outline.filter(F.col("title").rlike(CONDITION)).select("source_id", "title", heading_number(F.col("title")).alias("number")).filter("number <> ''")
    digits = F.split(F.regexp_extract("title", r"(?U)^((?:\d+\.)+)", 1), r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(digits) - 1), lambda n: F.array_join(F.slice(digits, 1, n), "."))
    below = outline.filter(F.size(digits) > 1).select("source_id", F.explode(ups).alias("number"))
    return heads.join(below, ["source_id", "number"]).groupBy("source_id", "number", "title").agg(F.count("*").alias("children"))
