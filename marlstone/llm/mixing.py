"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Documents hang on a tree domain - language - source.  The token budget flows
from the root: each node's share is split among its children by weight, no
child gets more than its subtree can give (``MAX_EPOCHS`` times its tokens),
and what a child cannot take goes to its siblings first; only what a whole
family cannot take is left to the families above (parents know the capacity of
their subtrees).  A leaf's budget is spent on whole epochs and a prefix of the
next one, in an order seeded by epoch and id.

The prefix's end is found without sorting a leaf: token sums by the leading
digits of the order key, refined ``LEVELS`` times inside the one bucket that
holds the end.  Each level moves counts of at most ``2**DIGIT`` buckets a leaf.

Defined results: null domain, language and source are nodes of their own; null
and empty texts have no tokens and go with the prefix; rows that share an id, and
those with a null id, share a place in the order and are taken or left together;
texts of any length are counted whole and taken whole; an input column
``mix_copies`` is replaced, others stay, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .quality import words

SEED = 17
MAX_EPOCHS = 4
#: Budget as a share of all tokens.
BUDGET_SHARE = 1.0
#: Weights of languages and sources are their tokens to this power; domains weigh the same.
POWER = 0.5
DOMAINS = 4
DIGIT, LEVELS = 12, 4
_NONE = "\x00"


def domain_of(source: Column) -> Column:
    """Domain of a source: its number modulo ``DOMAINS``; sources without a number are one domain."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("long") % DOMAINS).cast("string"))).otherwise(F.lit("other"))


def _leaf(df: DataFrame) -> list[Column]:
    return [F.coalesce(domain_of(F.col("source")), F.lit("other")).alias("domain"), F.coalesce(F.col("lang"), F.lit(_NONE)).alias("lang"), F.coalesce(F.col("source"), F.lit(_NONE)).alias("source")]


def _key() -> Column:
    return F.xxhash64("domain", "lang", "source")


def _pour(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Column ``share``: ``budget`` of the family split by ``weight``, at most ``cap`` each, shortages to siblings."""
    w = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), "name")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(Window.partitionBy(*parents)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # children by how soon they are full: the level at which the rest shares what is left, at the first child that isn't full by then
    level = F.when(left <= rest * F.col("cap") / F.col("weight"), F.struct(F.row_number().over(w).alias("no"), (left / F.greatest(rest, F.lit(1e-12))).alias("level")))
    out = nodes.withColumn("level", level).withColumn("level", F.min("level").over(Window.partitionBy(*parents))["level"])
    return out.withColumn("share", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).drop("level")


def leaf_budgets(leaves: DataFrame, budget_share: float = BUDGET_SHARE) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``share``: the tokens to take from each."""
    cap = lambda: (F.sum("tokens") * MAX_EPOCHS).cast("double").alias("cap")
    weight = lambda: F.pow(F.greatest(F.sum("tokens"), F.lit(1)).cast("double"), POWER).alias("weight")
    domains = leaves.groupBy("domain").agg(cap(), F.lit(1.0).alias("weight")).withColumn("name", F.col("domain")).withColumn("root", F.lit(0))
    domains = domains.withColumn("budget", F.sum("cap").over(Window.partitionBy("root")) / MAX_EPOCHS * budget_share)
    domains = _pour(domains, ["root"]).select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(cap(), weight()).withColumn("name", F.col("lang")).join(domains, "domain")
    langs = _pour(langs, ["domain"]).select("domain", "lang", F.col("share").alias("budget"))
    sources = leaves.groupBy("domain", "lang", "source").agg(cap(), weight(), F.sum("tokens").alias("tokens")).withColumn("name", F.col("source")).join(langs, ["domain", "lang"])
    return _pour(sources, ["domain", "lang"]).select("domain", "lang", "source", "tokens", "share")


def _order(epochs: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: the first ``DIGIT * LEVELS`` bits of an MD5 of seed, epoch and id."""
    name = F.concat_ws(":", F.lit(str(SEED)), epochs.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, DIGIT * LEVELS // 4), 16, 10).cast("long")


def plan(documents: DataFrame) -> DataFrame:
    """One row per leaf: leaf, domain, lang, source, tokens, share, epochs (whole ones) and cut (end of the prefix of the next)."""
    docs = documents.select("doc_id", *_leaf(documents), F.size(words(F.col("text"))).cast("long").alias("n"))
    docs = stash(docs.select("doc_id", "domain", "lang", "source", "n", _key().alias("leaf")), "mix-docs")
    leaves = docs.groupBy("domain", "lang", "source").agg(F.sum("n").alias("tokens"))
    state = leaf_budgets(leaves).withColumn("leaf", _key())
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("share") / F.col("tokens") + 1e-9), F.lit(MAX_EPOCHS))).otherwise(F.lit(1)).cast("int")
    state = state.withColumn("epochs", whole)
    rest = F.greatest(F.col("share") - F.col("epochs") * F.col("tokens"), F.lit(0.0))
    state = stash(state.withColumn("rest", F.floor(rest).cast("long")).withColumn("cut", F.lit(0).cast("long")), "mix-state")
    # a leaf's prefix ends in bucket `cut`, whose earlier siblings are spent from `rest`
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        slim = state.select("leaf", "epochs", "cut")
        digit = F.shiftrightunsigned(_order(F.col("epochs"), F.col("doc_id")), shift)
        inside = docs.select("doc_id", "n", "leaf").join(slim, "leaf").withColumn("d", digit).filter(F.shiftrightunsigned("d", DIGIT) == F.col("cut"))
        sums = inside.groupBy("leaf", "d").agg(F.sum("n").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("d"))).join(state.select("leaf", "rest"), "leaf")
        first_over = run.groupBy("leaf").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("d", (F.col("upto") - F.col("n")).alias("spent")))).alias("f"), F.max("upto").alias("all"))
        past = F.shiftleft(F.col("cut") + 1, DIGIT)  # the whole bucket fits: the end is its end
        state = stash(
            state.join(first_over, "leaf", "left")
            .withColumn("rest", F.col("rest") - F.coalesce("f.spent", "all", F.lit(0)))
            .withColumn("cut", F.coalesce(F.col("f.d"), past))
            .drop("f", "all"),
            "mix-state",
        )
    return state.select("leaf", "domain", "lang", "source", "tokens", "share", "epochs", "cut")


def _counted(documents: DataFrame, leaf_plan: DataFrame) -> DataFrame:
    """Rows (d: all columns in one struct, n: copies): nothing can clash with the input's names."""
    p = leaf_plan.select("leaf", "epochs", "cut")
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), F.xxhash64(*_leaf(documents)).alias("of"), F.col("doc_id").alias("id"))
    taken = F.col("epochs") + (_order(F.col("epochs"), F.col("id")) < F.col("cut")).cast("int")
    return keyed.join(p, F.col("of") == F.col("leaf"), "left").select("d", F.coalesce(taken, F.lit(0)).alias("n"))


def copies(documents: DataFrame, leaf_plan: DataFrame) -> DataFrame:
    """``documents`` with ``mix_copies``: how often each is used.  The plan is joined by leaf (broadcast while it is small)."""
    kept = [F.col(f"d.`{c}`") for c in documents.columns if c.lower() != "mix_copies"]
    return _counted(documents, leaf_plan).select(*kept, F.col("n").alias("mix_copies"))


def mix(documents: DataFrame) -> DataFrame:
    """The mixture: each document as many times as it is used, columns unchanged."""
    used = _counted(documents, plan(documents)).filter("n > 0")
    return used.select("d", F.explode(F.sequence(F.lit(1), F.col("n")))).select("d.*")
