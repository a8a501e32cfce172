"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The classifier is fitted in one task on a bounded sample of labelled rows
(``TRAIN_ROWS`` ids, those with the smallest hash, and ``TRAIN_FEATURES``); its L1 penalty leaves
a few hundred to a few thousand weights, which are broadcast.  Scoring is one
map-only pass over whole texts.

Defined results: null and empty texts score the bias alone; rows with a null id
are scored and not held out; repeated rows are scored one by one, and fitted on
once; of rows that share an id, the least text is fitted on; labels
that disagree count as toxic; with no usable labels every score is 0.0; texts of
any length are scored whole, one at a time; an existing column ``toxicity`` is
replaced, other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, small_batches
from .ftrl import Ftrl
from .textfeatures import BITS, features

#: Bound of the labelled sample that the classifier is fitted on.
TRAIN_ROWS = 12_000
EPOCHS = 8
#: Bound of the sample's features, which one worker holds (4 bytes each): rows that would pass it, by that order, are not fitted on.
TRAIN_FEATURES = 1 << 26
#: Scores from here on count as toxic.
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights: parallel arrays of feature index and weight, and the bias (None: never fitted)."""

    index: np.ndarray
    weight: np.ndarray
    bias: float | None


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    xs: list[np.ndarray] = []
    ys: list[int] = []
    held = 0
    for b in batches:
        for t, y in zip(b["text"], b["y"], strict=True):
            x = features(t)
            held += len(x)
            if held <= TRAIN_FEATURES:
                xs.append(x)
                ys.append(int(y))
    if not xs:
        return
    model = Ftrl(BITS, alpha=1.0, beta=1.0, l1=8.0, l2=1.0)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(xs)):
            model.update(xs[i], ys[i])
    index, weight = model.sparse()
    yield pd.DataFrame({"i": np.append(index, -1), "w": np.append(weight, model.bias())})
    give_back()


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled documents whose crc32(id) mod 4 is not 2."""
    small_batches(documents.sparkSession)
    sample = (
        labels.select(F.col("doc_id").alias("k"), F.col("toxic").alias("y"))
        .filter((crc_mod(F.col("k"), 4) != 2) & F.col("y").isin(0, 1))
        .groupBy("k")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(train_rows)
    )
    # the sample's size is bounded by train_rows: ids and labels only
    texts = documents.select(F.col("doc_id").alias("k"), "text").join(F.broadcast(sample), "k")
    # one row an id, chosen before anything is moved; no more rows than in the sample reach the one task
    one = texts.groupBy("k").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    rows = one.coalesce(1).sortWithinPartitions(F.xxhash64("k"), "k").select("text", "y")
    fitted = rows.mapInPandas(_fit, "i long, w double").toPandas()
    if fitted.empty:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), None)
    live = fitted["i"] >= 0
    return ToxicityModel(fitted.loc[live, "i"].to_numpy(), fitted.loc[live, "w"].to_numpy(), float(fitted.loc[~live, "w"].iloc[0]))


def scorer(documents: DataFrame, model: ToxicityModel):
    """A function of the text column that gives its score between 0 and 1."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, weight, bias = sent.value
        dense = np.zeros(1 << BITS)
        dense[index] = weight
        for batch in texts:
            raw = np.array([dense[features(t)].sum() for t in batch], np.float64)
            yield pd.Series(np.zeros(len(raw)) if bias is None else 1.0 / (1.0 + np.exp(-np.clip(raw + bias, -35, 35))))
        give_back()

    return toxicity


def score(documents: DataFrame, model: ToxicityModel, text: str | Column = "text") -> DataFrame:
    """``documents`` with a column ``toxicity``."""
    return documents.withColumn("toxicity", scorer(documents, model)(text))
