"""Models as column functions: encoders, rerankers and readers that are made once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoder(make: Callable[[], Callable[[list[str]], list]], batch: int = 256) -> Callable[[Column], Column]:
    """Text -> vector column by ``make()(texts)``; wrong counts and invalid vectors raise."""

    @F.pandas_udf("array<double>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            out = []
            for at in range(0, len(s), batch):
                part = list(s[at : at + batch])
                got = [np.asarray(v, np.float64) for v in model(part)]
                if len(got) != len(part):
                    raise ValueError("embedding count mismatch")
                if any(v.ndim != 1 or not np.isfinite(v).all() or not v.any() for v in got):
                    raise ValueError("invalid embedding")
                out += [v.tolist() for v in got]
            yield pd.Series(out, dtype=object)

    return encode


def reranker(make: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 32) -> Callable[[Column, Column], Column]:
    """(query, passage) -> score column; wrong counts and scores that are not finite raise."""

    @F.pandas_udf("double")
    def score(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, p in series:
            out: list[float] = []
            for at in range(0, len(q), batch):
                got = list(model(list(q[at : at + batch]), list(p[at : at + batch])))
                if len(got) != len(q[at : at + batch]) or not np.isfinite(got).all():
                    raise ValueError("invalid reranker scores")
                out += got
            yield pd.Series(out, dtype="float64")

    return score


def read_images(images: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """image_id, lines (text, score, polygon, bbox) of pictures (image_id, content) by ``make()(content)``."""
    schema = "image_id string, lines array<struct<text:string,score:double,polygon:array<array<double>>,bbox:array<double>>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = []
            for content in b["content"]:
                lines = []
                for x in model(content):
                    poly = [[float(v) for v in p] for p in x["polygon"]]
                    xs, ys = [p[0] for p in poly], [p[1] for p in poly]
                    lines.append({"text": x["text"], "score": float(x["score"]), "polygon": poly, "bbox": [min(xs), min(ys), max(xs), max(ys)]})
                rows.append(lines)
            yield pd.DataFrame({"image_id": b["image_id"], "lines": rows})

    return images.select("image_id", "content").mapInPandas(run, schema)


def hashed_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], list]]:
    """Encoder without a model: tokens hashed to signed dimensions, so equal words give near vectors."""

    def make() -> Callable[[list[str]], list]:
        import re
        import zlib

        def run(texts: list[str]) -> list:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                out[i, 0] = 1e-3
                for w in re.findall(r"[a-z0-9]+|[一-鿿]", t.lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 16 & 1 else -1
            return list(out)

        return run

    return make
