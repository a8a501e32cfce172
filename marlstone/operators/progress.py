"""Figures that come from the pass that does the work, and progress while it runs."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "section string, metric string, value double"


class Collection:
    """Figures of several passes, by section.

    ``watch`` hangs figures on a table; whatever action runs it next makes them on
    the way, in the same tasks, so that no pass is made for figures alone.  A table
    must be run once: a second action counts nothing more.  A task that was lost counts
    once, since what it observed comes with its result.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, section: str, **figures: Column) -> DataFrame:
        """``df`` with aggregates (no distinct ones) to be taken where it passes."""
        if not figures:
            raise ValueError("no figures to watch")
        if section in (s for s, _ in self._seen):
            raise ValueError(f"section is watched already: {section}")
        seen = Observation(f"collection-{section}")
        self._seen.append((section, seen))
        return df.observe(seen, *[c.alias(n) for n, c in figures.items()])

    def rows(self, spark: SparkSession) -> DataFrame:
        """section, metric, value of all passes; waits for those that have not run."""
        out = [(s, n, None if v is None else float(v)) for s, seen in self._seen for n, v in seen.get.items()]
        return spark.createDataFrame(out, ROWS)


def quality(text: Column) -> dict[str, Column]:
    """Figures of texts: rows, missing, characters, longest; a null text is missing, and counts no characters."""
    n = F.length(text)
    return {"rows": F.count(F.lit(1)), "missing": F.count_if(text.isNull()), "chars": F.coalesce(F.sum(n), F.lit(0)), "longest": F.coalesce(F.max(n), F.lit(0))}


class StreamProgress(StreamingQueryListener):
    """Sums of what a stream observes under a name, told every ``every`` batches and at its end.

    Batches that are run again after a failure have the number they had and count once.
    ``totals`` is what is known so far; ``wait`` returns it once the stream has ended.
    Observed figures must be ones that add up: counts and sums.
    """

    def __init__(self, name: str, tell: Callable[[dict], None] | None = None, every: int = 25):
        self.name, self.tell, self.every = name, tell, every
        self._batches: set[int] = set()
        self.totals: dict[str, float] = {}
        self._told = 0
        self._ended = threading.Event()
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        batch = event.progress.batchId
        if row is None or batch in self._batches:
            return
        self._batches.add(batch)
        for n, v in row.asDict().items():
            self.totals[n] = self.totals.get(n, 0) + (v or 0)
        if len(self._batches) - self._told >= self.every:
            self._say()

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception
        if len(self._batches) > self._told:
            self._say()
        self._ended.set()

    def _say(self) -> None:
        self._told = len(self._batches)
        if self.tell:
            self.tell({"batches": self._told} | self.totals)

    def wait(self, seconds: float = 60) -> dict[str, float]:
        if not self._ended.wait(seconds):
            raise TimeoutError(f"no word of the end of the stream after {seconds} s")
        return dict(self.totals)


def run_stream(writer, listener: StreamProgress, spark: SparkSession) -> dict[str, float]:
    """Start a stream's writer, wait for its end and return the sums; other streams of the session that observe the same name are counted too, so names are to be the stream's own."""
    spark.streams.addListener(listener)
    try:
        writer.start().awaitTermination()
        return listener.wait()
    finally:
        spark.streams.removeListener(listener)
