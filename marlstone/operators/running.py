"""Stages of a job as tagged work that a request can end while it runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Seconds between two looks at a job's requests.
POLL = 0.1


class Requests(NamedTuple):
    """What is asked of a job at the moment."""

    cancel: bool = False
    pause: bool = False


class Outcome(NamedTuple):
    """completed, cancelled or paused, and the stages that this run ended."""

    status: str
    ended: list[str]


def markers(spark: SparkSession, root: str, job_id: str) -> set[str]:
    """Stages of a job that have been ended, in this run or an earlier one; at most as many as it has stages, however often one was marked."""
    rows = spark.read.schema("job_id string, stage string").parquet(_folder(spark, root))
    return {r["stage"] for r in rows.filter(rows["job_id"] == job_id).select("stage").distinct().collect()}


def _folder(spark: SparkSession, root: str) -> str:
    path = f"{root}/markers"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def _mark(spark: SparkSession, root: str, job_id: str, stage: str) -> None:
    spark.createDataFrame([(job_id, stage)], "job_id string, stage string").coalesce(1).write.mode("append").parquet(_folder(spark, root))


def run_stages(spark: SparkSession, job_id: str, stages: list[tuple[str, Callable[[SparkSession], None]]], requests: Callable[[], Requests], root: str, poll: float = POLL) -> Outcome:
    """Run the stages of a job in order that have no marker below ``root`` yet.

    ``requests`` is asked before each stage and every ``poll`` seconds while one runs.
    A cancel ends the Spark work of the running stage at once, again and again until
    the stage gives up, so that what it starts later is ended too; code of its own
    that starts no Spark work is waited for.  A pause is heeded where a stage ends.
    A stage that a cancel meets gets no marker, even if it ended at that moment, and is
    run again by a later run: it must bear that.  What a stage raises is raised, and
    leaves the markers of those before it.  A cancel wins over a pause.
    """
    ended: list[str] = []
    done = markers(spark, root, job_id)
    for name, stage in stages:
        if name in done:
            continue
        asked = requests()
        if asked.cancel or asked.pause:
            return Outcome("cancelled" if asked.cancel else "paused", ended)
        if not _run(spark, stage, requests, poll):
            return Outcome("cancelled", ended)
        _mark(spark, root, job_id, name)
        ended.append(name)
    return Outcome("completed", ended)


def _run(spark: SparkSession, stage: Callable[[SparkSession], None], requests: Callable[[], Requests], poll: float) -> bool:
    """Whether the stage ended before a cancel was asked."""
    # a job tag of the context: those of a session are known only in the thread that adds them
    sc, tag = spark.sparkContext, f"stage-{uuid.uuid4().hex}"
    raised: list[BaseException] = []

    def work() -> None:
        sc.addJobTag(tag)
        try:
            stage(spark)
        except BaseException as e:  # noqa: BLE001 (raised again by the thread that waits)
            raised.append(e)
        finally:
            sc.removeJobTag(tag)

    thread = InheritableThread(target=work)
    thread.start()
    cancelled = False
    try:
        while True:
            cancelled = cancelled or requests().cancel
            if cancelled:
                sc.cancelJobsWithTag(tag)
            if not thread.is_alive():
                break
            thread.join(poll)
    except BaseException:
        # whoever waits was interrupted: the stage must not run on unwatched
        while thread.is_alive():
            sc.cancelJobsWithTag(tag)
            time.sleep(poll)
        raise
    if raised and not cancelled:
        raise raised[0]
    return not cancelled
