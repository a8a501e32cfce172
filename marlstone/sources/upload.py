"""Sending documents to a remote store, with receipts that survive failures.

``send`` writes a plan through a Python data source: every task sends its rows in
chunks of ``CHUNK`` and keeps a journal in the shared folder.  Before a chunk it notes
what it is about to send, after the documents their ids, after the metadata that these
are applied.  So whatever stops a task, a run or the driver, it is known which rows
were sent, and which few are uncertain: for these the store is asked by name before
anything is created again.  A task that is started again reads the journal of its
earlier attempts; a later run leaves out what receipts prove.  Every ``MERGE`` notes of
a task become one compressed file, so a journal's files do not grow with its chunks.

A document that the store refuses ends the run, not its task: a task that failed would
have the others killed in the middle of their chunks, and workers live on for seconds after
that, sending beside the next run.  So all tasks come to their ends, the refusals are told
to the driver, and only then the run raises.

The run is committed when all tasks are done without a refusal (``commit``), else it is
marked as aborted; receipts hold either way, as they tell what the store has.
Speculative execution would let two attempts send at once and is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.scratch import swept

#: Documents that a task sends between two entries of its journal, and tasks at once.
CHUNK, WORKERS = 20, 4
#: Notes of a task's journal that are files of their own at once.
MERGE = 2048
RECEIPT = "run string, part int, attempt long, seq int, state string, key string, document_id string, hash string, metadata_applied boolean, error string, at timestamp"


class Store(Protocol):
    """What a remote store must offer; it is sent to executors."""

    def find(self, row: dict) -> str | None:
        """Id of the document that was created for a row, if there is one."""

    def put(self, row: dict) -> str:
        """Create the row's document, or replace that of its ``document_id``; returns the id."""

    def describe(self, document_id: str, row: dict) -> None:
        """Set the document's metadata; may be repeated."""


@dataclass
class Sent(WriterCommitMessage):
    part: int
    sent: int
    described: int
    refused: int
    error: str


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _line(row: dict) -> bytes:
    return json.dumps(row).encode() + b"\n"


class Journal:
    """Entries of a task's attempts: a small file for each note, never changed; every ``MERGE`` of them are merged.

    A merged file has what counts of each key: its last receipt, or that it was about to
    be sent, and all errors.  It gets its name when it is whole, and only then its notes go.
    """

    def __init__(self, root: str, run: str, part: int, attempt: int):
        self.system, root = _open(root)
        self.folder, self.attempt, self.seq = f"{root}/receipts/{run}/{part}", attempt, 0
        self.head = {"run": run, "part": part, "attempt": attempt}
        self.small: list[str] = []
        self.told: list[tuple[str, str, bytes]] = []

    def write(self, state: str, entries: list[dict]) -> None:
        if not entries:
            return
        if not self.seq:
            self.system.create_dir(self.folder)
        self.seq += 1
        head = self.head | {"seq": self.seq, "state": state}
        told = [(state, e["key"], _line(head | e)) for e in entries]
        path = f"{self.folder}/{self.attempt}-{self.seq}.json"
        with self.system.open_output_stream(path) as out:
            out.write(b"".join(line for _, _, line in told))
        self.small.append(path)
        self.told += told
        if len(self.small) == MERGE:
            self.merge()

    def merge(self) -> None:
        if not self.small:
            return
        last = {key: line for state, key, line in self.told if state == "receipt"}
        rest = [line for state, key, line in self.told if state == "error" or state == "asked" and key not in last]
        name = f"{self.attempt}-{self.seq}.json.gz"
        with self.system.open_output_stream(f"{self.folder}/_{name}", compression="gzip") as out:  # not read under this name
            out.write(b"".join([*last.values(), *rest]))
        self.system.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
        for path in self.small:
            self.system.delete_file(path)
        self.small, self.told = [], []

    def before(self) -> tuple[dict[str, tuple[str, bool]], set[str]]:
        """Of earlier attempts: document_id and metadata_applied of each key's last receipt, and keys without one that were about to be sent."""
        from pyarrow import fs

        receipts: dict[str, tuple[str, bool]] = {}
        asked = set()
        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        made = [(int(m[1]), int(m[2]), info.path) for info in found if (m := re.fullmatch(r"(\d+)-(\d+)\.json(\.gz)?", info.base_name))]
        for _, _, path in sorted(made):
            try:
                with self.system.open_input_stream(path) as f:
                    entries = [json.loads(line) for line in f.read().decode().splitlines()]
            except FileNotFoundError:  # merged meanwhile, by an attempt that still runs
                return self.before()
            for e in entries:
                if e["state"] == "receipt":
                    receipts[e["key"]] = e["document_id"], e["metadata_applied"]
                elif e["state"] == "asked":
                    asked.add(e["key"])
        return receipts, asked - receipts.keys()


class _Writer(DataSourceWriter):
    def __init__(self, store: Store, root: str, run: str):
        self.store, self.root, self.run = store, root, run

    def write(self, rows: Iterator) -> Sent:
        context = TaskContext.get()
        journal = Journal(self.root, self.run, context.partitionId(), context.taskAttemptId())
        receipts, asked = journal.before()
        done = Sent(context.partitionId(), 0, 0, 0, "")
        chunk: list[dict] = []
        for row in rows:
            chunk.append(row.asDict(recursive=True))
            if len(chunk) == CHUNK:
                self._send(chunk, journal, receipts, asked, done)
                chunk = []
                if done.refused:  # the rest of the task's rows stay for the next run
                    break
        if not done.refused:
            self._send(chunk, journal, receipts, asked, done)
        journal.merge()
        return done

    def _send(self, chunk: list[dict], journal: Journal, receipts: dict, asked: set, done: Sent) -> None:
        receipt = lambda row, i, applied: {"key": row["key"], "document_id": i, "hash": row["content_hash"], "metadata_applied": applied}
        ids, errors = {}, []
        new = []
        for row in chunk:
            had = receipts.get(row["key"])
            if had or row["action"] == "metadata":
                ids[row["key"]] = had[0] if had else row["document_id"]
            else:
                new.append(row)
        journal.write("asked", [{"key": r["key"]} for r in new])
        told = []
        for row in new:
            try:
                # what may have been created already is looked for, never created twice; an update may be repeated
                unsure = row["document_id"] is None and (row["key"] in asked or row["uncertain"])
                i = self.store.find(row) if unsure else None
                if i is None:
                    i = self.store.put(row)
                    done.sent += 1
                ids[row["key"]] = i
                told.append(receipt(row, i, False))
            except Exception as e:  # the others of the chunk are still sent
                errors.append({"key": row["key"], "error": f"{type(e).__name__}: {e}"})
        journal.write("receipt", told)
        told = []
        for row in chunk:
            if row["key"] in ids and not receipts.get(row["key"], ("", False))[1]:
                try:
                    self.store.describe(ids[row["key"]], row)
                    done.described += 1
                    told.append(receipt(row, ids[row["key"]], True))
                except Exception as e:
                    errors.append({"key": row["key"], "error": f"{type(e).__name__}: {e}"})
        journal.write("receipt", told)
        journal.write("error", errors)
        if errors:
            done.refused += len(errors)
            done.error = done.error or f"{errors[0]['key']} for one: {errors[0]['error']}"

    def _mark(self, state: str, messages: list) -> None:
        system, root = _open(self.root)
        system.create_dir(f"{root}/runs")
        told = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/runs/{self.run}.json") as out:
            out.write(json.dumps({"run": self.run, "state": state, "tasks": len(told), "sent": sum(m.sent for m in told), "described": sum(m.described for m in told)}).encode())

    def commit(self, messages: list) -> None:
        refused = [m for m in messages if m is not None and m.refused]
        if refused:  # marked by ``abort``
            raise RuntimeError(f"{sum(m.refused for m in refused)} documents were not sent, {refused[0].error}")
        self._mark("committed", messages)

    def abort(self, messages: list) -> None:
        self._mark("aborted", messages)


def _document(row: dict) -> str:
    """Id under which a row's document is created; a letter first: hex digits alone may look like a number."""
    return "d" + hashlib.sha256(f"{row.get('domain')}\n{row['name']}".encode()).hexdigest()[:16]


@dataclass
class FolderStore:
    """A store that keeps what it is sent as files of a shared folder: one for each put, so that a document sent twice shows."""

    root: str

    def _place(self, row: dict) -> tuple:
        system, root = _open(self.root)
        system.create_dir(f"{root}/puts")
        system.create_dir(f"{root}/described")
        return system, root, _document(row)

    def find(self, row: dict) -> str | None:
        from pyarrow import fs

        system, root, name = self._place(row)
        return name if system.get_file_info(f"{root}/puts/{name}-0.json").type != fs.FileType.NotFound else None

    def put(self, row: dict) -> str:
        from pyarrow import fs

        system, root, name = self._place(row)
        n = 0
        while system.get_file_info(f"{root}/puts/{name}-{n}.json").type != fs.FileType.NotFound:
            n += 1
        document_id = row["document_id"] or name
        with system.open_output_stream(f"{root}/puts/{name}-{n}.json") as out:
            out.write(json.dumps({"key": row["key"], "action": row["action"], "document_id": document_id, "hash": row["content_hash"]}).encode())
        return document_id

    def describe(self, document_id: str, row: dict) -> None:
        system, root, name = self._place(row)
        with system.open_output_stream(f"{root}/described/{name}.json") as out:
            out.write(json.dumps({"key": row["key"], "document_id": document_id}).encode())


@dataclass
class LedgerStore:
    """A store that keeps what it is sent as lines of files in a shared folder: one line for each put, so that a document sent twice shows.

    For many documents, since a file takes a block of the disk however short it is.  A
    task writes files of its own and flushes each line, after which others must see it.
    """

    root: str
    _files: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def create(self) -> None:
        """Its folders, which readers need also where nothing is sent."""
        system, root = _open(self.root)
        for folder in ("puts", "described"):
            system.create_dir(f"{root}/{folder}")

    def _add(self, folder: str, line: dict) -> None:
        if folder not in self._files:
            system, root = _open(self.root)
            system.create_dir(f"{root}/{folder}")
            self._files[folder] = system.open_output_stream(f"{root}/{folder}/{uuid.uuid4().hex}.json")
        self._files[folder].write(_line(line))
        self._files[folder].flush()

    def find(self, row: dict) -> str | None:
        from pyarrow import fs

        system, root = _open(self.root)
        name = _document(row)
        sought = f'"document_id": "{name}"'.encode()
        for info in system.get_file_info(fs.FileSelector(f"{root}/puts/{name[1]}", allow_not_found=True)):
            with system.open_input_stream(info.path) as f:
                rest = b""
                while block := f.read(1 << 20):
                    block = rest + block
                    if sought in block:
                        return name
                    rest = block[-len(sought) :]
        return None

    def put(self, row: dict) -> str:
        name = _document(row)
        document_id = row["document_id"] or name
        # by a digit of the name, so that looking for one reads a sixteenth
        self._add(f"puts/{name[1]}", {"key": row["key"], "action": row["action"], "document_id": document_id, "hash": row["content_hash"]})
        return document_id

    def describe(self, document_id: str, row: dict) -> None:
        self._add("described", {"key": row["key"], "document_id": document_id})


def _entries(spark: SparkSession, root: str) -> DataFrame:
    system, path = _open(root)
    system.create_dir(f"{path}/receipts")
    return spark.read.schema(RECEIPT).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(f"{root}/receipts")


def receipts(spark: SparkSession, root: str) -> DataFrame:
    """key, document_id, hash, metadata_applied: the last receipt of each key, of committed and of aborted runs."""
    rows = _entries(spark, root).filter("state = 'receipt'")
    # a run is named by its number, tasks by theirs: entries of a key are in the order in which they were made
    order = F.struct("run", "attempt", "seq", "metadata_applied")
    return rows.groupBy("key").agg(F.max_by(F.struct("document_id", "hash", "metadata_applied"), order).alias("r")).select("key", "r.*")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """run, state, tasks, sent, described of each run that came to its end."""
    return spark.read.schema("run string, state string, tasks int, sent long, described long").json(f"{root}/runs")


def send(plan: DataFrame, store: Store, root: str, workers: int = WORKERS) -> str:
    """Carry out ``plan`` (key, action, document_id, content_hash and what ``store`` needs); returns the run's name.

    Rows whose action is skip or defer stay; create and update send the document and
    then its metadata, metadata only that.  Rows with a receipt for their content are
    left out, or have their metadata sent if that is open.  ``root``: folder of
    receipts, in the shared folder.  At most ``workers`` (1 to 4) tasks send at once. A
    task stops behind the chunk in which a document is refused; this raises when all
    tasks have ended, and the receipts of what was sent stay.
    """
    if not 1 <= workers <= 4:
        raise ValueError("one to four workers send")
    spark = plan.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("a speculative attempt would send documents twice")
    earlier = _entries(spark, root)
    last = receipts(spark, root).select(F.col("key").alias("__k"), F.col("document_id").alias("__id"), F.col("hash").alias("__hash"), "metadata_applied")
    asked = earlier.filter("state = 'asked'").select(F.col("key").alias("__asked")).distinct()
    key = F.col("key").cast("string")
    todo = plan.filter(F.col("action").isin("create", "update", "metadata")).withColumn("key", key).withColumn("document_id", F.col("document_id").cast("string"))
    rows = todo.join(last, F.col("key") == F.col("__k"), "left").join(asked, F.col("key") == F.col("__asked"), "left")
    proven = F.coalesce(F.col("__hash") == F.col("content_hash"), F.lit(False))
    rows = rows.filter(~(proven & F.col("metadata_applied")))
    # a receipt without metadata leaves the metadata to do; a note without a receipt is uncertain
    rows = rows.withColumns({"action": F.when(proven, "metadata").otherwise(F.col("action")), "document_id": F.when(proven, F.col("__id")).otherwise(F.coalesce("document_id", "__id")), "uncertain": F.col("__asked").isNotNull() & F.col("__id").isNull()})
    number = earlier.agg(F.coalesce(F.max(F.substring_index("run", "-", 1).cast("int")), F.lit(0))).first()[0] + 1
    run = f"{number:06d}-{uuid.uuid4().hex[:8]}"

    class Upload(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"upload_{run.replace('-', '_')}"

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return _Writer(store, root, run)

    spark.dataSource.register(Upload)
    # dealt by the run too: what one task of a broken run left is shared by all of the next
    out = rows.drop("__k", "__id", "__hash", "__asked", "metadata_applied").repartition(workers, F.xxhash64("key", F.lit(number))).sortWithinPartitions("key")
    with swept(spark):
        out.write.format(Upload.name()).mode("append").save()
    return run
