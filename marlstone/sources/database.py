"""SQLite tables as a Spark data source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {"INTEGER": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, query: str):
        self.path, self.query = path, query

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(self.query)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``: options path and table (or query with a schema); one partition, for state that one driver writes."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cols = db.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {_TYPES.get(c[2].upper(), 'string')}" for c in cols)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options.get("query") or f'select * from "{self.options["table"]}"')
