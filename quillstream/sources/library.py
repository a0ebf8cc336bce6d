"""A bibliographic library in SQLite as a Spark data source, read only.

`spark.read.format("sqlite_library").option("path", ...).option("table", ...)` reads one table in parallel
ranges of row ids; the database is opened immutable, so nothing can write to it.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.library import Library

#: Tables of the library with the columns that scans use.
SCHEMAS = {
    "itemTypes": "itemTypeID long, typeName string", "items": "itemID long, itemTypeID long, dateModified string, key string, version long", "deletedItems": "itemID long",
    "itemAttachments": "itemID long, parentItemID long, linkMode int, contentType string, path string", "fields": "fieldID long, fieldName string",
    "itemDataValues": "valueID long, value string", "itemData": "itemID long, fieldID long, valueID long", "creators": "creatorID long, firstName string, lastName string, fieldMode int",
    "creatorTypes": "creatorTypeID long, creatorType string", "itemCreators": "itemID long, creatorID long, creatorTypeID long, orderIndex int", "tags": "tagID long, name string",
    "itemTags": "itemID long, tagID long", "collections": "collectionID long, key string, collectionName string", "collectionItems": "collectionID long, itemID long", "relations": "subject long, predicate string, object string",
}


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection to an immutable database."""
    connection = sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)
    connection.execute("PRAGMA query_only = ON")
    return connection


class SqliteLibrary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_library"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> "DataSourceReader":
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("partitions", "1")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((start, start + step)) for start in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end = partition.value
        names = ", ".join(f'"{c}"' for c in self.columns)
        with connect(self.path) as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (start, end))


def read_library(spark: SparkSession, path: str, partitions: int = 1) -> Library:
    """All tables of a library."""
    spark.dataSource.register(SqliteLibrary)
    read = lambda t: spark.read.format("sqlite_library").option("path", path).option("table", t).option("partitions", partitions).load()
    return Library({t: read(t) for t in SCHEMAS})
