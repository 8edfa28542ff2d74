"""Documents from files, from a browser's store and from an SQLite library."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.functions.paths import browser_path
from quire.operators.library import renumber
from quire.schemas import READER_DOCUMENT, RECENT


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of the PDF files of a folder; what is not selected is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def browser_files(files: DataFrame, name: str) -> DataFrame:
    """Files without a path of their own get one from their name."""
    return files.withColumn("file_path", browser_path(F.col(name)))


def parse_store(text: Column) -> Column:
    """The list of documents in a browser's store; missing or malformed text is an empty list."""
    kind = T.ArrayType(READER_DOCUMENT)
    return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind))


def read_store(stores: DataFrame, text: str) -> DataFrame:
    """A row for each document of each store, with its position."""
    return stores.select(F.posexplode(parse_store(F.col(text))).alias("position", "document")).select("position", "document.*")


def write_store(documents: DataFrame, n: int = RECENT) -> DataFrame:
    """One row with the list of the first n documents by position as JSON; at most n rows meet."""
    record = F.struct("position", F.struct(*READER_DOCUMENT.fieldNames()).alias("document"))
    ordered = F.transform(F.array_sort(F.collect_list(record)), lambda x: x["document"])
    return renumber(documents, n).agg(F.to_json(ordered).alias("store"))


def _time(text: str) -> datetime:
    """A time as scripts write it, such as 2024-01-01T00:00:00.000Z; without a zone it is UTC."""
    value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def _decoder(kind: T.DataType) -> Callable | None:
    """What turns a value that SQLite holds into one of Spark's type, if anything has to."""
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, T.TimestampType):
        return _time
    return float if isinstance(kind, T.DoubleType) else None


class SqliteRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.parts = int(options.get("numpartitions", 4))
        self.key = options.get("key"), options.get("value")

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[SqliteRange]:
        with self._connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [SqliteRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [SqliteRange(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: SqliteRange):
        columns = ", ".join(f'"{c}"' for c in self.schema.fieldNames())
        name, wanted = self.key
        where = f' AND "{name}" = ?' if name else ""
        decoders = [_decoder(f.dataType) for f in self.schema]
        with self._connect() as db:
            values = (partition.low, partition.high, *([wanted] if name else []))
            for row in db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?{where}', values):
                yield tuple(decode(v) if decode and v is not None else v for decode, v in zip(decoders, row, strict=True))


class SqliteSource(DataSource):
    """spark.read.format("sqlite"): a table of an SQLite file that every executor can open, in ranges of rowid. A schema is needed.

    Options key and value leave an equality to the database. Filters of Spark are not pushed: what is pushed for one query of a DataFrame would
    stay for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, {k.lower(): v for k, v in self.options.items()})


def register_sqlite(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
