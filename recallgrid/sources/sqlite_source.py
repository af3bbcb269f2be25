"""Spark data source for the tables of a SQLite file: ranges of row ids on executors, equality on columns pushed down."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Row ids of a partition, and rows of a batch.
RANGE, BATCH = 100_000, 5_000
_NAME = re.compile(r"\w+")


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def opened(path: str) -> sqlite3.Connection:
    """The file for reading alone, with the collation that collection files name."""
    db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    db.create_collation("unicase", lambda a, b: (a.lower() > b.lower()) - (a.lower() < b.lower()))
    return db


class SqliteSource(DataSource):
    """Options: path, table and range (row ids of a partition). The schema that the reader gives names the columns; a file
    must not change while it is read, so a copy is read of one that another program owns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("range", RANGE)))


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, size: int) -> None:
        if not all(_NAME.fullmatch(x) for x in (table, *schema.names)):
            raise ValueError("names of tables and columns are letters, digits and underscores")
        self.names, self.types = schema.names, {f.name: f.dataType.simpleString() for f in schema.fields}
        self.path, self.table, self.size = path, table, size
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if values and len(f.attribute) == 1 and all(type(v) in (int, str) for v in values):
                self.tests.append((f.attribute[0], values))
            else:
                yield f

    def where(self) -> tuple[str, list]:
        """The pushed tests in SQL, and their values."""
        return "".join(f" and {name} in ({', '.join('?' * len(values))})" for name, values in self.tests), [v for _, values in self.tests for v in values]

    def partitions(self) -> list[Rows]:
        """Ranges of row ids between the smallest and the largest that pass the pushed tests."""
        test, values = self.where()
        with closing(opened(self.path)) as db:
            least, most = db.execute(f"select min(rowid), max(rowid) from {self.table} where true{test}", values).fetchone()
            if least is None:
                return [Rows(0, -1)]
            count = db.execute(f"select count(*) from {self.table} where true{test}", values).fetchone()[0]
        # Row ids of these files are times or small numbers: equal steps of ids hold about equal numbers of rows.
        parts = max(1, min(-(-count // self.size), most - least + 1))
        step = -(-(most - least + 1) // parts)
        return [Rows(a, min(a + step - 1, most)) for a in range(least, most + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        test, values = self.where()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds.get(self.types[name], pa.string())) for name in self.names])
        with closing(opened(self.path)) as db:
            rows = db.execute(f"select {', '.join(self.names)} from {self.table} where rowid between ? and ?{test}", [partition.first, partition.last, *values])
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, size: int = RANGE):
    """Rows of one table. The file must stand where driver and executors can open it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).options(path=path, table=table, range=size).load()
