"""Tables in SQLite files as a data source: many files, ranges of rowids, filters and columns read by SQLite."""

from __future__ import annotations

import contextlib
import glob
import os
import shutil
import sqlite3
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

FORMAT = "sqlite_tables"
#: Rows that are handed on at a time.
ROWS = 8192
#: Spark's types as SQLite's, and SQLite's declared types (by what they contain) as Spark's.
AFFINITY = {StringType: "TEXT", BinaryType: "BLOB", DoubleType: "REAL", FloatType: "REAL", LongType: "INTEGER", IntegerType: "INTEGER", ShortType: "INTEGER", ByteType: "INTEGER", BooleanType: "INTEGER"}
DECLARED = [("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("BLOB", BinaryType())]


def local(path: str) -> str:
    """A path that SQLite can open: a mounted one."""
    bare = path.removeprefix("file://").removeprefix("file:")
    if "://" in bare:
        raise ValueError(f"SQLite opens files of a mounted folder only, not {path}")
    return bare


def files_of(path: str) -> list[str]:
    bare = local(path)
    return sorted(glob.glob(f"{glob.escape(bare)}/*.sqlite")) if os.path.isdir(bare) else [bare]


def opened(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class RowidRange(D.InputPartition):
    path: str
    lo: int | None
    hi: int | None


class SqliteTables(D.DataSource):
    """Reads the option `table` of a file, or of all *.sqlite files of a folder (`path`); `partitions` ranges of rowids a file.

    Only the columns of the schema are read: give a schema of the columns wanted. Comparisons with constants, lists and
    tests for null are SQLite's to filter. Tables without rowids are one range a file.
    Writes one file a task, moved into place when all tasks have ended.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no SQLite file in {self.options['path']}")
        with contextlib.closing(opened(files[0])) as c:
            columns = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda t: next((k for part, k in DECLARED if part in t.upper()), BinaryType() if not t else DoubleType())
        return StructType([StructField(name, kind(declared or ""), True) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return SqliteReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceWriter:
        return SqliteWriter(schema, self.options, overwrite)


class SqliteReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)
        self.arrow = to_arrow_schema(schema)
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802  Spark's name
        """Takes the filters that SQLite answers as Spark does; the others stay Spark's."""
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        for f in filters:
            kind, column = type(f), quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            plain = lambda v: isinstance(v, (int, float, str)) and v == v
            if column and kind in signs and plain(f.value):
                self.where.append(f"{column} {signs[kind]} ?")
                self.values.append(f.value)
            elif column and kind is D.In and all(map(plain, f.value)) and 0 < len(f.value) <= 500:
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column and kind in (D.IsNull, D.IsNotNull):
                self.where.append(f"{column} IS {'NOT ' if kind is D.IsNotNull else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[RowidRange]:
        table, parts, out = quoted(self.options["table"]), max(1, int(self.options.get("partitions", 4))), []
        for path in files_of(self.options["path"]):
            with contextlib.closing(opened(path)) as c:
                try:
                    lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(RowidRange(path, None, None))
                    continue
            if lo is not None:
                step = -(-(hi - lo + 1) // parts)
                out += [RowidRange(path, a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]
        return out or [RowidRange("", None, None)]

    def read(self, partition: RowidRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, values = list(self.where), list(self.values)
        if partition.lo is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.lo, partition.hi]
        columns = ", ".join(map(quoted, self.names)) or "1"
        sql = f"SELECT {columns} FROM {quoted(self.options['table'])}{' WHERE ' + ' AND '.join(where) if where else ''}"
        with contextlib.closing(opened(partition.path)) as c:
            cursor = c.execute(sql, values)
            while rows := cursor.fetchmany(ROWS):
                cells = [[bool(v) if pa.types.is_boolean(f.type) and v is not None else v for v in column] for f, column in zip(self.arrow, zip(*rows))]
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(cells, self.arrow)], schema=self.arrow)


@dataclass
class PartFile(D.WriterCommitMessage):
    staged: str | None


class SqliteWriter(D.DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("files are only added: use mode('append')")
        wrong = [f.name for f in schema if type(f.dataType) not in AFFINITY]
        if wrong:
            raise ValueError(f"SQLite has no type for {wrong}")
        self.root, self.table, self.job = local(options["path"]).rstrip("/"), options["table"], uuid.uuid4().hex
        self.columns = [(f.name, AFFINITY[type(f.dataType)]) for f in schema]
        os.makedirs(self.staging)  # goes when the job ends; a task that is still at work then has nowhere to write

    @property
    def staging(self) -> str:
        return f"{self.root}/_staging-{self.job}"

    def write(self, rows: Iterator) -> PartFile:
        first = next(rows, None)
        if first is None:
            return PartFile(None)
        path = f"{self.staging}/part-{uuid.uuid4().hex}.sqlite"
        with contextlib.closing(sqlite3.connect(path)) as c:
            c.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(n)} {t}' for n, t in self.columns)})")
            put = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})"
            c.execute(put, tuple(first))
            c.executemany(put, (tuple(r) for r in rows))
            c.commit()
        return PartFile(path)

    def commit(self, messages: list[PartFile | None]) -> None:
        for m in messages:
            if m and m.staged:
                os.replace(m.staged, f"{self.root}/{os.path.basename(m.staged)}")
        self.abort(messages)

    def abort(self, messages: list[PartFile | None]) -> None:
        for wait in (0, 0.1, 0.5, 2):  # a task that has not heard of the end may have opened a file meanwhile
            time.sleep(wait)
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.isdir(self.staging):
                break


def read_sqlite(spark, path: str, table: str, schema: str | StructType | None = None, partitions: int = 4) -> DataFrame:
    """The table, with filters on it answered by SQLite; a schema names the columns to read."""
    spark.dataSource.register(SqliteTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("path", path).option("table", table).option("partitions", partitions)
    return (reader.schema(schema) if schema else reader).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """A SQLite file a task under path, each with its rows of the table."""
    os.makedirs(local(path), exist_ok=True)
    df.sparkSession.dataSource.register(SqliteTables)
    df.write.format(FORMAT).mode("append").option("path", path).option("table", table).save()
