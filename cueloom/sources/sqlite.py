"""SQLite files as a Spark data source, read and written by tasks.

    spark.read.format("sqlite").option("path", ...).option("table", ...).load()
    df.write.format("sqlite").option("path", folder).option("table", ...).mode("overwrite").save()

The path is a file or a folder of files that hold the same table. A file is cut
into `numPartitions` ranges of row ids, each read by a task of its own. Only the
columns that a plan asks for are selected if they are named by the `columns`
option (comma-separated).

Comparisons, IN, IS NULL and beginnings of texts reach the file as its WHERE, in
two ways. read_sqlite(where=...) states them for good, with the relation. With
the option `pushFilters` a plan's own filters are taken as Spark hands them over
(spark.sql.python.filterPushdown.enabled). Spark 4.1 keeps one reader for a
relation, the last that it pushed filters to, and gives it to plans without
filters too; so a relation with this option should be read by one plan, and it is off otherwise.

A write gives each task a file of its own in the folder; they appear by rename
when the job has ended well, and a failed job leaves none. The folder must lie where
driver and executors see it as files. JDBC databases are read with Spark's own
`jdbc` format and its partition column.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_KINDS = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_STATED = {"=": ds.EqualTo, ">": ds.GreaterThan, ">=": ds.GreaterThanOrEqual, "<": ds.LessThan, "<=": ds.LessThanOrEqual, "in": ds.In, "starts with": ds.StringStartsWith, "is null": ds.IsNull, "is not null": ds.IsNotNull}
#: What SQLite compares as Spark does, by the column's declared kind.
_ALIKE = {"bigint": (int,), "double": (int, float), "string": (str,)}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class RowRange(InputPartition):
    path: str
    low: int
    high: int


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def files(self) -> list[str]:
        path = _plain(self.options["path"])
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".db")) if os.path.isdir(path) else [path]

    def kinds(self) -> dict[str, str]:
        """Column -> Spark type, as the first file declares them."""
        found = self.files()
        con = connect(found[0]) if found else None
        try:
            info = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall() if con else []
        finally:
            con and con.close()
        if not info:
            raise ValueError(f"no table {self.options['table']!r}")
        return {name: _KINDS.get((kind or "").upper()[:4], _KINDS["INT"] if "INT" in (kind or "").upper() else "string") for _, name, kind, *_ in info}

    def schema(self) -> str:
        kinds = self.kinds()
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or list(kinds)
        return ", ".join(f"`{c}` {kinds[c]}" for c in wanted)

    def reader(self, schema) -> DataSourceReader:
        push = self.options.get("pushFilters", "false").lower() == "true"
        return (PushingReader if push else SqliteReader)(self, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options, schema, overwrite)


def connect(path: str, write: bool = False):
    import sqlite3

    return sqlite3.connect(path) if write else sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema):
        self.files, self.columns = source.files(), [f.name for f in schema.fields]
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.table = source.options["table"]
        self.parts = int(source.options.get("numPartitions", "4"))
        self.where: list[tuple[str, list]] = []
        for column, how, value in json.loads(source.options.get("where", "[]")):
            made = self._clause(_STATED[how]((column,)) if how in ("is null", "is not null") else _STATED[how]((column,), tuple(value) if how == "in" else value))
            if made is None:
                raise ValueError(f"not a condition for {column!r}: {how} {value!r}")
            self.where.append(made)

    def _clause(self, f) -> tuple[str, list] | None:
        if isinstance(f, ds.Not):
            inner = self._clause(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in self.kinds:
            return None
        column, alike = _quoted(f.attribute[0]), _ALIKE.get(self.kinds[f.attribute[0]], ())
        same = lambda x: type(x) in alike  # noqa: E731  a bool is no int here
        if isinstance(f, ds.IsNull):
            return f"{column} IS NULL", []
        if isinstance(f, ds.IsNotNull):
            return f"{column} IS NOT NULL", []
        if type(f) in _COMPARED and same(f.value):
            return f"{column} {_COMPARED[type(f)]} ?", [f.value]
        if isinstance(f, ds.In) and all(same(x) for x in f.value) and len(f.value) < 500:
            return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, ds.StringStartsWith) and same(f.value):
            return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
        return None

    def partitions(self):
        out = []
        for path in self.files:
            con = connect(path)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            finally:
                con.close()
            if low is not None:
                step = -(-(high - low + 1) // self.parts)
                out += [RowRange(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [RowRange("", 0, -1)]

    def read(self, partition: RowRange):
        if not partition.path:
            return
        con = connect(partition.path)
        try:
            names = ", ".join(map(_quoted, self.columns))
            asked = "".join(f" AND ({sql})" for sql, _ in self.where)
            values = [v for _, vs in self.where for v in vs]
            yield from con.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?{asked}", (partition.low, partition.high, *values))
        finally:
            con.close()


class PushingReader(SqliteReader):
    """Takes a plan's own filters too; Spark asks for that setting where a reader has this method."""

    def pushFilters(self, filters):
        """Takes the filters that the file can answer as Spark would; the others are left to Spark."""
        for f in filters:
            made = self._clause(f)
            if made is None:
                yield f
            else:
                self.where.append(made)


@dataclass
class Written(WriterCommitMessage):
    part: str
    target: str


class SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB", "string": "TEXT"}
        unknown = [f.name for f in schema.fields if f.dataType.simpleString() not in kinds]
        if unknown:
            raise ValueError(f"columns of no SQLite type: {', '.join(unknown)}")
        self.folder, self.table, self.overwrite = _plain(options["path"]), options["table"], overwrite
        self.columns = [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields]
        if os.path.exists(self.folder) and not os.path.isdir(self.folder):
            raise ValueError(f"{self.folder} is a file")
        self.before = [] if not overwrite or not os.path.isdir(self.folder) else [f for f in os.listdir(self.folder) if f.endswith(".db")]

    def write(self, iterator) -> Written:
        from itertools import islice

        name = uuid.uuid4().hex
        os.makedirs(self.folder, exist_ok=True)
        part = os.path.join(self.folder, f".{name}.part")
        con = connect(part, write=True)
        try:
            con.execute(f"CREATE TABLE {_quoted(self.table)} ({', '.join(f'{_quoted(c)} {kind}' for c, kind in self.columns)})")
            insert = f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})"
            while rows := [tuple(r) for r in islice(iterator, 1000)]:
                con.executemany(insert, rows)
            con.commit()
        finally:
            con.close()
        return Written(part, os.path.join(self.folder, f"part-{name}.db"))

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.part, m.target)
        for f in self.before:
            os.remove(os.path.join(self.folder, f))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.remove(m.part)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4, where: list[tuple] = (), push: bool = False) -> DataFrame:
    """The table's rows; where: conditions (column, how, value) that the files answer, with how of = > >= < <= in, starts with, is null, is not null.

    push: take the plan's own filters too, see above.
    """
    spark.dataSource.register(SqliteSource)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    stated = json.dumps([(c, how, rest[0] if rest else None) for c, how, *rest in where])
    read = spark.read.format("sqlite").option("path", path).option("table", table).option("numPartitions", str(partitions))
    return read.option("where", stated).option("pushFilters", str(push).lower()).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """Writes df as a folder of SQLite files, one a task."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").option("path", path).option("table", table).mode(mode).save()
