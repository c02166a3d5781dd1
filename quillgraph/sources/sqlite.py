"""SQLite files as Spark sources: what they hold, their keys, and scans in ranges of rows.

Executors open the file too, so on a cluster its path must lie in a folder that they share.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that a worker holds at once.
BATCH = 10_000
#: Spark types by the sign found first in a declared type; any other is a number, none at all a string.
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def _text(raw: bytes) -> str:
    """UTF-8, or else Latin-1, which reads any bytes."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _open(path: str):
    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    con.text_factory = _text
    return closing(con)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str | None) -> str:
    declared = (declared or "").upper()
    if not declared:
        return "string"
    return next((t for sign, t in AFFINITY if sign in declared), "double")


def _tables(con: sqlite3.Connection) -> list[tuple]:
    return con.execute(r"SELECT name, type, sql FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\_%' ESCAPE '\' ORDER BY name").fetchall()


def tables(spark: SparkSession, path: str) -> DataFrame:
    """(table, kind, ddl)."""
    with _open(path) as con:
        return spark.createDataFrame(_tables(con), "table string, kind string, ddl string")


def columns(spark: SparkSession, path: str) -> DataFrame:
    """(table, position, column, type, is_key) as declared."""
    with _open(path) as con:
        rows = [(t, i, c, kind, key > 0) for t, _, _ in _tables(con) for i, c, kind, _, _, key in con.execute(f"PRAGMA table_info({_quoted(t)})")]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, is_key boolean")


def references(spark: SparkSession, path: str) -> DataFrame:
    """(table, column, ref_table, ref_column); a reference that names no column means the first key column."""
    rows = []
    with _open(path) as con:
        for t, _, _ in _tables(con):
            for r in con.execute(f"PRAGMA foreign_key_list({_quoted(t)})").fetchall():
                keys = sorted((k, c) for _, c, _, _, _, k in con.execute(f"PRAGMA table_info({_quoted(r[2])})") if k)
                rows.append((t, r[3], r[2], r[4] or (keys[0][1] if keys else None)))
    return spark.createDataFrame(rows, "table string, column string, ref_table string, ref_column string")


def scan(spark: SparkSession, path: str, table: str, parts: int = 8, types: dict[str, str] | None = None) -> DataFrame:
    """All rows of a table or view, read in ranges of rowid, side by side.

    Types follow the declared ones, or types where given. A value that isn't of its column's type
    raises, as null would lose it; read such a column as string. Views and tables without rowid are
    one range.
    """
    with _open(path) as con:
        fields = [(c, (types or {}).get(c) or spark_type(kind)) for _, c, kind, _, _, _ in con.execute(f"PRAGMA table_info({_quoted(table)})")]
        if not fields:
            raise ValueError(f"no table {table}")
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
            ranged = not isinstance(low, (str, bytes)) and [k for n, k, _ in _tables(con) if n == table] == ["table"]
        except sqlite3.OperationalError:
            ranged = False
    spans = [(None, None)]
    if ranged and low is not None:
        step = -(-(high - low + 1) // parts)
        spans = [(x, min(x + step - 1, high)) for x in range(low, high + 1, step)]
    sql = f"SELECT {', '.join(_quoted(c) for c, _ in fields)} FROM {_quoted(table)}"

    def column(values: tuple, kind: str) -> pa.Array:
        if kind == "string":
            values = [x if x is None or isinstance(x, str) else _text(x) if isinstance(x, bytes) else str(x) for x in values]
        elif kind == "binary":
            values = [x if x is None or isinstance(x, bytes) else str(x).encode() for x in values]
        return pa.array(values, _ARROW[kind])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for span in zip(b["low"].to_pylist(), b["high"].to_pylist()):
                with _open(path) as con:
                    rows = con.execute(sql) if span[0] is None else con.execute(f"{sql} WHERE rowid BETWEEN ? AND ?", span)
                    while got := rows.fetchmany(BATCH):
                        yield pa.RecordBatch.from_arrays([column(v, k) for v, (_, k) in zip(zip(*got), fields)], [c for c, _ in fields])

    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(k)) for c, k in fields])
    return spark.createDataFrame(spans, "low long, high long").repartition(len(spans)).mapInArrow(work, schema)
