"""What the corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import materialise

# The ASCII white space between words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

# For ``bytes.translate``: ASCII letters in lower case, digits and bytes of other characters
# stay, everything else parts words.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32
    for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def utf8(text: str = "text") -> Column:
    """A text as its UTF-8 bytes, null read as empty: what Python helpers are given."""
    return whole(text).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, row: str) -> DataFrame:
    """``df`` with a number of every row in the column ``row``, written out once.

    Two scans may cut the same files differently, as splits follow the cores that are there
    when a job starts. Whoever meets rows again by number reads this table on both sides.
    """
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), "numbered")


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


# Matrices that are added up in one step, and how they travel.
FAN = 64
LINES = "line int, task int, values array<double>"


def sent(matrix: np.ndarray) -> pa.RecordBatch:
    """A task's matrix as rows ``LINES``."""
    return pa.record_batch([
        pa.array(range(len(matrix)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(matrix), pa.int32()),
        pa.array(list(matrix), pa.list_(pa.float64()))], ["line", "task", "values"])


def summed(parts: DataFrame, lines: int, width: int | None = None) -> np.ndarray:
    """The matrices that tasks sent, added up; only one matrix reaches the driver."""

    def add(table: pa.Table) -> pa.Table:
        column = table.column("values").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return pa.table({"line": table.column("line")[:1], "task": table.column("task")[:1],
                         "values": pa.array([values.sum(axis=0)], pa.list_(pa.float64()))})

    near = parts.withColumn("task", F.expr(f"task div {FAN}").cast("int")).groupBy("line", "task").applyInArrow(add, LINES)
    out = np.zeros((lines, width or lines))
    for r in near.groupBy("line").applyInArrow(add, LINES).collect():
        out[r["line"]] = r["values"]
    return out
