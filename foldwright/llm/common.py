"""Shared expressions and helpers of the text operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of a side that may be broadcast as key tables (about 24 bytes a row in the executors).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: str | Column) -> Column:
    """Array of the words of a text, in order; empty for null."""
    return F.filter(F.split(text_of(col), f"{SPACE_CLASS}+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, like a let-expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share.

    Where the session names none, a local master gets a folder below /tmp, as all its threads see it; a cluster gets an
    error, as rows written to a machine's own disk would be lost.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or "file:///tmp/checkpoints"


#: Settings while a table is written: its shuffle files go when the query ends, not when the driver collects its
#: garbage, and Python workers get batches of fewer rows, as texts can be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


#: Paths of the tables that the innermost ``last_table_only`` has seen written.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def last_table_only(spark: SparkSession) -> Iterator[None]:
    """At its end, delete all tables that were written inside but the last one, which must not read the others any more."""
    token = _written.set([])
    try:
        yield
    finally:
        made = _written.get()
        _written.reset(token)
        for path in made[:-1]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder; a lost executor loses none of it. Its shuffles are then removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldwright/{label}-{uuid.uuid4().hex}"
    if (made := _written.get()) is not None:
        made.append(path)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keys_within(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Join ``df`` with a table of keys; the keys are broadcast only after counting them, else both sides shuffle."""
    return df.join(sized(keys), on, how)


#: A value is hot if more than one in so many rows hold it, and more than HOT_LEAST; there are at most so many of them, or
#: one in HOT_LEAST rows where rows are few.
HOT_SHARE = 10_000
HOT_LEAST = 100


def join_counted(rows: DataFrame, counts: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counts``, one row a value that says in ``n`` how many of the ``total`` rows hold it.

    Rows of hot values stay where they are: of values that more than total / HOT_SHARE rows hold there are fewer than
    HOT_SHARE, which are broadcast. The others are joined by shuffling, and none of their groups is large.
    """
    limit = max(total // HOT_SHARE, HOT_LEAST)
    hot, cold = counts.where(F.col(n) > limit), counts.where(F.col(n) <= limit)
    if total <= limit or not hot.limit(1).count():
        return rows.join(counts, on)
    cold_rows = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(cold_rows.join(cold, on))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
