"""Shared working folder and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stored table up to which Spark may send it to all tasks. It goes by the size of the files, in which a million keys can
#: take less than the ten megabytes of its threshold, and what is sent passes through the driver.
SENT_ROWS = 50_000

#: Tables written since each open scope began.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or the one set on the context."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that `cut_lineage` writes inside, at the end. Whatever reads them has to be written by then."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes.remove(written)
        for path in written:
            remove(spark, path)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, removed at the end of the open scope."""
    path = f"{shared_folder(spark)}/rollcall/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` computed once, as a table written to the shared folder.

    It survives lost executors, and Spark knows its true size when it plans the joins.
    """
    path = new_folder(df.sparkSession)
    # a column that is null throughout may have no type yet
    untyped = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    df = df.withColumns(untyped) if untyped else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table as a side of a join: one of more than `SENT_ROWS` rows is shuffled. `rows`: their number, if it is known."""
    return table.hint("merge") if (table.count() if rows is None else rows) > SENT_ROWS else table
