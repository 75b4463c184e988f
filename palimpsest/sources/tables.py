"""Written tables: a plan's rows kept in the folder that driver and executors share, so that no executor's loss costs them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders of the tables that the open scratch blocks have written, innermost last.
_OPEN: list[list[str]] = []
_ENDS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own that goes when the program ends;
    a cluster is refused, since a folder of one machine is not there for the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _at_end(spark: SparkSession, folder: str) -> None:
    def end() -> None:
        with contextlib.suppress(Exception):  # the session may have ended first
            removed(spark, folder)

    if folder not in _ENDS:
        _ENDS.add(folder)
        atexit.register(end)


def written(df: DataFrame, tag: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Writes df as Parquet and reads it again: later steps reuse it instead of computing it anew. With `by`, the rows of each of
    that column's values are files of their own, so that a choice by it reads nothing else.

    It is deleted when the innermost scratch block ends (with `keep`, the next one out), or with the program."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}"
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    _at_end(spark, folder)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by key to as many tasks as a shuffle has. Rows that are read from a small file, or were moved while they were
    small, and are then grown by expressions are else worked on by the few tasks that fit the small bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def beside(a: DataFrame, b: DataFrame, on: str | list[str] = "record_id", how: str = "inner") -> DataFrame:
    """a joined with b by record, never by a copy of b on the driver: tables that grow with the records are small files where their
    columns repeat, so that Spark takes them for small tables."""
    return a.join(b.hint("merge"), on, how)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose written tables are deleted when it ends; what it returns must not read them."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            removed(spark, path)


def numbered(df: DataFrame, order: list[str], name: str = "r") -> DataFrame:
    """df with a rank from 1 by `order`, without one task for all rows: ranges of the order, a rank inside each, and before it the
    rows of the ranges that come earlier, of which there is one number a range."""
    laid = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = laid.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row a range
    inside = laid.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return inside.join(before, "__p").withColumn(name, F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")
