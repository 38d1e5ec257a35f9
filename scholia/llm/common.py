"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: the list that materialise() adds its folders to, within scope().
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The folders that materialise() writes within the block, for discard(); what is written outside of it, or within another
    block (of this thread or another), is not among them."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder takes its place, on a local master only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts the
    lineage, survives lost executors, and gives exact statistics to later joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (mine := _scope.get()) is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders.  Only for a caller that has written the results it needs; DataFrames over these folders can't be read again."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a digest of a row's id and text: rows that differ in either have keys of their own.  A null text counts as empty."""
    name = F.col(id_col).cast("string")
    told = F.concat(F.coalesce(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name), F.lit(":")), text_or_empty(text_col))
    return F.substring(F.unhex(F.sha2(told, 256)), 1, 16)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n
