"""Session helpers: where shared tables go, and how a small fitted table is frozen."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose executors are threads of
    the driver (``local[...]``) may go without: a folder is made for it. Any other session is
    refused, since its executors would write where nobody else can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


#: Files that a task keeps open at once when it writes a partitioned table; partitions beyond them are sorted.
OPEN_FILES = 16


#: No limit on a batch's bytes. Spark weighs all columns of a batch after every row to keep one, which takes longer
#: than sending it; rows here are numbers, a few kB at most, and a batch has a limited number of them.
ANY_SIZE = str(2**31 - 1)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``_`` for ``.``) while a table is written."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write_parquet(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Write a table. Partition columns here have a few values, so a task writes all its partitions' files side by side;
    Spark would sort, and spill, whole rows by them first."""
    own = {"spark_sql_maxConcurrentOutputFileWriters": str(OPEN_FILES)} if partition_by else {}
    with settings(df.sparkSession, **own):
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def freeze(df: DataFrame, label: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a fitted table once and read it back.

    Fitted reference tables must not move after they are fitted, and a table read from files has a
    size the optimizer knows: it broadcasts the table when that size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise. No hint is needed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, spark_sql_execution_arrow_maxBytesPerBatch=ANY_SIZE):
        write_parquet(df, path, partition_by=partition_by, mode="overwrite")
    return spark.read.schema(df.schema).parquet(path)
