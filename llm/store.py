"""Files that tasks write into the cluster's shared folder and other tasks read back by range.

A file appears under its final name only when it is whole (it is written under the attempt's own name and
renamed), and a repeated task writes the same bytes, so lost executors and repeated attempts do no harm.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from stillvalid.session import scratch_path


def folder(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path in it; paths without a scheme are local (a mounted share)."""
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def publish(path: str, blocks) -> int:
    """Write the blocks of bytes as one file; the size in bytes."""
    system, place = open_fs(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    own, size = f"{place}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(own) as out:
        for block in blocks:
            out.write(block)
            size += len(block)
    system.move(own, place)
    return size


def mapped(path: str) -> pa.NativeFile:
    """Random access to a file: memory-mapped where it is local, ranged reads elsewhere."""
    system, place = open_fs(path)
    return pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage, and tasks that write files run once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch of whole texts that goes to Python; Spark's 10,000 hold tens of MB in the JVM and again in Python.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is written meanwhile passes batches of at most so many rows to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
        yield
    finally:
        spark.conf.set(name, before)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
