"""Token-id files: flat unsigned integers and 64-bit document offsets, in ascending order of the ids of documents.

Documents are range-partitioned on their id, encoded, and each partition writes ``shard-n.bin`` (16-bit ids if the
vocabulary fits, else 32-bit) and ``shard-n.idx`` (64-bit offsets of its documents, in tokens, with the end).
Partition bases are prefix sums over the manifest, which has one row for each shard. Readers memory-map the files.

Defined cases: a null text is empty, so its document holds the end id alone; rows with equal ids stay together in
the order of their texts' hashes; a null id comes first; an empty table gives no document; other columns
are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces, store

MANIFEST = "shard long, path string, bits int, docs long, tokens long"


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document's ids."""
    n = counts + 1
    out = np.empty(int(n.sum()), ids.dtype)
    last = np.cumsum(n) - 1
    own = np.ones(len(out), bool)
    own[last] = False
    out[own], out[last] = ids, end
    return out, n


def write(df: DataFrame, path: str, *, vocabulary: str = "word_bpe_49k.json", end: int = 1,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files under path; the manifest, one row for each shard with the base of its first token."""
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces.encoder(pieces.vocabulary(vocabulary))
        kind = np.dtype("<u2" if max(enc.size, end + 1) <= 1 << 16 else "<u4")
        n = TaskContext.get().partitionId()
        keys, counts = [], [np.zeros(0, np.int64)]

        def blocks() -> Iterator[bytes]:
            for b in batches:
                flat, k = with_end(*enc.ids(b.column(1)), end)
                keys.append(b.column(0))
                counts.append(k)
                yield flat.astype(kind).tobytes()

        name = f"{path}/shard-{n:06d}"
        store.publish(f"{name}.bin", blocks())
        total = np.concatenate(counts)
        if len(total):
            store.publish(f"{name}.idx", [np.concatenate([[0], np.cumsum(total)]).astype("<i8").tobytes()])
            ids = pa.chunked_array(keys).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, pa.schema([("key", ids.type)])) as w:
                w.write(pa.record_batch([ids], ["key"]))
            store.publish(f"{name}.keys", [sink.getvalue().to_pybytes()])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([name]), pa.array([kind.itemsize * 8], pa.int32()),
                                              pa.array([len(total)], pa.int64()), pa.array([int(total.sum())], pa.int64())],
                                             ["shard", "path", "bits", "docs", "tokens"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    order = ["key", F.xxhash64("text")]
    made = rows.repartitionByRange(store.width(df.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(shard, MANIFEST)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store.kept(made, "token-manifest").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, *, slice_docs: int = 20_000) -> DataFrame:
    """From the files: each document's id, its first token among all documents' tokens, count and checksum."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (row for b in batches for row in b.to_pylist()):
            kind = np.dtype("<u2" if s["bits"] == 16 else "<u4")
            with store.mapped(f"{s['path']}.idx") as f:
                off = np.frombuffer(f.read(), "<i8")
            with store.mapped(f"{s['path']}.keys") as f:
                keys = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
            with store.mapped(f"{s['path']}.bin") as f:
                for i in range(0, len(keys), slice_docs):
                    j = min(len(keys), i + slice_docs)
                    crc = np.empty(j - i, np.int64)
                    for k in range(i, j):
                        ids = np.frombuffer(f.read_at(int(off[k + 1] - off[k]) * kind.itemsize, int(off[k]) * kind.itemsize), kind)
                        crc[k - i] = zlib.crc32(ids.astype("<u4"))
                    yield pa.RecordBatch.from_arrays(
                        [keys[i:j], pa.array(off[i:j] + s["base"]), pa.array(np.diff(off[i:j + 1])), pa.array(crc)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    each = manifest.repartition(store.width(spark))
    return each.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, **kw) -> DataFrame:
    spark = df.sparkSession
    return read(spark, write(df, store.folder(spark, "tokens"), **kw))
