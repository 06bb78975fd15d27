"""WARC archives with a two-level capture index.

Each task writes its records as one archive, a gzip member for each record. Of records with equal payloads of at least
`REVISIT_BYTES`, the one with the largest id is the response and the others are revisits that name it. Index lines (key,
id, file, offset, length) are range-partitioned by their reversed-host key and id, sorted, and written as compressed
blocks of `LINES` lines; beside each index file stands its sparse directory: first key and place of each block.
The index files' own first keys form the top level, one entry for each file. A lookup binary-searches the top level, then
one directory, reads one block by range, binary-searches it, and reads the record by range.

Defined cases: a null html has an empty payload; a null url has the empty key; rows with equal urls, equal payloads
and equal ids are all kept (equal ids with equal payloads: one is the response); empty tables give no files and
no rows; other columns are ignored.
"""
from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

REVISIT_BYTES = 1000
#: Index lines of a compressed block, and bytes of neighbouring records fetched by one range read.
LINES, SPAN = 1000, 1 << 20
#: Fixed: archive date, so that a repeated task writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_key(url: str | None) -> str:
    """com,example,www)/path?query for http://www.example.com/path?query; case of the host is dropped."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload; its digest and size stay in the header."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    name = hashlib.sha1(f"{page_id}\0{url}\0{digest}".encode()).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(raw.encode() + body + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


ENTRY = "key string, page_id long, file string, offset long, length long"


def write_archives(df: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one archive for each task; the index lines."""
    pages = df.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"),
                      F.coalesce(F.encode(F.col(f"`{html}`"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = (pages.where(large).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "response"))
    decided = pages.join(groups, "digest", "left").withColumn(
        "refers_to", F.when(large & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("response")), F.col("response")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, lines, at = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", [], 0

        def members() -> Iterator[bytes]:
            nonlocal at
            for b in batches:
                for i, u, p, d, r in zip(*(b.column(c) for c in range(5)), strict=True):
                    m = record(i.as_py(), u.as_py(), p.as_py(), d.as_py(), r.as_py())
                    lines.append((reversed_key(u.as_py()), i.as_py(), file, at, len(m)))
                    at += len(m)
                    yield m

        if store.publish(file, members()):
            cols = list(zip(*lines, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["key", "page_id", "file", "offset", "length"])

    return store.kept(decided.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(task, ENTRY), "warc-lines")


#: Keys compare as (reversed-host key in UTF-8 bytes, id); a null id stands first.
def sort_key(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.encode(), -(1 << 63) if page_id is None else page_id


def write_index(lines: DataFrame, folder: str) -> list[tuple]:
    """Write the compressed blocks and their directories; the top level: (first key, first id, file) in order."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index-{TaskContext.get().partitionId():06d}"
        blocks: list[list] = []

        def members() -> Iterator[bytes]:
            at, block = 0, []

            def closed() -> bytes:
                nonlocal at
                m = gzip.compress("".join(json.dumps(x) + "\n" for x in block).encode(), 6, mtime=0)
                blocks.append([block[0][0], block[0][1], at, len(m)])
                at += len(m)
                return m

            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    block.append(row)
                    if len(block) == LINES:
                        yield closed()
                        block.clear()
            if block:
                yield closed()

        if store.publish(f"{name}.gz", members()):
            store.publish(f"{name}.dir", [json.dumps(blocks).encode()])
            yield pa.RecordBatch.from_arrays([pa.array([blocks[0][0]]), pa.array([blocks[0][1]], pa.int64()), pa.array([name])], ["key", "page_id", "name"])

    order = ["key", "page_id"]
    made = lines.repartitionByRange(store.width(lines.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(task, "key string, page_id long, name string")
    return sorted(((r["key"], r["page_id"], r["name"]) for r in made.collect()), key=lambda r: sort_key(r[0], r[1]))  # one row for each index file


class Index:
    """Reader of the two levels. `top` is the list that write_index returned."""

    def __init__(self, top: list[tuple]):
        self.top, self.firsts = top, [sort_key(k, i) for k, i, _ in top]

    @staticmethod
    @lru_cache(maxsize=4)
    def directory(name: str) -> tuple[list, list]:
        with store.mapped(f"{name}.dir") as f:
            rows = json.loads(f.read())
        return rows, [sort_key(k, i) for k, i, _, _ in rows]

    @staticmethod
    @lru_cache(maxsize=4)
    def block(name: str, at: int, size: int) -> tuple[list, list]:
        with store.mapped(f"{name}.gz") as f:
            rows = [json.loads(x) for x in zlib.decompress(f.read_at(size, at), 31).decode().splitlines()]
        return rows, [sort_key(r[0], r[1]) for r in rows]

    def find(self, key: str, page_id: int | None) -> list[list]:
        """Index lines with this key and id (several if rows were repeated)."""
        want, out = sort_key(key, page_id), []
        if not self.top:
            return out
        file = max(0, bisect_right(self.firsts, want) - 1)
        while file >= 0:
            name = self.top[file][2]
            blocks, firsts = self.directory(name)
            for b in range(max(0, bisect_right(firsts, want) - 1), -1, -1):
                rows, keys = self.block(name, *blocks[b][2:])
                i = bisect_right(keys, want)
                while i and keys[i - 1] == want:
                    out.append(rows[i - 1])
                    i -= 1
                if i:  # something smaller stands before: no earlier block has this key
                    return out
            file -= 1
        return out


def read_back(spark: SparkSession, wanted: DataFrame, top: list[tuple]) -> DataFrame:
    """(page_id, url), distinct, to the facts of their records, each found by lookup and read by range."""
    shared = spark.sparkContext.broadcast(top)  # one entry for each index file

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            lines = [x for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in index.find(reversed_key(u), i)]
            rows = []
            lines.sort(key=lambda x: (x[2], x[3]))
            i = 0
            while i < len(lines):
                j = i
                while j + 1 < len(lines) and lines[j + 1][2] == lines[i][2] and lines[j + 1][3] - lines[j][3] - lines[j][4] < 4096 and lines[j + 1][3] - lines[i][3] < SPAN:
                    j += 1
                with store.mapped(lines[i][2]) as f:
                    span = f.read_at(lines[j][3] + lines[j][4] - lines[i][3], lines[i][3])
                for x in lines[i:j + 1]:
                    rows.append(facts(span[x[3] - lines[i][3]:x[3] - lines[i][3] + x[4]]))
                i = j + 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    order = ["key", "page_id"]
    return (wanted.select("page_id", "url", "key").repartitionByRange(store.width(spark), *order).sortWithinPartitions(*order)
            .select("page_id", "url").mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))


def facts(member: bytes) -> tuple:
    """page_id, size and digest of the full payload, type, and what it refers to, from the record alone."""
    warc, http, payload = parsed(member)
    kind, size = warc["WARC-Type"], int(http["Content-Length"])
    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {warc['X-Page-Id']}")
    page = warc["X-Page-Id"]
    return int(page) if page else None, size, digest, kind, int(warc["X-Refers-To-Page-Id"]) if kind == "revisit" else None


def round_trip(df: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    spark = df.sparkSession
    folder = store.folder(spark, "warc")
    top = write_index(write_archives(df, folder, key=key, url=url, html=html), folder)

    @F.pandas_udf("string")
    def keyed(urls: pd.Series) -> pd.Series:
        return urls.map(reversed_key)

    wanted = df.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"))
    return read_back(spark, wanted.withColumn("key", keyed("url")).dropDuplicates(["key", "page_id"]), top)
