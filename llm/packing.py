"""Sequence packing by minimum bin slack.

Each task keeps a pool of encoded documents of bounded size. Whole windows are cut off long documents; the rest
lengths are packed window by window: the longest is placed, and a subset-sum programme over the remaining
lengths (one bit for each reachable sum, a number of copies of each length) finds the multiset that fills the
window closest to its capacity; the counts of each length are traced back through the kept bitsets. Where some
slack is left, it is filled with the head of a document that stays in the pool. What remains at a pool's end is
cut into sequences whose lengths are powers of two, which need no padding. Nothing is shuffled.

Defined cases: a null or empty text holds the end id alone; a very long text is cut into whole windows;
equal lengths and repeated rows are separate items; an empty table gives no piece; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .token_files import with_end

CAPACITY = 4096
#: A pool is packed when it holds so many documents or tokens.
POOL_DOCS, POOL_TOKENS = 8192, 2_000_000


def fill(lengths: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Which lengths, and how many of each, come closest to the capacity. lengths: (length, copies), longest first.

    The reachable sums are the bits of one integer; copies of a length are added in powers of two.
    """
    mask, reach, kept = (1 << (capacity + 1)) - 1, 1, []
    for length, copies in lengths:
        most = min(copies, capacity // length)
        if not most:
            continue
        kept.append((length, most, reach))
        left, step = most, 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(kept):
        n = next(n for n in range(most + 1) if n * length <= total and before >> (total - n * length) & 1)
        if n:
            chosen[length] = n
            total -= n * length
    return chosen


def plan(tokens: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length); every token of every item is in exactly one."""
    out, stock = [], {}

    def put(item: int, start: int, length: int) -> None:
        if length:
            stock.setdefault(length, []).append((item, start))

    for item, n in enumerate(tokens):
        whole = n - n % capacity
        out += [[(item, s, capacity)] for s in range(0, whole, capacity)]
        put(item, whole, n - whole)
    order = sorted(stock, reverse=True)
    while stock:
        order = [x for x in order if x in stock]
        first = order[0]
        some = [(x, len(stock[x]) - (x == first)) for x in order]
        chosen = fill(some, capacity - first)
        chosen[first] = chosen.get(first, 0) + 1
        slack = capacity - sum(x * n for x, n in chosen.items())
        again = min(len(stock[x]) // n for x, n in chosen.items()) if not slack else 1
        for _ in range(again):
            out.append([(*stock[x].pop(), x) for x, n in chosen.items() for _ in range(n)])
        for x in chosen:
            if not stock[x]:
                del stock[x]
        if slack and stock:
            x = max(stock)
            item, start = stock[x].pop()
            if not stock[x]:
                del stock[x]
            out[-1].append((item, start, slack))
            if x - slack not in stock:
                order = sorted({*order, x - slack}, reverse=True)
            put(item, start + slack, x - slack)
        elif slack:
            out += powers_of_two(out.pop())
    return out


def powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same tokens in sequences whose lengths are powers of two."""
    out, total = [], sum(n for _, _, n in row)
    row = row[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out.append([])
        while size:
            item, start, n = row.pop()
            take = min(n, size)
            out[-1].append((item, start, take))
            if n > take:
                row.append((item, start + take, n - take))
            size -= take
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, *, vocabulary: str = "word_bpe_49k.json", end: int = 2, capacity: int = CAPACITY,
         key: str = "doc_id", text: str = "text", with_ids: bool = False, pool_docs: int = POOL_DOCS,
         pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each piece; with_ids adds its ids. A sequence is complete within one task."""
    def pool(keys: list, docs: list[np.ndarray], task: int, first: int) -> tuple[pa.RecordBatch, int]:
        rows, ids = [], []
        made = plan([len(d) for d in docs], capacity)
        for k, sequence in enumerate(made):
            offset = 0
            for item, start, n in sequence:
                part = docs[item][start:start + n]
                rows.append((keys[item], start, n, zlib.crc32(part), len(docs[item]), (task << 36) + first + k, offset))
                offset += n
                if with_ids:
                    ids.append(part)
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(off, np.concatenate(ids).astype(np.int32)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names), first + len(made)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces.encoder(pieces.vocabulary(vocabulary))
        n, first, keys, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                flat, counts = with_end(*enc.ids(part.column(1)), end)
                for k, d in zip(part.column(0).to_pylist(), np.split(flat.astype("<u4"), np.cumsum(counts)[:-1]), strict=True):
                    keys.append(k)
                    docs.append(d)
                    held += len(d)
                    if len(docs) >= pool_docs or held >= pool_tokens:
                        out, first = pool(keys, docs, n, first)
                        yield out
                        keys, docs, held = [], [], 0
        if docs:
            yield pool(keys, docs, n, first)[0]

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(task, PIECES + (", ids array<int>" if with_ids else ""))
