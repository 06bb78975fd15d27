"""Toxicity: class-conditional Kneser-Ney models of characters inside words.

Every labelled training document adds to one of two models, toxic and ordinary. The model of order `ORDER` has its
own counts for each class; lower orders hold continuation counts, each class's own down to `SHARED` + 1, and counts
of both classes together from `SHARED` down. A rare expression that one class never saw therefore backs off to what
words share in either. A word's evidence is the difference of the two log-likelihoods of its characters; a
passage's is the sum over its words, normalised by its length. A document is judged by its most toxic
passage and by the whole, put on a scale from 0 to 1 by a logistic fit.

Counts come from all labelled rows of three training folds: words are counted before they are shuffled, then
character strings are counted over the distinct words. The fitted tables hold every string and every
context under a number of its own (a permutation of its bytes), so they grow with the corpus and an unseen string has
no counts. Tasks write them to the shared folder in shards of about `SHARD` strings, sorted, and memory-map them to
score by binary search. The logistic fit uses at most `FIT_ROWS` labelled rows of a fourth
training fold, which the counts have not seen; the held-out fold is used for nothing.

Defined cases: a null text is empty; a text without words has evidence 0; rows without a label are scored alike; a
row labelled twice is toxic if one label says so, null labels count as none; repeated rows are scored each for
itself; without labels of both classes the scale is a fixed one; an empty table gives an empty result; other columns
are ignored.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, words
from .pieces import ragged

ORDER, SHARED = 6, 3
SLOTS = 20  # bits that tell shards apart, at most
SHARD = 1 << 17
DISCOUNT = 0.75
#: Words of a passage, and how far apart passages begin.
PASSAGE, STRIDE = 8, 4
#: Characters added to a length, so that a passage of one short word is not an extreme.
SOFTEN = 20.0
FIT_ROWS = 20_000
#: Labels up to so many rows are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Bytes of text whose distinct words are looked up together.
SLICE = 2 << 20
START, END = 2, 3  # bytes around a word
FOLD = 5


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLD


# Counting

def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to distinct words of each slice with their counts in either class."""
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False).astype(float)
        for c in words.cut(b.column(0), size=SLICE):
            code, place = words.coded(c)
            n = np.bincount(code, minlength=len(place))
            t = np.bincount(code, weights=toxic[c.docs], minlength=len(place)).astype(np.int64)
            own = [c.raw[i:j].tobytes() for i, j in zip(c.starts[place].tolist(), c.ends[place].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(t), pa.array(n - t)], ["word", "toxic", "ordinary"])


def packed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes that end at each byte of each word and at its end mark, as one number; and how many a word has."""
    n = lengths + ORDER  # ORDER - 1 start marks before it, an end mark after it
    at = np.cumsum(n) - n
    text = np.full(int(n.sum()), START, np.uint64)
    text[ragged(at + ORDER - 1, lengths)] = raw[ragged(starts, lengths)]
    text[at + n - 1] = END
    key = np.zeros(len(text), np.uint64)
    for j in range(ORDER):
        key[j:] |= text[:len(text) - j] << np.uint64(8 * j)
    return key[ragged(at + ORDER - 1, lengths + 1)], lengths + 1


def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their counts to strings of ORDER bytes with theirs."""
    for b in batches:
        data = b.column(0).cast(pa.large_binary())
        off = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2], np.uint8) if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
        key, n = packed(raw, off[:-1], np.diff(off))
        kinds, code = np.unique(key, return_inverse=True)
        sums = [np.bincount(code, weights=np.repeat(b.column(i).to_numpy(), n), minlength=len(kinds)).astype(np.int64) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), *map(pa.array, sums)], ["key", "toxic", "ordinary"])


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, key, toxic, ordinary) to sums by place: of the strings, and of what they follow."""
    for b in batches:
        order, key = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint64)
        t, o = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
        for k in np.unique(order):
            own = order == k
            for kind in (0, 1):
                places, code = np.unique(words.mix(key[own] >> np.uint64(8 * kind)), return_inverse=True)
                cols = [t[own], o[own], np.maximum(t[own] - DISCOUNT, 0), np.maximum(o[own] - DISCOUNT, 0)]
                sums = [np.bincount(code, weights=c, minlength=len(places)) for c in cols]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), k, np.int32)), pa.array(np.full(len(places), kind, np.int32)), pa.array(places.view(np.int64)),
                     *(pa.array(s) for s in sums)], ["order", "kind", "place", "toxic", "ordinary", "toxic_less", "ordinary_less"])


def fit_counts(labelled: DataFrame, path: str, *, bits: int = SLOTS) -> str:
    """Count the models over (text, toxic) rows and write their tables in shards."""
    spark = labelled.sparkSession
    distinct = (labelled.select("text", F.col("toxic").cast("int")).mapInArrow(count_words, "word binary, toxic long, ordinary long")
                .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    top = (distinct.mapInArrow(count_strings, "key long, toxic long, ordinary long")
           .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    top = store.kept(top, "toxicity-strings")
    few = min(bits, max(0, (top.count() // SHARD).bit_length()))  # bits of the shards
    level = top.withColumn("both", F.lit(1))
    parts = []
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # a string's count is the number of different bytes seen before it
            level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("key")).agg(
                F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary"), F.count("*").alias("both"))
        cols = ("both", "both") if k <= SHARED else ("toxic", "ordinary")
        parts.append(level.select(F.lit(k).alias("order"), "key", *(F.col(c).cast("long").alias(n) for c, n in zip(cols, ("toxic", "ordinary"), strict=True))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    sums = rows.mapInArrow(place, "order int, kind int, place long, toxic double, ordinary double, toxic_less double, ordinary_less double")
    total = sums.groupBy("order", "kind", "place").agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary", "toxic_less", "ordinary_less")))
    total = total.withColumn("shard", F.shiftrightunsigned("place", 64 - few).cast("int") if few else F.lit(0))

    def written(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name = tuple(map(int, key))
        store.publish(shard(path, *name), [x.tobytes() for x in table(rows, name[1])])
        return pd.DataFrame([name], columns=["order", "kind", "shard"])

    there = total.groupBy("order", "kind", "shard").applyInPandas(written, "order int, kind int, shard int").collect()
    store.publish(path, [json.dumps([few, sorted(map(list, there))]).encode()])
    return path


def shard(path: str, order: int, kind: int, number: int) -> str:
    return f"{path}-{order}-{kind}-{number}"


def table(rows: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's places in order, and by place for strings (kind 0) the discounted count in either class, for contexts
    one over the count in either class (0, 1) and the share that backs off (2, 3)."""
    at = rows["place"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(at)
    count, less = (rows[[f"toxic{x}", f"ordinary{x}"]].to_numpy(float)[order] for x in ("", "_less"))
    if not kind:
        return at[order], less.astype(np.float32)
    some = np.maximum(count, 1e-300)
    return at[order], np.hstack([np.where(count > 0, 1 / some, 0), np.where(count > 0, (count - less) / some, 1)]).astype(np.float32)


# Scoring

class Table(NamedTuple):
    bits: int     # that tell shards apart
    shards: dict  # number to (places, values)
    unseen: tuple

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """The values of each string or context."""
        out = np.tile(np.array(self.unseen, np.float32), (len(key), 1))
        at = words.mix(key)
        order = np.argsort(at)
        at = at[order]
        number = (at >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(at), np.int64)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        for i, j in zip(first, np.append(first[1:], len(at)), strict=True):
            if int(number[i]) in self.shards:
                places, values = self.shards[int(number[i])]
                p = np.minimum(np.searchsorted(places, at[i:j]), len(places) - 1)
                there = places[p] == at[i:j]
                out[order[i:j][there]] = values[p[there]]
        return out


@lru_cache(maxsize=1)
def model(path: str, bits: int) -> list[tuple[Table, Table]]:
    """The orders' tables of strings and contexts, memory-mapped where the folder is local."""
    few, there = json.loads(store.mapped(path).read())
    out = [(Table(few, {}, (0, 0)), Table(few, {}, (0, 0, 1, 1))) for _ in range(ORDER)]
    for order, kind, number in there:
        raw, width = store.mapped(shard(path, order, kind, number)).read_buffer(), 4 if kind else 2
        n = raw.size // (8 + 4 * width)
        out[order - 1][kind].shards[number] = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.float32, offset=8 * n).reshape(n, width)
    return out


def evidence(key: np.ndarray, m: list[tuple[Table, Table]], bits: int) -> np.ndarray:
    """log P(byte | before, toxic) - log P(byte | before, ordinary)."""
    p = np.full((len(key), 2), 1 / 256, np.float32)
    for k, (strings, contexts) in enumerate(m, 1):
        own = key & np.uint64((1 << (8 * k)) - 1)
        count, ctx = strings(own), contexts(own >> np.uint64(8))
        p = count * ctx[:, :2] + ctx[:, 2:] * p
    p = np.log(np.maximum(p, 1e-12))
    return (p[:, 0] - p[:, 1]).astype(np.float64)


def features(texts: pa.Array, m: list[tuple[Table, Table]], bits: int) -> np.ndarray:
    """For each text: the highest evidence of a passage, and of the whole, each over its length."""
    doc, value, size = [], [], []
    for c in words.cut(texts, size=SLICE):
        if not len(c.starts):
            continue
        code, first = words.coded(c)
        key, n = packed(c.raw, c.starts[first], c.ends[first] - c.starts[first])
        kinds, kind = np.unique(key, return_inverse=True)  # words share most of their strings
        own = np.add.reduceat(evidence(kinds, m, bits)[kind], np.cumsum(n) - n)
        doc.append(c.docs)
        value.append(own[code])
        size.append((c.ends - c.starts + 1).astype(float))
    out = np.zeros((len(texts), 2))
    if not doc:
        return out
    doc, value, size = np.concatenate(doc), np.concatenate(value), np.concatenate(size)
    v, s = np.concatenate([[0.0], np.cumsum(value)]), np.concatenate([[0.0], np.cumsum(size)])
    counts = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    some = np.flatnonzero(counts)
    passages = np.maximum(1, -(-(counts[some] - PASSAGE) // STRIDE) + 1)
    a = np.repeat(begin[some], passages) + STRIDE * (ragged(np.zeros(len(some), np.int64), passages))
    b = np.minimum(a + PASSAGE, np.repeat((begin + counts)[some], passages))
    each = (v[b] - v[a]) / (s[b] - s[a] + SOFTEN)
    out[some, 0] = np.maximum.reduceat(each, np.cumsum(passages) - passages)
    out[some, 1] = (v[(begin + counts)[some]] - v[begin[some]]) / (s[(begin + counts)[some]] - s[begin[some]] + SOFTEN)
    return out


def measured(df: DataFrame, path: str, bits: int) -> DataFrame:
    """All columns but the text, with the two features."""
    rest = [f for f in df.schema.fields if f.name != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, bits)
        for whole in batches:
            for b in words.by_size(whole, b_text, SLICE):
                x = features(b.column(b_text), m, bits)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                                 [*(f.name for f in rest), "highest", "mean"])

    b_text = df.columns.index("text")
    others = [i for i, c in enumerate(df.columns) if c != "text"]
    return df.mapInArrow(task, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "highest double", "mean double"]))


#: On x = (highest, mean, 1) where there is nothing to fit.
FIXED = (20.0, 0.0, -2.0)


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        return FIXED
    spread = x.std(axis=0) + 1e-9
    z, w = np.column_stack([x / spread, np.ones(len(x))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.diag([1, 1, 1e-6]) + 1e-9 * np.eye(3),
                               z.T @ (y - p) - ridge * len(y) * np.array([w[0], w[1], 0]))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return (*(w[:2] / spread).tolist(), float(w[2]))


def score(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
          bits: int = SLOTS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df, and the two features."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = (labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
             .where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    small = labels.count() <= BROADCAST_ROWS
    counted = lambda d: d.where(~fold(F.col("doc_id")).isin(0, FOLD - 1))
    known = counted(docs).join(F.broadcast(counted(marks)) if small else counted(marks), "doc_id")
    path = fit_counts(known, store.folder(spark, "toxicity") + "/tables", bits=bits)
    chosen = marks.where(fold(F.col("doc_id")) == FOLD - 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    fresh = docs.join(F.broadcast(chosen), "doc_id")
    rows = measured(fresh.select("text", "toxic"), path, bits).toPandas()
    a, b, c = fit_scale(rows[["highest", "mean"]].to_numpy(), rows["toxic"].to_numpy().astype(float))
    linear = F.lit(a) * F.col("highest") + F.lit(b) * F.col("mean") + F.lit(c)
    return (measured(docs, path, bits)
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"), "highest", "mean")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
