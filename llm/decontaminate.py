"""Benchmark decontamination by latent semantic retrieval.

The terms are the words of the benchmark. Documents become sequences of term numbers (0: not a term), written once.
Inverse document frequencies count the passages of all documents. The benchmark's passages, weighted by them, are a
matrix whose singular vectors come from a distributed randomised range finder: each task multiplies its passages
with a shared thin matrix and only sums of term rows travel. Every passage of every document (`PASSAGE` words, half
overlapping) is projected with them; a passage is a candidate for an item if the cosine of the two reaches `COSINE`
and enough of its weight lies in the latent space. A space of `RANK` directions keeps little of a passage once the
benchmark has more passages than that, so rare terms give candidates too, and they miss none: whoever covers
`OVERLAP` of an item covers a known number of its rarest words (`postings`), and every stretch of a document that has
so many of them is a candidate. A candidate is confirmed if the longest common
subsequence of the item and the words around the passage covers `OVERLAP` of the item, the covered terms hold
`MASS` of its weight, and the answer (what follows "Answer:" or "A:", else the item's last third) is covered too.

The benchmark is worked through in blocks of `BLOCK` items, so what tasks hold has a fixed bound; the documents'
side is never grouped or shuffled.

Defined cases: null texts are empty; an item without words is in nothing; items with equal texts are found alike;
a document that comes twice is reported twice; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words
from .pieces import ragged

PASSAGE, RANK, EXTRA, ROUNDS = 32, 256, 16, 2
COSINE, ENERGY = 0.45, 0.15
OVERLAP, MASS = 0.6, 0.55
BLOCK = 2000
ANSWER = re.compile(r"(?:^|\W)(?:answer|a)\s*:", re.IGNORECASE)


class Latent(NamedTuple):
    terms: np.ndarray     # sorted hashes of the terms; term i has number i + 1
    weight: np.ndarray    # by number; 0 has the weight of a term found nowhere
    vectors: np.ndarray   # terms to latent space, by number
    items: list           # (item_id, numbers, first number of the answer)
    owner: np.ndarray     # of each benchmark passage, its item
    passages: np.ndarray  # latent vectors of length 1
    begin: np.ndarray     # of each number's items in holders, with the end
    holders: np.ndarray   # the items that have a number among their rarest words
    least: np.ndarray     # of each item, how many of its rarest words a leak covers


def numbers(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at + 1, 0).astype(np.int32)


class Lookup:
    """Numbers of hashes by one table read; most words are no term and end there."""

    def __init__(self, terms: np.ndarray, bits: int = 18):
        self.terms, self.shift = terms, np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[(terms >> self.shift).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.some[(hashes >> self.shift).astype(np.int64)])
        out[maybe] = numbers(hashes[maybe], self.terms)
        return out


def windows(n: int, size: int = PASSAGE) -> list[tuple[int, int]]:
    """Half overlapping passages of an item."""
    step = size // 2
    return [(a, min(n, a + size)) for a in range(0, max(1, n - step), step)] if n else []


@lru_cache(maxsize=2)
def loaded(path: str):
    return pickle.loads(store.mapped(path).read())


def saved(value, path: str) -> str:
    store.publish(path, [pickle.dumps(value, protocol=5)])
    return path


# The documents as term numbers

def streams(docs: DataFrame, path: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(loaded(path))
        for whole in batches:
            for b in words.by_size(whole, 1):
                h, off = words.hashes(b.column(1))
                x = look(h)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(x)])],
                    ["doc_id", "terms"])

    return docs.mapInArrow(task, "doc_id long, terms binary")


def half_passages(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a batch; the half passage each is in; how many half passages each document has."""
    half = PASSAGE // 2
    data = b.column(1)
    off = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
    raw = data.buffers()[2]
    x = np.frombuffer(raw, np.int32)[off[0] // 4:off[-1] // 4] if raw is not None else np.zeros(0, np.int32)
    n = np.diff(off) // 4
    halves = -(-n // half)
    first = np.cumsum(halves) - halves
    return x, np.repeat(first, n) + ragged(np.zeros(len(n), np.int64), n) // half, halves


def frequencies(stream: DataFrame, size: int) -> np.ndarray:
    """In how many half passages each number stands; at 0 the number of half passages."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                x, where, halves = half_passages(whole.slice(i, 500))
                own = x > 0
                pair = np.sort(where[own] * (size + 1) + x[own])
                total += np.bincount(pair[np.diff(pair, prepend=-1) > 0] % (size + 1), minlength=size + 1)
                total[0] += halves.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    rows = stream.mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[rows["term"]] = rows["n"]
    return out


# Rare terms

def needed(n: int) -> int:
    """The fewest of n words that reach OVERLAP."""
    return next(c for c in range(int(OVERLAP * n), n + 1) if c / n >= OVERLAP)


def postings(items: list[tuple], df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, holders and least of Latent. Of the n - needed + k rarest words of an item, any `needed` of its n words
    hold at least k."""
    pairs, least = [np.zeros((0, 2), np.int64)], np.zeros(len(items), np.int64)
    for i, (_, x, _) in enumerate(items):
        need = needed(len(x))
        least[i] = max(1, need // 3)
        rare = np.unique(x[np.argsort(df[x], kind="stable")[:len(x) - need + least[i]]])
        pairs.append(np.stack([rare, np.full(len(rare), i)], axis=1))
    both = np.concatenate(pairs)
    both = both[np.argsort(both[:, 0], kind="stable")]
    return np.searchsorted(both[:, 0], np.arange(len(df) + 1)), both[:, 1], least


# The latent space

def weighted(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's terms and their weights: term frequency by inverse document frequency."""
    t, n = np.unique(x[x > 0], return_counts=True)
    return t, n * weight[t]


#: Rows of a partial sum that travel together.
CHUNK = 256


def summed(matrix: DataFrame, path: str, gram: bool) -> np.ndarray:
    """Sum over all passages of A' (A Q), or of (A Q)' (A Q) if gram; Q is the file at path."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = loaded(path)
        out = np.zeros((q.shape[1] if gram else len(q), q.shape[1]))
        for b in batches:
            for r in b.to_pylist():
                t, w = np.asarray(r["terms"], np.int64), np.asarray(r["weights"])
                y = w @ q[t]
                if gram:
                    out += np.outer(y, y)
                else:
                    out[t] += np.outer(w, y)
        some = [i for i in range(0, len(out), CHUNK) if out[i:i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([out[i:i + CHUNK].tobytes() for i in some], pa.binary())], ["first", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in pdf["part"])
        return pdf.head(1).assign(part=[total.tobytes()])

    height, width = loaded(path).shape
    out = np.zeros((width if gram else height, width))
    rows = matrix.mapInArrow(task, "first long, part binary").groupBy("first").applyInPandas(add, "first long, part binary")
    for r in rows.collect():
        out[r["first"]:r["first"] + CHUNK] = np.frombuffer(r["part"], np.float64).reshape(-1, width)
    return out


def singular_vectors(matrix: DataFrame, size: int, folder: str, rank: int) -> np.ndarray:
    """Right singular vectors of the passages (terms, weights): randomised range finder, then a small problem."""
    q = np.random.default_rng(3).standard_normal((size + 1, rank + EXTRA))
    q[0] = 0
    for i in range(ROUNDS):
        q, _ = np.linalg.qr(summed(matrix, saved(q, f"{folder}/range-{i}"), False))
    value, vector = np.linalg.eigh(summed(matrix, saved(q, f"{folder}/range-{ROUNDS}"), True))
    keep = np.argsort(-value)[:rank]
    return q @ vector[:, keep[value[keep] > 1e-9 * max(value.max(), 1e-300)]]


def fit(items: list[tuple], terms: np.ndarray, df: np.ndarray, docs: DataFrame, folder: str, rank: int) -> Latent:
    spark = docs.sparkSession
    weight = np.log((df[0] + 2) / (np.concatenate([[0], df[1:]]) + 1.0))
    rows, owner = [], []
    for i, (_, x, _) in enumerate(items):
        for a, b in windows(len(x)):
            t, w = weighted(x[a:b], weight)
            rows.append((t.tolist(), w.tolist()))
            owner.append(i)
    rare = postings(items, df)
    if not rows:
        return Latent(terms, weight.astype(np.float32), np.zeros((len(weight), 1), np.float32), items, np.zeros(0, np.int64), np.zeros((0, 1), np.float32), *rare)
    matrix = spark.createDataFrame(rows, "terms array<long>, weights array<double>").repartition(max(1, len(rows) // 128))
    v = singular_vectors(matrix, len(terms), folder, min(rank, len(rows)))
    p = np.stack([np.asarray(w) @ v[t] for t, w in rows])
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return Latent(terms, weight.astype(np.float32), (weight[:, None] * v).astype(np.float32), items, np.asarray(owner), p.astype(np.float32), *rare)


# The search

def common(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words of the item are on a longest common subsequence with the text, by bit-parallel rows traced back."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        if x:
            where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row, rows, hits = full, [], []
    for x in text.tolist():
        hit = where.get(x, 0)
        if hit:
            rows.append(row)
            hits.append(hit)
            u = row & hit
            row = (row + u | row - u) & full
    found = np.zeros(len(item), bool)
    length = lambda r, i: (~r & ((1 << i) - 1)).bit_count()  # noqa: E731  of the subsequence with the first i words
    i = len(item)
    for before, hit in zip(reversed(rows), reversed(hits), strict=True):
        while i and length(row, i) == length(row, i - 1):
            i -= 1
        if not i:
            break
        if length(before, i) < length(row, i) and hit >> (i - 1) & 1:
            found[i - 1] = True
            i -= 1
        row = before
    return found


def confirmed(item: tuple, text: np.ndarray, weight: np.ndarray) -> tuple[float, float] | None:
    _, x, answer = item
    on = common(x, text)
    mass = float(weight[x[on]].sum() / max(weight[x].sum(), 1e-9))
    if on.mean() >= OVERLAP and mass >= MASS and on[answer:].mean() >= OVERLAP:
        return float(on.mean()), float(on[answer:].mean())
    return None


def search(stream: DataFrame, path: str, key: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Latent = loaded(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                b = whole.slice(i, 250)
                rows = found(m, *half_passages(b), b.column(0).to_pylist())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "cosine", "overlap", "answer"])

    return stream.mapInArrow(task, "doc_id long, item_id long, cosine double, overlap double, answer double")


def found(m: Latent, x: np.ndarray, where: np.ndarray, halves: np.ndarray, ids: list) -> list[tuple]:
    total = int(halves.sum())
    if not total or not len(m.passages):
        return []
    half = PASSAGE // 2
    mass = np.bincount(where, weights=m.weight[x].astype(float) ** 2, minlength=total)
    own = np.flatnonzero(x > 0)
    z = np.zeros((total, m.vectors.shape[1]), np.float32)
    if len(own):
        at = np.flatnonzero(np.diff(where[own], prepend=-1))
        for i in range(0, len(at), 4096):  # so that gathered rows stay few
            lo, hi = at[i], at[i + 4096] if i + 4096 < len(at) else len(own)
            z[where[own[at[i:i + 4096]]]] = np.add.reduceat(m.vectors[x[own[lo:hi]]], at[i:i + 4096] - lo, axis=0)
    first = np.cumsum(halves) - halves
    last = np.zeros(total, bool)
    last[(first + halves - 1)[halves > 0]] = True
    whole, weight = z.copy(), mass.copy()
    whole[:-1] += z[1:] * ~last[:-1, None]
    weight[:-1] += mass[1:] * ~last[:-1]
    inside = np.einsum("ij,ij->i", whole, whole)
    some = np.flatnonzero(inside >= ENERGY * np.maximum(weight, 1e-9))
    out: dict[tuple, tuple] = {}
    words_of = np.cumsum(np.bincount(where, minlength=total)) - np.bincount(where, minlength=total)
    doc = np.repeat(np.arange(len(halves)), halves)
    begin = np.append(words_of[first[halves > 0]], len(x))
    doc_begin, doc_end = np.zeros(len(halves), np.int64), np.zeros(len(halves), np.int64)
    doc_begin[halves > 0], doc_end[halves > 0] = begin[:-1], begin[1:]
    tried = set()
    for i in range(0, len(some), 8192):
        part = some[i:i + 8192]
        cosine = (whole[part] / np.sqrt(inside[part])[:, None]) @ m.passages.T
        for p, j in zip(*np.nonzero(cosine >= COSINE), strict=True):
            d, k = int(doc[part[p]]), int(m.owner[j])
            if (d, k) in out or (int(part[p]), k) in tried:
                continue
            tried.add((int(part[p]), k))
            a, n = int(words_of[part[p]]), len(m.items[k][1])
            text = x[max(doc_begin[d], a - n):min(doc_end[d], a + PASSAGE + n)]
            got = confirmed(m.items[k], text, m.weight)
            if got:
                out[d, k] = (ids[d], m.items[k][0], float(cosine[p, j]), *got)
    seen = np.zeros(len(m.weight), bool)
    for d, k, h in stretches(m, x, doc[where], doc_begin, halves):
        p = int(first[d]) + h
        if (d, k) in out or (p, k) in tried:
            continue
        a, item = int(doc_begin[d]) + half * h, m.items[k][1]
        text = x[max(doc_begin[d], a - len(item)):min(doc_end[d], a + PASSAGE + len(item))]
        seen[text] = True
        enough = seen[item].mean() >= OVERLAP
        seen[text] = False
        got = confirmed(m.items[k], text, m.weight) if enough else None
        if got:
            best = (m.passages[m.owner == k] @ whole[p]).max() / max(float(np.sqrt(inside[p])), 1e-9)
            out[d, k] = (ids[d], m.items[k][0], float(best), *got)
    return list(out.values())


#: Pairs of a word and an item that are sorted together, unless one document has more.
PAIRS = 1 << 21


def stretches(m: Latent, x: np.ndarray, doc: np.ndarray, doc_begin: np.ndarray, halves: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, item, half passage): where the words around a passage hold enough of the item's rarest words."""
    half, size = PASSAGE // 2, np.array([len(i[1]) for i in m.items], np.int64)
    n = m.begin[x + 1] - m.begin[x]
    own = np.flatnonzero(n)
    before = np.concatenate([[0], np.cumsum(n[own])])
    ends = np.append(np.flatnonzero(np.diff(doc[own])) + 1, len(own))  # between documents
    lo = 0
    while lo < len(own):
        hi = int(ends[max(np.searchsorted(before[ends], before[lo] + PAIRS, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
        w = own[lo:hi]
        at, item = np.repeat(w, n[w]), m.holders[ragged(m.begin[x[w]], n[w])]
        key = doc[at] * len(m.items) + item
        order = np.argsort(key, kind="stable")
        at, item, key = at[order], item[order], key[order]
        j = np.minimum(np.arange(len(key)) + m.least[item] - 1, len(key) - 1)
        enough = (np.arange(len(key)) + m.least[item] <= len(key)) & (key[j] == key) & (at[j] - at < PASSAGE + 2 * size[item])
        i = np.flatnonzero(enough)
        d, k = doc[at[i]], item[i]
        a, b = at[i] - doc_begin[d], at[j[i]] - doc_begin[d]
        low, high = np.maximum(0, (b - PASSAGE - size[k]) // half + 1), np.minimum(halves[d] - 1, (a + size[k]) // half)
        n_h = np.maximum(0, high - low + 1)
        most = int(halves.max(initial=0)) + 1
        found = np.unique((np.repeat(d, n_h) * len(m.items) + np.repeat(k, n_h)) * most + ragged(low, n_h))
        pair, h = np.divmod(found, most)
        yield from zip((pair // len(m.items)).tolist(), (pair % len(m.items)).tolist(), h.tolist(), strict=True)
        lo = hi


def leaks(df: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", rank: int = RANK, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, cosine and the covered shares of item and answer, for each item found in a document."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    blocks, out = max(1, -(-items.count() // block)), None
    for i in range(blocks):
        folder = store.folder(spark, f"benchmark-{i}")
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        h, off = words.hashes(pa.array([r["text"] for r in rows], pa.string()))
        terms = np.unique(h)
        kept = []
        for r, a, b in zip(rows, off[:-1], off[1:], strict=True):
            if b > a:
                mark = max((x.end() for x in ANSWER.finditer(r["text"])), default=None)
                n = int(words.hashes(pa.array([r["text"][:mark]]))[1][-1]) if mark else b - a
                kept.append((r["item_id"], numbers(h[a:b], terms), n if n < b - a else int((b - a) * 2 // 3)))
        stream = store.kept(streams(docs, saved(terms, f"{folder}/terms")), "benchmark-terms")
        latent = fit(kept, terms, frequencies(stream, len(terms)), docs, folder, rank)
        hits = search(stream, saved(latent, f"{folder}/latent"), key)
        out = hits if out is None else out.unionAll(hits)
    return out
