"""Exact removal of repeated byte strings: suffix arrays by induced sorting, over the shards that can hold repeats.

A string of `LENGTH` bytes that starts twice has the same lowest-ranked `GRAM`-byte gram in both places. So each
start p is given to the anchor of its string (the leftmost gram of lowest hash), starts with one anchor form a run, and
a run's context is all bytes its strings reach. Runs whose anchor hash is found once cannot repeat and are dropped; a
context found twice repeats whole. What is left are different contexts around one anchor: they are gathered by anchor
into shards of bounded size and trimmed to where they agree with any other one around the anchor. Each shard's suffix
array is built by induced sorting (suffixes are classified, the leftmost-smaller substrings are sorted and named, and
their order found recursively, the rest is induced in linear scans), and a start
repeats if the permuted common prefix of its suffix and a neighbour's reaches `LENGTH`. Anchors with more than
`HOT` different contexts are split further: each start is a key of its own there, its string's 128-bit hash.

A run's starts are its own only, so no place is ever compared with itself. Texts move once (those that have a repeated
anchor); all else that moves is about 30 bytes for each run, some 170 starts.

Defined cases: a null text is empty; texts under `LENGTH` bytes lose nothing; a string may repeat within one
document, overlapping itself; equal rows repeat each other; a null id is kept as it is; an empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words
from .pieces import flat_bytes, ragged

LENGTH, GRAM = 400, 64
#: Bytes of a shard, and contexts of an anchor from which it is split by start.
SHARD, HOT = 1 << 20, 2000
#: Bytes of one text whose runs are found at a time.
SEGMENT = 1 << 22
_PLACE = 24


# Runs

def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First start and number of starts of each run, hash of its anchor and of its context, and the anchor's place
    in the context."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    at = np.arange(len(raw) - gram + 1)
    gram_hash = words.substring_hashes(raw, at, at + gram)
    place = np.uint64((1 << _PLACE) - 1)
    anchor = (lowest(gram_hash & ~place | at.astype(np.uint64), length - gram + 1) & place).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    n = np.diff(np.append(first, len(anchor)))
    context = words.substring_hashes(raw, first, first + n + length - 1)
    return first, n, gram_hash[anchor[first]].view(np.int64), context.view(np.int64), anchor[first] - first


def found_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(uid, text) to the runs of every text: anchor, context, uid, lo, n, at."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.by_size(whole, 1):
                raw, off = flat_bytes(b.column(1))
                uid, out = b.column(0).to_numpy(), []
                for d in range(b.num_rows):
                    for s in range(int(off[d]), max(int(off[d]) + 1, int(off[d + 1]) - length + 1), SEGMENT):
                        lo, n, anchor, context, at = runs(raw[s:min(int(off[d + 1]), s + SEGMENT + length - 1)], length, gram)
                        if len(lo):
                            out.append((anchor, context, np.full(len(lo), uid[d]), lo + s - off[d], n, at))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                     ["anchor", "context", "uid", "lo", "n", "at"])

    return docs.mapInArrow(task, "anchor long, context long, uid long, lo long, n long, at long")


# Suffix arrays

def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the only lowest."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]  # the last of a row of equal symbols
    after = np.append(s[1:], -1)
    out = s[nearest] < after[nearest]
    out[-1] = True
    return out


def _induce(s: list[int], small: list[bool], order: list[int], counts: np.ndarray) -> list[int]:
    """All suffixes in order, from the leftmost-smaller ones in order."""
    n = len(s)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    sa = [-1] * n
    for p in reversed(order):
        c = s[p]
        tails[c] -= 1
        sa[tails[c]] = p
    for i in range(n):  # larger suffixes, in passing from the left
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = s[p]
            sa[heads[c]] = p
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):  # smaller ones, from the right
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = s[p]
            tails[c] -= 1
            sa[tails[c]] = p
    return sa


def substring_names(s: np.ndarray, small: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Dense ranks of the leftmost-smaller substrings (each up to the next one's start), in text order.

    A symbol and its type are one code; codes are compared a few at a time, and only substrings still equal to
    another go on. Equal codes end at the same place, so no substring is a prefix of another.
    """
    ends, code = np.append(left[1:], len(s) - 1), 2 * s + small
    bits = int(code.max()).bit_length()
    per, rank, done = max(1, 62 // bits), np.zeros(len(left), np.int64), 0
    active = np.arange(len(left))
    while len(active):
        key = np.zeros(len(active), np.int64)
        for q in range(done, done + per):
            at = left[active] + q
            key = key << bits | np.where(at <= ends[active], code[np.minimum(at, len(s) - 1)], 0)
        order = np.lexsort((key, rank[active]))
        r, k, i = rank[active][order], key[order], np.arange(len(order))
        new_class = np.append(True, r[1:] != r[:-1])
        new = new_class | np.append(True, k[1:] != k[:-1])
        rank[active[order]] = r + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(new_class, i, 0))
        alone = new & np.append(new[1:], True)
        done += per
        rest = active[order[~alone]]
        active = rest[left[rest] + done <= ends[rest]]
    count = np.zeros(len(left) + 1, np.int64)
    count[rank + 1] = 1
    return np.cumsum(count)[rank]


def suffix_array(s: np.ndarray) -> list[int]:
    """Suffix array of small whole numbers, the last of which is 0 and the only 0."""
    if len(s) == 1:
        return [0]
    small = smaller_types(s)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = substring_names(s, small, left)
    if names.max() + 1 < len(left):
        order = left[suffix_array(names)]
    else:
        order = left[np.argsort(names)]
    return _induce(s.tolist(), small.tolist(), order.tolist(), np.bincount(s))


def alike(strings: list[bytes]) -> list[int]:
    """The longest prefix that each string shares with another one."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:]):
        a, b = strings[i], strings[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid - 1
        out[i], out[j] = max(out[i], low), max(out[j], low)
    return out


def trimmed(contexts: list[bytes], anchors: list[int], gram: int, length: int) -> list[tuple[int, int]]:
    """Of contexts around one anchor gram (at anchors[i]), the parts that can hold repeats: as far as a context
    agrees with any other one to the left and to the right. (0, 0) where that is too short."""
    left = alike([c[:a][::-1] for c, a in zip(contexts, anchors, strict=True)])
    right = alike([c[a + gram:] for c, a in zip(contexts, anchors, strict=True)])
    return [(a - x, a + gram + y) if x + gram + y >= length else (0, 0) for a, x, y in zip(anchors, left, right, strict=True)]


def repeated(contexts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its first starts[i] strings of `length` bytes also start elsewhere in the shard."""
    joined = b"".join(contexts)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(size + 1) - size - 1
    s = np.full(int(size.sum()) + len(contexts) + 1, 1, np.int64)  # 1 parts contexts, 0 ends the shard
    s[ragged(begin, size)] = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    s[-1] = 0
    sa = np.asarray(suffix_array(s))
    before = np.empty(len(s), np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    text = b"\0".join(contexts) + b"\0\0"
    own = np.zeros(len(s), bool)
    own[ragged(begin, np.asarray(starts, np.int64))] = True
    hit = np.zeros(len(s), bool)
    common = 0
    neighbour = before.tolist()
    for p in np.flatnonzero(own).tolist():  # a common prefix shrinks by one at most from a start to the next
        q = neighbour[p]
        common = max(0, common - 1) if p and own[p - 1] else 0
        if q < 0 or not own[q]:
            common = 0
            continue
        if common < length:
            if text[p + common:p + length] == text[q + common:q + length]:
                common = length
            else:
                while common < length and text[p + common] == text[q + common]:
                    common += 1
        if common >= length:
            hit[p] = hit[q] = True
    return [hit[b:b + n] for b, n in zip(begin.tolist(), starts, strict=True)]


def ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each row of hits."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


FOUND = "anchor long, context long, covered array<struct<a: long, b: long>>"


def by_suffix_arrays(parts: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """(anchor, context, times, n, at, bytes) to the repeated starts of contexts that are there once."""
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("anchor", ignore_index=True)
        edge = np.flatnonzero(np.append(True, pdf["anchor"].to_numpy()[1:] != pdf["anchor"].to_numpy()[:-1])).tolist() + [len(pdf)]
        raw, at = pdf["bytes"].tolist(), pdf["at"].tolist()
        part = [x for i, j in zip(edge, edge[1:]) for x in trimmed(raw[i:j], at[i:j], gram, length)]
        some = [i for i, (x, y) in enumerate(part) if y]
        hits = repeated([raw[i][slice(*part[i])] for i in some], [part[i][1] - part[i][0] - length + 1 for i in some], length) if some else []
        rows = [(pdf["anchor"][i], pdf["context"][i], [{"a": part[i][0] + x, "b": part[i][0] + y} for x, y in ranges(h)])
                for i, h in zip(some, hits, strict=True) if pdf["times"][i] == 1 and h.any()]
        return pd.DataFrame(rows, columns=["anchor", "context", "covered"])

    return parts.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(task, FOUND)


def by_starts(parts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: each start's string is a key."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw, at = np.frombuffer(r["bytes"], np.uint8), np.arange(r["n"])
                h = [words.substring_hashes(x, at, at + length).view(np.int64) for x in (raw, raw[::-1].copy())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(r["n"], r[c])) for c in ("anchor", "context", "times")] + [pa.array(h[0]), pa.array(h[1][::-1] if len(raw) == r["n"] + length - 1 else h[1]), pa.array(at)],
                    ["anchor", "context", "times", "h1", "h2", "at"])

    each = store.kept(parts.mapInArrow(task, "anchor long, context long, times long, h1 long, h2 long, at long"), "repeat-starts")
    twice = each.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    hit = each.where("times = 1").join(twice, ["anchor", "h1", "h2"])
    return hit.select("anchor", "context", F.struct(F.col("at").alias("a"), F.col("at").alias("b")).alias("x")).groupBy("anchor", "context").agg(F.collect_list("x").alias("covered"))


def with_uid(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("uid"), "doc_id", "text")


def repeats(docs: DataFrame, length: int, gram: int, shard: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(uid, text) to the texts with a repeated anchor, and their covered ranges of starts (uid, lo, covered)."""
    all_runs = store.kept(found_runs(docs.select("uid", "text"), length, gram), "repeat-runs")
    # Counts are written before they are joined: both sides of the join are then plain shuffles, whose hot anchors
    # adaptive execution can split.
    twice = store.kept(all_runs.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "repeat-twice")
    again = store.kept(all_runs.join(twice, "anchor"), "repeat-again")
    kinds = store.kept(again.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("uid", "lo", "n", "at")).alias("one")), "repeat-kinds")
    mixed = store.kept(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest")).where("kinds > 1 and fewest = 1"), "repeat-mixed")
    asked = (kinds.join(mixed, "anchor").select("one.uid", F.struct("anchor", "context", "times", "kinds", F.col("one.lo").alias("lo"), F.col("one.n").alias("n"), F.col("one.at").alias("at")).alias("ask"))
             .groupBy("uid").agg(F.collect_list("ask").alias("asks")))
    needed = again.groupBy("uid").agg(F.count("*").alias("k")).join(asked, "uid", "left").select("uid", "asks")
    texts = store.kept(docs.select("uid", "text").join(needed, "uid"), "repeat-texts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw = r["text"].encode()
                rows = {(a["anchor"], a["context"]): (a["times"], a["kinds"], a["n"], a["at"], raw[a["lo"]:a["lo"] + a["n"] + length - 1]) for a in r["asks"]}
                cols = list(zip(*((*k, *v) for k, v in rows.items()), strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())],
                                                 ["anchor", "context", "times", "kinds", "n", "at", "bytes"])

    parts = store.kept(texts.where("asks is not null").select("text", "asks").mapInArrow(
        task, "anchor long, context long, times long, kinds long, n long, at long, bytes binary").dropDuplicates(["anchor", "context"]), "repeat-parts")
    plain, split = parts.where(F.col("kinds") <= hot), parts.where(F.col("kinds") > hot)
    total = plain.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    covered = (kinds.where("times > 1").select("anchor", "context", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("one.n") - 1).alias("b"))).alias("covered"))
               .unionByName(by_suffix_arrays(plain.drop("kinds"), max(1, -(-total // shard)), length, gram))
               .unionByName(by_starts(split.drop("kinds"), length)))
    return texts.select("uid", "text"), again.join(covered, ["anchor", "context"]).select("uid", "lo", "covered")


def remove(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
           shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""
    docs = with_uid(df, key, text)
    texts, covered = repeats(docs, length, gram, shard, hot)
    per_text = (covered.select("uid", F.transform("covered", lambda x: F.struct((F.col("lo") + x["a"]).alias("a"), (F.col("lo") + x["b"] + length).alias("b"))).alias("spans"))
                .groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw = r["text"].encode()
                rest, removed, n = cut_out(raw, sorted((x["a"], x["b"]) for x in r["spans"]))
                out.append((r["uid"], removed, n, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             ["uid", "removed", "n", "sha"])

    done = texts.join(per_text, "uid").mapInArrow(task, "uid long, removed long, n long, sha string").dropDuplicates(["uid"])
    whole = docs.select("uid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("whole_sha"))
    return whole.join(done, "uid", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha", "whole_sha").alias("kept_sha256"))


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans (sorted; they may overlap), the bytes removed, and the removed runs."""
    rest, end, removed, n = [], 0, 0, 0
    for a, b in spans:
        if a > end or not n:
            rest.append(raw[end:a])
            n += 1
        a = max(a, end)
        if b > a:
            removed += b - a
            end = b
    return b"".join([*rest, raw[end:]]), removed, n
