"""Near-duplicate documents by Order MinHash.

A text is a sequence of words; its k-mers are its five-word shingles, and a repeated shingle carries the number of its
occurrence. For each of `BANDS` hash functions the `KEPT` smallest shingles are taken and put back into text order: two
texts agree on such a key with a probability near the power `KEPT` of their shared shingles, less if the order
differs. Texts of up to `SHORT` words, where one edit hits most shingles, have further keys of one shingle each. Texts
with equal words are one class from the start and go on as one. Each text is compared with the first of all texts that
share a key with it by a banded alignment of their words: similarity is the number of aligned words over all
words of both, each aligned pair counted once, and `SIMILARITY` or more is a link. The band is as wide as any alignment
of that similarity can stray, so it loses none. Keys whose texts are not one component by then may hold more links.
Each text has a bag: its words counted in `BAG` slots
by their hash. Slots shared by two bags bound their aligned words from above, so only pairs whose bags reach the
similarity are aligned: first each text with the `CLOSEST` ones, which have most keys in common with it, then, once these
links have joined components, all pairs that are still apart. Bags instead of texts meet (`close`): of keys with up to
`BUCKET` texts all pairs, of larger ones those that share one of their rarest words (of up to `SHORT` words) or word pairs. That filter is exact: a text of
n words has at least s n words, and (2 s - 1) n - 1 word pairs, in common with any text of similarity s, so both have one
of these among their rarest others plus one. So every two texts with a common key that reach the similarity end in one
class. Classes are the connected components of the links, found by alternating large-star and small-star steps in
written tables.

At similarity 0.8 by scattered single-word edits two texts still share some 0.39 of their shingles: all 32 keys of 2
miss such a pair with a probability near 0.006; at 0.9 (0.6 of the shingles) near 1e-6.

Defined cases: a null text is empty; texts without words are equal to each other; texts under five words have
one shingle, all their words; equal texts are always one class; a class's id is its smallest document id; a document
id that comes twice is one document of two texts, and its class joins both; null ids take no part; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, KEPT, SHORT = 32, 2, 64
#: Texts of a key up to which the bags of all their pairs are compared; and texts of one block of a comparison.
BUCKET, BLOCK = 4096, 1024
#: Texts of other components with which each text is aligned before all close pairs are.
CLOSEST = 4
#: Slots of a bag of words; texts that a group of comparisons holds on average.
BAG, GROUP = 256, 8192
#: Keys of a text by which a pair that shares several is compared once.
LISTED = 64
#: Bits of the filter that keeps texts of no pair out of a shuffle.
BITS = 1 << 24
#: Shingles hashed by all functions at a time.
CHUNK = 1 << 15
_RNG = np.random.default_rng(8)
_SEED, _ODD = _RNG.integers(1, 1 << 63, (2, 256), np.uint64)
_ODD = _ODD | np.uint64(1)


def _chain(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros_like(columns[0])
    with np.errstate(over="ignore"):
        for c in columns:
            h = words.mix(h * np.uint64(31) + c)
    return h


def shingles(tokens: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in order."""
    if not len(tokens):
        return tokens
    n = min(size, len(tokens))
    return _chain([tokens[i:len(tokens) - n + 1 + i] for i in range(n)])


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Shingles told apart by the number of the occurrence."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return hashes
    run = np.flatnonzero(np.append(True, ~same))
    nth = np.empty(len(s), np.uint64)
    nth[order] = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
    return np.where(nth > 0, words.mix(hashes ^ words.mix(nth)), hashes)


def sketch(hashes: np.ndarray, bands: int = BANDS, kept: int = KEPT) -> np.ndarray:
    """One key for each band: its smallest labelled shingles in text order."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    x, at = labelled(hashes), None
    with np.errstate(over="ignore"):
        for i in range(0, len(x), CHUNK):
            part = np.broadcast_to(np.arange(i, min(i + CHUNK, len(x))), (bands, min(CHUNK, len(x) - i)))
            at = part if at is None else np.concatenate([at, part], axis=1)
            if at.shape[1] > kept:
                rank = (x[at] ^ _SEED[:bands, None]) * _ODD[:bands, None]
                at = np.take_along_axis(at, np.argpartition(rank, kept - 1, axis=1)[:, :kept], axis=1)
    at = np.sort(at, axis=1)
    return _chain([_SEED[:bands] ^ np.uint64(kept), *(x[at[:, j]] for j in range(at.shape[1]))]).astype(np.int64)


def keys(tokens: np.ndarray) -> np.ndarray:
    own = shingles(tokens)
    return np.concatenate([sketch(own), sketch(own, kept=1)]) if 0 < len(tokens) <= SHORT else sketch(own)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose pairs lie within the band, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, x in enumerate(b):
        hit = where.get(x, 0)
        if hit:
            low, high = max(0, j - band), j + band + 1
            hit = hit >> low << low & ((1 << high) - 1)
            if hit:
                u = row & hit
                row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the aligned words reach the similarity."""
    total = len(a) + len(b)
    need = least / (1 + least) * total - 1e-9
    if min(len(a), len(b)) < need or not total:
        return not total
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    n -= head
    tail = int(np.argmin(np.append(a[len(a) - n:][::-1] == b[len(b) - n:][::-1], False)))
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if head + tail + min(len(a), len(b)) < need:
        return False
    common = np.isin(a, b).sum() if len(a) and len(b) else 0
    if head + tail + common < need:
        return False
    return head + tail + aligned(a.tolist(), b.tolist(), int((1 - least) / (1 + least) * total) + 1) >= need


def sketches(df: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, the digest of its words, and its keys."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.by_size(whole, 1):
                h, off = words.hashes(b.column(1))
                with np.errstate(over="ignore"):
                    place = words.mix(np.arange(len(h), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64))
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h ^ place ^ s))]) for s in _SEED[:2]]
                    digest = [(t[off[1:]] - t[off[:-1]]).astype(np.int64) for t in sums]
                own = [keys(h[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, digest), pa.ListArray.from_arrays(ends, np.concatenate(own) if own else np.zeros(0, np.int64))],
                                                 ["doc_id", "d1", "d2", "keys"])

    return df.mapInArrow(task, "doc_id long, d1 long, d2 long, keys array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs with one of the ids. A bitmap of the ids' hashes, of bounded size, drops most others before the
    texts are shuffled; the join drops the rest."""
    def place(df: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        return df.withColumns({"_word": F.shiftright(at, 6), "_bit": F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")})

    words_set = place(ids).groupBy("_word").agg(F.bit_or("_bit").alias("_set"))
    some = place(docs).join(F.broadcast(words_set), "_word").where(F.col("_set").bitwiseAND(F.col("_bit")) != 0)
    return some.select(*docs.columns).join(ids, "doc_id")


def candidates(reps: DataFrame) -> DataFrame:
    """(rep, keys) to pairs a < b: each text with the first text of its keys, one pair a text at most."""
    each = reps.select("rep", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where(F.col("first") < F.col("last"))
    return each.join(shared.select("key", "first"), "key").groupBy("rep").agg(F.min("first").alias("a")).where("a < rep").select("a", F.col("rep").alias("b"))


def _parts(reps: DataFrame, root: DataFrame) -> DataFrame:
    """(key, rep, part): each text under each of its keys with its component."""
    each = reps.select("rep", F.explode("keys").alias("key"))
    return each.join(root, each["rep"] == root["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("part"))


def _rare(least: float):
    """The labelled words of a short text, the word pairs of a long one, and of how many of its rarest it must share one
    with any text that is similar. Texts near the border have both."""
    border = SHORT if (2 * least - 1) * SHORT > 2 else np.inf

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.by_size(whole, 2):
                h, off = words.hashes(b.column(2))
                row, length, own, must, which = [], [], [np.zeros(0, np.uint64)], [], []
                for i, n in enumerate(np.diff(off).tolist()):
                    t = h[off[i]:off[i + 1]]
                    made = [(labelled(t), np.ceil(least * n - 1e-6))] if n <= border / least else []
                    made += [(labelled(shingles(t, 2)), np.ceil((2 * least - 1) * n - 1 - 1e-6))] if n > border else []
                    for x, common in made:
                        own.append(x)
                        row += [i] * len(x)
                        length += [n] * len(x)
                        which += [int(t.sum().astype(np.int64))] * len(x)
                        must += [len(x) - int(common) + 1] * len(x)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(length, pa.int64()), pa.array(np.concatenate(own).astype(np.int64)),
                                                  pa.array(must, pa.int64()), pa.array(which, pa.int64())], ["rep", "part", "length", "token", "must", "which"])

    return task


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to rep, the number of its words, their counts in slots (one byte each) and what is beyond a byte."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.by_size(whole, 1):
                h, off = words.hashes(b.column(1))
                n = np.diff(off)
                slot = (h % np.uint64(BAG)).astype(np.int64) + np.repeat(np.arange(len(n)) * BAG, n)
                count = np.bincount(slot, minlength=len(n) * BAG).reshape(-1, BAG)
                low = np.minimum(count, 255)
                ends = pa.py_buffer((np.arange(len(n) + 1) * BAG).astype(np.int32))
                bag = pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(low.astype(np.uint8))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array((count - low).sum(axis=1)), bag],
                                                 ["rep", "length", "over", "bag"])

    return docs.select("doc_id", "text").mapInArrow(task, "rep long, length long, over long, bag binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(whole.to_pylist()), np.uint8).reshape(-1, BAG)


def _need(total: np.ndarray, least: float) -> np.ndarray:
    return least / (1 + least) * total - 1e-9


def close_pairs(pairs: DataFrame, bag: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose bags leave room for the similarity."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(i).to_numpy() for i, n in enumerate(b.schema.names) if not n.startswith("bag")}
            shared = np.minimum(_matrix(b.column("bag")), _matrix(b.column("bag_b"))).sum(axis=1, dtype=np.int64)
            ok = shared + np.minimum(at["over"], at["over_b"]) >= _need(at["length"] + at["length_b"], least)
            yield b.select([0, 1]).filter(pa.array(ok))

    other = bag.select(F.col("rep").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("length", "over", "bag")])
    met = pairs.join(bag.withColumnRenamed("rep", "a"), "a").join(other, "b")
    return met.select("a", "b", "length", "over", "bag", "length_b", "over_b", "bag_b").mapInArrow(task, "a long, b long").distinct()


def close(met: DataFrame, bag: DataFrame, by: str, least: float = SIMILARITY) -> DataFrame:
    return meetings(met, bag, by, least).distinct()


def _top(u: np.ndarray, v: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each u the `CLOSEST` pairs of the largest share."""
    order = np.lexsort((-share, u))
    u, v, share = u[order], v[order], share[order]
    first = np.searchsorted(u, u)
    ok = np.arange(len(u)) - first < CLOSEST
    return u[ok], v[ok], share[ok]


def closest(met: DataFrame, bag: DataFrame, by: str, least: float = SIMILARITY) -> DataFrame:
    """Of the pairs of `meetings` those of each text that have most values, then words, in common, as (rep, other, share).
    Blocks of a large group don't meet each other here."""
    return meetings(met, bag, by, least, best=True)


def meetings(met: DataFrame, bag: DataFrame, by: str, least: float = SIMILARITY, *, best: bool = False) -> DataFrame:
    """Pairs a < b of texts that agree in a column, lie in different components, and whose bags leave room for the
    similarity. A large group is dealt in blocks; every two blocks meet once, in one of many tasks. Each pair comes from
    the group of the least value that both have, of the `LISTED` least of each; pairs that share none of these meet more often."""
    sizes = met.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").drop("lo", "hi")
    dealt = met.join(sizes, by).withColumn("lot", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.col("lot")) if best else dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col(by).alias("g"), F.least("lot", "other").alias("x"), F.greatest("lot", "other").alias("y"), "lot", "rep", "part")
    cells = store.kept(dealt, "near-cells")
    groups = cells.count() // GROUP + 1
    own_values = cells.groupBy("rep").agg(F.slice(F.sort_array(F.collect_set("g")), 1, LISTED).alias("values"))

    def task(t: pa.Table) -> pa.Table:
        g, x, y, lot, rep, part, length, over = (t.column(c).to_numpy() for c in ("g", "x", "y", "lot", "rep", "part", "length", "over"))
        own = _matrix(t.column("bag"))
        order = np.lexsort((length, y, x, g))
        g, x, y, lot, rep, part, length, over, own = (v[order] for v in (g, x, y, lot, rep, part, length, over, own))
        lists, at = t.column("values").combine_chunks(), order.tolist()
        ends, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
        new = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(g)]]).tolist()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        near = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            # sorted by length: a text can only be similar to those that are not much longer
            last = start + np.searchsorted(length[start:end], length[start:end] / least + 1e-6, side="right")
            of_cell = len(near)
            lower, whole = {}, {}  # values below the group's own
            for i, stop in zip(range(start, end), last.tolist(), strict=True):
                ok = part[i + 1:stop] != part[i]
                if x[i] != y[i]:
                    ok &= lot[i + 1:stop] != lot[i]
                j = np.flatnonzero(ok) + i + 1
                if len(j):
                    shared = np.minimum(own[i], own[j]).sum(axis=1, dtype=np.int64) + np.minimum(over[i], over[j])
                    ok = shared >= _need(length[i] + length[j], least)
                    j, shared = j[ok], shared[ok]
                    for k in (i, *j.tolist()) if len(j) else ():
                        if k not in lower:
                            values = flat[ends[at[k]]:ends[at[k] + 1]]
                            lower[k], whole[k] = frozenset(values[values < g[k]].tolist()), frozenset(values.tolist())
                    ok = [lower[i].isdisjoint(lower[k]) for k in j.tolist()]
                    j, shared = (j[ok], shared[ok]) if len(j) else (j, shared)
                    if best and len(j):
                        common = np.array([len(whole[i] & whole[k]) for k in j.tolist()])
                        near.append((np.full(len(j), i), j, common + shared / (length[i] + length[j] + 1)))
                    left.append(np.full(len(j), rep[i]))
                    right.append(rep[j])
            if len(near) > of_cell:
                u, v, share = (np.concatenate(c) for c in zip(*near[of_cell:], strict=True))
                near[of_cell:] = [_top(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([share, share]))]
        if best:
            u, v, share = (np.concatenate(c) for c in zip(*near, strict=True))
            return pa.table({"rep": rep[u], "other": rep[v], "share": share})
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rows = cells.join(bag.join(own_values, "rep"), "rep").withColumn("task", F.pmod(F.xxhash64("g", "x", "y"), F.lit(groups)))
    if best:
        return rows.groupBy("task").applyInArrow(task, "rep long, other long, share double").where("rep <> other")
    return rows.groupBy("task").applyInArrow(task, "a long, b long").where("a < b")


def open_pairs(reps: DataFrame, root: DataFrame, docs: DataFrame, least: float = SIMILARITY, bag: DataFrame | None = None, *,
               best: bool = False) -> DataFrame:
    """Pairs a < b with a common key whose texts are in different components (node, root) and could be similar; with best
    only the `CLOSEST` ones of each text."""
    bag = bags(docs) if bag is None else bag

    def chosen(found: DataFrame) -> DataFrame:
        if not best:
            return found.distinct()
        top = found.groupBy("rep").agg(F.slice(F.sort_array(F.collect_set(F.struct("share", "other")), asc=False), 1, CLOSEST).alias("_o"))
        top = top.select("rep", F.explode("_o.other").alias("other"))
        return top.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()

    pick = closest if best else close
    parts = _parts(reps, root)
    split = parts.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    met = store.kept(parts.join(split.select("key", "n"), "key"), "near-open")
    small = pick(met.where(F.col("n") <= BUCKET), bag, "key", least)
    large = met.where(F.col("n") > BUCKET)
    if large.isEmpty():
        return chosen(small)
    texts = large.select("rep", "part").distinct().join(docs, F.col("rep") == F.col("doc_id")).select("rep", "part", "text")
    found = store.kept(texts.mapInArrow(_rare(least), "rep long, part long, length long, token long, must long, which long"), "near-tokens")
    counted = found.join(found.groupBy("token").agg(F.count("*").alias("times")), "token")
    rank = F.row_number().over(Window.partitionBy("rep", "which", "must").orderBy("times", "token"))
    rare = counted.withColumn("rank", rank).where("rank <= must and times > 1").select("token", "rep", "part").distinct()
    return chosen(small.unionAll(pick(rare, bag, "token", least)))


def linked(pairs: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs that the alignment confirms."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = store.kept(texts_of(docs, ends), "near-texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.by_size(whole, 2):
                sides = [words.hashes(b.column(i)) for i in (2, 3)]
                ok = [similar(*(h[off[i]:off[i + 1]] for h, off in sides), least) for i in range(b.num_rows)]
                yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(task, "a long, b long")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for all nodes of the links (a < b); root is the smallest node of the component."""
    edges = store.kept(links.distinct(), "star-0")
    before = None
    for n in range(1, most_rounds + 1):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the least of them
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u")
                 .select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b").distinct())
        edges = store.kept(small, f"star-{n}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id for each document."""
    with store.small_batches(df.sparkSession):
        return _classes(df, key, text, least)


def _classes(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    docs = (df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .where("doc_id is not null"))
    seen = store.kept(sketches(docs), "near-sketches")
    equal = seen.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    reps = store.kept(equal, "near-reps")
    twice = seen.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    each = reps.select("rep", "keys")
    # Every two texts that share a key are in these; what follows works on their texts alone.
    shared = each.select("rep", F.explode("keys").alias("key")).groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    ends = each.select(F.col("rep").alias("doc_id"), F.explode("keys").alias("key")).join(shared.select("key"), "key", "left_semi").select("doc_id").distinct()
    texts = store.kept(texts_of(docs, store.kept(ends, "near-ends")), "near-met")
    bag = store.kept(bags(texts), "near-bags")
    member = seen.select("doc_id", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    links = member.join(twice, "doc_id").where("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    first = store.kept(candidates(each), "near-pairs")
    root = components(linked(store.kept(close_pairs(first, bag, least), "near-first"), texts, least).unionAll(links))
    # The closest texts first: they join most of what the complete round after them would align pair by pair.
    for best in (True, False):
        found = store.kept(open_pairs(each, root, texts, least, bag, best=best).join(first, ["a", "b"], "left_anti"), "near-rest")
        more = store.kept(linked(found, texts, least), "near-links")
        if not more.isEmpty():
            root = components(root.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(more))
        first = first.unionAll(found)
    own = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    return (own.join(root, own["rep"] == root["node"], "left")
            .select("doc_id", F.coalesce("root", "rep").alias("class_id")))
