"""Spelling variants of words, found by k-d trees over vectors of letter counts.

Two words are near if one inserted, deleted or replaced letter turns one into the other. Then their letter counts are
at most two apart in L1: words of equal length have one letter more and one less, a word one letter longer has one more.
So for every pair of lengths (L, L) and (L, L + 1) a range search in the tree of the longer length finds all words that
can be near, and only their letter order is compared.

* Each length has a k-d tree over count vectors. Its upper part is fitted on a bounded sample (`SAMPLE` words) and cuts
  the words of that length into cells; a word lives in one cell and is sent, as a query, to the cells whose box the
  range reaches. The sample decides only where the cuts are, never what is found.
* A task takes one cell: its words go into a k-d tree over their distinct vectors with tight boxes, queries pass
  through it in batches (all open (query, box) pairs at once). Vectors in range are compared exactly; words of two
  vectors in range meet only if their first or second halves agree, as they must around a single edit. So a group of
  words with the same letters is never compared pair by pair.
* A cell with more words than `CELL` is cut into chunks by a hash and its queries go to every chunk.
* Links are summed up per word before they are moved (count, best partner); copies of pairs are never stored.

Words are Latin-1 letters, one byte each inside (`binary`), so byte order is code-point order.
Defined results: null texts have no words; a null doc_id counts as an empty one; repeated rows are counted as often as
they come; no words give no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import flat_bytes, ragged
from .store import kept
from .words import mix

#: Shortest word, least number of occurrences, how many times as frequent a form is.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: Runs whose key is divisible by this lose a letter.
NOISE = 31
#: Words of one length that make a cell of its own; most words of one chunk; words drawn to place the cuts.
LEAF, CELL, SAMPLE = 20_000, 80_000, 200_000
#: Distinct vectors in a leaf of a task's own tree; queries that pass through it at once; bytes of text cut at a time.
SMALL, AT_ONCE, SLICE = 12, 4_096, 1 << 22
DIMS = 26 + 64

_DIM = np.zeros(256, np.int64)
_DIM[97:123], _DIM[192:256] = np.arange(26), np.arange(26, DIMS)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_WEIGHTS = np.random.default_rng(13).integers(1, 1 << 63, 1024, np.uint64) | np.uint64(1)


# -- words of documents ------------------------------------------------------------------------
def crc32_of(prefix: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each raw[start:start + length], going on from a crc32 of what stands before."""
    order = np.argsort(-lengths, kind="stable")
    state, at, left = prefix[order] ^ np.uint32(0xFFFFFFFF), starts[order], lengths[order]
    long = int(np.searchsorted(-left, -64, side="left"))
    for i in range(long):
        state[i] = zlib.crc32(raw[at[i]:at[i] + left[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))
        part = state[long:n]
        state[long:n] = _CRC[(part ^ raw[at[long:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _slices(raw: np.ndarray, letter: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(raw):
        j = min(len(raw), i + SLICE)
        while j < len(raw) and letter[j]:
            j += 1
        yield i, j
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the batches' texts with counts, after some have lost a letter."""
    for batch in batches:
        raw, off = flat_bytes(batch.column("text"))
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        lead = raw == 0xC3
        letter = (raw >= 97) & (raw <= 122) | lead
        letter[1:] |= lead[:-1]
        prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], np.uint32)
        for i, j in _slices(raw, letter):
            part, word, twice = raw[i:j], letter[i:j], lead[i:j]
            inner = off[(off > i) & (off < j)] - i
            first = word.copy()
            first[1:] &= ~word[:-1]
            first[inner] |= word[inner]
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            flat = part[word]                                    # the runs' bytes, one after the other
            bounds = np.append(np.cumsum(word)[starts] - 1, len(flat))
            points = np.diff(np.concatenate([[0], np.cumsum(~twice[word])])[bounds])
            docs = np.searchsorted(off, starts + i, side="right") - 1
            runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
            enough = points >= LETTERS
            if not enough.any():
                continue
            coded = runs.filter(pa.array(enough)).dictionary_encode()
            texts, place = flat_bytes_of(coded.dictionary)
            pairs, n = np.unique(docs[enough] * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            doc, code = np.divmod(pairs, max(1, len(coded.dictionary)))
            key = crc32_of(prefix[doc], texts, place[code], np.diff(place)[code])
            hit = key % NOISE == 0
            total = np.bincount(code[~hit], n[~hit], len(coded.dictionary)).astype(np.int64)
            latin, at = to_latin(texts, place)
            words, counts = [], []
            for c, k, m in zip(code[hit].tolist(), key[hit].tolist(), n[hit].tolist(), strict=True):
                w = latin[at[c]:at[c + 1]].tobytes()
                if len(w) > LETTERS:
                    words.append(w[:k % len(w)] + w[k % len(w) + 1:])
                    counts.append(m)
            whole = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(latin))])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([whole.filter(pa.array(total > 0)).cast(pa.binary()), pa.array(words, pa.binary())]),
                                              pa.array(np.concatenate([total[total > 0], np.array(counts, np.int64)]))], names=["word", "n"])


def flat_bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row, and where each begins (with the end)."""
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2] if len(values) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def to_latin(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of Latin-1 letters as one byte a letter."""
    lead = raw == 0xC3
    out = raw.copy()
    out[1:][lead[:-1]] += np.uint8(0x40)
    return out[~lead], np.concatenate([[0], np.cumsum(~lead)])[off]


def words_of(docs: DataFrame) -> DataFrame:
    """word (Latin-1 bytes), n: words with enough letters and occurrences."""
    return (docs.select("doc_id", "text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= OCCURRENCES))


# -- trees ---------------------------------------------------------------------------------------
class Tree(NamedTuple):
    """Nodes of a k-d tree; leaf -1 marks inner ones, whose children are `kids` and `kids` + 1."""
    kids: np.ndarray
    leaf: np.ndarray
    lo: np.ndarray      # boxes, one row a node
    hi: np.ndarray
    order: np.ndarray   # the vectors, leaf after leaf
    bounds: np.ndarray  # where each leaf begins there (with the end)


def letter_counts(m: np.ndarray) -> np.ndarray:
    """One vector of letter counts for each row of a matrix of letters."""
    n, length = m.shape
    flat = np.repeat(np.arange(n) * DIMS, length) + _DIM[m.ravel()]
    return np.bincount(flat, minlength=n * DIMS).reshape(n, DIMS).astype(np.int16 if length < 30_000 else np.int64)


def build(v: np.ndarray, size: int, *, tight: bool) -> Tree:
    """Split at medians of the dimension that varies most until leaves have at most `size` vectors or equal ones.

    tight: boxes are those of the vectors; else they fill the space, so that any vector has a leaf.
    """
    big = np.iinfo(v.dtype).max // 2
    kids, leaf, los, his, order, bounds = [-1], [-1], [np.zeros(v.shape[1], v.dtype)], [np.full(v.shape[1], big, v.dtype)], [], [0]
    todo = [(0, np.arange(len(v)))]
    while todo:
        node, rows = todo.pop()
        own = v[rows]
        if tight and len(rows):
            los[node], his[node] = own.min(0), own.max(0)
        spread = own.astype(np.float32).var(0) if len(rows) > size else np.zeros(1)
        d = int(spread.argmax())
        if spread[d] == 0:
            leaf[node] = len(bounds) - 1
            order.append(rows)
            bounds.append(bounds[-1] + len(rows))
            continue
        x = own[:, d]
        cut = min(int(np.median(x)), int(x.max()) - 1)
        kids[node] = len(kids)
        for side in (x <= cut, x > cut):
            lo, hi = los[node].copy(), his[node].copy()
            if side[x.argmax()]:
                lo[d] = cut + 1
            else:
                hi[d] = cut
            kids.append(-1)
            leaf.append(-1)
            los.append(lo)
            his.append(hi)
            todo.append((len(kids) - 1, rows[side]))
    return Tree(np.array(kids), np.array(leaf), np.array(los), np.array(his), np.concatenate(order) if order else np.zeros(0, np.int64), np.array(bounds))


def visit(tree: Tree, q: np.ndarray, up: int, down: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) for every leaf whose box is within `up` added and `down` dropped letters of a query."""
    who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
    down = np.broadcast_to(down, len(q))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(who):
        near = np.maximum(tree.lo[node] - q[who], 0).sum(1) <= up
        who, node = who[near], node[near]
        near = np.maximum(q[who] - tree.hi[node], 0).sum(1) <= down[who]
        who, node = who[near], node[near]
        end = tree.leaf[node] >= 0
        found.append((who[end], tree.leaf[node[end]]))
        who, kids = who[~end], tree.kids[node[~end]]
        who, node = np.concatenate([who, who]), np.concatenate([kids, kids + 1])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- the words of one cell -------------------------------------------------------------------------
def _hash(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(0, m.shape[1], len(_WEIGHTS)):
            part = m[:, j:j + len(_WEIGHTS)].astype(np.uint64)
            out = mix(out) + (part * _WEIGHTS[:part.shape[1]]).sum(1, dtype=np.uint64)
    return mix(out)


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the number of each row among them."""
    v = np.ascontiguousarray(v)
    _, first, inverse = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return v[first], inverse


class Cell:
    """Words of one length under one k-d tree of their distinct vectors."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters
        vectors, self.vector = _distinct(letter_counts(letters))
        self.used = vectors.any(0)
        self.vectors = np.ascontiguousarray(vectors[:, self.used])
        self.tree = build(self.vectors, SMALL, tight=True)
        self.keys: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {}

    def _halves(self, longer: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For first and second halves: sorted keys (vector, half) of the words, and the words in that order."""
        if longer not in self.keys:
            n = self.letters.shape[1] - longer
            self.keys[longer] = []
            for half in (self.letters[:, :n // 2], self.letters[:, n // 2 + longer:]):
                key = _hash(half) ^ mix(self.vector.astype(np.uint64))
                order = np.argsort(key, kind="stable")
                self.keys[longer].append((key[order], order))
        return self.keys[longer]

    def near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all near pairs; queries are as long as the words or one letter shorter."""
        longer = q.shape[1] < self.letters.shape[1]
        wanted, number = _distinct(letter_counts(q))
        outside = wanted[:, ~self.used].sum(1)
        down = (0 if longer else 1) - outside
        wanted = wanted[:, self.used].astype(self.vectors.dtype)
        who, leaf = visit(self.tree, wanted, 1, down)
        # The vectors of the leaves in range, compared exactly.
        n = np.diff(self.tree.bounds)[leaf]
        who, vector = np.repeat(who, n), self.tree.order[ragged(self.tree.bounds[leaf], n)]
        more = self.vectors[vector] - wanted[who]
        fits = (np.maximum(more, 0).sum(1) == 1) & (np.maximum(-more, 0).sum(1) + outside[who] == (0 if longer else 1))
        who, vector = who[fits], vector[fits]
        # From distinct vectors to the queries that have them.
        order = np.argsort(number, kind="stable")
        begin = np.searchsorted(number[order], np.arange(len(wanted) + 1))
        n = np.diff(begin)[who]
        query, vector = order[ragged(begin[who], n)], np.repeat(vector, n)
        length, pairs = q.shape[1], []
        for half, (keys, words) in zip((q[:, :length // 2], q[:, length // 2:]), self._halves(longer), strict=True):
            key = _hash(half)[query] ^ mix(vector.astype(np.uint64))
            a, b = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
            pairs.append(np.repeat(query, b - a) * len(self.letters) + words[ragged(a, b - a)])
        query, word = np.divmod(np.unique(np.concatenate(pairs)), len(self.letters))
        x, y = q[query], self.letters[word]
        if longer:  # letters that agree from the front and from the back cover the shorter word
            front = np.cumprod(x == y[:, :-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
            back = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
            same = front + back >= length
        else:
            same = (x != y).sum(1) == 1
        return query[same], word[same]


def _matrix(words: pa.Array) -> np.ndarray:
    """Words of equal length as a matrix of letters."""
    raw, off = flat_bytes_of(words.cast(pa.large_binary()))
    return raw.reshape(len(words), -1) if len(words) else np.zeros((0, 1), np.uint8)


def _best(a: np.ndarray, b: np.ndarray, words_a: np.ndarray, words_b: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
    """For each a: how many partners it has, and the most frequent of them (ties: smallest)."""
    text = np.ascontiguousarray(words_b).view(f"S{words_b.shape[1]}").ravel()
    order = np.lexsort((np.argsort(np.argsort(text, kind="stable"), kind="stable")[b], -n_b[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    k = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays([
        pa.array([w.tobytes() for w in words_a[a[first]]], pa.binary()), pa.array(k, pa.int64()), pa.array(n_b[b[first]], pa.int64()),
        pa.array([w.tobytes() for w in words_b[b[first]]], pa.binary())], names=["word", "n_near", "best_n", "best"])


MEMBER, EQUAL, SHORTER = 0, 1, 2


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (length, leaf, chunk), the cell's own words before the queries."""
    now, cell, own, n_own, held = None, None, [], [], []

    def answers(words: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = _matrix(words)
        for i in range(0, len(m), AT_ONCE):
            q, counts = m[i:i + AT_ONCE], n[i:i + AT_ONCE]
            a, b = cell.near(q)
            if len(a):
                yield _best(a, b, q, cell.letters, held[0])
                if q.shape[1] < cell.letters.shape[1]:
                    yield _best(b, a, cell.letters, q, counts)

    def begin() -> Iterator[pa.RecordBatch]:
        """All words of the cell are there: build its tree, let them ask first."""
        nonlocal cell
        words = pa.concat_arrays(own)
        held[:] = [np.concatenate(n_own)]
        cell = Cell(_matrix(words))
        yield from answers(words, held[0])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("length", "leaf", "chunk", "kind")], axis=1)
        if not len(keys):
            continue
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        for i, j in zip(at, [*at[1:], len(keys)], strict=True):
            *where, kind = keys[i].tolist()
            words, n = batch.column("word").slice(i, j - i), batch.column("n").slice(i, j - i).to_numpy()
            if where != now:
                if own and cell is None:
                    yield from begin()
                now, cell, own, n_own = where, None, [], []
            if kind == MEMBER:
                own.append(words)
                n_own.append(n)
                continue
            if own and cell is None:
                yield from begin()
            if cell is not None:
                yield from answers(words, n)
    if own and cell is None:
        yield from begin()


def _route(trees: dict[int, Tree]):
    """Each word to its own cell, and as a query to the other cells that its range reaches."""
    names = ("length", "leaf", "kind", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").cast(pa.binary()), batch.column("n")
            lengths = pa.compute.binary_length(words).to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                some = words.take(pa.array(rows))
                for i in range(0, len(rows), AT_ONCE):
                    part = rows[i:i + AT_ONCE]
                    v = letter_counts(_matrix(some.slice(i, AT_ONCE))) if {length, length + 1} & trees.keys() else None
                    none = np.arange(len(part)), np.zeros(len(part), np.int64)
                    home = visit(trees[length], v, 0, 0) if length in trees else none
                    homes = np.empty(len(part), np.int64)
                    homes[home[0]] = home[1]
                    who, leaf = visit(trees[length], v, 1, 1) if length in trees else (none[0][:0], none[1][:0])
                    other = leaf != homes[who]
                    longer = visit(trees[length + 1], v, 1, 0) if length + 1 in trees else none
                    for kind, size, (a, b) in ((MEMBER, length, (none[0], homes)), (EQUAL, length, (who[other], leaf[other])), (SHORTER, length + 1, longer)):
                        if len(a):
                            at = pa.array(part[a])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), size)), pa.array(b), pa.array(np.full(len(a), kind)),
                                                              words.take(at), n.take(at)], names=names)

    return run


def cell_trees(words: DataFrame) -> dict[int, Tree]:
    """Trees whose leaves are the cells, for every length with more than LEAF words, fitted on a bounded sample."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > LEAF).collect()}
    total, out = sum(sizes.values()), {}
    if not sizes:
        return out
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    drawn = (words.where(F.length("word").isin(*sizes)).where(place < int((1 << 30) * min(1.0, SAMPLE / total)))
             .select("word").limit(2 * SAMPLE).toArrow().column("word").combine_chunks().cast(pa.binary()))
    lengths = pa.compute.binary_length(drawn).to_numpy()
    for length, n in sizes.items():
        own = drawn.filter(pa.array(lengths == length))
        if len(own):
            out[length] = build(letter_counts(_matrix(own)), max(1, len(own) * LEAF // n), tight=False)
    return out


def links(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: near words of each word that has any."""
    routed = kept(words.mapInArrow(_route(cell_trees(words)), "length long, leaf long, kind long, word binary, n long"), "spelling-cells")
    cap = F.greatest(F.lit(64), F.least(F.lit(CELL), F.lit(1 << 25) / F.col("length")))
    large = (routed.where(F.col("kind") == MEMBER).groupBy("length", "leaf").agg(F.count(F.lit(1)).alias("size"))
             .where(F.col("size") > cap).select("length", "leaf", F.ceil(F.col("size") / cap).alias("chunks")))
    own = F.when(F.col("kind") == MEMBER, F.pmod(F.xxhash64("word"), "chunks"))
    dealt = (routed.join(large, ["length", "leaf"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .withColumn("kind", F.when(own == F.col("chunk"), F.lit(MEMBER)).otherwise(F.greatest("kind", F.lit(EQUAL))).cast("long"))
             .select("length", "leaf", "chunk", "kind", "word", "n"))
    near = (dealt.repartition("length", "leaf", "chunk").sortWithinPartitions("length", "leaf", "chunk", "kind")
            .mapInArrow(_search, "word binary, n_near long, best_n long, best binary"))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return (near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of a word lead. Forms are ever more frequent, so a few doublings suffice."""
    led = forms.select("word", F.col("form").alias("root"))
    while True:
        step = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = kept(led.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if led.where("moved").isEmpty():
            return led.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (Latin-1 bytes) with counts n."""
    words = kept(words, "spelling-words")
    frequent = F.col("best_n") >= TIMES * F.col("n")
    rated = kept(words.join(links(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("best")).alias("form"),
        F.when(frequent, F.col("best_n")).alias("form_n")), "spelling-forms")
    led = rated.join(roots(rated.where("form is not null").select("word", "form")), "word", "left")
    text = {c: F.decode(F.col(c), "ISO-8859-1").alias(c) for c in ("word", "form")}
    return led.select(text["word"], text["form"], F.decode(F.coalesce("root", "word"), "ISO-8859-1").alias("root"), "n", "n_near", "form_n")


#: crc32 bit by bit: a byte is mixed in, then eight shifts follow.
def crc_sql(codes: str) -> str:
    bits = f"flatten(list_transform({codes}, lambda c: list_concat([c::UBIGINT], list_transform(range(8), lambda z: 256::UBIGINT))))"
    return (f"xor(list_reduce(list_concat([4294967295::UBIGINT], {bits}), lambda a, x: CASE WHEN x < 256 THEN xor(a, x) "
            "WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT)")


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= {LETTERS}),
pairs AS (SELECT d, w, count(*) AS k FROM runs GROUP BY 1, 2),
keyed AS (SELECT w, k, {crc_sql("flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, 128 + ord(c) % 64] END))")} AS h FROM pairs),
words AS (
  SELECT w, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {NOISE} = 0 THEN w[:(h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2:] ELSE w END AS w, k FROM keyed)
  WHERE length(w) >= {LETTERS} GROUP BY 1 HAVING sum(k) >= {OCCURRENCES}),
cut AS (SELECT w, n, i, w[:i - 1] || w[i + 1:] AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT cut.w AS a, words.w AS b FROM cut JOIN words ON words.w = cut.rest),
near AS (
  SELECT x.w AS a, y.w AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.w <> y.w
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY m.n DESC, b) AS b, max(m.n) AS top FROM near JOIN words m ON m.w = near.b GROUP BY a),
forms AS (
  SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * n THEN b END AS form, CASE WHEN top >= {TIMES} * n THEN top END AS form_n
  FROM words LEFT JOIN best ON best.a = words.w),
walk AS (
  SELECT w, w AS root, form AS next FROM forms
  UNION ALL SELECT walk.w, walk.next, forms.form FROM walk JOIN forms ON forms.w = walk.next)
SELECT forms.w AS word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN walk ON walk.w = forms.w AND walk.next IS NULL
"""
