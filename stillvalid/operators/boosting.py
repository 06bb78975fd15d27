"""Gradient-boosted trees for any number of classes (or one numeric target), grown by Spark aggregates.

A round adds one tree for each class, fitted to the gradient of the softmax loss. All trees of a round
grow together: each level is one pass over the rows, which tasks reduce to histograms of gradient and
curvature per (class, node, feature, bin). Rounds run inside a barrier stage: a task keeps its share of the
rows in memory, all tasks add up the histograms of a level, whose size does not depend on the rows, and each
finds the same splits. Rows with the same bins and target have the same scores and gradients in every round,
so they meet in one task as a cell, which counts how many of its rows a round has drawn; of a row itself only
its number and its cell are kept. A job grows `REFRESH` rounds, so that
there are a few jobs instead of one for each level. Barrier stages need all their tasks at once: there are
no more tasks than slots, and Spark refuses them under dynamic allocation.

Trees are complete binary trees of a given depth. A node that cannot gain sends all rows to the left.
Missing values have a bin of their own below all others. Ties between splits go to the first feature
and the lowest cut; gains are compared after rounding, so that the order of partial sums does not matter.

Rows are scored by masks of leaves: each feature's bin rules out the leaves left of the nodes that send it to
the right, and the first leaf that no feature rules out is the row's (`LeafMasks`).
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze, scratch_path
from .learned import EMBED_DIM

#: Rounds grown by one job (what a lost executor costs at most); digits of a gain that count; rows of a task at least.
REFRESH, DIGITS, ROWS = 50, 9, 25_000
#: Rows scored, and rows whose draws are looked at, in one go.
TILE, DRAWS = 1_000, 1 << 20


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 4
    rate: float = 0.1
    penalty: float = 1.0
    row_share: float = 0.9
    feature_share: float = 0.9
    bins: int = 64
    seed: int = 0


@dataclass
class Boosted:
    """A fitted model. Arrays are indexed by (round, output, node); inner nodes are numbered like a heap."""

    classes: int            # 0: regression
    settings: Settings
    edges: list[np.ndarray]  # cut points of each feature
    base: np.ndarray        # score of each output before the first round
    feature: np.ndarray     # -1: no split
    cut: np.ndarray         # rows with a bin above it go right
    value: np.ndarray       # of leaves, shrunk already

    @property
    def outputs(self) -> int:
        return len(self.base)

    def leaves(self, bins: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Leaf of each row in each tree of the rounds: (rows, rounds, outputs)."""
        last = len(self.feature) if last is None else last
        masks = LeafMasks(self, first, last)
        return np.concatenate([masks.leaves(bins[i:i + TILE]) for i in range(0, max(len(bins), 1), TILE)]).reshape(len(bins), last - first, self.outputs)

    def gains(self, leaf: np.ndarray, first: int, last: int) -> Iterator[np.ndarray]:
        """What each round adds to the scores of rows with these leaves: (outputs, rows), round by round."""
        at = np.ascontiguousarray(leaf.reshape(len(leaf), -1).T).reshape(last - first, self.outputs, len(leaf))
        begin = (np.arange(self.outputs) * self.value.shape[2])[:, None]
        for r in range(first, last):
            yield self.value[r].ravel().take(at[r - first] + begin)

    def add(self, scores: np.ndarray, bins: np.ndarray, first: int, last: int) -> np.ndarray:
        """Scores after the rounds first, ..., last - 1."""
        out, masks = scores.copy(), LeafMasks(self, first, last)
        for i in range(0, len(bins), TILE):
            for gain in self.gains(masks.leaves(bins[i:i + TILE]), first, last):
                out[i:i + TILE] += gain.T
        return out

    def level(self, r: int, level: int, feature: np.ndarray, cut: np.ndarray, *sides: tuple[np.ndarray, np.ndarray]) -> None:
        """Enter the splits of a level of a round; those of the last level give the leaves."""
        s, nodes = self.settings, slice((1 << level) - 1, (2 << level) - 1)
        self.feature[r, :, nodes], self.cut[r, :, nodes] = feature.reshape(self.outputs, -1), cut.reshape(self.outputs, -1)
        if level == s.depth - 1:
            leaf = [-s.rate * x / (c + s.penalty) for x, c in sides]
            self.value[r] = np.stack(leaf, axis=1).reshape(self.outputs, -1)

    # -- keeping a model ---------------------------------------------------------------------
    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table: one row for each node (cut as a value of the feature) and leaf."""
        inner, rows = self.feature.shape[2], []
        for r, k in np.ndindex(self.feature.shape[:2]):
            for i in range(inner):
                f, c = int(self.feature[r, k, i]), int(self.cut[r, k, i])
                at = None if f < 0 else float(self.edges[f][c - 1]) if c > 0 else None
                rows.append((int(r), int(k), i, f, c, at, None))
            rows += [(int(r), int(k), inner + i, None, None, None, float(v)) for i, v in enumerate(self.value[r, k])]
        return spark.createDataFrame(rows, "round int, output int, node int, feature int, cut int, at double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model into a folder that any later session can load from."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        head = [("classes", 0, [float(self.classes)]), ("base", 0, [float(b) for b in self.base])]
        head += [("edges", i, [float(e) for e in cuts]) for i, cuts in enumerate(self.edges)]
        head += [(name, 0, [float(v)]) for name, v in vars(self.settings).items()]
        spark.createDataFrame(head, "name string, i int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        head = {(r["name"], r["i"]): np.array(r["numbers"]) for r in spark.read.parquet(f"{path}/head").collect()}
        kinds = {n: type(v) for n, v in vars(Settings()).items()}
        settings = Settings(**{n: kind(head[n, 0][0]) for n, kind in kinds.items()})
        edges = [head["edges", i] for i in range(sum(n == "edges" for n, _ in head))]
        base = head["base", 0]
        inner = (1 << settings.depth) - 1
        feature = np.full((settings.rounds, len(base), inner), -1)
        cut, value = np.zeros_like(feature), np.zeros((settings.rounds, len(base), inner + 1))
        for r in spark.read.parquet(f"{path}/nodes").toLocalIterator():
            if r["node"] < inner:
                feature[r["round"], r["output"], r["node"]], cut[r["round"], r["output"], r["node"]] = r["feature"], r["cut"]
            else:
                value[r["round"], r["output"], r["node"] - inner] = r["value"]
        return cls(int(head["classes", 0][0]), settings, edges, base, feature, cut, value)


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Position of each row among the nodes at a depth."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(depth):
        node = at + (1 << level) - 1
        f = feature[node]
        at = 2 * at + ((f >= 0) & (bins[rows, f] > cut[node]))
    return at


class LeafMasks:
    """Leaves of all trees of the rounds first, ..., last - 1 at once.

    A node that sends a row to the right rules out the leaves below its left side; of those that no node rules
    out, the first is the row's. For each feature and bin there is one word of allowed leaves a tree, so a row costs
    a few words for each feature, whatever the depth. Trees deeper than six levels are descended one by one.
    """

    def __init__(self, model: Boosted, first: int, last: int):
        self.depth = model.settings.depth
        inner = model.feature.shape[2]
        self.feature, self.cut = (a[first:last].reshape(-1, inner) for a in (model.feature, model.cut))
        if self.depth > 6:
            return
        self.word = np.dtype(f"u{max(1, (1 << self.depth) // 8)}")
        every = self.word.type((1 << (1 << self.depth)) - 1)
        size = max((len(e) for e in model.edges), default=0) + 2
        self.allowed = np.full((len(model.edges), size, len(self.feature)), every, self.word)
        for node in range(inner):
            level = (node + 1).bit_length() - 1
            leaves = 1 << (self.depth - level)
            begin = (node + 1 - (1 << level)) * leaves
            left = self.word.type(int(every) & ~(((1 << (leaves // 2)) - 1) << begin))
            for f in range(len(model.edges)):
                own = np.flatnonzero(self.feature[:, node] == f)
                right = np.arange(size)[:, None] > self.cut[own, node]
                self.allowed[f][:, own] &= np.where(right, left, every)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree: (rows, trees)."""
        if self.depth > 6:
            return np.stack([descend(bins, f, c, self.depth) for f, c in zip(self.feature, self.cut, strict=True)], axis=1).astype(np.uint16)
        left = self.allowed[0].take(bins[:, 0], axis=0)
        for f in range(1, bins.shape[1]):
            left &= self.allowed[f].take(bins[:, f], axis=0)
        return np.bitwise_count(~left & (left - self.word.type(1)))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss with respect to each score."""
    if not classes:
        return scores - y[:, None], np.ones_like(scores)
    p = softmax(scores)
    return p - (y[:, None] == np.arange(classes)), np.maximum(p * (1 - p), 1e-12)


# -- binned rows -----------------------------------------------------------------------------
def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of equal length as a matrix; missing entries become NaN."""
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: 0 where it is missing, else one more than the number of edges below it."""
    out = np.zeros(x.shape, np.uint8)
    for f, cuts in enumerate(edges):
        known = np.isfinite(x[:, f])
        out[known, f] = 1 + np.searchsorted(cuts, x[known, f], side="left")
    return out


def quantile_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Distinct cut points of each feature at equal shares of the rows."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    got = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, F.lit(10_000)).alias(f"e{i}") for i in range(width)]).first()
    return [np.unique(np.array(e, float)) if e is not None else np.zeros(0) for e in got]


def _prepare(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            cell = np.concatenate([binned(matrix(batch.column("x")), edges), np.ascontiguousarray(y).view(np.uint8).reshape(len(y), 8)], axis=1)
            yield pa.RecordBatch.from_arrays([_packed(cell), batch.column("row")], names=["cell", "row"])

    return run


def _packed(m: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    step = m.dtype.itemsize * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * step), pa.py_buffer(np.ascontiguousarray(m))])


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]].view(dtype).reshape(len(column), -1)


def _drawn(row: np.ndarray, r: int, share: float, seed: int) -> np.ndarray:
    """Whether a row takes part in a round: a hash of both, the same wherever the row lies."""
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >= np.uint64(int((1 - share) * 2**64) if share < 1 else 0)


def _histograms(g: np.ndarray, h: np.ndarray, node: np.ndarray, bins: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """Sums of gradient and curvature per (class and node of a level, feature, bin) of a task's rows.

    g, h and node have one line for each class, bins one for each feature."""
    outputs, width = node.shape[0], bins.shape[0]
    out = np.zeros((2, outputs, nodes, width, size))
    for k in range(outputs):
        at = node[k] * size
        for f in range(width):
            place = at + bins[f]
            for i, w in enumerate((g[k], h[k])):
                out[i, k, :, f] = np.bincount(place, w, nodes * size).reshape(nodes, size)
    return out.reshape(2, outputs * nodes, width, size)


def _cells(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins and target of the distinct cells in their order, and of every row its number and the place of its cell."""
    found = [(b.column("cell"), b.column("row").to_numpy()) for b in batches if b.num_rows]
    if not found:
        return np.zeros((0, width), np.uint8), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
    coded = pa.chunked_array([c for c, _ in found]).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    cells = _unpacked(coded.dictionary.take(pa.array(order)), np.uint8)
    return (np.ascontiguousarray(cells[:, :width]), np.ascontiguousarray(cells[:, width:]).view(np.float64).ravel(),
            np.concatenate([r for _, r in found]), place[coded.indices.to_numpy()])


def _drawn_of(place: np.ndarray, row: np.ndarray, cells: int, r: int, s: Settings) -> np.ndarray:
    """How many rows of each cell take part in a round."""
    out = np.zeros(cells)
    for i in range(0, len(row), DRAWS):
        out += np.bincount(place[i:i + DRAWS][_drawn(row[i:i + DRAWS], r, s.row_share, s.seed)], minlength=cells)
    return out


class Exchange:
    """Sums over all tasks of a barrier stage, by one file of each task in the shared folder for every step.

    The stage's own ``allGather`` answers once a second, and a fit has hundreds of steps. A file appears under its name
    only when it is whole, a repeated stage has names of its own, and a file goes when every task has read it: who
    has published a step has read the one before.
    """

    def __init__(self, path: str):
        context = BarrierTaskContext.get()
        self.me, self.tasks, self.step, self.mine = context.partitionId(), len(context.getTaskInfos()), 0, []
        local = urlparse(path).scheme in ("", "file")
        self.system, place = (fs.LocalFileSystem(), urlparse(path).path) if local else fs.FileSystem.from_uri(path)
        self.place = f"{place}/{context.allGather(uuid.uuid4().hex)[0]}"  # one name for this attempt of the stage
        self.system.create_dir(self.place, recursive=True)

    def added(self, sums: np.ndarray) -> np.ndarray:
        """The sums of all tasks, added in the order of the tasks."""
        if self.tasks == 1:
            return sums
        names = [f"{self.place}/{self.step}-{i}" for i in range(self.tasks)]
        with self.system.open_output_stream(f"{names[self.me]}.part") as out:
            out.write(zlib.compress(sums.tobytes(), 1))
        self.system.move(f"{names[self.me]}.part", names[self.me])
        total = np.zeros_like(sums)
        for i, name in enumerate(names):
            pause = 0.001
            while i != self.me and self.system.get_file_info(name).type == fs.FileType.NotFound:
                time.sleep(pause)
                pause = min(2 * pause, 0.05)
            if i == self.me:
                total += sums
            else:
                with self.system.open_input_stream(name) as file:
                    total += np.frombuffer(zlib.decompress(file.read())).reshape(sums.shape)
        if len(self.mine) == 2:
            self.system.delete_file(self.mine.pop(0))
        self.mine.append(names[self.me])
        self.step += 1
        return total


def _grow(model: Boosted, first: int, last: int, allowed: list[np.ndarray], path: str):
    """The rounds first, ..., last - 1: each task keeps its rows, and all tasks add up the histograms of a level."""
    s, outputs, size = model.settings, model.outputs, model.settings.bins + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, y, row, place = _cells(batches, len(model.edges))
        scores, tasks = model.add(np.tile(model.base, (len(cells), 1)), cells, 0, first), Exchange(path)
        # Bins by feature for sums, and flat for looking up one bin of each cell.
        bins, flat, begin = np.ascontiguousarray(cells.T).astype(np.intp), cells.ravel(), np.arange(len(cells)) * len(model.edges)
        for r in range(first, last):
            n, node = _drawn_of(place, row, len(cells), r, s), np.zeros((outputs, len(cells)), np.intp)
            g, h = (np.ascontiguousarray(v.T) * n for v in gradients(scores, y, model.classes))
            for level in range(s.depth):
                sums = tasks.added(_histograms(g, h, node, bins, 1 << level, size))
                model.level(r, level, *best_splits(*sums, allowed[r - first], s.penalty))
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                for k in range(outputs):
                    f = model.feature[r, k, nodes]
                    cut = np.where(f >= 0, model.cut[r, k, nodes], 255)
                    node[k] = 2 * node[k] + (flat.take(begin + np.maximum(f, 0).take(node[k])) > cut.take(node[k]))
            for k in range(outputs):
                scores[:, k] += model.value[r, k].take(node[k])
        if tasks.me == 0:
            feature, cut, value = (x[first:last].ravel() for x in (model.feature, model.cut, model.value))
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]) for x in (feature, cut, value)], schema=pa.schema(
                [("feature", pa.list_(pa.int64())), ("cut", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))]))

    return run


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    sc, conf = spark.sparkContext, spark.sparkContext.getConf()
    n = sc.defaultParallelism
    if conf.contains("spark.default.parallelism") and not sc.master.startswith("local"):
        n = min(n, int(conf.get("spark.executor.instances", "1")) * int(conf.get("spark.executor.cores", "1")))
    return max(1, n // int(conf.get("spark.task.cpus", "1")))


def best_splits(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, penalty: float) -> tuple[np.ndarray, ...]:
    """For each node: feature (-1 without gain), cut, and the sums (g, h) to the left and right of it.

    g and h have one entry for each (node, feature, bin).
    """
    gl, hl = g.cumsum(2), h.cumsum(2)
    total_g, total_h = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = total_g - gl, total_h - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total_g**2 / (total_h + penalty)
    # Both sides need rows; sums that should be 0 may be a little off.
    gain = np.where((hl > 1e-9) & (hr > 1e-9) & allowed[None, :, None], np.round(gain, DIGITS), 0.0)
    flat = gain.reshape(len(gain), -1)
    best, rows = flat.argmax(1), np.arange(len(gain))
    found = flat[rows, best] > 0
    feature, cut = np.divmod(best, g.shape[2])
    at = (rows, feature, cut)
    zero = np.zeros(len(rows))
    left = np.where(found, gl[at], total_g[:, 0, 0]), np.where(found, hl[at], total_h[:, 0, 0])
    right = np.where(found, gr[at], zero), np.where(found, hr[at], zero)
    return np.where(found, feature, -1), np.where(found, cut, 0), left, right


def dealt(rows: DataFrame, n: int, tasks: int) -> DataFrame:
    """Rows by their cell in a number of tasks; a cell with many of the n rows is dealt over all of them by row."""
    if tasks == 1:
        return rows.repartition(1)
    large = rows.groupBy("cell").count().filter(F.col("count") > n // (4 * tasks)).select("cell")      # under 4 x tasks rows
    large = [bytes(r["cell"]) for r in large.collect()]
    spread = F.when(F.col("cell").isin(large), F.pmod("row", F.lit(tasks))).otherwise(-1) if large else F.lit(-1)
    return rows.repartition(tasks, "cell", spread)


def fit(pre: DataFrame, *, classes: int = 0, settings: Settings = Settings(), edges: list[np.ndarray] | None = None) -> Boosted:
    """Fit on rows with x (array of numbers), y and optionally row (a number for draws); rows without y are left out."""
    known = pre.filter("y is not null and x is not null")
    if "row" not in known.columns:
        by = [c for c in ("stream_id", "row_idx") if c in known.columns]
        known = known.withColumn("row", F.xxhash64(*(by or ["x", "y"])))
    known = freeze(known.select("x", F.col("y").cast("double").alias("y"), "row"), "boosted-input")
    n, mean, kinds = known.agg(F.count(F.lit(1)), F.avg("y"), F.approx_count_distinct("y")).first()
    if n < 20:
        raise ValueError(f"only {n} rows to fit on")
    if classes and kinds < 2:
        raise ValueError("one class only: the predictor would be constant")
    edges = edges if edges is not None else quantile_edges(known, settings.bins)
    if any(len(e) > settings.bins for e in edges):
        raise ValueError(f"more than {settings.bins} cut points")
    if classes:
        share = known.agg(*[F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(classes)]).first()
        base = np.log((np.array(share, float) + 1e-9 * n) / n)
    else:
        base = np.array([mean])
    s, outputs, inner = settings, len(base), (1 << settings.depth) - 1
    model = Boosted(classes, s, edges, base, np.full((s.rounds, outputs, inner), -1), np.zeros((s.rounds, outputs, inner), np.int64),
                    np.zeros((s.rounds, outputs, inner + 1)))
    width = len(edges)
    rng = np.random.default_rng(s.seed)
    # A round has a level's worth of exchanges between tasks: no more tasks than the rows are worth, or than run at once.
    tasks = max(1, min(slots(pre.sparkSession), n // ROWS))
    rows = dealt(freeze(known.mapInArrow(_prepare(edges), "cell binary, row long"), "boosted-rows"), n, tasks)
    for first in range(0, s.rounds, REFRESH):
        last = min(first + REFRESH, s.rounds)
        allowed = [np.isin(np.arange(width), rng.permutation(width)[:max(1, int(width * s.feature_share))]) for _ in range(first, last)]
        grown = (rows.mapInArrow(_grow(model, first, last, allowed, scratch_path(pre.sparkSession, "boosted-sums")), "feature array<long>, cut array<long>, value array<double>",
                                                    barrier=True).toArrow())
        for name in ("feature", "cut", "value"):
            mine = getattr(model, name)
            mine[first:last] = grown.column(name).combine_chunks().flatten().to_numpy().reshape(mine[first:last].shape)
    return model


# -- scoring ---------------------------------------------------------------------------------
def projection(model: Boosted, dim: int = EMBED_DIM) -> np.ndarray:
    """Fixed random projection of leaf positions, drawn once from the seed and the model's width."""
    width = len(model.feature) * model.outputs
    rng = np.random.default_rng(model.settings.seed)
    return rng.normal(scale=1.0 / np.sqrt(max(width, 1)), size=(width, dim))


def _nested(m: np.ndarray) -> pa.Array:
    """A matrix, or a stack of matrices, as (nested) lists."""
    out = pa.array(np.ascontiguousarray(m).ravel())
    for size, count in zip(m.shape[:0:-1], np.cumprod(m.shape)[-2::-1], strict=True):
        out = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * np.int32(size)), out)
    return out


def score(rows: DataFrame, model: Boosted, *, members: int = 5, leaves: bool = False, embedding: bool = True, sums: bool = False) -> DataFrame:
    """Rows (batch or streaming, with x) with y_pred, raw (scores), embedding (projected leaves) and for classes
    proba and members: probabilities of the model cut at equal shares of its rounds, the last one whole; with
    ``sums`` also the scores once more, as sums of the leaves (``leaf_sum``)."""
    project, rounds = projection(model), len(model.feature)
    stops = [max(1, round(rounds * m / members)) for m in range(1, members + 1)]
    added = [("y_pred", "double"), ("raw", "array<double>")] + ([("embedding", "array<double>")] if embedding else [])
    added += [("proba", "array<double>"), ("members", "array<array<double>>")] if model.classes else []
    added += [("leaf", "array<int>")] if leaves else []
    added += [("leaf_sum", "array<double>")] if sums else []
    kept = [f for f in rows.schema.fields if f.name not in dict(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = LeafMasks(model, 0, rounds)
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                bins = binned(matrix(part.column("x")), model.edges)
                flat, scores, cuts, begin = masks.leaves(bins), np.tile(model.base, (len(bins), 1)).T.copy(), [], 0
                gains = model.gains(flat, 0, rounds)
                for stop in stops:
                    for _ in range(begin, stop):
                        scores += next(gains)
                    cuts.append(scores.T.copy())
                    begin = stop
                scores = cuts[-1]
                out = {"raw": _nested(scores)}
                if embedding:
                    out["embedding"] = _nested(flat.astype(float) @ project)
                if leaves:
                    out["leaf"] = _nested(flat.astype(np.int32))
                if sums:
                    out["leaf_sum"] = _nested(leaf_totals(flat, model))
                if model.classes:
                    p = softmax(scores)
                    out |= {"y_pred": pa.array(p.argmax(1).astype(float)), "proba": _nested(p), "members": _nested(np.stack([softmax(c) for c in cuts], axis=1))}
                else:
                    out["y_pred"] = pa.array(scores[:, 0])
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [out[n] for n, _ in added],
                                                 names=[f.name for f in kept] + [n for n, _ in added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in added])
    return rows.select(*[f.name for f in kept]).mapInArrow(run, schema)


def leaf_totals(leaf: np.ndarray, model: Boosted) -> np.ndarray:
    """The scores of rows with these leaves: base and values of all leaves, added up by output."""
    out = np.tile(model.base, (len(leaf), 1))
    for k in range(model.outputs):
        values = np.ascontiguousarray(model.value[:, k])
        at = leaf[:, k::model.outputs] + np.arange(len(values)) * values.shape[1]
        out[:, k] += values.ravel().take(at).sum(1)
    return out


def leaf_sums(scored: DataFrame, model: Boosted) -> DataFrame:
    """The scores once more, from the leaf positions: ``leaf_sum``."""
    kept = scored.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                leaf = part.column("leaf").flatten().to_numpy().reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, _nested(leaf_totals(leaf, model))], names=[*part.schema.names, "leaf_sum"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["leaf_sum array<double>"])
    return scored.mapInArrow(run, schema)
