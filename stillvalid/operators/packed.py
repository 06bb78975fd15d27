"""The window pass in whole windows at a time, for class scorers with inputs.

Scored rows lie in order in their files, so nearly every window is met whole inside a task. There it becomes its
row of :meth:`fused.WindowPass.run` at once, by array arithmetic over many windows; only the rows of windows that a
file or a split cuts go through the shuffle as they are, and meet behind it. Rows in any other order give the same
result, with more rows shuffled. A window is held by one task only; nothing depends on the length of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PROBA_FLOOR
from .reference import PSI_BINS

#: Rows of cut windows that are worked on in one go.
GATHERED = 20_000


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Arrays (of arrays) of equal length, one line a row; missing entries are NaN."""
    flat = column.combine_chunks()
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return _numbers(flat).reshape(rows, -1)


def _entropy(p: np.ndarray) -> np.ndarray:
    c = np.clip(p, PROBA_FLOOR, 1.0)
    return -(c * np.log(c)).sum(-1)


def _lists(m: np.ndarray) -> pa.Array:
    """One array for each line; NaN becomes a missing entry."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1])),
                                    pa.array(np.ascontiguousarray(m, float).ravel(), from_pandas=True))


def _over_known(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population spread of the known entries of each line; NaN if there are none."""
    known = ~np.isnan(m)
    n = known.sum(1)
    some = np.maximum(n, 1)
    mean = np.where(known, m, 0.0).sum(1) / some
    spread = np.sqrt((np.where(known, m - mean[:, None], 0.0) ** 2).sum(1) / some)
    return np.where(n > 0, mean, np.nan), np.where(n > 0, spread, np.nan)


class Windows:
    """Rows of whole windows to one row each. ``run`` is picklable work of the tasks of :func:`window_pass`."""

    def __init__(self, classes: int, width: int, embedding: int, quantiles: list[float], bins: int):
        self.classes, self.width, self.embedding, self.quantiles, self.bins = classes, width, embedding, quantiles, bins
        scalars = ["msp", "msp_std", "ent", "ent_std", "ent_max", "ent_q90", "gap", "energy", "energy_q10", "alea", "epi",
                   "member_var", "norm", "norm_std"]
        sums = ["top", "ece", "total", "products", "known", "sum", "square", "psi"] + (["eknown", "esum"] if embedding else [])
        self.fields = [("n", "bigint")] + [(c, "double") for c in scalars] + [("n_whole", "bigint")] + [
            (c, "array<double>") for c in ["msp_q", *[f"s_{c}" for c in sums], *[f"z{j}" for j in range(width)]]]
        self.frozen: dict[str, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = {}

    def _vectors(self, rows: pa.Table, streams: list[str], code: np.ndarray) -> None:
        """The frozen means, spreads and cut points of each stream, which come with some of its rows."""
        for k, s in enumerate(streams):
            if s not in self.frozen:
                at = np.flatnonzero((code == k) & rows.column("_mean").combine_chunks().is_valid().to_numpy(zero_copy_only=False))[0]
                mean, std, cuts = (rows.column(c)[int(at)].as_py() for c in ("_mean", "_std", "_cuts"))
                self.frozen[s] = np.array(mean, float), np.array(std, float), [np.array(c or [], float) for c in cuts]

    def of(self, rows: pa.Table, size: int) -> pa.RecordBatch:
        """One row for each window; ``rows`` has windows of this many rows, one after the other and each in order."""
        total, count = rows.num_rows, rows.num_rows // size
        coded = rows.column("stream_id").combine_chunks().dictionary_encode()
        code, streams = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self._vectors(rows, streams, code)

        def lines(v: np.ndarray) -> np.ndarray:
            return v.reshape(count, size)

        def added(m: np.ndarray) -> np.ndarray:
            return m.reshape(count, size, -1).sum(1)

        p, y, k = _matrix(rows.column("proba"), total), _numbers(rows.column("y")), self.classes
        conf, top = p.max(1), p.argmax(1)
        ranked = np.sort(np.clip(p, PROBA_FLOOR, 1.0), axis=1)
        gap = ranked[:, -1] - ranked[:, -2] if k > 1 else np.zeros(total)
        raw = _matrix(rows.column("raw"), total)
        raw = np.concatenate([np.zeros_like(raw), raw], axis=1) if raw.shape[1] == 1 else raw
        high = raw.max(1)
        members = np.clip(_matrix(rows.column("members"), total).reshape(total, -1, k), PROBA_FLOOR, 1.0)
        alea = _entropy(members).mean(1)
        ok, edges = (top == y).astype(float), np.array([i * (1.0 / self.bins) for i in range(self.bins)])
        place, hot = np.searchsorted(edges, conf, side="left"), np.zeros((total, self.bins))
        hot[np.arange(total), np.maximum(place - 1, 0)] = np.where(place > 0, ok - conf, 0.0)
        msp, ent, energy = lines(np.clip(conf, PROBA_FLOOR, 1.0)), lines(_entropy(p)), lines(
            -(high + np.log(np.exp(raw - high[:, None]).sum(1))))
        out: dict[str, np.ndarray] = {
            "n": np.full(count, size), "msp": msp.mean(1), "msp_std": msp.std(1), "msp_q": np.quantile(msp, self.quantiles, axis=1).T,
            "ent": ent.mean(1), "ent_std": ent.std(1), "ent_max": ent.max(1), "ent_q90": np.quantile(ent, 0.9, axis=1),
            "gap": lines(gap).mean(1), "energy": energy.mean(1), "energy_q10": np.quantile(energy, 0.1, axis=1),
            "alea": lines(alea).mean(1), "epi": lines(_entropy(members.mean(1)) - alea).mean(1),
            "member_var": lines(members[:, :, -1].std(1) ** 2).mean(1),
            "s_top": added(top[:, None] == np.arange(k)), "s_ece": added(hot)}

        x, bin_of = _matrix(rows.column("x"), total), np.zeros((total, self.width), np.int64)
        mean, std = (np.stack([self.frozen[s][i] for s in streams])[code] for i in (0, 1))
        z = (x - mean) / std
        for c, s in enumerate(streams):
            own = slice(None) if len(streams) == 1 else np.flatnonzero(code == c)
            for j, cuts in enumerate(self.frozen[s][2]):
                bin_of[own, j] = np.searchsorted(cuts, x[own, j], side="right")
        known = ~np.isnan(z)
        whole = known.all(1)
        zero, clean = np.where(known, z, 0.0), np.where(whole[:, None], z, 0.0)
        cell = (np.repeat(np.arange(count), size)[:, None] * self.width + np.arange(self.width)) * PSI_BINS + bin_of
        out |= {"n_whole": lines(whole).sum(1), "s_total": added(clean), "s_products": added(clean[:, :, None] * clean[:, None, :]),
                "s_known": added(known), "s_sum": added(zero), "s_square": added(zero * zero),
                "s_psi": np.bincount(cell[known & (bin_of < PSI_BINS)], minlength=count * self.width * PSI_BINS).reshape(count, -1)}
        out |= {f"z{j}": lines(z[:, j]) for j in range(self.width)}
        vector = z
        if self.embedding:
            vector = _matrix(rows.column("embedding"), total)
            there = ~np.isnan(vector)
            out |= {"s_eknown": added(there), "s_esum": added(np.where(there, vector, 0.0))}
        out["norm"], out["norm_std"] = _over_known(lines(np.sqrt((vector * vector).sum(1))))

        head = rows.take(pa.array(np.arange(count) * size))
        made = [head.column(c).combine_chunks() for c in ("stream_id", "window_idx")]
        for name, kind in self.fields:
            v = out[name]
            made.append(_lists(v) if kind.startswith("array") else pa.array(v.astype(np.int64)) if kind == "bigint"
                        else pa.array(v.astype(float), from_pandas=True))
        return pa.RecordBatch.from_arrays(made, names=["stream_id", "window_idx", *[n for n, _ in self.fields]])

    def of_any(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole windows in any order and of any size."""
        rows = rows.sort_by([("stream_id", "ascending"), ("window_idx", "ascending"), ("seg_row", "ascending")]).combine_chunks()
        begin = _starts(rows)
        size = np.diff(begin, append=rows.num_rows)
        for n in np.unique(size):
            at = begin[size == n][:, None] + np.arange(n)
            yield self.of(rows.take(pa.array(at.ravel())), int(n))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where another window begins than that of the row before."""
    stream = rows.column("stream_id").combine_chunks().dictionary_encode().indices.to_numpy()
    window = rows.column("window_idx").to_numpy()
    return np.flatnonzero(np.concatenate([[True], (np.diff(stream) != 0) | (np.diff(window) != 0)]))


def window_pass(rows: DataFrame, windows: Windows, size: int) -> DataFrame:
    """One row per window with the fields of ``windows``; ``rows`` carries the frozen vectors of its stream."""
    columns = ["stream_id", "window_idx", "seg_row", "y", "proba", "raw", "members", "x", *(["embedding"] if windows.embedding else [])]
    vectors = ["_mean", "_std", "_cuts"]
    # Windows have the same number of rows, and the first one brings the vectors.
    first = F.col("seg_row") == F.col("window_idx") * size
    sent = rows.select(*[F.col(c) for c in columns], *[F.when(first, F.col(c)).alias(c) for c in vectors])
    own = ", ".join(f"`{n}` {t}" for n, t in windows.fields)
    later = [f for f in sent.schema.fields if f.name not in ("stream_id", "window_idx")]
    both = f"stream_id string, window_idx bigint, {own}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in later)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream_id", "window_idx", *[n for n, _ in windows.fields], *[f.name for f in later]]
        schema = None

        def filled(part: pa.RecordBatch | pa.Table) -> pa.Table:
            return pa.table([part.column(n) if n in part.schema.names else pa.nulls(part.num_rows, schema.field(n).type) for n in names], schema=schema)

        def split(table: pa.Table, end: bool) -> tuple[list[pa.Table], pa.Table]:
            """What is ready, and the last window, which may go on in the next batch."""
            begin = _starts(table)
            length = np.diff(begin, append=table.num_rows)
            kept = table.num_rows if end else int(begin[-1])
            begin, length = (begin, length) if end else (begin[:-1], length[:-1])
            ready = []
            full = length == size
            if full.any():
                at = (begin[full][:, None] + np.arange(size)).ravel()
                inner = table if len(at) == table.num_rows else table.take(pa.array(at))
                row = inner.column("seg_row").to_numpy().reshape(-1, size)
                if (np.diff(row, axis=1) < 0).any():
                    order = (np.argsort(row, axis=1, kind="stable") + np.arange(len(row))[:, None] * size).ravel()
                    inner = inner.take(pa.array(order))
                ready.append(filled(windows.of(inner.combine_chunks(), size)))
            if not full.all():
                cut = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[~full], length[~full], strict=True)])
                ready.append(filled(table.take(pa.array(cut))))
            return ready, table.slice(kept)

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                kinds = {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
                schema = pa.schema([("stream_id", pa.string()), ("window_idx", pa.int64()), *[(n, kinds[t]) for n, t in windows.fields],
                                    *[(f.name, batch.schema.field(f.name).type) for f in later]])
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None and rest.num_rows else table
            ready, rest = split(table, False)
            for part in ready:
                yield from part.combine_chunks().to_batches()
        if rest is not None and rest.num_rows:
            for part in split(rest.combine_chunks(), True)[0]:
                yield from part.combine_chunks().to_batches()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = ["stream_id", "window_idx", *[n for n, _ in windows.fields]]
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ready = table.column("n").is_valid()
            yield from table.filter(ready).select(done).combine_chunks().to_batches()
            cut = table.filter(table.column("n").is_null()).select(sent_names)
            if cut.num_rows:
                held.append(cut)
            if sum(t.num_rows for t in held) >= GATHERED:
                rows = pa.concat_tables(held).combine_chunks()
                last = int(_starts(rows)[-1])       # this window may go on
                held = [rows.slice(last)]
                if last:
                    yield from windows.of_any(rows.slice(0, last).combine_chunks())
        if held:
            yield from windows.of_any(pa.concat_tables(held).combine_chunks())

    sent_names = sent.columns
    meeting = sent.mapInArrow(whole, both).repartition("stream_id", "window_idx").sortWithinPartitions("stream_id", "window_idx")
    return meeting.mapInArrow(met, f"stream_id string, window_idx bigint, {own}")
