"""The monitor as Structured Streaming jobs.

Each function takes and returns streaming DataFrames. On a replayed table every result equals the
batch operator for windows the watermark has closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Count windows whose sums are one key's state: a call of Python and of the store serves all of them.
WINDOWS_PER_KEY = 512


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """Custom keyed state needs the RocksDB store; the session's own choice is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything that is available into files and return them as a table.

    A later call with the same ``path`` goes on where the earlier one has stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    job = (stream.writeStream.format("parquet").outputMode(mode)
           .option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def join_labels(predictions: DataFrame, labels: DataFrame, max_delay: str, *,
                keep_unlabelled: bool = False) -> DataFrame:
    """Match predictions with labels arriving up to ``max_delay`` later.

    Both sides carry watermarks, so the join drops its state once no partner can come. With
    ``keep_unlabelled`` a prediction without a label in time comes out with NULL label columns.
    """
    on = (F.expr(f"event_id = label_id and p_stream = l_stream and label_ts >= ts "
                 f"and label_ts <= ts + interval {max_delay}"))
    left = predictions.withColumnRenamed("stream_id", "p_stream")
    right = labels.withColumnRenamed("stream_id", "l_stream")
    out = left.join(right, on, "left_outer" if keep_unlabelled else "inner")
    return out.withColumnRenamed("p_stream", "stream_id").drop("l_stream", "label_id")


class WindowTable:
    """Risk per event-time window, from any order of arrival, with late rows counted.

    Each micro-batch adds its own sums per window to a table (a folder of its number, so a repeated
    batch replaces itself); no state is held between batches. Reading the table merges them: the
    watermark before a batch is the latest event time of all earlier batches less ``delay``, and rows
    of a window that had ended by then are late. They are counted (``n_late``) and left out of the
    risk, as the window had been reported. A window is reported once the watermark has passed it, or
    with ``final`` (the source has ended) in any case. An outer join before the table hands a row
    without partner on in the batch after the one that moved its watermark: ``lag`` such batches.

    Rows of the stream ``MARKER`` move watermarks at the end of a source and belong to no window. They
    are left out here: a filter in the streaming plan would move below the watermark and undo them.
    """

    MARKER = "__end__"

    def __init__(self, spark: SparkSession, duration: str, slide: str | None = None, *,
                 delay: str = "0 seconds", lag: int = 0, path: str | None = None):
        self.spark, self.duration, self.slide, self.delay, self.lag = spark, duration, slide, delay, lag
        self.path = path or scratch_path(spark, "window-sums")

    schema = ("stream_id string, w_start timestamp, w_end timestamp, n long, n_known long, total double, "
              "last timestamp, batch long")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """Add one micro-batch (stream_id, ts, loss); for ``foreachBatch``."""
        window = F.window("ts", self.duration, self.slide) if self.slide else F.window("ts", self.duration)
        sums = rows.filter(F.col("stream_id") != self.MARKER).groupBy("stream_id", window.alias("w")).agg(
            F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_known"), F.sum("loss").alias("total"),
            F.max("ts").alias("last"))
        sums.select("stream_id", F.col("w.start").cast("timestamp").alias("w_start"), F.col("w.end").cast("timestamp").alias("w_end"),
                    "n", "n_known", "total", F.col("last").cast("timestamp").alias("last")).write.mode("overwrite").parquet(
            f"{self.path}/batch={batch}")

    def windows(self, final: bool = False) -> DataFrame:
        """stream_id, w_start, w_end, n, n_known, risk, n_late of every reported window."""
        sums = self.spark.read.schema(self.schema).parquet(self.path)
        clock = sums.groupBy("batch").agg(F.max("last").alias("last"))            # a row for each batch
        before = Window.orderBy("batch").rangeBetween(Window.unboundedPreceding, -1 - self.lag)
        clock = clock.select("batch", (F.max("last").over(before) - F.expr(f"interval {self.delay}")).alias("mark"))
        late = F.coalesce(F.col("w_end") <= F.col("mark"), F.lit(False))
        own = {c: F.sum(F.when(late, 0).otherwise(F.col(c))).cast(kind).alias(c)
               for c, kind in (("n", "long"), ("n_known", "long"), ("total", "double"))}
        out = sums.join(clock, "batch").groupBy("stream_id", "w_start", "w_end").agg(
            *own.values(), F.sum(F.when(late, F.col("n")).otherwise(0)).cast("long").alias("n_late"))
        if not final:
            now = sums.agg((F.max("last") - F.expr(f"interval {self.delay}")).alias("_now"))    # one row
            out = out.join(F.broadcast(now)).filter("w_end <= _now").drop("_now")
        risk = F.when((F.col("n") == F.col("n_known")) & (F.col("n") > 0), F.round(F.col("total") / F.col("n"), 12))
        return out.select("stream_id", "w_start", "w_end", "n", "n_known", risk.alias("risk"), "n_late")


def run_into(stream: DataFrame, table: WindowTable, checkpoint: str) -> int:
    """Process what is available into a window table, going on from the checkpoint.

    Returns how many rows the query's own watermarks (of joins before the table) have dropped.
    """
    job = (stream.writeStream.foreachBatch(table).outputMode("append")
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    job.awaitTermination()
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in job.recentProgress for op in p["stateOperators"])


def window_risk(losses: DataFrame, duration: str, slide: str | None = None) -> DataFrame:
    """Mean loss per event-time window; unknown as soon as one label is missing.

    ``losses`` needs stream_id, ts (with a watermark) and loss.
    """
    window = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    out = losses.groupBy("stream_id", window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_known"),
        F.round(F.avg("loss"), 12).alias("_mean"))
    risk = F.when(F.col("n") == F.col("n_known"), F.col("_mean"))
    return out.select("stream_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"),
                      "n", "n_known", risk.alias("risk"))


class _ArrivalWindows(StatefulProcessor):
    """Running (window number, rows, loss sum, unknown losses) of the open count window per stream."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", T.StructType([
            T.StructField("idx", T.LongType()), T.StructField("n", T.LongType()),
            T.StructField("total", T.DoubleType()), T.StructField("unknown", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        idx, n, total, unknown = self.open.get() if self.open.exists() else (0, 0, 0.0, 0)
        loss = batch["loss"].to_numpy(dtype=float)
        place = n + np.arange(len(loss))
        window = idx + place // self.size
        known = np.isfinite(loss)
        out = []
        for w in np.unique(window):
            here = window == w
            first = w == idx
            rows_here = int(here.sum()) + (n if first else 0)
            s = float(loss[here & known].sum()) + (total if first else 0.0)
            missing = int((here & ~known).sum()) + (unknown if first else 0)
            if rows_here == self.size:
                out.append((key[0], int(w), None if missing else round(s / self.size, 12)))
                last = (int(w) + 1, 0, 0.0, 0)
            else:
                last = (int(w), rows_here, s, missing)
        self.open.update(last)
        yield pd.DataFrame(out, columns=["stream_id", "window_idx", "risk"])

    def close(self) -> None:
        pass


class _PlacedWindows(StatefulProcessor):
    """(rows, loss sum, unknown losses) of each window of a block; a window comes out once all its rows are there."""

    def __init__(self, size: int, block: int):
        self.size, self.block = size, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", T.StructType([
            T.StructField("n", T.ArrayType(T.LongType())), T.StructField("total", T.ArrayType(T.DoubleType())),
            T.StructField("unknown", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.sums.get() if self.sums.exists() else [[0] * self.block] * 3
        n, total, unknown = (np.array(v, dtype) for v, dtype in zip(state, (np.int64, float, np.int64), strict=True))
        for batch in rows:
            loss = batch["loss"].to_numpy(dtype=float)
            known, at = np.isfinite(loss), batch["place"].to_numpy(np.int64) - key[1] * self.block
            n += np.bincount(at, minlength=self.block)
            total += np.bincount(at[known], loss[known], self.block)
            unknown += np.bincount(at[~known], minlength=self.block)
        whole = np.flatnonzero(n >= self.size)
        out = [(key[0], int(key[1] * self.block + w), None if unknown[w] else round(float(total[w]) / self.size, 12)) for w in whole]
        for v in (n, total, unknown):
            v[whole] = 0
        if n.any():
            self.sums.update((n.tolist(), total.tolist(), unknown.tolist()))
        else:
            self.sums.clear()
        yield pd.DataFrame(out, columns=["stream_id", "window_idx", "risk"])

    def close(self) -> None:
        pass


def count_window_risk(losses: DataFrame, size: int, position: str | None = None) -> DataFrame:
    """Risk of every ``size`` consecutive rows of a stream.

    With ``position``, a column that numbers the rows of a stream (0, 1, 2, ...), a row's window is
    known whenever it arrives: blocks of ``WINDOWS_PER_KEY`` windows are keyed on their own, so rows may
    come in any order over any number of micro-batches, and no task holds a stream. Without it windows follow arrival: rows
    of one micro-batch are ordered by (ts, event_id), and a row that comes in a later batch than its
    successors joins the window open at that time.
    """
    schema = T.StructType([T.StructField("stream_id", T.StringType()),
                           T.StructField("window_idx", T.LongType()),
                           T.StructField("risk", T.DoubleType())])
    if position is not None:
        placed = losses.select("stream_id", F.floor(F.col(position) / size).alias("place"), "loss").withColumn(
            "block", F.floor(F.col("place") / WINDOWS_PER_KEY))
        return placed.groupBy("stream_id", "block").transformWithStateInPandas(
            statefulProcessor=_PlacedWindows(size, WINDOWS_PER_KEY), outputStructType=schema, outputMode="Append",
            timeMode="None")
    return losses.select("stream_id", "ts", "event_id", "loss").groupBy(
        "stream_id").transformWithStateInPandas(
        statefulProcessor=_ArrivalWindows(size), outputStructType=schema, outputMode="Append",
        timeMode="None")


class _InOrder(StatefulProcessor):
    """Hands the windows of a stream on in their order 0, 1, 2, ..., whatever order they arrive in.

    A window waits until all earlier ones have come; one that comes again is ignored. A window that
    never comes does not hold its stream up: it is handed on without values once a window ``patience``
    places later is there, or once the watermark has passed a window that waits behind it (then by a
    timer, whether or not more rows come). A given-up window that comes after all is counted.
    """

    fields: tuple[str, ...] = ("risk",)
    patience: int | None = None
    timed: bool = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = [T.StructField("window_idx", T.LongType()), T.StructField("ms", T.LongType())]
        kept += [T.StructField(f, T.DoubleType()) for f in self.fields]
        self.handle = handle
        self.ahead = handle.getListState("ahead", T.StructType(kept))
        self.next = handle.getValueState("next", T.StructType([
            T.StructField("window_idx", T.LongType()), T.StructField("n_late", T.LongType())]))

    def in_order(self, rows, timer_values) -> list[tuple]:
        """(window_idx, fields...) of the windows that are now due; without values for lost ones."""
        due, late = self.next.get() if self.next.exists() else (0, 0)
        waiting = {r[0]: tuple(r) for r in (self.ahead.get() if self.ahead.exists() else ())}
        for batch in rows:
            for r in batch[["window_idx", "ms", *self.fields]].itertuples(index=False, name=None):
                if r[0] >= due:
                    waiting[int(r[0])] = (int(r[0]), int(r[1]), *(
                        float(v) if v is not None and np.isfinite(v) else None for v in r[2:]))
                else:
                    late += 1
        mark = timer_values.getCurrentWatermarkInMs() if self.timed else -1
        out = []
        while waiting:
            if due in waiting:
                r = waiting.pop(due)
                out.append((r[0], *r[2:]))
            elif (self.patience is not None and max(waiting) >= due + self.patience) or (
                    self.timed and min(r[1] for r in waiting.values()) <= mark):
                out.append((due, *[None] * len(self.fields)))
            else:
                break
            due += 1
        self.next.update((due, late))
        if waiting:
            self.ahead.put(list(waiting.values()))
            if self.timed:
                self.handle.registerTimer(min(r[1] for r in waiting.values()))
        elif self.ahead.exists():
            self.ahead.clear()
        return out

    def hand_on(self, key, windows: list[tuple]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.hand_on(key, self.in_order(rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.hand_on(key, self.in_order((), timerValues))

    def close(self) -> None:
        pass


def _ordered(risks: DataFrame, processor: _InOrder, schema: T.StructType, time: str | None,
             patience: int | None) -> DataFrame:
    """Run a processor per stream; with ``time``, a column with a watermark, gaps end by timers."""
    processor.patience, processor.timed = patience, time is not None
    # As a plain number the time is no event-time column any more: late windows come through and are counted.
    ms = F.unix_millis(F.col(time)) if time else F.lit(0).cast("long")
    return risks.select("stream_id", "window_idx", ms.alias("ms"), *processor.fields).groupBy(
        "stream_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="EventTime" if time else "None")


def feedback_features(a: np.ndarray, n: int, reference: float | None) -> tuple[float, ...]:
    """The batch operator's features of the latest known risks ``a`` (oldest first) out of ``n``."""
    if n == 0:
        return (0.0,) * (len(FEEDBACK_COLUMNS) - 2)
    moves = np.diff(a)
    signs = np.sign(moves)[np.sign(moves) != 0]
    i, j = np.triu_indices(len(a), 1)
    falls = np.flatnonzero(moves <= 0)
    run = len(moves) - (falls[-1] + 1 if falls.size else 0)
    many = len(a) >= 3
    return (1.0, float(n), a[-1], a.mean(), a.std(), a.min(), a.max(),
            float(np.median((a[j] - a[i]) / (j - i))) if len(a) >= 2 else 0.0,
            moves[-1] if len(a) >= 2 else 0.0,
            a[-1] - reference if reference is not None else 0.0,
            float((signs[1:] != signs[:-1]).sum()) if many else 0.0, float(run) if many else 0.0)


class _Feedback(_InOrder):
    """Last risks per stream: ``delay`` not yet usable ones and the ``k`` latest known ones."""

    fields = ("risk", "risk_mean")

    def __init__(self, delay: int, k: int):
        self.delay, self.k = delay, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        one = T.StructType([T.StructField("risk", T.DoubleType())])
        self.recent, self.waiting = handle.getListState("recent", one), handle.getListState("waiting", one)
        self.seen = handle.getValueState("seen", T.StructType([
            T.StructField("n", T.LongType()), T.StructField("reference", T.DoubleType())]))

    def hand_on(self, key, windows: list[tuple]) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        n, known = self.seen.get() if self.seen.exists() else (0, None)
        out = []
        for window, risk, reference in windows:
            known = reference = known if reference is None else reference
            waiting.append(risk)
            if len(waiting) > self.delay:
                ready = waiting.pop(0)
                if ready is not None:
                    recent = (recent + [ready])[-self.k:]
                    n += 1
            out.append((key[0], window, *feedback_features(np.asarray(recent), n, reference)))
        for state, values in ((self.recent, recent), (self.waiting, waiting)):
            if values:
                state.put([(v,) for v in values])
            elif state.exists():
                state.clear()
        self.seen.update((n, known))
        yield pd.DataFrame(out, columns=FEEDBACK_COLUMNS)


FEEDBACK_COLUMNS = ["stream_id", "window_idx", "fb_available", "fb_n_matured", "fb_risk_last",
                    "fb_risk_mean", "fb_risk_std", "fb_risk_min", "fb_risk_max", "fb_risk_slope",
                    "fb_risk_delta", "fb_risk_vs_reference", "fb_sign_changes",
                    "fb_increasing_run"]


def feedback(risks: DataFrame, delay: int, k: int = 5, *, time: str | None = None,
             patience: int | None = None) -> DataFrame:
    """Feedback features from the risks a monitor may know at each window.

    ``risks`` needs stream_id, window_idx (0, 1, 2, ...), risk and risk_mean (the reference's; it may
    be NULL). With delay 0 the window's own risk counts as known, as in the batch operator. Windows
    may arrive in any order. A lost window counts as one of unknown risk after ``patience`` later
    ones or, with ``time``, once the watermark has passed a later one.
    """
    schema = T.StructType([T.StructField("stream_id", T.StringType()),
                           T.StructField("window_idx", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in FEEDBACK_COLUMNS[2:]])
    return _ordered(risks, _Feedback(delay, max(k, 2)), schema, time, patience)


class _Alarm(_InOrder):
    """The earliest warning since the last violation."""

    fields = ("risk", "eps")

    def __init__(self, margin: float):
        self.margin = margin

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.warned = handle.getValueState("warned", T.StructType([
            T.StructField("at", T.LongType())]))

    def hand_on(self, key, windows: list[tuple]) -> Iterator[pd.DataFrame]:
        at = self.warned.get()[0] if self.warned.exists() else -1
        out = []
        for window, risk, eps in windows:
            if risk is None:
                continue
            if risk > eps:
                out.append((key[0], window, at, window - at if at >= 0 else -1))
                at = -1
            elif at < 0 and risk > eps - self.margin:
                at = window
        self.warned.update((at,))
        yield pd.DataFrame(out, columns=["stream_id", "violation_at", "warning_at", "lead_time"])


def alarms(risks: DataFrame, margin: float, *, time: str | None = None,
           patience: int | None = None) -> DataFrame:
    """One row per violation with the warning that preceded it (-1 where there was none).

    ``risks`` needs stream_id, window_idx (0, 1, 2, ...), risk and eps, in any order of arrival. A
    warning is the first window since the last violation whose risk is within ``margin`` of the
    threshold. Lost windows are passed over as in ``feedback``.
    """
    schema = T.StructType([T.StructField("stream_id", T.StringType())]
                          + [T.StructField(c, T.LongType())
                             for c in ("violation_at", "warning_at", "lead_time")])
    return _ordered(risks, _Alarm(margin), schema, time, patience)
