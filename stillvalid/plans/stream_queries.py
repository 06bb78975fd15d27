"""Queries that replay stored tables through the streaming monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import uniform
from ..operators.risk import bounded_absolute_error
from ..session import freeze, scratch_path
from ..streaming import live
from .catalog import query
from .monitor import Monitor, monitor
from .specs import EVENTS

WATERMARK = "10 minutes"
MAX_DELAY = "1 hour"
#: Micro-batches of the replays.
BATCHES = 5
#: Rows arrive up to so many seconds after their event; this share of them only in the last batch.
JITTER, STRAY = 480, 0.01


def _stream(df: DataFrame, label: str, batches: int = 1) -> DataFrame:
    """Replay a table as a stream of files; with more batches, rows dealt over them without order."""
    path = scratch_path(df.sparkSession, label)
    reader = df.sparkSession.readStream.schema(df.schema)
    if batches > 1:
        df = df.repartition(batches, F.xxhash64(*df.columns))
        reader = reader.option("maxFilesPerTrigger", 1)
    df.write.parquet(path)
    return reader.parquet(path)


def _events(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.expr(EVENTS.stream).alias("stream_id"), "event_id", F.col("ts").cast("timestamp"),
        F.col("event_type").alias("score_key"), F.col("value").alias("y"))


def _arrivals(df: DataFrame, ts: str, key: str, stray: float = STRAY) -> DataFrame:
    """``_batch``: the micro-batch in which each row arrives, out of order within the jitter; strays come last."""
    span = df.agg(F.min(F.unix_micros(ts)).alias("_t0"), F.max(F.unix_micros(ts)).alias("_t1"))     # one row
    at = F.unix_micros(ts) + F.floor(uniform("jitter", key) * (JITTER * 1000000)) - F.col("_t0")
    place = F.least(F.floor(at * BATCHES / (F.col("_t1") - F.col("_t0") + 1)), F.lit(BATCHES - 1))
    return df.join(F.broadcast(span)).withColumn(
        "_batch", F.when(uniform("stray", key) < stray, F.lit(BATCHES - 1)).otherwise(place).cast("int")).drop("_t0", "_t1")


class _Replay:
    """A table that arrives batch after batch; a source stream reads what has arrived so far."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.columns = df.sparkSession, [c for c in df.columns if c != "_batch"]
        self.path, self.all = scratch_path(self.spark, label), freeze(df, f"{label}-all", partition_by=("_batch",))
        self.schema = self.all.select(*self.columns).schema

    def arrive(self, batch: int) -> None:
        self.all.filter(F.col("_batch") == batch).select(*self.columns).write.mode("append").parquet(self.path)

    def mark(self, *values) -> None:
        """The end of the source: one row that moves the watermark past everything."""
        self.spark.createDataFrame([values], self.schema).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def _window_table(spark, folder, duration: str, slide: str | None = None) -> DataFrame:
    """Windows over five batches of scored events, strays counted as late."""
    m = monitor(spark, folder, EVENTS)
    replay = _Replay(_arrivals(_events(spark, folder), "ts", "event_id"), "replay")
    table, state = live.WindowTable(spark, duration, slide, delay=WATERMARK), scratch_path(spark, "replay-state")
    for batch in range(BATCHES):
        replay.arrive(batch)
        live.run_into(m.scored(replay.stream()).select("stream_id", "event_id", "ts", "loss"), table, state)
    return _micros(table.windows(final=True), "w_start", "w_end")


def _label_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Predictions and, apart from them, labels that come up to two hours late or (5 %) never."""
    m = monitor(spark, folder, EVENTS)
    base = _events(spark, folder)
    predictions = m.scored(base.withColumn("y", F.lit(0.0))).select(
        "stream_id", "event_id", "ts", "y_pred", "scale")
    late = F.floor(uniform("late", "event_id") * 7200)
    labels = base.filter(uniform("missing", "event_id") >= 0.05).select(
        "stream_id", F.col("event_id").alias("label_id"), F.col("y").alias("label"),
        F.timestamp_micros(F.unix_micros("ts") + late * 1000000).alias("label_ts"))
    return predictions, labels


def _label_replays(spark, folder) -> tuple[_Replay, _Replay]:
    """Both tables batch after batch, by one clock."""
    predictions, labels = _label_tables(spark, folder)
    return (_Replay(_arrivals(predictions, "ts", "event_id", 0.0), "predictions"),
            _Replay(_arrivals(labels, "label_ts", "label_id", 0.0), "labels"))


def _joined(replays: tuple[_Replay, _Replay], **options) -> DataFrame:
    predictions, labels = replays
    return live.join_labels(predictions.stream().withWatermark("ts", WATERMARK),
                            labels.stream().withWatermark("label_ts", WATERMARK), MAX_DELAY, **options)


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as whole microseconds, free of time-zone display rules."""
    for c in columns:
        df = df.withColumn(c, F.unix_micros(c))
    return df


@query("r1_label_join")
def _(spark, folder):
    """Predictions joined to labels that arrive at most one hour later, over five batches."""
    replays, path = _label_replays(spark, folder), scratch_path(spark, "joined")
    for batch in range(BATCHES):
        for replay in replays:
            replay.arrive(batch)
        live.run_available(_joined(replays), "joined", path=path)
    return spark.read.parquet(f"{path}/data").select("stream_id", "event_id", "label", "y_pred")


@query("r2_tumbling_risk")
def _(spark, folder):
    """R2: risk per one-hour window from five batches out of order; rows behind the watermark are counted."""
    return _window_table(spark, folder, "1 hour").fillna(-1.0, ["risk"])


@query("r3_sliding_risk")
def _(spark, folder):
    """Risk per three-hour window every hour, as R2."""
    return _window_table(spark, folder, "3 hours", "1 hour").fillna(-1.0, ["risk"])


@query("r4_missing_labels")
def _(spark, folder):
    """Risk per six-hour window after the label join; a missing label leaves it unknown.

    After the last batch markers on both sides end the replay, so that predictions still waiting for
    a label come out and every window is reported.
    """
    replays = _label_replays(spark, folder)
    loss = bounded_absolute_error(F.col("label"), F.col("y_pred"), F.col("scale"))
    # The longest delay of a label and the watermark's.
    table, state = live.WindowTable(spark, "6 hours", delay="70 minutes", lag=1), scratch_path(spark, "matured-state")
    end = _events(spark, folder).agg(F.max("ts") + F.expr("interval 3 days")).first()[0]
    # A batch works with the watermark of the batches before it: the second marker's acts on the first's.
    for batch in range(BATCHES + 2):
        if batch < BATCHES:
            for replay in replays:
                replay.arrive(batch)
        else:
            replays[0].mark(table.MARKER, -2 * batch, end, 0.0, 1.0)
            replays[1].mark(table.MARKER, -2 * batch - 1, 0.0, end)
        rows = _joined(replays, keep_unlabelled=True).withColumn("loss", loss)
        live.run_into(rows.select("stream_id", "ts", "loss"), table, state)
    # -1 stands for an unknown risk so that the column has no gaps.
    return _micros(table.windows(final=True), "w_start", "w_end").fillna(-1.0, ["risk"])


def _risk_stream(m: Monitor, label: str) -> DataFrame:
    rows = m.risk.join(m.eps, "stream_id").join(m.reference_risk, "stream_id")
    return _stream(rows.select("stream_id", "window_idx", "risk", "eps", "risk_mean"), label, BATCHES)


@query("r5_feedback")
def _(spark, folder):
    """Feedback features from keyed state, with a delay of two windows."""
    m = monitor(spark, folder, EVENTS)
    with live.keyed_state_store(spark):
        return live.run_available(live.feedback(_risk_stream(m, "risks"), 2), "feedback")


@query("r5_feedback_gaps")
def _(spark, folder):
    """Feedback features of streams that lose every 13th window; a lost one counts as unknown."""
    m = monitor(spark, folder, EVENTS)
    rows = m.risk.join(m.reference_risk, "stream_id").filter("window_idx % 13 <> 6").select(
        "stream_id", "window_idx", "risk", "risk_mean")
    with live.keyed_state_store(spark):
        out = live.run_available(live.feedback(_stream(rows, "gaps"), 2, patience=3), "gaps")
    return out.select("stream_id", "window_idx", "fb_n_matured", "fb_risk_last", "fb_risk_mean", "fb_risk_max")


@query("r6_count_windows")
def _(spark, folder):
    """Risk of every 20 consecutive rows of a stream, from rows in any order over five batches."""
    m = monitor(spark, folder, EVENTS)
    rows = _stream(m.rows.select("stream_id", "row_idx", "loss"), "rows", BATCHES)
    with live.keyed_state_store(spark):
        return live.run_available(live.count_window_risk(rows, 20, "row_idx"), "counts")


@query("r7_alarms")
def _(spark, folder):
    """Violations with their lead time."""
    m = monitor(spark, folder, EVENTS)
    with live.keyed_state_store(spark):
        return live.run_available(live.alarms(_risk_stream(m, "alarm-risks"), 0.03), "alarms")
