"""Streaming operators give one result however their rows are dealt over micro-batches."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillvalid.plans.stream_queries import _stream
from stillvalid.streaming import live


def rows_of(df):
    return sorted(tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def risks(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, None if (i + len(s)) % 7 == 3 else float(rng.random()), 0.6, 0.4) for s in ("a", "bb") for i in range(14)]
    return spark.createDataFrame(rows, "stream_id string, window_idx bigint, risk double, eps double, risk_mean double")


@pytest.mark.parametrize("run", [lambda r: live.feedback(r, 2), lambda r: live.alarms(r, 0.1)])
def test_one_and_many_batches_agree(spark, risks, run):
    with live.keyed_state_store(spark):
        one, many = (rows_of(live.run_available(run(_stream(risks, "t", n)), "t")) for n in (1, 4))
    assert one == many and one


def test_count_windows_by_position(spark):
    rng = np.random.default_rng(9)
    loss = [None if i == 17 else float(rng.random()) for i in range(33)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(loss)], "stream_id string, row_idx bigint, loss double")
    with live.keyed_state_store(spark):
        got = rows_of(live.run_available(live.count_window_risk(_stream(df, "c", 4), 5, "row_idx"), "c"))
    want = [("a", w, None if w == 3 else pytest.approx(np.mean(loss[5 * w:5 * w + 5]))) for w in range(6)]
    assert got == want


@pytest.mark.parametrize("block", [1, 4, 512])
def test_count_windows_share_keys(spark, monkeypatch, block):
    """A key serves a block of windows: far fewer calls, the same windows, open ones kept for later batches."""
    monkeypatch.setattr(live, "WINDOWS_PER_KEY", block)
    df = spark.range(103).selectExpr("concat('s', id % 2) as stream_id", "id div 2 as row_idx", "if(id = 40, null, id / 7D) as loss")
    stream = _stream(df, "k", 3)
    with live.keyed_state_store(spark):
        got = rows_of(live.run_available(live.count_window_risk(stream, 5, "row_idx"), "k"))
    want = [(f"s{s}", w, None if (s, w) == (0, 4) else pytest.approx(np.mean([(2 * i + s) / 7 for i in range(5 * w, 5 * w + 5)])))
            for s in (0, 1) for w in range(10)]
    assert got == want


def test_state_of_a_block_of_count_windows():
    class Value:
        def __init__(self): self.v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    p, value = live._PlacedWindows(2, 3), Value()
    p.sums = value
    first = pd.concat(p.handleInputRows(("a", 1), [pd.DataFrame({"place": [3, 3, 4], "loss": [1.0, 2.0, np.nan]})], None))
    assert first.values.tolist() == [["a", 3, 1.5]] and value.v == ([0, 1, 0], [0.0, 0.0, 0.0], [0, 1, 0])
    second = pd.concat(p.handleInputRows(("a", 1), [pd.DataFrame({"place": [4], "loss": [1.0]})], None))
    assert second.values.tolist() == [["a", 4, None]] and value.v is None


def test_feedback_features_by_hand():
    got = live.feedback_features(np.array([0.2, 0.5, 0.4, 0.6]), 9, 0.3)
    assert got == pytest.approx((1, 9, 0.6, 0.425, np.std([0.2, 0.5, 0.4, 0.6]), 0.2, 0.6, (0.1 + 0.4 / 3) / 2, 0.2, 0.3, 2, 1))
    assert set(live.feedback_features(np.array([]), 0, None)) == {0.0}


def test_lost_window_after_patience(spark, risks):
    lost = risks.filter("not (stream_id = 'a' and window_idx in (4, 5))")
    unknown = risks.withColumn("risk", F.expr("if(stream_id = 'a' and window_idx in (4, 5), null, risk)"))
    with live.keyed_state_store(spark):
        want = rows_of(live.run_available(live.feedback(_stream(unknown, "u", 3), 2), "u"))
        got = rows_of(live.run_available(live.feedback(_stream(lost, "l"), 2, patience=3), "l"))
        stuck = rows_of(live.run_available(live.feedback(_stream(lost, "s", 3), 2), "s"))
        alarms = [rows_of(live.run_available(live.alarms(_stream(df, "m", 1 if p else 3), 0.1, patience=p), "m")) for df, p in ((unknown, None), (lost, 3))]
    assert got == want and len(got) == 28
    assert [r for r in stuck if r[0] == "a"] == [r for r in want if r[0] == "a" and r[1] < 4]
    assert alarms[0] == alarms[1]


def test_lost_window_by_timer(spark, risks, tmp_path):
    """The watermark passes the windows that wait behind a gap: they come out without a later row of their stream."""
    timed = risks.withColumn("t", F.timestamp_seconds(F.col("window_idx") * 3600))
    lost = timed.filter("not (stream_id = 'a' and window_idx = 11)")
    mark = spark.createDataFrame([("end", 0, None, 0.6, 0.4)], "stream_id string, window_idx bigint, risk double, eps double, risk_mean double")
    mark = mark.withColumn("t", F.timestamp_seconds(F.lit(10**7)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(df):
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(timed.schema).parquet(source).withWatermark("t", "1 hour")
        return live.run_available(live.feedback(stream, 2, time="t"), "t", path=out)

    with live.keyed_state_store(spark):
        before = {r[1] for r in rows_of(run(lost)) if r[0] == "a"}
        after = {r[1] for r in rows_of(run(mark)) if r[0] == "a"}
    # The last time is hour 13, so the watermark has passed window 12 already: a timer gives up window 11.
    assert before >= set(range(11)) and after == set(range(14))


def test_window_table_counts_late_rows(spark):
    table = live.WindowTable(spark, "1 hour", delay="10 minutes")

    def batch(*rows):
        return spark.createDataFrame([(s, m * 60, v) for s, m, v in rows], "stream_id string, s long, loss double").select(
            "stream_id", F.timestamp_seconds("s").alias("ts"), "loss")

    table(batch(("a", 5, 0.5), ("a", 50, None), ("a", 65, 0.25)), 0)
    table(batch(("a", 59, 0.5), ("a", 130, 1.0)), 1)        # the mark is 55: the first hour is still open
    table(batch(("a", 10, 0.5), ("a", 70, 0.75), ("b", 20, 0.1)), 2)  # the mark is 120: two hours have ended
    table(batch(("a", 10, 0.5), ("a", 70, 0.75), ("b", 20, 0.1)), 2)  # a repeated batch replaces itself
    got = {(r.stream_id, int(r.h)): (r.n, r.n_known, r.risk, r.n_late) for r in table.windows(final=True).withColumn(
        "h", F.unix_seconds("w_start") / 3600).collect()}
    assert got == {("a", 0): (3, 2, None, 1), ("a", 1): (1, 1, 0.25, 1), ("a", 2): (1, 1, 1.0, 0), ("b", 0): (0, 0, None, 1)}
    assert {(r.stream_id) for r in table.windows().collect()} == {"a", "b"} and table.windows().count() == 3
