"""Monitoring a given prediction log: losses, refusals, the embedding view."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stillvalid.operators import scorer
from stillvalid.plans.monitor import Monitor
from stillvalid.sources.stream_log import StreamSpec

SPEC = StreamSpec(name="log", table="", stream="s", order=("i",), time="i", target="y", score_key="s",
                  classes=2, proba="p", window=5, pre_fraction=0.5, embedding="e")


def log(spark, n=60, bad=None):
    rows = [("a", i, float(i % 2), [0.8, 0.2] if i % 4 else [0.3, 0.7], [float(i), 1.0]) for i in range(n)]
    if bad:
        rows[7] = bad(rows[7])
    return spark.createDataFrame(rows, "s string, i bigint, y double, p array<double>, e array<double>")


def test_losses_come_from_the_log(spark):
    m = Monitor(log(spark), SPEC)
    got = {r["row_idx"]: (r["y_pred"], r["loss"]) for r in m.rows.collect()}
    assert got == {i: (float(i % 4 == 0), float((i % 4 == 0) != (i % 2))) for i in range(60)}
    rep = m.blocks()["rep"].orderBy("window_idx").collect()
    assert len(rep) == 6 and rep[0]["rep_norm_mean"] == pytest.approx(
        sum((i * i + 1) ** 0.5 for i in range(30, 35)) / 5)


@pytest.mark.parametrize("bad", [
    lambda r: (*r[:3], None, r[4]), lambda r: (*r[:3], [0.5, 0.6], r[4]), lambda r: (*r[:3], [1.0], r[4]),
    lambda r: (*r[:3], [1.2, -0.2], r[4]), lambda r: (*r[:4], None), lambda r: (*r[:4], [1.0])])
def test_an_invalid_log_is_refused(spark, bad):
    with pytest.raises(ValueError, match="invalid prediction log"):
        Monitor(log(spark, bad=bad), SPEC).rows


def test_a_short_stream_is_refused(spark):
    with pytest.raises(ValueError, match="complete window"):
        Monitor(log(spark, 8), SPEC).rows


def test_given_values_use_the_frozen_spread(spark):
    df = log(spark).withColumn("g", F.col("y") + 0.1)
    m = Monitor(df, replace(SPEC, classes=0, proba="", y_pred="g", embedding=""))
    assert [round(r["loss"], 9) for r in m.rows.limit(3).collect()] == [0.2] * 3
    assert scorer.log_violations(df.withColumnRenamed("s", "stream_id").withColumn("y_pred", F.lit(None).cast("double")), 0, False).count() == 1
