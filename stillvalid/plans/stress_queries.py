"""Queries that apply controlled shifts to a stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stress
from ..operators.stress import Shift
from .catalog import query
from .monitor import monitor
from .specs import LINES

BLOCK = 97
START, END = 2000, 8000


def _rows(spark, folder):
    m = monitor(spark, folder, LINES)
    return m.rows.select("stream_id", "row_idx", "x", (F.col("y") == 2).cast("int").alias("y"))


def _digest(rows):
    """Per stream and block of rows: mean of each feature (the price in thousands) and of the label."""
    return rows.groupBy("stream_id", F.floor(F.col("row_idx") / BLOCK).cast("bigint").alias(
        "block")).agg(*[(F.avg(F.col("x").getItem(i)) / (1000 if i == 1 else 1)).alias(f"x{i}") for i in range(4)],
                      F.avg("y").alias("y"))


@query("x1_severity")
def _(spark, folder):
    """Severity of every schedule by row, one with a random jump."""
    rows = _rows(spark, folder).select("stream_id", "row_idx")
    sizes = rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_n"))
    shifts = {"abrupt": Shift("covariate", "abrupt", 1.0, START),
              "incremental": Shift("covariate", "incremental", 1.0, START, END),
              "recurring": Shift("covariate", "recurring", 1.0, START, END, period=500),
              "seasonal": Shift("covariate", "seasonal", 1.0, START, END, period=700),
              "jump": Shift("covariate", "incremental", 1.0, START, END, jump=0.4)}
    out = rows.join(sizes, "stream_id")
    w = [stress.severity(s, F.col("_n")).alias(n) for n, s in shifts.items()]
    out = out.select("stream_id", F.floor(F.col("row_idx") / BLOCK).cast("bigint").alias("block"),
                     *w)
    return out.groupBy("stream_id", "block").agg(*[F.avg(n).alias(n) for n in shifts])


@query("x2_covariate")
def _(spark, folder):
    """Features translated in units of their spread, ramping up."""
    shift = Shift("covariate", "incremental", 0.9, START, END, (0, 2))
    return _digest(stress.apply_shift(_rows(spark, folder), shift))


@query("x2_regime")
def _(spark, folder):
    """Features moved to an unseen region with a sign flip."""
    return _digest(stress.apply_shift(_rows(spark, folder), Shift("regime", "abrupt", 0.8, START,
                                                                  features=(1,))))


@query("x2_sensor_corruption")
def _(spark, folder):
    """Gain and bias on sensors, oscillating."""
    shift = Shift("sensor_corruption", "seasonal", 0.7, START, END, (0, 3), period=900)
    return _digest(stress.apply_shift(_rows(spark, folder), shift))


@query("x2_feature_dropout")
def _(spark, folder):
    """A feature blends towards its mean."""
    shift = Shift("feature_dropout", "recurring", 1.0, START, END, (1,), period=600)
    return _digest(stress.apply_shift(_rows(spark, folder), shift))


@query("x3_noise_escalation")
def _(spark, folder):
    """Gaussian noise of growing scale."""
    shift = Shift("noise_escalation", "incremental", 1.0, START, END, (0, 1))
    return _digest(stress.apply_shift(_rows(spark, folder), shift))


@query("x4_conditional")
def _(spark, folder):
    """Labels flip with a given probability; inputs stay identical."""
    return _digest(stress.apply_shift(_rows(spark, folder),
                                      Shift("conditional", "abrupt", 0.3, START)))


@query("x5_prior")
def _(spark, folder):
    """Rows replaced by rows of the rarer class."""
    return _digest(stress.apply_shift(_rows(spark, folder), Shift("prior", "abrupt", 0.5, START)))


@query("x6_gradual")
def _(spark, folder):
    """A gradual schedule mixes old and new rows."""
    shift = Shift("covariate", "gradual", 1.0, START, END, (0,))
    return _digest(stress.apply_shift(_rows(spark, folder), shift))


@query("x8_exogenous")
def _(spark, folder):
    """Negative control with a random change point per stream."""
    m = monitor(spark, folder, LINES)
    return _digest(stress.exogenous_shift(_rows(spark, folder), m.sizes))


@query("x9_compound")
def _(spark, folder):
    """Two shifts in turn, placed relative to the start of deployment."""
    shifts = [Shift("covariate", "incremental", 0.5, 0, 4000, (0,)),
              Shift("conditional", "abrupt", 0.2, 1000)]
    return _digest(stress.apply_shifts(_rows(spark, folder), shifts, deployment_start=START))
