"""Controlled shifts applied to a real table, to stress a monitor.

Rows need stream_id, row_idx, x (array) and y. Random choices are hash draws keyed by the row, so a
shifted table can be recomputed on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import normal, spread, uniform
from ..session import freeze
from .ordered import index_bucket, running_sum
from .reference import long_features

# Mechanisms by what they change, and schedules with a precursor.
INPUT_MECHANISMS = ("covariate", "feature_dropout", "sensor_corruption", "noise_escalation",
                    "regime")
LABEL_MECHANISMS = ("prior", "conditional")
SCHEDULES = ("abrupt", "gradual", "incremental", "recurring", "seasonal")
PROGRESSIVE = ("gradual", "incremental", "seasonal", "recurring")


@dataclass(frozen=True)
class Shift:
    mechanism: str
    schedule: str
    severity: float
    start: int
    end: int | None = None
    features: tuple[int, ...] = ()
    period: int | None = None
    jump: float = 0.0
    declared_class: str | None = None

    def __post_init__(self):
        actual = forecastability(self.mechanism, self.schedule, self.jump)
        if self.declared_class is not None and self.declared_class != actual:
            raise ValueError(f"declared {self.declared_class}, but the shift is {actual}")


def forecastability(mechanism: str, schedule: str, jump: float = 0.0) -> str:
    """U: labels change abruptly, nothing to see. F: inputs move progressively. PF: the rest."""
    if mechanism not in INPUT_MECHANISMS + LABEL_MECHANISMS:
        raise ValueError(f"unknown mechanism {mechanism!r}")
    if schedule not in SCHEDULES:
        raise ValueError(f"unknown schedule {schedule!r}")
    if mechanism in LABEL_MECHANISMS and schedule == "abrupt":
        return "U"
    if mechanism in INPUT_MECHANISMS and schedule in PROGRESSIVE and jump == 0.0:
        return "F"
    return "PF"


def compound_forecastability(shifts: Sequence[Shift]) -> str:
    if not shifts:
        raise ValueError("a stream without shifts has no forecastability class")
    found = {forecastability(s.mechanism, s.schedule, s.jump) for s in shifts}
    return found.pop() if len(found) == 1 else "PF"


def severity(shift: Shift, n_rows: Column, start: Column | None = None,
             seed: str = "jump") -> Column:
    """Severity weight in [0, 1] of a row, from ``row_idx``."""
    t = F.col("row_idx")
    a = start if start is not None else F.lit(shift.start)
    b = F.lit(shift.end) if shift.end is not None else n_rows
    span = F.greatest(b - a, F.lit(1))
    inside = (t >= a) & (t < b)
    if shift.schedule in ("recurring", "seasonal") and (shift.period or 0) < 2:
        raise ValueError(f"{shift.schedule} needs a period of at least 2")
    if shift.schedule == "abrupt":
        w = F.when(t >= a, 1.0).otherwise(0.0)
    elif shift.schedule in ("incremental", "gradual"):
        w = F.least(F.greatest((t - a) / span, F.lit(0.0)), F.lit(1.0))
    elif shift.schedule == "recurring":
        phase = F.floor((t - a) / (shift.period // 2)) % 2
        w = F.when(inside, phase.cast("double")).otherwise(0.0)
    else:
        angle = F.lit(6.283185307179586) * (t - a) / F.lit(float(shift.period))
        w = F.when(inside, 0.5 * (1.0 - F.cos(angle))).otherwise(0.0)
    if shift.jump > 0:
        tau = a + F.floor(uniform(seed, "stream_id") * span)
        w = (1.0 - shift.jump) * w + shift.jump * F.when(t >= tau, 1.0).otherwise(0.0)
    return F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_rows"))


def _scales(rows: DataFrame) -> DataFrame:
    """Spread and mean of each feature over the unshifted table, one row per stream."""
    long = long_features(rows)
    per = long.groupBy("stream_id", "feature").agg(spread(F.col("value")).alias("_s"),
                                                   F.avg("value").alias("_m"))
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    packed = per.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("feature", sd.alias("sd"), F.col("_m").alias("m"))))
        .alias("_f"))
    return packed.select("stream_id", F.col("_f.sd").alias("_sd"),
                         F.col("_f.m").alias("_mean")).join(_sizes(rows), "stream_id")


def apply_shift(rows: DataFrame, shift: Shift, seed: str = "shift",
                start: str | None = None) -> DataFrame:
    """Apply one mechanism. Untouched features and, for label shifts, all inputs stay identical."""
    # Frozen: the optimizer knows the size then and does not sort all rows by the few streams.
    own = _sizes(rows) if shift.mechanism in LABEL_MECHANISMS else _scales(rows)
    base = rows.join(freeze(own, "shift-scales"), "stream_id")
    at = F.col(start) if start else None
    base = base.withColumn("_w", severity(shift, F.col("_rows"), at, f"{seed}/jump"))
    if shift.schedule == "gradual":
        # The ramp is a mixing probability: a row is fully in the new concept or in the old one.
        base = base.withColumn("_w", F.when(
            uniform(f"{seed}/mix", "stream_id", "row_idx") < F.col("_w"), 1.0).otherwise(0.0))
    base = base.withColumn("_m", F.col("_w") * F.lit(float(shift.severity)))
    m = F.col("_m")
    if shift.mechanism == "conditional":
        u = uniform(f"{seed}/flip", "stream_id", "row_idx")
        out = base.withColumn("y", F.when(u < m, 1 - F.col("y")).otherwise(F.col("y")))
    elif shift.mechanism == "prior":
        out = _resample_rarer(base, seed)
    else:
        touched = [int(f) for f in shift.features]

        def move(v: Column, i: Column) -> Column:
            sd, mean = F.get("_sd", i), F.get("_mean", i)
            if shift.mechanism == "covariate":
                new = v + m * sd
            elif shift.mechanism == "regime":
                new = v * (1.0 - 2.0 * m) + 3.0 * m * sd
            elif shift.mechanism == "sensor_corruption":
                new = v * (1.0 + 0.5 * m) + 0.75 * m * sd
            elif shift.mechanism == "noise_escalation":
                new = v + normal(f"{seed}/noise", F.col("stream_id"), F.col("row_idx"), i) * m * sd
            else:
                new = (1.0 - m) * v + m * mean
            return F.when(i.isin(touched), new).otherwise(v)

        out = base.withColumn("x", F.when(m > 0, F.transform("x", move)).otherwise(F.col("x")))
    return out.select(*rows.columns)


def _resample_rarer(base: DataFrame, seed: str) -> DataFrame:
    """Replace active rows by rows of the stream's rarer class, keeping P(x | y)."""
    shares = base.groupBy("stream_id").agg(F.count_if(F.col("y") == 0).alias("_n0"),
                                           F.count_if(F.col("y") == 1).alias("_n1"))
    rare = F.when(F.col("_n1") < F.col("_n0"), 1).otherwise(0)
    out = base.join(freeze(shares.select("stream_id", rare.alias("_rare"),
                                         F.least("_n0", "_n1").alias("_pool")), "shift-shares"), "stream_id")
    member = F.col("y") == F.col("_rare")
    pool = running_sum(out.filter(member).select("stream_id", "row_idx", "x", "y"),
                       ["stream_id"], "row_idx", index_bucket(F.col("row_idx")),
                       {"_rank": F.lit(1)})
    pool = pool.select("stream_id", (F.col("_rank") - 1).cast("bigint").alias("_pick"),
                       F.col("x").alias("_px"), F.col("y").alias("_py"))
    take = (uniform(f"{seed}/take", "stream_id", "row_idx") < F.col("_m")) & (F.col("_pool") > 0)
    pick = F.floor(uniform(f"{seed}/pick", "stream_id", "row_idx") * F.col("_pool"))
    out = out.withColumn("_take", F.coalesce(take, F.lit(False)))
    # Only replaced rows meet the pool, without the values that they lose.
    moved = out.filter("_take").drop("x", "y").withColumn("_pick", pick.cast("bigint"))
    moved = moved.join(pool, ["stream_id", "_pick"], "left").withColumnsRenamed({"_px": "x", "_py": "y"})
    stay = out.filter("not _take")
    return stay.unionByName(moved.select(*stay.columns))


def random_change_point(sizes: DataFrame, low: float = 0.15, high: float = 0.75,
                        seed: str = "tau") -> DataFrame:
    """``tau`` per stream, uniform inside a fraction range of its deployment segment."""
    if not 0.0 < low < high < 1.0:
        raise ValueError(f"need 0 < low < high < 1, got {low}, {high}")
    u = F.lit(low) + F.lit(high - low) * uniform(seed, "stream_id")
    tau = F.col("boundary") + F.floor(u * (F.col("n_rows") - F.col("boundary")))
    return sizes.select("stream_id", tau.cast("bigint").alias("tau"))


def exogenous_shift(rows: DataFrame, sizes: DataFrame, level: float = 0.45, low: float = 0.15,
                    high: float = 0.75, seed: str = "tau") -> DataFrame:
    """Negative control: labels flip from a random row on; inputs and earlier labels are untouched."""
    tau = random_change_point(sizes, low, high, seed)
    shift = Shift("conditional", "abrupt", level, 0)
    return apply_shift(rows.join(tau, "stream_id"), shift, seed, start="tau")


def apply_shifts(rows: DataFrame, shifts: Sequence[Shift], deployment_start: int = 0,
                 seed: str = "shift") -> DataFrame:
    """Apply several shifts in turn, their rows counted from the start of deployment."""
    compound_forecastability(shifts)
    out = rows
    for i, s in enumerate(shifts):
        moved = replace(s, start=s.start + deployment_start,
                        end=None if s.end is None else s.end + deployment_start)
        out = apply_shift(out, moved, f"{seed}{i}")
    return out
