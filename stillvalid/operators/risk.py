"""Losses, window risk and the validity threshold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import settle
from .ordered import exact_quantiles

# Risk quantiles kept with the frozen reference.
RISK_QUANTILES = {"q50": 0.5, "q60": 0.6, "q75": 0.75, "q80": 0.8, "q90": 0.9, "q95": 0.95}


def zero_one_loss(y: Column, y_pred: Column) -> Column:
    return (y != y_pred).cast("double")


def brier_loss(y: Column, p: Column) -> Column:
    """Squared error of a probability; a probability outside [0, 1] fails the query."""
    checked = F.when(p.isNull() | p.between(0.0, 1.0), p).otherwise(
        F.raise_error(F.lit("probability outside [0, 1]")).cast("double"))
    return (checked - y) * (checked - y)


def bounded_absolute_error(y: Column, y_pred: Column, scale: Column) -> Column:
    """Absolute error in units of the frozen target spread, cut at 1."""
    unit = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    error = F.abs(y - y_pred) / unit
    return F.when(error.isNotNull(), F.least(error, F.lit(1.0)))


def window_risk(loss: Column) -> Column:
    """Mean loss of a window; unknown (NULL) as soon as one loss is unknown.

    A loss outside [0, 1] fails the query: the threshold has no meaning for it.
    """
    known = F.when(F.count(loss) == F.count(F.lit(1)), settle(F.avg(loss)))
    return F.when((F.min(loss) < 0) | (F.max(loss) > 1),
                  F.raise_error(F.lit("loss outside [0, 1]")).cast("double")).otherwise(known)


def reference_risk(pre_risk: DataFrame) -> DataFrame:
    """Frozen mean, spread and quantiles of the pre-deployment window risks, per stream."""
    spread = pre_risk.filter(F.col("risk").isNotNull()).groupBy("stream_id").agg(
        F.avg("risk").alias("risk_mean"), F.stddev_pop("risk").alias("risk_std"))
    quantiles = exact_quantiles(pre_risk, ["stream_id"], "risk", RISK_QUANTILES)
    return spread.join(quantiles.drop("n_values"), "stream_id")


def threshold(reference: DataFrame, quantile: float, margin: float) -> DataFrame:
    """``eps``: a pre-deployment risk quantile plus a tolerance, at most 1."""
    names = {q: name for name, q in RISK_QUANTILES.items()}
    if not 0.0 < quantile < 1.0:
        raise ValueError(f"quantile must lie in (0, 1), got {quantile}")
    if not 0.0 <= margin < 1.0:
        raise ValueError(f"margin must lie in [0, 1), got {margin}")
    if quantile not in names:
        raise KeyError(f"quantile {quantile} was not fitted on the reference: {sorted(names)}")
    eps = F.least(F.col(names[quantile]) + F.lit(float(margin)), F.lit(1.0))
    return reference.select("stream_id", settle(eps).alias("eps"))


def rethreshold(reference: DataFrame, quantile: float, margins: Mapping[str, float]) -> DataFrame:
    """Threshold at several margins, recomputed from the quantile.

    Adjusting an already capped threshold by a margin difference would be wrong wherever the cap
    was active.
    """
    parts = [threshold(reference, quantile, m).withColumn("margin", F.lit(name))
             for name, m in margins.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
