"""Survival and warning metrics. Censored origins are never scored as non-events.

Curves arrive as (stream_id, origin, method, y_tilde, event, surv[H]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, total
from .ordered import running_sum
from .survival import CENSORING_FLOOR, censoring_curve


def _s(h: int) -> Column:
    return clip(F.get("surv", F.lit(h - 1)), 0.0, 1.0)


def brier_by_horizon(curves: DataFrame, origins: DataFrame, horizon: int) -> DataFrame:
    """Censoring-weighted Brier score of each method at each horizon.

    An event at y is weighted by the censoring curve at ``max(y - 1, 1)`` and a survivor of h by its
    value at h; the sum is divided by the number of contributing origins.
    """
    g = censoring_curve(origins, horizon).select(F.col("surv").alias("_g"))      # one row
    y, d, h = F.col("y_tilde"), F.col("event"), F.col("_i") + 1
    floor = F.lit(CENSORING_FLOOR)
    long = curves.join(F.broadcast(g)).select(
        "method", "y_tilde", "event", "_g", F.posexplode("surv").alias("_i", "_raw"))
    s = clip(F.col("_raw"), 0.0, 1.0)
    failed, alive = (y <= h) & (d == 1), y > h
    before = F.greatest(F.get("_g", F.greatest(y - 2, F.lit(0))), floor)
    at_h = F.greatest(F.get("_g", F.col("_i")), floor)
    term = F.when(failed, s * s / before).when(alive, (s - 1.0) * (s - 1.0) / at_h)
    scored = long.select("method", h.alias("h"), term.alias("_t"))
    return scored.groupBy("method", "h").agg(F.count("_t").alias("n"), F.avg("_t").alias("brier"))


def integrated_brier(by_horizon: DataFrame) -> DataFrame:
    """Mean over the horizons where the score is defined."""
    return by_horizon.groupBy("method").agg(F.avg("brier").alias("ipcw_ibs"))


def _ranked_pairs(curves: DataFrame) -> DataFrame:
    """Per method, horizon and survival value: events at h, origins beyond h, and running counts.

    A pair is an event at y_i = h and any origin with y_j > h, compared at S(h). Counting equal
    survival values first and summing along them replaces the comparison of all pairs.
    """
    out = curves.select("method", "y_tilde", "event", F.posexplode(
        F.slice("surv", 1, F.col("y_tilde"))).alias("_i", "_raw"))
    out = out.select("method", (F.col("_i") + 1).alias("h"), clip(F.col("_raw"), 0.0, 1.0)
                     .alias("s"), "y_tilde", "event")
    counts = out.groupBy("method", "h", "s").agg(
        F.count_if(F.col("y_tilde") > F.col("h")).alias("beyond"),
        F.count_if((F.col("y_tilde") == F.col("h")) & (F.col("event") == 1)).alias("events"))
    ranked = running_sum(counts, ["method", "h"], "s", None,
                         {"upto": F.col("beyond")})
    tot = counts.groupBy("method", "h").agg(F.sum("beyond").alias("total"))
    return ranked.join(tot, ["method", "h"])


def concordance(curves: DataFrame) -> DataFrame:
    """Time-dependent concordance; NULL when no pair is comparable."""
    better = (F.col("total") - F.col("upto")) + 0.5 * F.col("beyond")
    return _ranked_pairs(curves).groupBy("method").agg(
        F.try_divide(F.sum(F.col("events") * better),
                     F.sum(F.col("events") * F.col("total")).cast("double")).alias("concordance"),
        F.sum(F.col("events") * F.col("total")).cast("bigint").alias("n_pairs"))


def concordance_contributions(curves: DataFrame) -> DataFrame:
    """Share of later-surviving origins each event is ordered correctly against."""
    ranked = _ranked_pairs(curves).filter(F.col("events") > 0).select(
        "method", F.col("h").alias("y_tilde"), "s", F.try_divide(
            (F.col("total") - F.col("upto")) + 0.5 * F.col("beyond"),
            F.col("total")).alias("contribution"))
    at = curves.withColumn("s", F.when(F.col("event") == 1, clip(
        F.get("surv", F.col("y_tilde") - 1), 0.0, 1.0)))
    return at.select("stream_id", "origin", "method", "y_tilde", "event", "s").join(
        ranked, ["method", "y_tilde", "s"], "left").drop("s")


def d_calibration(curves: DataFrame, bins: int = 10) -> DataFrame:
    """Uniformity of S(T): a censored origin spreads its mass over the bins below its value."""
    s = clip(F.get("surv", F.col("y_tilde") - 1), CENSORING_FLOOR, 1.0)
    base = curves.select("method", "event", s.alias("s"))
    edges = [i / bins for i in range(bins + 1)]
    place = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1))
    parts = []
    for b in range(bins):
        share = F.greatest(F.least(F.lit(edges[b + 1]), F.col("s")) - F.lit(edges[b]),
                           F.lit(0.0)) / F.col("s")
        spread = F.when(F.col("s") <= CENSORING_FLOOR, F.lit(1.0 if b == 0 else 0.0)
                        ).otherwise(share)
        parts.append(F.sum(F.when(F.col("event") == 1, (place == b).cast("double"))
                           .otherwise(spread)).alias(f"c{b}"))
    agg = base.groupBy("method").agg(*parts)
    c = [F.col(f"c{b}") for b in range(bins)]
    expected = total(c) / bins
    chi2 = total([(x - expected) * (x - expected) / expected for x in c])
    worst = F.greatest(*[F.abs(x - expected) for x in c]) / expected
    return agg.select("method", chi2.alias("chi2"), worst.alias("max_deviation"),
                      F.lit(bins - 1).alias("df"))


def calibration_curve(curves: DataFrame, h: int, bins: int = 10) -> DataFrame:
    """Predicted against observed violation within h, with the weighted gap (``ece``)."""
    y, d = F.col("y_tilde"), F.col("event")
    failed = (y <= h) & (d == 1)
    p = 1.0 - _s(h)
    edges = [i * (1.0 / bins) for i in range(bins)]
    place = total([(p >= e).cast("int") for e in edges]) - 1
    base = curves.filter(failed | (y > h)).select(
        "method", p.alias("_p"), failed.cast("double").alias("_o"), place.alias("bin"))
    per = base.groupBy("method", "bin").agg(F.avg("_p").alias("predicted"),
                                            F.avg("_o").alias("observed"),
                                            F.count(F.lit(1)).alias("n"))
    gap = per.groupBy("method").agg((F.sum(F.col("n") * F.abs(
        F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return per.join(gap, "method")


def horizon_error(table: DataFrame, predicted: str, true: str, event: str) -> DataFrame:
    """Mean absolute horizon error on uncensored rows; fails when there are none."""
    seen = F.col(event) == 1
    n = F.count_if(seen)
    error = F.when(n > 0, F.avg(F.when(seen, F.abs(F.col(predicted) - F.col(true))))).otherwise(
        F.raise_error(F.lit("no uncensored row: the horizon error is undefined")).cast("double"))
    return table.agg(error.alias("vhmae"), n.alias("n_uncensored"),
                     (1.0 - F.avg(F.col(event))).alias("censoring_rate"))


def lead_time(table: DataFrame, violation: str, warning: str) -> DataFrame:
    """Windows between warning and violation where both happened."""
    return table.filter(F.col(violation).isNotNull() & F.col(warning).isNotNull()).withColumn(
        "lead_time", F.col(violation) - F.col(warning))


def warning_scores(table: DataFrame, warned: str, violates: str, *keys: str) -> DataFrame:
    w, v = F.col(warned).cast("boolean"), F.col(violates).cast("boolean")
    hit, false = F.count_if(w & v), F.count_if(w & ~v)
    return table.groupBy(*keys).agg(
        F.try_divide(hit, F.count_if(w)).alias("precision"),
        F.try_divide(hit, F.count_if(v)).alias("recall"),
        F.try_divide(100.0 * false, F.count(F.lit(1))).alias("false_per_100"))
