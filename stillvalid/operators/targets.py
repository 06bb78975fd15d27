"""Right-censored time-to-violation targets and the table of origins built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import smooth
from .ordered import halo, own_rows


def _horizon(horizon: int) -> None:
    if horizon < 1:
        raise ValueError("the horizon must be at least one window")


def censored_targets(risk: DataFrame, eps: DataFrame, horizon: int) -> DataFrame:
    """Origins with ``y_tilde``, ``event`` and the realised ``risk_path``.

    ``risk`` has dense ``window_idx`` per stream. An origin is a window of known risk at or below
    ``eps`` that has a successor. Its event time is the first strict violation within the horizon;
    an unknown risk before it, or the end of the stream, censors it.
    """
    _horizon(horizon)
    chunked, by = halo(risk.join(eps, "stream_id"), ["stream_id"], "window_idx", 0, horizon)
    ahead = by.rowsBetween(1, horizon)
    violated = F.when(F.col("risk") > F.col("eps"), F.col("window_idx"))
    unknown = F.when(F.col("risk").isNull(), F.col("window_idx"))
    out = own_rows(chunked.select(
        "stream_id", "window_idx", "risk", "eps", "_chunk", "_own",
        F.count(F.lit(1)).over(ahead).alias("_ahead"),
        F.min(violated).over(ahead).alias("_violated"),
        F.min(unknown).over(ahead).alias("_unknown"),
        F.array(*[F.lead("risk", h).over(by) for h in range(1, horizon + 1)]).alias("risk_path")))
    t = F.col("window_idx")
    hit = F.col("_violated").isNotNull() & (
        F.col("_unknown").isNull() | (F.col("_violated") < F.col("_unknown")))
    y = (F.when(hit, F.col("_violated") - t)
          .when(F.col("_unknown").isNotNull(), F.col("_unknown") - t - 1)
          .otherwise(F.col("_ahead")))
    out = out.filter((F.col("risk") <= F.col("eps")) & (F.col("_ahead") > 0))
    out = out.withColumn("y_tilde", y.cast("int")).filter(F.col("y_tilde") >= 1)
    return out.select("stream_id", t.alias("origin"), "y_tilde", hit.cast("int").alias("event"),
                      F.col("risk").alias("risk_now"),
                      F.col("risk_path").getItem(0).alias("risk_next"), "risk_path", "eps")


def matured_history(risk: DataFrame, context: int, delay: int) -> DataFrame:
    """Last ``context`` risks known at each window, oldest first, padded with the first of them.

    Labels arrive ``delay`` windows late, so window t sees risks up to t - delay.
    """
    chunked, by = halo(risk, ["stream_id"], "window_idx", delay + context - 1, 0)
    seen = F.collect_list(F.struct("risk")).over(by.rowsBetween(-(delay + context - 1), -delay))
    out = own_rows(chunked.select("stream_id", "window_idx", "_chunk", "_own", seen.alias("_s")))
    hist = F.transform("_s", lambda s: s["risk"])
    pad = F.array_repeat(F.get(hist, F.lit(0)), context - F.size("_s"))
    return out.select("stream_id", "window_idx", F.concat(pad, hist).alias("risk_hist"))


def with_history(origins: DataFrame, risk: DataFrame, context: int, delay: int,
                 alpha: float = 0.3) -> DataFrame:
    """Add ``risk_hist`` and ``anchor``, the smoothed level of the known history."""
    hist = matured_history(risk, context, delay).withColumnRenamed("window_idx", "origin")
    out = origins.join(hist, ["stream_id", "origin"])
    known = F.filter("risk_hist", lambda r: r.isNotNull())
    return out.withColumn("anchor", F.coalesce(smooth(known, alpha), F.col("risk_now"),
                                               F.lit(0.5)))


def context_tensor(states: DataFrame, features: list[str], context: int) -> DataFrame:
    """``context_states``: the last ``context`` state vectors, the first one repeated on the left."""
    packed = states.select("stream_id", "window_idx", F.array(*features).alias("_s"))
    chunked, by = halo(packed, ["stream_id"], "window_idx", context - 1, 0)
    seen = F.collect_list("_s").over(by.rowsBetween(-(context - 1), 0))
    out = own_rows(chunked.withColumn("_seen", seen))
    pad = F.array_repeat(F.get("_seen", F.lit(0)), context - F.size("_seen"))
    return out.select("stream_id", "window_idx",
                      F.concat(pad, F.col("_seen")).alias("context_states"))


def censoring_rate(origins: DataFrame) -> DataFrame:
    """Share of censored origins; fails on an empty table."""
    n = F.count(F.lit(1))
    rate = F.when(n > 0, 1.0 - F.avg("event")).otherwise(
        F.raise_error(F.lit("no origins: the censoring rate is undefined")).cast("double"))
    return origins.agg(n.alias("n_origins"), F.sum("event").cast("bigint").alias("n_events"),
                       rate.alias("censoring_rate"))


def conditioned(origins: DataFrame) -> DataFrame:
    """Origins valid now and still valid in the next window, where detection cannot score."""
    return origins.filter((F.col("risk_now") <= F.col("eps"))
                          & (F.col("risk_next") <= F.col("eps")))


def person_periods(origins: DataFrame) -> DataFrame:
    """One row per origin and horizon at risk; ``failed`` marks the violating period."""
    out = origins.withColumn("h", F.explode(F.sequence(F.lit(1), F.col("y_tilde"))))
    return out.withColumn("failed", ((F.col("h") == F.col("y_tilde"))
                                     & (F.col("event") == 1)).cast("int"))


def usability(origins: DataFrame, keys: list[str], min_origins: int = 100,
              max_censoring: float = 0.6) -> DataFrame:
    """Whether each dataset can carry the survival contest."""
    out = origins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_origins"), F.sum("event").cast("bigint").alias("n_events"),
        F.countDistinct("stream_id").alias("n_streams"),
        (1.0 - F.avg("event")).alias("censoring_rate"))
    c = F.col("censoring_rate")
    return out.withColumn("usable", (F.col("n_origins") >= min_origins) & (c > 0)
                          & (c < max_censoring))
