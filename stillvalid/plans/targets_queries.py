"""Queries on censored targets, origins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits, targets
from ..operators import state as st
from .catalog import query
from .monitor import Monitor, monitor
from .specs import EVENTS, LINES

# Gap between splits: one horizon, so that no training origin's outcomes reach into the next part.
GAP = 20


def split_origins(m: Monitor):
    return splits.chronological_split(m.origins, 0.5, 0.2, GAP)


@query("t2_time_to_violation")
def _(spark, folder):
    """Censored time to violation of every valid origin (the flagship query)."""
    m = monitor(spark, folder, EVENTS)
    return m.origins.select("stream_id", "origin", "y_tilde", "event", "risk_now", "risk_next",
                            "eps")


@query("t3_risk_path")
def _(spark, folder):
    """Realised risk at each horizon of each origin, where it exists."""
    o = monitor(spark, folder, EVENTS).origins
    return o.select("stream_id", "origin", F.posexplode("risk_path").alias("_i", "risk")).select(
        "stream_id", "origin", (F.col("_i") + 1).alias("h"), "risk").filter("risk is not null")


@query("t4_censoring_rate")
def _(spark, folder):
    """T4: origins, events and censoring rate."""
    return targets.censoring_rate(monitor(spark, folder, EVENTS).origins)


@query("t6_history_and_anchor")
def _(spark, folder):
    """Known risk history of each origin and its smoothed level."""
    o = monitor(spark, folder, EVENTS).origins
    known = F.filter("risk_hist", lambda r: r.isNotNull())
    return o.select("stream_id", "origin", "anchor", F.size(known).alias("n_known"),
                    F.coalesce(F.get("risk_hist", F.lit(0)), F.lit(-1.0)).alias("oldest"),
                    F.coalesce(F.get("risk_hist", F.lit(19)), F.lit(-1.0)).alias("newest"))


@query("t8_context")
def _(spark, folder):
    """Context of the last 20 state vectors, the first one repeated on the left."""
    m = monitor(spark, folder, EVENTS)
    states = st.value_prediction_block(m.deployment)
    tensor = targets.context_tensor(states, ["pred_mean", "pred_std"], 20)
    return tensor.select("stream_id", "window_idx", F.posexplode("context_states").alias(
        "step", "_v")).select("stream_id", "window_idx", "step",
                              F.col("_v").getItem(0).alias("pred_mean"),
                              F.col("_v").getItem(1).alias("pred_std"))


@query("t10_chronological_split")
def _(spark, folder):
    """Split of each stream's origins at their quantiles with a gap."""
    return split_origins(monitor(spark, folder, EVENTS)).select("stream_id", "origin", "split")


@query("t11_stream_split")
def _(spark, folder):
    """Whole streams assigned to splits."""
    return splits.stream_split(monitor(spark, folder, EVENTS).origins)


@query("t12_split_guard")
def _(spark, folder):
    """Split sizes, failing where a split is too small or has no event."""
    return splits.check_splits(split_origins(monitor(spark, folder, EVENTS)))


@query("t13_conditioned")
def _(spark, folder):
    """Origins valid now and in the next window."""
    return targets.conditioned(monitor(spark, folder, EVENTS).origins).select("stream_id", "origin")


@query("t14_usability")
def _(spark, folder):
    """Usability screen over both monitored tables."""
    both = None
    for spec in (EVENTS, LINES):
        o = monitor(spark, folder, spec).origins.select("stream_id", "event").withColumn(
            "dataset", F.lit(spec.name))
        both = o if both is None else both.unionByName(o)
    return targets.usability(both, ["dataset"])


@query("t15_regime_comparability")
def _(spark, folder):
    """Mean risk ahead of test origins over that of training origins."""
    return splits.regime_comparability(split_origins(monitor(spark, folder, EVENTS)))


@query("t16_age_hazard")
def _(spark, folder):
    """Event share by age quintile and the age/event correlation."""
    return splits.age_hazard(monitor(spark, folder, EVENTS).origins)


@query("t16_age_association")
def _(spark, folder):
    """Correlation of deployment age and violation with its t statistic and p."""
    return splits.age_association(monitor(spark, folder, EVENTS).origins)


@query("t17_leave_one_out")
def _(spark, folder):
    """Pools of all streams but one."""
    return splits.pool_sizes(monitor(spark, folder, EVENTS).origins, "stream_id")


@query("t17_transfer")
def _(spark, folder):
    """Violation rate fitted without a stream, scored on that stream."""
    return splits.transfer_scores(monitor(spark, folder, EVENTS).origins, "stream_id")


@query("t18_person_periods")
def _(spark, folder):
    """Periods at risk and failures by horizon."""
    long = targets.person_periods(monitor(spark, folder, EVENTS).origins)
    return long.groupBy("h").agg(F.count(F.lit(1)).alias("at_risk"), F.sum("failed").alias(
        "failed"))
