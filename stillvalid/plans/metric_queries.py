"""Queries on forecast scores, survival metrics and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf_col
from ..operators import compare as cmp
from ..operators import forecast as fc
from ..operators import metrics
from .catalog import query
from .contest import contest
from .model_queries import events_contest
from .monitor import monitor
from .specs import EVENTS, LINES
from .targets_queries import GAP


@query("e1_horizon_scores")
def _(spark, folder):
    """MAE, RMSE and skill against persistence at each horizon, tuned methods, test."""
    return events_contest(spark, folder).path_scores()


@query("e3_origin_errors")
def _(spark, folder):
    """Absolute error of each test origin at horizon 5."""
    return fc.errors_at(events_contest(spark, folder).forecasts, 5)


@query("e4_score_summary")
def _(spark, folder):
    """Mean scores with horizons 1, 5 and 10 broken out."""
    return fc.score_summary(events_contest(spark, folder).path_scores())


@query("e5_brier")
def _(spark, folder):
    """E5: censoring-weighted Brier score at each horizon."""
    c = events_contest(spark, folder)
    return metrics.brier_by_horizon(c.reference_curves, c.part("test"), 20)


@query("e6_integrated_brier")
def _(spark, folder):
    """Integrated Brier score."""
    c = events_contest(spark, folder)
    return metrics.integrated_brier(metrics.brier_by_horizon(c.reference_curves, c.part("test"),
                                                             20))


@query("e7_concordance")
def _(spark, folder):
    """Time-dependent concordance."""
    return metrics.concordance(events_contest(spark, folder).reference_curves)


@query("e8_contributions")
def _(spark, folder):
    """Concordance contribution of each origin with an event."""
    out = metrics.concordance_contributions(events_contest(spark, folder).reference_curves)
    return out.filter("contribution is not null").select("stream_id", "origin", "method",
                                                         "contribution")


@query("e9_d_calibration")
def _(spark, folder):
    """Uniformity of the survival at the observed time (statistic and largest deviation)."""
    return metrics.d_calibration(events_contest(spark, folder).reference_curves)


@query("e9_d_calibration_p")
def _(spark, folder):
    """The same with its p-value (nine degrees of freedom)."""
    d = metrics.d_calibration(events_contest(spark, folder).reference_curves)
    return d.withColumn("p", chi2_sf_col("chi2", "df"))


@query("e10_calibration_curve")
def _(spark, folder):
    """Predicted against observed violation within ten windows."""
    return metrics.calibration_curve(events_contest(spark, folder).reference_curves, 10)


@query("e11_horizon_error")
def _(spark, folder):
    """Error of the median horizon on uncensored test origins."""
    from ..operators.survival import horizon_readouts

    c = events_contest(spark, folder)
    read = horizon_readouts(c.reference_curves.filter("method = 'age_kaplan_meier'"), 20)
    both = c.part("test").join(read, ["stream_id", "origin"])
    return metrics.horizon_error(both, "median_horizon", "y_tilde", "event")


def _warnings(spark, folder):
    """One row per origin: warned when the anchor is within 0.03 of the threshold."""
    o = monitor(spark, folder, EVENTS).origins
    near = F.col("anchor") > F.col("eps") - 0.03
    return o.select("stream_id", "origin", near.alias("warned"),
                    ((F.col("event") == 1) & (F.col("y_tilde") <= 3)).alias("violates"),
                    F.when(F.col("event") == 1, F.col("origin") + F.col("y_tilde"))
                    .alias("violation_at"), F.when(near, F.col("origin")).alias("warned_at"))


@query("e12_lead_time")
def _(spark, folder):
    """Windows between warning and violation."""
    out = metrics.lead_time(_warnings(spark, folder), "violation_at", "warned_at")
    return out.select("stream_id", "origin", "lead_time")


@query("e13_warning_scores")
def _(spark, folder):
    """Warning precision, recall and false alarms per 100 windows."""
    return metrics.warning_scores(_warnings(spark, folder), "warned", "violates", "stream_id")


def _pairs(spark, folder):
    return events_contest(spark, folder).error_pairs("exponential_smoothing")


@query("e14_cliffs_delta")
def _(spark, folder):
    """Dominance of smoothing errors over each baseline's."""
    return cmp.cliffs_delta(_pairs(spark, folder), ["h", "baseline"])


@query("e15_paired_d")
def _(spark, folder):
    """Paired Cohen's d."""
    return cmp.paired_d(_pairs(spark, folder), ["h", "baseline"])


@query("e16_signed_ranks")
def _(spark, folder):
    """Signed-rank statistic with split zeros and its tie sum."""
    return cmp.signed_ranks(_pairs(spark, folder), ["h", "baseline"])


@query("e17_holm")
def _(spark, folder):
    """Step-down correction, per horizon, of the sign-flip p of every baseline."""
    flips = cmp.blocked_permutation(_pairs(spark, folder), ["h", "baseline"], draws=20000)
    return cmp.holm(flips.select("h", "baseline", F.col("p_value").alias("p_raw")), ["h"])


@query("e18_blocked_bootstrap")
def _(spark, folder):
    """Mean error at horizon 5 with an interval from resampling whole streams."""
    errors = fc.errors_at(events_contest(spark, folder).forecasts, 5)
    return cmp.blocked_bootstrap(errors, ["method"], "error", draws=2000)


@query("e19_comparison")
def _(spark, folder):
    """Full comparison record with p-values, effect sizes and the rule for "beats"."""
    return cmp.compare(_pairs(spark, folder), ["h"])


@query("e20_blocked_permutation")
def _(spark, folder):
    """Sign-flip test of the mean stream difference."""
    return cmp.blocked_permutation(_pairs(spark, folder), ["h", "baseline"], draws=20000)


def _stream_results(spark, folder):
    """Scores of both reference curves on each stream, the stream standing for a seed."""
    c = events_contest(spark, folder)
    tagged = c.reference_curves.withColumn("method", F.concat("method", F.lit("|"), "stream_id"))
    scores = metrics.concordance(tagged).join(metrics.d_calibration(tagged), "method")
    ibs = metrics.integrated_brier(metrics.brier_by_horizon(tagged, c.part("test"), 20))
    out = scores.join(ibs, "method").withColumn("d_cal_p", chi2_sf_col("chi2", "df"))
    parts = F.split("method", r"\|")
    out = out.filter("concordance is not null")      # a stream without comparable pairs
    return out.select(parts[0].alias("method"), parts[1].alias("seed"), "concordance", "ipcw_ibs",
                      "d_cal_p", (F.col("concordance") - 0.5).alias("effect_delta"),
                      F.lit(0.01).alias("p_adjusted"), (F.col("concordance") > 0.5).alias("beats"))


@query("e21_seed_summary")
def _(spark, folder):
    """Mean, spread, rejections and wins over repeated runs."""
    return cmp.summarise_seeds(_stream_results(spark, folder), ["method"])


@query("e22_verdict")
def _(spark, folder):
    """Tiers and the boundary verdict over datasets (streams of both monitored tables)."""
    rows = None
    for spec, kind in ((EVENTS, "SOCIAL"), (LINES, "PHYSICAL")):
        o = monitor(spark, folder, spec).origins.groupBy("stream_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("event").alias("share"))
        one = o.select(F.concat(F.lit(spec.name + ":"), "stream_id").alias("dataset"),
                       F.lit(kind).alias("drift_class"), (F.col("n") >= 60).alias("usable"),
                       F.lit(1).alias("n_seeds"), (F.col("share") > 0.95).cast("int").alias(
                           "seeds_beaten"))
        rows = one if rows is None else rows.unionByName(one)
    return cmp.boundary_verdict(cmp.assign_tier(rows, ["lines:s4"]))


@query("e22_tiers")
def _(spark, folder):
    """Tier and reason of each stream."""
    o = monitor(spark, folder, EVENTS).origins.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"))
    rows = o.select(F.col("stream_id").alias("dataset"), F.when(F.col("stream_id") == "s1", "NONE")
                    .otherwise("PHYSICAL").alias("drift_class"), (F.col("n") >= 70).alias("usable"))
    return cmp.assign_tier(rows, ["s0"])


@query("e23_equivalence")
def _(spark, folder):
    """Does a method's mean concordance leave the band around chance?"""
    return cmp.equivalence(_stream_results(spark, folder), ["method"])


@query("e24_rank_auc")
def _(spark, folder):
    """Area under the curve of the current risk for a violation within five windows."""
    o = monitor(spark, folder, EVENTS).origins
    soon = ((F.col("event") == 1) & (F.col("y_tilde") <= 5)).cast("int")
    return cmp.rank_auc(o.select("stream_id", "risk_now", soon.alias("soon")), ["stream_id"],
                        "soon", "risk_now")


@query("contest_survival")
def _(spark, folder):
    """Entry 3: survival ranking of the reference methods on the classification stream."""
    c = contest(monitor(spark, folder, LINES), GAP)
    return c.survival_scores(c.reference_curves)
