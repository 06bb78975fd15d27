"""Queries on frozen reference statistics and the deployment-state blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import reference as ref
from ..operators import state as st
from ..operators.ordered import halo, own_rows
from .catalog import query
from .monitor import Monitor, monitor
from .specs import BOOSTED, EVENTS, GIVEN, LINES, SHIFTS, VECTORS
from .targets_queries import split_origins

KEY = st.KEY


def interventions(m: Monitor):
    """Interventions derived from the stream: wherever risk newly crosses the threshold."""
    chunked, by = halo(m.risk.join(m.eps, "stream_id"), ["stream_id"], "window_idx", 1, 1)
    near = own_rows(chunked.withColumn("_before", F.lag("risk").over(by))
                    .withColumn("_after", F.lead("risk").over(by)))
    hit = near.filter((F.col("risk") > F.col("eps")) & (F.col("_before") <= F.col("eps")))
    return hit.select(*KEY, F.lit(1).alias("seq"),
                      (F.col("risk") - F.col("eps")).alias("magnitude"),
                      F.coalesce(F.col("_after") - F.col("risk"), F.lit(0.0)).alias("risk_delta"))


@query("f1_feature_moments")
def _(spark, folder):
    """mean and population spread of each feature on the reference."""
    return monitor(spark, folder, LINES).reference_features.select("stream_id", "feature", "mean",
                                                                   "std")


@query("f2_psi_edges")
def _(spark, folder):
    """interior PSI cut points, equal quantiles merged."""
    return monitor(spark, folder, LINES).reference_features.select(
        "stream_id", "feature", "n_bins", F.posexplode("cuts").alias("position", "cut"))


@query("f3_reference_sample")
def _(spark, folder):
    """the capped reference sample (smallest hash draws)."""
    return monitor(spark, folder, LINES).reference_sample.select("stream_id", "rank", "row_idx")


@query("f4_bandwidth")
def _(spark, folder):
    """median-heuristic kernel bandwidth on at most 512 standardised sample rows."""
    return monitor(spark, folder, LINES).geometry.select("stream_id", "bandwidth")


@query("f5_embedding_moments")
def _(spark, folder):
    """Mean and spread of the linear embedding (inputs in reference units)."""
    return monitor(spark, folder, LINES).embedding_reference


@query("f6_principal_axes")
def _(spark, folder):
    """frozen principal axes of the 64-wide vectors; the largest loading is positive."""
    g = monitor(spark, folder, VECTORS).geometry
    return g.select("stream_id", F.posexplode("components").alias("axis", "_c")).select(
        "stream_id", "axis", F.posexplode("_c").alias("feature", "loading"))


@query("f6_axis_invariants")
def _(spark, folder):
    """all axes of the four inputs: orthonormal, and with the trace and determinant of the covariance."""
    m = monitor(spark, folder, LINES)
    moments = geo.second_moments(m.embedded(m.pre).select("stream_id", "z"), ["stream_id"], 4)
    along = geo.axis_spread(moments, m.geometry.select("stream_id", "components"))
    return along.groupBy("stream_id").agg(
        F.sum("variance").alias("trace"), F.sum(F.log("variance")).alias("log_determinant"),
        F.max("skew").alias("skew"))


@query("f8_behaviour")
def _(spark, folder):
    """F8: predicted-class shares, confidence and entropy on the reference."""
    b = monitor(spark, folder, LINES).reference_behaviour
    return b.select("stream_id", *[F.col("prior").getItem(i).alias(f"prior_{i}")
                                   for i in range(3)], "confidence_mean", "entropy_mean")


@query("f11_normaliser")
def _(spark, folder):
    """normaliser fitted on training windows only, applied to all."""
    m = monitor(spark, folder, EVENTS)
    cols = ["fb_risk_last", "fb_risk_mean", "fb_n_matured"]
    states = st.feedback_block(m.risk, m.reference_risk, 1).select(*KEY, *cols)
    train = split_origins(m).filter("split = 'train'").select("stream_id", F.col("origin").alias("window_idx"))
    norm = ref.fit_normaliser(states.join(train, KEY), cols)
    return ref.normalise(states, norm, cols)


@query("s1_prediction_block")
def _(spark, folder):
    """Confidence, entropy, margin and class-share movement per window."""
    m = monitor(spark, folder, LINES)
    return st.class_prediction_block(m.deployment, m.reference_behaviour, 3)


@query("s6_value_predictions")
def _(spark, folder):
    """Prediction statistics and uncertainty of a regression stream."""
    m = monitor(spark, folder, EVENTS)
    return st.value_prediction_block(m.deployment).join(
        st.value_uncertainty_block(m.deployment), KEY)


@query("s7_volatility")
def _(spark, folder):
    """Spread and trend of headline statistics over the five previous windows."""
    m = monitor(spark, folder, LINES)
    base = st.class_prediction_block(m.deployment, m.reference_behaviour, 3).join(
        st.class_uncertainty_block(m.deployment), KEY)
    return st.volatility(base, {"pred_volatility": "pred_msp_mean",
                                "unc_volatility": "unc_entropy_mean"},
                         {"pred_trend": "pred_msp_mean"})


@query("s9_representation")
def _(spark, folder):
    """Centroid movement and norms of the embedding."""
    m = monitor(spark, folder, LINES)
    return st.representation_block(m.embedded(m.deployment), m.embedding_reference)


@query("s11_covariance_trace")
def _(spark, folder):
    """Spread of the embedding cloud (trace of its covariance)."""
    return monitor(spark, folder, LINES).shape_block.select(*KEY, "rep_cov_trace")


@query("s11_covariance_shape")
def _(spark, folder):
    """Log-determinant and condition number of the embedding covariance."""
    return monitor(spark, folder, LINES).shape_block.select(
        *KEY, "rep_cov_logdet", "rep_cov_condition")


@query("s11_covariance_logdet")
def _(spark, folder):
    """Log-determinant of the embedding covariance."""
    return monitor(spark, folder, LINES).shape_block.select(*KEY, "rep_cov_logdet")


@query("s12_coordinate_invariants")
def _(spark, folder):
    """With all four axes kept, the energy is 1 and the coordinates keep the distance from the centre."""
    g = monitor(spark, folder, LINES).shape_block
    squares = sum((F.pow(F.col(f"rep_pca{i}_mean"), F.lit(2.0)) for i in range(2, 5)),
                  F.pow(F.col("rep_pca1_mean"), F.lit(2.0)))
    return g.select(*KEY, "rep_pca_energy", squares.alias("distance2"))


@query("s12_principal_coordinates")
def _(spark, folder):
    """Window means and energy in the frozen principal axes (64-wide vectors)."""
    g = monitor(spark, folder, VECTORS).shape_block
    return g.select(*KEY, *[c for c in g.columns if c.startswith("rep_pca")])


@query("s13_neighbour_distance")
def _(spark, folder):
    """Distance of window rows to their ten nearest reference rows."""
    return monitor(spark, folder, LINES).distance_block.select(
        *KEY, "rep_knn_dist_mean", "rep_knn_dist_q90", "rep_knn_dist_max")


@query("s14_uncertainty")
def _(spark, folder):
    """Entropy, energy score, aleatoric and epistemic parts, member spread."""
    m = monitor(spark, folder, LINES)
    return st.class_uncertainty_block(m.deployment)


@query("s17_members")
def _(spark, folder):
    """Nested truncations as ensemble members (first 20, 40, ... % of the fit)."""
    m = monitor(spark, folder, LINES)
    cols = [F.avg(F.col("members").getItem(i).getItem(2)).alias(f"member_{i}") for i in range(5)]
    return m.deployment.groupBy(*KEY).agg(*cols)


@query("s19_kernel_discrepancy")
def _(spark, folder):
    """Unbiased squared kernel discrepancy at the frozen bandwidth."""
    return monitor(spark, folder, LINES).distance_block.select(*KEY, "dist_mmd2")


@query("s20_distribution_distances")
def _(spark, folder):
    """Energy, Wasserstein and Kolmogorov-Smirnov distances over features."""
    g = monitor(spark, folder, LINES).distance_block
    return g.select(*KEY, "dist_energy", *[c for c in g.columns
                                           if c.startswith(("dist_wasser", "dist_ks"))])


@query("s23_stability_index")
def _(spark, folder):
    """PSI on frozen cut points, mean shift and scale ratio."""
    m = monitor(spark, folder, LINES)
    return st.moment_block(m.deployment, m.reference_features)


@query("s25_matured")
def _(spark, folder):
    """Number of risks known at each window when labels are two windows late."""
    return st.matured_risks(monitor(spark, folder, EVENTS).risk, 2)


@query("s26_feedback")
def _(spark, folder):
    """Statistics of the known risks with a delay of two windows."""
    m = monitor(spark, folder, EVENTS)
    return st.feedback_block(m.risk, m.reference_risk, 2)


@query("s30_calibration_error")
def _(spark, folder):
    """Calibration error of the latest labelled window."""
    m = monitor(spark, folder, LINES)
    out = st.feedback_block(m.risk, m.reference_risk, 1, ece=st.calibration_error(m.deployment))
    return out.select(*KEY, "fb_ece")


@query("s31_context")
def _(spark, folder):
    """Deployment age and calendar of each window's start."""
    return st.context_block(monitor(spark, folder, EVENTS).risk)


@query("s34_interventions")
def _(spark, folder):
    """State of past interventions, joined as of each window."""
    m = monitor(spark, folder, EVENTS)
    return st.adaptation_block(m.risk, interventions(m))


@query("s35_block_selection")
def _(spark, folder):
    """A subset of blocks leaves the surviving columns unchanged."""
    states = monitor(spark, folder, EVENTS).states
    return st.select_blocks(states, ["ctx", "adapt"])


@query("s36_state_and_risk")
def _(spark, folder):
    """State beside its realised risk; the state of a window never contains that risk."""
    m = monitor(spark, folder, EVENTS)
    return m.states.select(*KEY, "fb_risk_last", "fb_n_matured", "ctx_deployment_age").join(
        m.risk.select(*KEY, "risk"), KEY)


@query("s38_census")
def _(spark, folder):
    """Columns and constant-zero columns per block and stream."""
    m = monitor(spark, folder, EVENTS)
    return st.census(st.assemble([st.value_prediction_block(m.deployment),
                                  st.value_uncertainty_block(m.deployment)]))


@query("s39_given_log")
def _(spark, folder):
    """The state table of a given prediction log with its own embedding, and its risk."""
    m = monitor(spark, folder, GIVEN)
    return m.states.join(m.risk.select(*KEY, "risk"), KEY)


@query("s39_monitor")
def _(spark, folder):
    """The full state table of a classification stream in one call."""
    m = monitor(spark, folder, LINES)
    return m.states.join(m.risk.select(*KEY, "risk"), KEY)


@query("s39_boosted")
def _(spark, folder):
    """The full state table under a frozen model of boosted trees with three classes."""
    m = monitor(spark, folder, BOOSTED)
    return m.states.join(m.risk.select(*KEY, "risk"), KEY)


@query("s33_regime")
def _(spark, folder):
    """The operating regime of each window, as the state table of a stream with regimes has it."""
    return monitor(spark, folder, SHIFTS).state(("ctx",)).select(*KEY, "ctx_regime")
