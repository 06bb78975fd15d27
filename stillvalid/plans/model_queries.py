"""Queries on forecasters, survival estimators and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import settle
from ..operators import forecast as fc
from ..operators import boosting, learned, survival, targets
from ..session import freeze
from .catalog import query
from .contest import Contest, contest
from .monitor import Monitor, monitor
from .specs import BOOSTED, EVENTS, LINES
from .targets_queries import GAP

COVARIATES = ["fb_risk_last", "fb_risk_mean", "fb_risk_slope", "ctx_deployment_age_log"]


def events_contest(spark, folder) -> Contest:
    return contest(monitor(spark, folder, EVENTS), GAP)


def curve_rows(curves, *keys):
    """Long form of survival arrays: (keys, h, s)."""
    return curves.select(*keys, F.posexplode("surv").alias("_i", "s")).select(
        *keys, (F.col("_i") + 1).alias("h"), "s")


def origin_states(m: Monitor, part, columns):
    states = m.states.select("stream_id", F.col("window_idx").alias("origin"), *columns)
    return part.join(states, ["stream_id", "origin"])


@query("m1_forecast_candidates")
def _(spark, folder):
    """M1-M4, M7: level and slope of every method and grid setting at each origin."""
    out = fc.candidate_lines(monitor(spark, folder, EVENTS).origins)
    return out.withColumn("setting", F.coalesce("setting", F.lit(-1.0))).drop("position")


@query("m5_ar_one")
def _(spark, folder):
    """M5: first-order autoregression, iterated to the horizon."""
    o = monitor(spark, folder, EVENTS).origins
    out = fc.ar_forecasts(o, 1, 20)
    return out.select("stream_id", "origin", F.posexplode("pred").alias("_i", "pred")).select(
        "stream_id", "origin", (F.col("_i") + 1).alias("h"), "pred")


@query("m5_ar_tuned")
def _(spark, folder):
    """M5, M6: autoregressive order chosen on the calibration origins, forecast on the test ones."""
    c = events_contest(spark, folder)
    best = fc.tune_ar(c.part("calibration"), 20).first()
    out = fc.ar_forecasts(c.part("test"), int(best["setting"]), 20)
    return out.select("stream_id", "origin", F.lit(int(best["setting"])).alias("order"),
                      F.posexplode("pred").alias("_i", "pred")).withColumn(
        "h", F.col("_i") + 1).drop("_i")


@query("m6_tuned_settings")
def _(spark, folder):
    """M6: grid setting of each method with the lowest calibration error."""
    return events_contest(spark, folder).tuned.select(
        "method", F.coalesce("setting", F.lit(-1.0)).alias("setting"), "mae")


@query("m8_kaplan_meier")
def _(spark, folder):
    """M8: marginal survival of time to violation, per stream."""
    o = monitor(spark, folder, EVENTS).origins
    return curve_rows(survival.kaplan_meier(o, 20, ["stream_id"]), "stream_id")


@query("m9_age_kaplan_meier")
def _(spark, folder):
    """M9: survival by deployment-age bin, cut on training origins, for each test origin."""
    c = events_contest(spark, folder)
    train, test = c.with_age(c.part("train")), c.with_age(c.part("test"))
    return curve_rows(survival.age_kaplan_meier(train, test, 20, "age"), "stream_id", "origin",
                      "age_bin")


@query("m10_censoring_curve")
def _(spark, folder):
    """Kaplan-Meier of the censoring times."""
    return curve_rows(survival.censoring_curve(monitor(spark, folder, EVENTS).origins, 20))


@query("m11_cox")
def _(spark, folder):
    """Penalised Cox regression on principal scores of the full state (classification); every row says
    whether its curve is an estimate, and why not."""
    m = monitor(spark, folder, LINES)
    c = contest(m, GAP)
    columns = [f for f in m.states.columns if f not in ("stream_id", "window_idx")]
    return curve_rows(c.cox_curves(columns), "stream_id", "origin", "method", "status", "reason")


@query("m12_hazard_to_survival")
def _(spark, folder):
    """Survival as the running product of one minus the hazard."""
    long = targets.person_periods(monitor(spark, folder, EVENTS).origins)
    hazards = long.groupBy("stream_id").agg(*[
        F.avg(F.when(F.col("h") == h, F.col("failed"))).alias(f"_h{h}") for h in range(1, 21)])
    arr = F.array(*[F.coalesce(F.col(f"_h{h}"), F.lit(0.0)) for h in range(1, 21)])
    return curve_rows(hazards.select("stream_id", survival.hazard_to_survival(arr).alias("surv")),
                      "stream_id")


@query("m13_discrete_hazard")
def _(spark, folder):
    """Discrete hazard by logistic regression on person-periods."""
    c = events_contest(spark, folder)
    train, test = (origin_states(c.monitor, c.part(p), COVARIATES) for p in ("train", "test"))
    model = learned.fit_hazard(train, COVARIATES, 20, regParam=1e-3)
    return curve_rows(learned.hazard_curves(model, test, COVARIATES, 20), "stream_id", "origin")


def _risk_model(c: Contest):
    train, test = (origin_states(c.monitor, c.part(p), COVARIATES) for p in ("train", "test"))
    model, sigma, rho = learned.fit_risk_path(train, COVARIATES, 20)
    return learned.risk_path_centres(model, test, COVARIATES, 20), sigma, rho


@query("m14_risk_path_model")
def _(spark, folder):
    """Multi-horizon risk path from state, as a correction of the anchor."""
    out, _, _ = _risk_model(events_contest(spark, folder))
    return out.select("stream_id", "origin", F.posexplode("pred").alias("_i", "pred")).select(
        "stream_id", "origin", (F.col("_i") + 1).alias("h"), "pred")


@query("m16_sampled_survival")
def _(spark, folder):
    """First-passage survival from paths sampled around the fitted risk path."""
    out, sigma, rho = _risk_model(events_contest(spark, folder))
    return curve_rows(survival.sampled_paths(out, sigma, rho, 256), "stream_id", "origin")


def _anchor_paths(spark, folder):
    """Paths around the anchor of every origin; their spread is that of the training origins."""
    c = events_contest(spark, folder)
    sigma, rho = survival.anchor_residuals(c.part("train"), 20)
    centre = F.array_repeat(settle(learned.logit(F.col("anchor"))), 20)
    return survival.sampled_paths(c.monitor.origins.withColumn("centre", centre), sigma, rho, 256)


@query("m15_first_passage")
def _(spark, folder):
    """First-passage survival from paths sampled around the anchor."""
    return curve_rows(_anchor_paths(spark, folder), "stream_id", "origin")


@query("m17_mean_path")
def _(spark, folder):
    """Mean of the sampled risk paths."""
    return _anchor_paths(spark, folder).select("stream_id", "origin", F.posexplode("pred").alias("_i", "pred")).select(
        "stream_id", "origin", (F.col("_i") + 1).alias("h"), "pred")


@query("m18_horizon_readouts")
def _(spark, folder):
    """Expected, median and lower-bound validity horizon of each test origin."""
    return survival.horizon_readouts(events_contest(spark, folder).reference_curves, 20)


def _binary_rows(spark, folder):
    m = monitor(spark, folder, LINES)
    return m.rows.select("segment", "stream_id", "row_idx", "window_idx", "x",
                         (F.col("y") == 2).cast("double").alias("y"))


def _by_window(scored, *extra):
    return scored.filter("segment = 'dep' and window_idx is not null").groupBy(
        "stream_id", "window_idx").agg(F.avg("y_pred").alias("mean_prediction"), *extra)


@query("m19_logistic_scorer")
def _(spark, folder):
    """Frozen logistic scorer fitted on the pre-deployment segment, applied to all rows."""
    rows = _binary_rows(spark, folder)
    model = learned.fit_scorer(rows.filter("segment = 'pre'"), "logistic", classes=2)
    return _by_window(learned.score(rows, model, 2), F.avg(F.col("proba")[1]).alias("mean_p"))


@query("m19_forest_scorer")
def _(spark, folder):
    """Frozen random forest for three classes."""
    m = monitor(spark, folder, LINES)
    rows = m.rows.select("segment", "stream_id", "row_idx", "window_idx", "x", "y")
    model = learned.fit_scorer(rows.filter("segment = 'pre'"), "forest", classes=3, numTrees=200)
    return _by_window(learned.score(rows, model, 3), F.avg(F.col("proba")[2]).alias("mean_p"))


@query("m20_tree_embedding")
def _(spark, folder):
    """Boosted trees; leaf embedding of 32 dimensions and truncated members."""
    rows = _binary_rows(spark, folder)
    model = learned.fit_scorer(rows.filter("segment = 'pre'"), "boosted", classes=2, maxIter=10,
                               maxDepth=3)
    scored = learned.tree_embedding(learned.score(rows, model, 2), 10)
    out = learned.truncated_members(scored, model)
    return _by_window(out, F.avg(F.col("z")[0]).alias("mean_z0"),
                      F.avg(F.col("z")[31]).alias("mean_z31"),
                      *[F.avg(F.col("members")[i][1]).alias(f"member_{i}") for i in range(5)])


#: Cut points of the stumps, fixed so that SQL can restate them.
STUMP_EDGES = ((10.0, 20.0, 30.0, 40.0), (20000.0, 40000.0, 60000.0, 80000.0), (0.02, 0.04, 0.06, 0.08),
               (0.02, 0.04, 0.06))


@query("m19_boosted_stumps")
def _(spark, folder):
    """Two rounds of boosted stumps for three classes; mean probabilities of each window."""
    m = monitor(spark, folder, LINES)
    settings = boosting.Settings(rounds=2, depth=1, rate=0.5, row_share=1.0, feature_share=1.0)
    model = boosting.fit(m.pre, classes=3, settings=settings, edges=[boosting.np.array(e) for e in STUMP_EDGES])
    scored = boosting.score(m.deployment.select("stream_id", "window_idx", "x"), model)
    return scored.groupBy("stream_id", "window_idx").agg(
        *[F.round(F.avg(F.col("proba")[k]), 6).alias(f"p{k}") for k in range(3)])


@query("m19_boosted_monitor")
def _(spark, folder):
    """200 rounds of boosted trees for three classes as a monitor's frozen scorer, by window."""
    m = monitor(spark, folder, BOOSTED)
    return m.deployment.groupBy("stream_id", "window_idx").agg(
        F.avg("loss").alias("risk"), *[F.avg(F.col("proba")[k]).alias(f"p{k}") for k in range(3)],
        *[F.avg(F.col("members")[i][2]).alias(f"member_{i}") for i in range(5)])


@query("m20_boosted_embedding")
def _(spark, folder):
    """Mean of the projected leaf positions of each window, all 32 dimensions."""
    rows = monitor(spark, folder, BOOSTED).deployment
    return rows.groupBy("stream_id", "window_idx").agg(
        *[F.avg(F.col("embedding")[i]).alias(f"z{i}") for i in range(learned.EMBED_DIM)])


@query("m20_boosted_consistency")
def _(spark, folder):
    """Per window, how far scores are from the sums of their leaves, probabilities
    from the softmax of scores, and the last truncation from the whole model."""
    m = monitor(spark, folder, BOOSTED)
    rows = m.deployment.select("stream_id", "window_idx", "x", "y_pred")
    again = boosting.score(rows.withColumnRenamed("y_pred", "logged"), m.scorer_model, embedding=False, sums=True)
    apart = lambda a, b: F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v)))
    total = F.aggregate("leaf_sum", F.lit(0.0), lambda s, v: s + F.exp(v))
    soft = F.transform("leaf_sum", lambda v: F.exp(v) / total)
    zero = lambda c: (F.round(F.max(c), 6) + F.lit(0.0))
    return freeze(again.groupBy("stream_id", "window_idx").agg(
        F.count(F.lit(1)).alias("n"), zero(apart(F.col("raw"), F.col("leaf_sum"))).alias("leaf_gap"),
        zero(apart(F.col("proba"), soft)).alias("softmax_gap"),
        zero(apart(F.element_at("members", -1), F.col("proba"))).alias("truncation_gap"),
        F.count_if(F.col("logged") != F.col("y_pred")).alias("n_other_class")), "consistency")
