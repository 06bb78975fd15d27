"""Models fitted with Spark ML: frozen scorers, their embeddings, hazard and risk-path models.

Linear models stand where a neural network would; they are reported under their own names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bind, clip
from .survival import hazard_to_survival
from .targets import person_periods

# Embedding width of tree models and the logit guard.
EMBED_DIM = 32
LOGIT_EPS = 1e-6
FAMILIES = ("logistic", "linear", "boosted", "forest", "mlp")


def _vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector("x"))


def fit_scorer(pre: DataFrame, family: str, *, classes: int = 0, seed: int = 0,
               **params) -> PipelineModel:
    """Fit on the pre-deployment rows handed in; deployment rows never reach the trainer.

    Boosting has no multiclass form in Spark ML, so three or more classes need "forest".
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; choose from {FAMILIES}")
    scaler = StandardScaler(inputCol="_v", outputCol="_sv", withMean=True, withStd=True)
    common = {"labelCol": "y", "featuresCol": "_v"}
    if family == "logistic":
        stages = [scaler, LogisticRegression(labelCol="y", featuresCol="_sv", **params)]
    elif family == "linear":
        stages = [scaler, LinearRegression(labelCol="y", featuresCol="_sv", **params)]
    elif family == "boosted":
        if classes > 2:
            raise ValueError("boosted trees are binary or regression here; use 'forest'")
        kind = GBTClassifier if classes else GBTRegressor
        stages = [kind(seed=seed, leafCol="_leaf", **common, **params)]
    elif family == "forest":
        kind = RandomForestClassifier if classes else RandomForestRegressor
        stages = [kind(seed=seed, leafCol="_leaf", **common, **params)]
    else:
        width = len(pre.select("x").first()[0])
        layers = params.pop("layers", [width, 16, max(classes, 2)])
        stages = [scaler, MultilayerPerceptronClassifier(labelCol="y", featuresCol="_sv",
                                                         layers=layers, seed=seed, **params)]
    return Pipeline(stages=stages).fit(_vector(pre.filter("y is not null")))


def score(rows: DataFrame, model: PipelineModel, classes: int) -> DataFrame:
    """``y_pred`` and, for classes, ``proba`` and ``raw`` as arrays; ``leaf`` for tree models."""
    out = model.transform(_vector(rows))
    cols = [F.col(c) for c in rows.columns] + [F.col("prediction").alias("y_pred")]
    if classes:
        cols.append(vector_to_array("probability").alias("proba"))
        cols.append(vector_to_array("rawPrediction").alias("raw"))
    if "_leaf" in out.columns:
        cols.append(vector_to_array("_leaf").alias("leaf"))
    return out.select(*cols)


def tree_embedding(scored: DataFrame, n_trees: int, seed: int = 0, dim: int = EMBED_DIM,
                   leaf: str = "leaf") -> DataFrame:
    """``z``: leaf positions through a fixed random projection, drawn once from the seed."""
    rng = np.random.default_rng(seed)
    matrix = rng.normal(scale=1.0 / np.sqrt(max(n_trees, 1)), size=(n_trees, dim))
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in matrix[:, j]]) for j in range(dim)])
    dot = F.transform(columns, lambda w: F.aggregate(
        F.zip_with(w, leaf, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return scored.withColumn("z", dot)


def truncated_members(rows: DataFrame, model: PipelineModel, members: int = 5) -> DataFrame:
    """``members``: probabilities of a boosted binary model cut at 20, 40, ... % of its rounds.

    A boosted margin is the weighted sum of its trees, so each cut is a partial sum over the same
    tree outputs: every tree is evaluated once, inside Spark, as a regression stage.
    """
    boosted = model.stages[-1]
    trees, weights = boosted.trees, boosted.treeWeights
    out = _vector(rows)
    for i, tree in enumerate(trees):
        stage = tree.copy({tree.predictionCol: f"_t{i}", tree.featuresCol: "_v"})
        stage.setLeafCol("")
        out = stage.transform(out)
    probs = []
    for m in range(1, members + 1):
        upto = max(1, round(len(trees) * m / members))
        margin = sum((F.lit(float(weights[i])) * F.col(f"_t{i}") for i in range(1, upto)),
                     F.lit(float(weights[0])) * F.col("_t0"))
        p = 1.0 / (1.0 + F.exp(-2.0 * margin))
        probs.append(F.array(1.0 - p, p))
    return out.select(*rows.columns, F.array(*probs).alias("members"))


def reduce_states(train: DataFrame, other: DataFrame, state: str,
                  k: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Leading principal scores of the standardised state array, fitted on training origins only."""
    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector(state))

    pipe = Pipeline(stages=[
        StandardScaler(inputCol="_v", outputCol="_sv", withMean=True, withStd=True),
        PCA(k=k, inputCol="_sv", outputCol="_pc")]).fit(vectors(train))
    names = [f"pc{i}" for i in range(k)]

    def apply(df: DataFrame) -> DataFrame:
        scores = vector_to_array("_pc")
        return pipe.transform(vectors(df)).select(*[c for c in df.columns if c != state], *[
            scores.getItem(i).alias(n) for i, n in enumerate(names)])

    return apply(train), apply(other), names


# -- discrete hazard -------------------------------------------------------------------------
def _period_vector(df: DataFrame, covariates: Sequence[str], horizon: int) -> DataFrame:
    marks = [(F.col("h") == h).cast("double") for h in range(2, horizon + 1)]
    return df.withColumn("_v", array_to_vector(F.array(*marks, *[F.col(c).cast("double")
                                                                for c in covariates])))


def fit_hazard(train: DataFrame, covariates: Sequence[str], horizon: int, **params):
    """Discrete hazard: logistic regression on person-periods with one level per horizon."""
    long = _period_vector(person_periods(train), covariates, horizon)
    return LogisticRegression(labelCol="failed", featuresCol="_v", **params).fit(long)


def hazard_curves(model, origins: DataFrame, covariates: Sequence[str],
                  horizon: int) -> DataFrame:
    """Survival of each origin from the fitted coefficients, as one column expression."""
    w = [float(v) for v in model.coefficients.toArray()]
    levels = [0.0, *w[:horizon - 1]]
    slope = sum((F.lit(b) * F.col(c) for b, c in zip(w[horizon - 1:], covariates)),
                F.lit(float(model.intercept)))
    hazard = bind(slope, lambda b: F.transform(
        F.array(*[F.lit(v) for v in levels]), lambda v: 1.0 / (1.0 + F.exp(-(v + b)))))
    return origins.select("stream_id", "origin", "y_tilde", "event",
                      hazard_to_survival(hazard).alias("surv"),
                      F.lit("discrete_hazard").alias("method"))


# -- risk path -------------------------------------------------------------------------------
def logit(p: Column) -> Column:
    q = clip(p, LOGIT_EPS, 1.0 - LOGIT_EPS)
    return F.log(q / (1.0 - q))


def _path_rows(origins: DataFrame, covariates: Sequence[str], horizon: int,
               residual: bool) -> DataFrame:
    long = origins.select("stream_id", "origin", "anchor", *covariates,
                          F.posexplode("risk_path").alias("_i", "r")).withColumn(
        "h", F.col("_i") + 1).filter("r is not null")
    base = logit(F.col("anchor")) if residual else F.lit(0.0)
    return _period_vector(long.withColumn("_y", logit(F.col("r")) - base), covariates, horizon)


def path_levels(model, covariates: Sequence[str], horizon: int) -> Column:
    """The linear model's prediction for each horizon, as one array."""
    w = [float(v) for v in model.coefficients.toArray()]
    levels = [0.0, *w[:horizon - 1]]
    slope = sum((F.lit(b) * F.col(c) for b, c in zip(w[horizon - 1:], covariates)),
                F.lit(float(model.intercept)))
    return bind(slope, lambda b: F.transform(F.array(*[F.lit(v) for v in levels]), lambda v: v + b))


def fit_risk_path(train: DataFrame, covariates: Sequence[str], horizon: int, *,
                  residual: bool = True, **params) -> tuple[object, list[float], float]:
    """Huber regression of the logit risk path; with ``residual`` it corrects the anchor.

    Returns the model, the residual spread per horizon and the lag-one correlation of residuals.
    """
    long = _path_rows(train, covariates, horizon, residual)
    settings = {"loss": "huber", "maxIter": 50, "regParam": 1e-3, **params}
    model = LinearRegression(labelCol="_y", featuresCol="_v", **settings).fit(long)
    # What the path misses, as one array of each origin: a step and the next one meet without a join.
    base = logit(F.col("anchor")) if residual else F.lit(0.0)
    missed = F.zip_with(F.transform("risk_path", lambda r: logit(r) - base), path_levels(model, covariates, horizon),
                        lambda y, p: y - p)
    left = train.select(missed.alias("_m")).select("_m", F.posexplode("_m").alias("_i", "_e")).filter("_e is not null").select(
        (F.col("_i") + 1).alias("h"), "_e", F.get("_m", F.col("_i") + 1).alias("_f"))
    spread = {r["h"]: r["s"] for r in left.groupBy("h").agg(
        F.stddev_pop("_e").alias("s")).collect()}                       # H rows
    rho = left.agg(F.corr("_e", "_f")).first()[0]
    sigma = [float(spread.get(h) or 1e-3) for h in range(1, horizon + 1)]
    return model, sigma, float(min(max(rho or 0.0, 0.0), 0.99))


def risk_path_centres(model, origins: DataFrame, covariates: Sequence[str], horizon: int,
                      residual: bool = True) -> DataFrame:
    """Adds ``centre`` (logit forecast per horizon) and ``pred`` (the same as risks)."""
    base = logit(F.col("anchor")) if residual else F.lit(0.0)
    centre = bind(base, lambda b: F.transform(path_levels(model, covariates, horizon), lambda v: v + b))
    return origins.withColumn("centre", centre).withColumn(
        "pred", F.transform("centre", lambda v: 1.0 / (1.0 + F.exp(-v))))
