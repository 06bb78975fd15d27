"""Frozen reference statistics, fitted once on the pre-deployment segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import argmax, entropy, spread, uniform
from .ordered import quantiles_of_counts

# Fixed values of the statistics' definitions.
COMPONENTS = 8
PSI_BINS = 10


def monitor_view(features: Sequence[str], embedding: str | None, view: str) -> str | list[str]:
    """Columns the discrepancy block compares: the caller names inputs or embedding."""
    if view == "inputs":
        return list(features)
    if view != "embedding":
        raise ValueError(f"unknown view {view!r}")
    if embedding is None:
        raise ValueError("the embedding view needs an embedding column")
    return embedding


def long_features(rows: DataFrame, *keep: str, vector: str = "x") -> DataFrame:
    return rows.select("stream_id", *keep, F.posexplode(vector).alias("feature", "value"))


def feature_reference(pre: DataFrame, width: int, bins: int = PSI_BINS) -> DataFrame:
    """Mean, population spread and PSI cut points per stream and feature.

    Quantiles come from value counts in ranges of about equal size, so a long pre-deployment segment
    is never buffered in one group.
    """
    long = long_features(pre, vector="x").filter(F.col("value").isNotNull())
    moments = long.groupBy("stream_id", "feature").agg(
        F.avg("value").alias("mean"), spread(F.col("value")).alias("_std"))
    counts = long.groupBy("stream_id", "feature", "value").agg(F.count(F.lit(1)).alias("copies"))
    qs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles_of_counts(counts, ["stream_id", "feature"], "value", qs, copies="copies")
    cuts = F.array_sort(F.array_distinct(F.array(*list(qs))))
    inner = F.when(F.size(cuts) > 2, F.slice(cuts, 2, F.size(cuts) - 2)).otherwise(
        F.array().cast("array<double>"))
    edges = edges.select("stream_id", "feature", inner.alias("cuts"),
                         F.greatest(F.size(cuts) - 1, F.lit(1)).alias("n_bins"))
    std = F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0))
    return moments.select("stream_id", "feature", "mean", std.alias("std")).join(
        edges, ["stream_id", "feature"])


def scale_vectors(features: DataFrame) -> DataFrame:
    """One row per stream: the reference means and spreads as arrays in feature order."""
    packed = features.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("_f"))
    return packed.select("stream_id", F.col("_f.mean").alias("means"),
                         F.col("_f.std").alias("stds"))


def standardise(rows: DataFrame, scales: DataFrame, vector: str = "x") -> DataFrame:
    """``z``: the vector in units of the frozen reference (also the linear model's embedding)."""
    centred = F.zip_with(vector, "means", lambda x, m: x - m)
    return rows.join(scales, "stream_id").withColumn(
        "z", F.zip_with(centred, "stds", lambda c, s: c / s)).drop("means", "stds")


def reference_sample(pre: DataFrame, rows: int, seed: str = "reference") -> DataFrame:
    """The ``rows`` pre-deployment rows of each stream with the smallest hash draws.

    Every task keeps its own smallest draws before anything is shuffled, so the ranking of a stream
    sees at most ``rows`` rows from each task.
    """
    ranked = pre.select("stream_id", "row_idx", "x", uniform(seed, "row_idx").alias("_u")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("stream_id").orderBy("_u", "row_idx")))
    return ranked.filter(F.col("rank") <= rows).select("stream_id", "rank", "row_idx", "x")


def behaviour_reference(pre: DataFrame, classes: int) -> DataFrame:
    """Predicted-class shares, mean confidence and mean entropy on the reference."""
    top = argmax(F.col("proba"))
    n = F.count(F.lit(1))
    return pre.groupBy("stream_id").agg(
        F.array(*[F.count_if(top == k) / n for k in range(classes)]).alias("prior"),
        F.avg(F.array_max("proba")).alias("confidence_mean"),
        F.avg(entropy(F.col("proba"))).alias("entropy_mean"))


def fit_normaliser(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means and spreads of the training rows only; a flat column keeps unit spread."""
    packed = train.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns],
                       *[F.stddev_pop(c).alias(f"{c}__std") for c in columns])
    return packed.select(*[f"{c}__mean" for c in columns], *[
        F.when(F.col(f"{c}__std") > 1e-8, F.col(f"{c}__std")).otherwise(F.lit(1.0))
         .alias(f"{c}__std") for c in columns])


def normalise(rows: DataFrame, normaliser: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply a fitted normaliser (exactly one row) to every split."""
    joined = rows.join(F.broadcast(normaliser))
    out = joined.select(*[
        ((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).alias(c) if c in columns
        else F.col(c) for c in rows.columns])
    return out
