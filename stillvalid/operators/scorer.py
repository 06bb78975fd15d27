"""Frozen scorers fitted on the pre-deployment segment only.

The rate table predicts from the pre-deployment rows that share a key. It is one aggregate, any SQL
engine can restate it, and its nested prefixes (the first 20, 40, ... % of the segment) serve as
ensemble members. Spark ML models are in :mod:`stillvalid.operators.learned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import argmax, clipped, spread
from .risk import bounded_absolute_error, zero_one_loss


def _shares(counts: list[Column], other: list[Column]) -> Column:
    n, m = sum(counts[1:], counts[0]), sum(other[1:], other[0])
    k = len(counts)
    return F.array(*[F.when(n > 0, c / n).when(m > 0, o / m).otherwise(F.lit(1.0 / k))
                     for c, o in zip(counts, other)])


def fit_class_rates(pre: DataFrame, classes: int, members: int) -> tuple[DataFrame, DataFrame]:
    """(by key, by stream) class shares per nested prefix; the last member is the full segment."""
    within = [F.col("row_idx") < F.floor(F.col("boundary") * m / members)
              for m in range(1, members + 1)]
    names = [[f"c{m}_{k}" for k in range(classes)] for m in range(members)]
    flat = [n for row in names for n in row]
    by_key = pre.groupBy("stream_id", "score_key").agg(*[
        F.count_if(within[m] & (F.col("y") == k)).alias(names[m][k])
        for m in range(members) for k in range(classes)])
    by_stream = by_key.groupBy("stream_id").agg(*[F.sum(n).alias(f"s_{n}") for n in flat])

    def table(df: DataFrame, own: str) -> list[Column]:
        return [F.array(*[_shares([F.col(own + n) for n in names[m]],
                                  [F.col("s_" + n) for n in names[m]])
                          for m in range(members)])]

    keyed = by_key.join(by_stream, "stream_id").select(
        "stream_id", "score_key", table(by_key, "")[0].alias("members"))
    return keyed, by_stream.select("stream_id", table(by_stream, "s_")[0].alias("stream_members"))


def _with_scores(rates: DataFrame, members: int) -> DataFrame:
    out = rates.withColumn("proba", F.col("members").getItem(members - 1))
    out = out.withColumn("raw", F.transform(clipped(F.col("proba")), lambda p: F.log(p)))
    return out.withColumn("y_pred", argmax(F.col("proba")).cast("double"))


def score_classes(rows: DataFrame, keyed: DataFrame, by_stream: DataFrame,
                  members: int) -> DataFrame:
    # What follows from the rates alone is worked out once for each key, not for each row.
    made = ["members", "proba", "raw", "y_pred"]
    by_stream = _with_scores(by_stream.withColumnRenamed("stream_members", "members"), members).withColumnsRenamed(
        {c: f"stream_{c}" for c in made})
    out = rows.join(by_stream, "stream_id").join(_with_scores(keyed, members), ["stream_id", "score_key"], "left")
    out = out.withColumns({c: F.coalesce(c, f"stream_{c}") for c in made}).drop(*[f"stream_{c}" for c in made])
    return out.withColumn("loss", zero_one_loss(F.col("y"), F.col("y_pred")))


# -- given prediction logs -------------------------------------------------------------------
def log_violations(rows: DataFrame, classes: int, embedding: bool) -> DataFrame:
    """Per stream: rows whose logged prediction is missing or no probability vector, and rows whose
    embedding is missing, has missing entries or another length than the first. No row: all is well."""
    if classes:
        p = F.col("proba")
        inside = F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0))
        total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
        good = (F.size(p) == classes) & inside & (F.abs(total - 1.0) <= 1e-6)
    else:
        good = F.col("y_pred").isNotNull()
    bad = [F.count_if(~F.coalesce(good, F.lit(False))).alias("n_bad_predictions")]
    if embedding:
        e = F.col("embedding")
        whole = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v))
        bad += [F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_bad_embeddings"),
                (F.max(F.size(e)) - F.min(F.size(e))).alias("width_range")]
    out = rows.groupBy("stream_id").agg(*bad)
    return out.filter(" or ".join(f"{c} > 0" for c in out.columns[1:]))


def given_classes(rows: DataFrame) -> DataFrame:
    """Loss of logged class probabilities; missing parts follow from the probabilities."""
    out = rows
    if "raw" not in rows.columns:
        out = out.withColumn("raw", F.transform(clipped(F.col("proba")), lambda p: F.log(p)))
    if "members" not in rows.columns:
        out = out.withColumn("members", F.array("proba"))
    out = out.withColumn("y_pred", argmax(F.col("proba")).cast("double"))
    return out.withColumn("loss", zero_one_loss(F.col("y"), F.col("y_pred")))


def given_values(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Loss of logged numbers, in units of the target's pre-deployment spread."""
    return rows.join(scale, "stream_id").withColumn(
        "loss", bounded_absolute_error(F.col("y"), F.col("y_pred"), F.col("scale")))


def target_scale(pre: DataFrame) -> DataFrame:
    return pre.groupBy("stream_id").agg(spread(F.col("y")).alias("scale"))


def fit_means(pre: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = pre.groupBy("stream_id", "score_key").agg(F.avg("y").alias("key_mean"))
    by_stream = pre.groupBy("stream_id").agg(F.avg("y").alias("stream_mean"),
                                             spread(F.col("y")).alias("scale"))
    return keyed, by_stream


def score_means(rows: DataFrame, keyed: DataFrame, by_stream: DataFrame) -> DataFrame:
    out = rows.join(by_stream, "stream_id").join(keyed, ["stream_id", "score_key"], "left")
    out = out.withColumn("y_pred", F.coalesce("key_mean", "stream_mean"))
    out = out.withColumn("loss", bounded_absolute_error(F.col("y"), F.col("y_pred"),
                                                        F.col("scale")))
    return out.drop("key_mean", "stream_mean")
