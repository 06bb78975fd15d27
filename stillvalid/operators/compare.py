"""Paired statistics between methods, and block-aware resampling.

Pairs arrive as (keys..., stream_id, origin, a, b): one row per origin scored by both methods.
Ranks come from value counts and running sums, so no sample is sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import settle, uniform
from ..functions.pvalues import signed_rank_p_col
from .ordered import running_sum, unit_bucket

# Significance level and smallest effect that counts.
ALPHA = 0.05
MIN_EFFECT = 0.147
#: Draws in one vector of partial sums; keys that a task holds at once.
PART, KEYS_HELD = 4096, 64


def pair_methods(scores: DataFrame, method: str, value: str) -> DataFrame:
    """Pair one method with every other (``baseline``) on the same origin."""
    key = ["stream_id", "origin"]
    mine = scores.filter(F.col("method") == method).select(*key, F.col(value).alias("a"))
    other = scores.filter(F.col("method") != method).select(
        *key, F.col("method").alias("baseline"), F.col(value).alias("b"))
    return mine.join(other, key)


def dominance(samples: DataFrame, keys: Sequence[str], value: str, first: Column,
              bucket: Column | None) -> DataFrame:
    """P(first > second) - P(first < second) for two labelled samples per key."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(first).alias("na"), F.count_if(~first).alias("nb"))
    ranked = running_sum(counts, keys, value, bucket, {"cb": F.col("nb")})
    size = counts.groupBy(*keys).agg(F.sum("na").alias("n_first"), F.sum("nb").alias("n_second"))
    below_minus_above = 2 * F.col("cb") - F.col("nb") - F.col("n_second")
    return ranked.join(size, list(keys)).groupBy(*keys, "n_first", "n_second").agg(
        F.try_divide(F.sum(F.col("na") * below_minus_above).cast("double"),
                     (F.first("n_first") * F.first("n_second")).cast("double")).alias("delta"))


def cliffs_delta(pairs: DataFrame, keys: Sequence[str], bucket=None) -> DataFrame:
    """Dominance of ``a`` over ``b``; ``bucket`` as in ``running_sum``."""
    both = pairs.select(*keys, F.inline(F.array(
        F.struct(F.lit(True).alias("first"), settle(F.col("a")).alias("v")),
        F.struct(F.lit(False).alias("first"), settle(F.col("b")).alias("v")))))
    return dominance(both, keys, "v", F.col("first"), bucket).select(
        *keys, F.col("delta").alias("effect_delta"))


def rank_auc(scored: DataFrame, keys: Sequence[str], label: str, score: str,
             bucket=None) -> DataFrame:
    """Area under the ROC curve with ties averaged."""
    return dominance(scored, keys, score, F.col(label) == 1, bucket).select(
        *keys, ((F.col("delta") + 1.0) / 2.0).alias("auc"))


def paired_d(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired Cohen's d; 0 when all differences agree, NULL under two pairs."""
    d = F.col("a") - F.col("b")
    sd = F.stddev_samp(d)
    return pairs.groupBy(*keys).agg(
        F.when(F.count(d) < 2, F.lit(None)).when(sd > 0, F.avg(d) / sd).otherwise(F.lit(0.0))
         .alias("effect_d"))


def signed_ranks(pairs: DataFrame, keys: Sequence[str], bucket=None) -> DataFrame:
    """Signed-rank statistic ``a`` against ``b``: W+, ties, zeros and pairs that differ at all."""
    known = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = settle(F.col("a") - F.col("b"))
    far = F.abs(F.col("a") - F.col("b")) > 1e-8 + 1e-5 * F.abs(F.col("b"))
    counts = known.select(*keys, F.abs(d).alias("m"), F.signum(d).alias("sign"),
                          far.alias("far")).groupBy(*keys, "m").agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("sign") > 0).alias("pos"),
        F.count_if(F.col("sign") == 0).alias("zero"), F.count_if("far").alias("n_far"))
    ranked = running_sum(counts, keys, "m", bucket, {"upto": F.col("t")})
    rank = F.col("upto") - (F.col("t") - 1) / 2.0
    t = F.col("t").cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum(rank * (F.col("pos") + 0.5 * F.col("zero"))).alias("w_plus"),
        F.sum("t").cast("bigint").alias("n_pairs"), F.sum(t * t * t - t).alias("tie_sum"),
        F.sum("zero").cast("bigint").alias("n_zero"), F.sum("n_far").cast("bigint").alias("n_far"))


def wilcoxon(pairs: DataFrame, keys: Sequence[str], bucket=None) -> DataFrame:
    """One-sided paired signed-rank test that ``a`` is smaller."""
    w = signed_ranks(pairs, keys, bucket)
    return w.withColumn("p_raw", signed_rank_p_col("w_plus", "n_pairs", "tie_sum", "n_zero",
                                                   "n_far"))


def holm(tests: DataFrame, family: Sequence[str], p: str = "p_raw",
         alpha: float = ALPHA) -> DataFrame:
    """Step-down correction inside each family (one row per comparison)."""
    order = Window.partitionBy(*family).orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = (n - F.row_number().over(order) + 1) * F.col(p)
    out = tests.withColumn("_step", step)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("p_adjusted", F.least(F.max("_step").over(upto), F.lit(1.0)))
    return out.withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_step")


def compare(pairs: DataFrame, family: Sequence[str], bucket=None) -> DataFrame:
    """Full comparison record per family and baseline, with the rule for "beats"."""
    keys = [*family, "baseline"]
    means = pairs.groupBy(*keys).agg(F.avg("a").alias("method_mean"),
                                     F.avg("b").alias("baseline_mean"))
    tests = wilcoxon(pairs, keys, bucket).select(*keys, "n_pairs", "p_raw")
    out = (means.join(tests, keys).join(cliffs_delta(pairs, keys, bucket), keys)
                .join(paired_d(pairs, keys), keys))
    out = holm(out, family)
    return out.withColumn("beats", F.col("rejected")
                          & (F.abs(F.col("effect_delta")) >= MIN_EFFECT))


# -- block resampling ------------------------------------------------------------------------
def block_sums(values: DataFrame, keys: Sequence[str], value: str, block: str) -> DataFrame:
    """(sum, count) per block, numbered 0..B-1 within the keys."""
    sums = values.filter(F.col(value).isNotNull()).groupBy(*keys, block).agg(
        F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_u", uniform("block", block))
    ordered = sums.withColumn("_o", F.struct("_u", block))
    ranked = running_sum(ordered, keys, "_o", unit_bucket(F.col("_u")), {"_rank": F.lit(1)})
    size = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    return ranked.join(size, list(keys)).withColumn("_id", F.col("_rank") - 1).drop(
        "_u", "_o", "_rank")


def blocked_bootstrap(values: DataFrame, keys: Sequence[str], value: str, block: str = "stream_id",
                      draws: int = 2000, level: float = 0.95, seed: str = "boot") -> DataFrame:
    """Mean with an interval from resampling whole blocks; no interval under two blocks.

    A draw picks B blocks with replacement; only block sums are resampled, never rows.
    """
    blocks = block_sums(values, keys, value, block)
    picks = blocks.select(*keys, "n_blocks", "_id",
                          F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw"))
    u = uniform(seed, *keys, "_draw", "_id")
    picks = picks.select(*keys, "_draw", F.floor(u * F.col("n_blocks")).cast("bigint").alias("_id"))
    means = picks.join(blocks.select(*keys, "_id", "_sum", "_n"), [*keys, "_id"]).groupBy(
        *keys, "_draw").agg((F.sum("_sum") / F.sum("_n")).alias("_m"))
    tail = (1.0 - level) / 2.0
    interval = means.groupBy(*keys).agg(          # at most ``draws`` values per key
        F.percentile("_m", F.lit(tail)).alias("lo"),
        F.percentile("_m", F.lit(1.0 - tail)).alias("hi"))
    point = blocks.groupBy(*keys).agg((F.sum("_sum") / F.sum("_n")).alias("point"),
                                      F.first("n_blocks").alias("n_blocks"))
    wide = F.col("n_blocks") >= 2
    return point.join(interval, list(keys)).select(
        *keys, "point", F.when(wide, F.col("lo")).alias("lo"),
        F.when(wide, F.col("hi")).alias("hi"), "n_blocks")


def blocked_permutation(pairs: DataFrame, keys: Sequence[str], block: str = "stream_id",
                        draws: int = 20000, seed: str = "flip") -> DataFrame:
    """Two-sided p of the mean block difference under random sign flips of whole blocks.

    Draws are vectors, never rows: every task adds its blocks' signed differences up.
    """
    means = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy(
        *keys, block).agg(settle(F.avg(F.col("a") - F.col("b"))).alias("_m"))
    text = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(block).cast("string"))
    rows = means.select(*keys, "_m", text.alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keys)])

    def flipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums over a task's blocks under every draw: one vector for each key, in parts."""
        sums: dict[tuple, list] = {}
        for batch in batches:
            for *key, m, name in batch.itertuples(index=False, name=None):
                own = sums.setdefault(tuple(key), [0, 0.0, np.zeros(draws)])
                own[0], own[1] = own[0] + 1, own[1] + m
                own[2] += np.where(sign_bits(name, draws), -m, m)
            if len(sums) > KEYS_HELD:
                yield parts(sums)
                sums = {}
        if sums:
            yield parts(sums)

    def parts(sums: dict[tuple, list]) -> pd.DataFrame:
        out = [(*key, n, total, i, list(part)) for key, (n, total, draw) in sums.items()
               for i, part in enumerate(np.array_split(draw, -(-draws // PART)))]
        return pd.DataFrame(out, columns=[*keys, "_n", "_total", "_part", "_sums"])

    # What is shuffled is a few vectors from each task, however many blocks there are.
    vectors = rows.mapInPandas(flipped, f"{kinds}, _n bigint, _total double, _part int, _sums array<double>")
    joint = vectors.groupBy(*keys, "_part").agg(
        F.sum("_n").alias("n_blocks"), F.sum("_total").alias("_total"),
        vector_to_array(Summarizer.sum(array_to_vector("_sums"))).alias("_sums"))
    n = F.col("n_blocks")
    extreme = F.size(F.filter("_sums", lambda v: F.abs(v / n) >= F.abs(F.col("_total") / n) - 1e-12))
    p = joint.withColumn("_extreme", extreme).groupBy(*keys).agg(
        F.first("n_blocks").alias("n_blocks"), (F.first("_total") / F.first("n_blocks")).alias("observed"),
        (F.sum("_extreme") / draws).alias("_p"))
    return p.select(*keys, "observed", "n_blocks",
                    F.greatest(F.col("_p"), F.lit(1.0 / draws)).alias("p_value"),
                    F.pow(F.lit(2.0), 1 - F.col("n_blocks")).alias("min_attainable_p"))


def sign_bits(name: str, draws: int) -> np.ndarray:
    """Whether each draw flips a block: the bits of digests of its name, 128 draws from each."""
    digests = b"".join(hashlib.md5(f"{name}|{i}".encode()).digest() for i in range(-(-draws // 128)))
    return np.unpackbits(np.frombuffer(digests, np.uint8))[:draws].astype(bool)


# -- summaries and verdicts ------------------------------------------------------------------
def summarise_seeds(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key over seeds: concordance and score spread, calibration rejections, seeds beaten.

    ``results``: seed, concordance, ipcw_ibs, d_cal_p, effect_delta, p_adjusted, beats.
    """
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("concordance").alias("c_mean"), F.stddev_pop("concordance").alias("c_sd"),
        F.avg("ipcw_ibs").alias("ibs_mean"), F.stddev_pop("ipcw_ibs").alias("ibs_sd"),
        F.percentile("d_cal_p", F.lit(0.5)).alias("d_cal_p_median"),
        F.count_if(F.col("d_cal_p") < ALPHA).alias("d_cal_rejected_seeds"),
        F.avg("effect_delta").alias("mean_delta"), F.avg("p_adjusted").alias("mean_p_adj"),
        F.count_if(F.col("beats")).alias("seeds_beaten"))


def assign_tier(datasets: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """PRIMARY or SECONDARY by the declared rules (``dataset``, ``drift_class``, ``usable``)."""
    classified = F.coalesce(F.col("drift_class").isin("PHYSICAL", "SOCIAL"), F.lit(False))
    reason = (F.when(F.col("dataset").isin(list(excluded)), "hypothesis-generating")
              .when(~classified, "drift class not in the test")
              .when(~F.coalesce(F.col("usable"), F.lit(False)), "fails the usability screen"))
    return (datasets.withColumn("tier", F.when(reason.isNull(), "PRIMARY").otherwise("SECONDARY"))
            .withColumn("tier_reason", F.coalesce(reason, F.lit("usable and classified"))))


def boundary_verdict(summary: DataFrame) -> DataFrame:
    """Verdict over datasets (``tier``, ``drift_class``, ``seeds_beaten``, ``n_seeds``).

    Undecided under three primary physical datasets; refuted by any beaten social one; supported
    from two beaten physical ones.
    """
    primary = F.col("tier") == "PRIMARY"
    won = primary & (F.col("seeds_beaten") == F.col("n_seeds"))
    phys, soc = F.col("drift_class") == "PHYSICAL", F.col("drift_class") == "SOCIAL"
    agg = summary.agg(F.count_if(primary & phys).alias("n_physical"),
                      F.count_if(won & phys).alias("n_physical_beaten"),
                      F.count_if(won & soc).alias("n_social_beaten"))
    return agg.withColumn(
        "verdict", F.when(F.col("n_physical") < 3, "UNDECIDED")
        .when(F.col("n_social_beaten") > 0, "REFUTED")
        .when(F.col("n_physical_beaten") >= 2, "SUPPORTED").otherwise("REFUTED"))


def equivalence(results: DataFrame, keys: Sequence[str], value: str = "concordance",
                centre: float = 0.5, limit: float = 0.10) -> DataFrame:
    """Negative control: does the mean leave the equivalence band around chance?"""
    out = results.groupBy(*keys).agg(F.avg(value).alias("mean_value"))
    gap = F.abs(F.col("mean_value") - centre)
    return out.withColumn("deviation", gap).withColumn("outside_band", gap > limit)
