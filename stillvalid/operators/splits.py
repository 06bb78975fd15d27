"""Leakage-safe splits of origins and diagnostics on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import correlation_p_col
from ..functions.numeric import uniform
from .ordered import exact_quantiles, index_bucket, running_sum, unit_bucket

# Fixed value: smallest split that carries early stopping and a test.
MIN_SPLIT_ORIGINS = 30


def _fractions(train: float, cal: float) -> None:
    if not 0 < train < 1 or not 0 < cal < 1 or train + cal >= 1:
        raise ValueError(f"invalid split fractions: train={train}, cal={cal}")


def chronological_split(origins: DataFrame, train: float, cal: float, gap: int) -> DataFrame:
    """Add ``split`` per stream at quantiles of its origins; origins inside a gap are dropped."""
    _fractions(train, cal)
    tau = exact_quantiles(origins, ["stream_id"], "origin",
                          {"tau1": train, "tau2": train + cal},
                          index_bucket(F.col("origin"))).drop("n_values")
    t = F.col("origin")
    split = (F.when(t < F.col("tau1"), "train")
              .when((t >= F.col("tau1") + gap) & (t < F.col("tau2")), "calibration")
              .when(t >= F.col("tau2") + gap, "test"))
    out = origins.join(tau, "stream_id").withColumn("split", split)
    return out.filter(F.col("split").isNotNull()).drop("tau1", "tau2")


def stream_split(streams: DataFrame, train: float = 0.5, cal: float = 0.2,
                 seed: str = "split") -> DataFrame:
    """Assign whole streams to splits in hash order; half-way sizes round to even."""
    _fractions(train, cal)
    one = (streams.select("stream_id").distinct()
           .withColumn("_u", uniform(seed, "stream_id")).withColumn("_k", F.lit(0)))
    # Two streams can only share a draw by a hash collision; the id then decides.
    one = one.withColumn("_o", F.struct("_u", "stream_id"))
    ranked = running_sum(one, ["_k"], "_o", unit_bucket(F.col("_u")), {"rank": F.lit(1)})
    n = one.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    out = ranked.join(n, "_k")
    n_train = F.greatest(F.lit(1), F.bround(F.lit(train) * F.col("n"), 0))
    wanted = F.greatest(F.lit(1), F.bround(F.lit(cal) * F.col("n"), 0))
    n_cal = F.when(n_train + wanted >= F.col("n"),
                   F.greatest(F.lit(1), F.col("n") - n_train - 1)).otherwise(wanted)
    split = (F.when(F.col("n") < 3, F.raise_error(F.lit("a stream split needs three streams")))
              .when(F.col("rank") <= n_train, "train")
              .when(F.col("rank") <= n_train + n_cal, "calibration").otherwise("test"))
    return out.select("stream_id", split.alias("split"))


def check_splits(split_origins: DataFrame, minimum: int = MIN_SPLIT_ORIGINS) -> DataFrame:
    """Sizes per split; fails where a split is too small or holds no event."""
    sizes = split_origins.groupBy("split").agg(F.count(F.lit(1)).alias("n_origins"),
                                               F.sum("event").cast("bigint").alias("n_events"))
    bad = (F.col("n_origins") < minimum) | (F.col("n_events") == 0)
    message = F.concat(F.lit("split cannot be used: "), F.col("split"), F.lit(" origins="),
                       F.col("n_origins").cast("string"), F.lit(" events="),
                       F.col("n_events").cast("string"))
    return sizes.withColumn("ok", F.when(bad, F.raise_error(message).cast("boolean"))
                            .otherwise(F.lit(True)))


def leave_one_out(rows: DataFrame, column: str, domains: Sequence[str]) -> DataFrame:
    """For every held-out domain, the rows of all others (``held_out`` names it)."""
    every = F.array(*[F.lit(d) for d in domains])
    return rows.withColumn("held_out", F.explode(F.array_except(every, F.array(column))))


def pool_sizes(rows: DataFrame, column: str) -> DataFrame:
    """Size of each leave-one-out pool: the totals less the held-out domain's own, nothing copied."""
    own = rows.groupBy(F.col(column).alias("held_out")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))
    total = own.agg(F.sum("n").alias("all_n"), F.sum("events").alias("all_events"),
                    F.count(F.lit(1)).alias("domains"))           # one row
    return own.join(F.broadcast(total)).select(
        "held_out", (F.col("all_n") - F.col("n")).alias("n_origins"),
        (F.col("all_events") - F.col("events")).alias("n_events"),
        (F.col("domains") - 1).alias("n_streams"))


def transfer_scores(rows: DataFrame, column: str) -> DataFrame:
    """Leave one domain out: the violation rate fitted on all other domains, and its Brier score and
    the domain's own rate on the held-out domain."""
    own = rows.groupBy(F.col(column).alias("held_out")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))
    pool = own.join(pool_sizes(rows, column), "held_out").filter("n_origins > 0")
    p, e, n = F.col("n_events") / F.col("n_origins"), F.col("events"), F.col("n")
    return pool.select("held_out", p.alias("pool_rate"), (e / n).alias("own_rate"),
                       ((e * F.pow(1 - p, F.lit(2.0)) + (n - e) * p * p) / n).alias("brier"))


def regime_comparability(split_origins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean realised risk ahead of test origins over that of training origins."""
    ahead = F.filter("risk_path", lambda r: r.isNotNull())
    sums = F.aggregate(ahead, F.lit(0.0), lambda a, r: a + r)
    base = split_origins.select(*keys, "split", sums.alias("_s"), F.size(ahead).alias("_n"))

    def mean(split: str):
        here = F.col("split") == split
        return F.try_divide(F.sum(F.when(here, F.col("_s"))), F.sum(F.when(here, F.col("_n"))))

    out = base.groupBy(*keys).agg(
        mean("train").alias("train_mean_risk"), mean("test").alias("test_mean_risk"),
        F.count_if(F.col("split") == "train").alias("n_train_origins"),
        F.count_if(F.col("split") == "test").alias("n_test_origins"))
    return out.withColumn("test_over_train", F.try_divide(F.col("test_mean_risk"),
                                                          F.col("train_mean_risk")))


def with_age(origins: DataFrame) -> DataFrame:
    first = origins.groupBy("stream_id").agg(F.min("origin").alias("_first"))
    return origins.join(first, "stream_id").withColumn(
        "age", (F.col("origin") - F.col("_first")).cast("bigint")).drop("_first")


def age_association(origins: DataFrame) -> DataFrame:
    """Correlation of age and event over all origins, its t statistic and two-sided p (one row)."""
    r = with_age(origins).agg(F.corr(F.col("event").cast("double"), F.col("age").cast("double")).alias("point_biserial_r"),
                              F.count(F.lit(1)).alias("n_origins"))
    rho = F.col("point_biserial_r")
    t = rho * F.sqrt((F.col("n_origins") - 2) / (1.0 - rho * rho))
    return r.select("n_origins", "point_biserial_r", t.alias("t_statistic"),
                    correlation_p_col("point_biserial_r", "n_origins").alias("p_value"))


def age_hazard(origins: DataFrame, parts: int = 5) -> DataFrame:
    """Event share by age quantile (bins closed above), with the overall age/event correlation.

    The correlation is NULL where every origin has the same outcome.
    """
    aged = with_age(origins).withColumn("_k", F.lit(0))
    names = {f"q{i}": i / parts for i in range(parts + 1)}
    edges = exact_quantiles(aged, ["_k"], "age", names, index_bucket(F.col("age")))
    # One row: the cut points, merged where equal.
    edges = edges.select("_k", F.array_distinct(F.array(*list(names))).alias("edges"))
    out = aged.join(F.broadcast(edges), "_k")
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(
        F.array().cast("array<double>"))
    place = F.size(F.filter(inner, lambda e: e < F.col("age")))
    out = out.withColumn("part", (place + 1).cast("int"))
    per = out.groupBy("part", "edges").agg(F.count(F.lit(1)).alias("n_origins"),
                                           F.avg("event").alias("hazard"))
    r = aged.groupBy("_k").agg(F.corr(F.col("event").cast("double"), F.col("age").cast("double"))
                               .alias("_r"), F.min("event").alias("_lo"), F.max("event").alias("_hi"))
    r = r.select(F.when(F.col("_lo") < F.col("_hi"), F.col("_r")).alias("point_biserial_r"))
    out = per.join(F.broadcast(r))
    return out.select("part", F.get("edges", F.col("part") - 1).alias("age_from"),
                      F.get("edges", F.col("part")).alias("age_to"), "n_origins", "hazard",
                      "point_biserial_r")


