"""Survival curves on the discrete horizon 1..H. A curve is an array; entry h-1 is S(h)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bind, clip, total
from ..session import freeze
from .ordered import exact_quantiles, index_bucket

# Fixed value: floor of the censoring curve.
CENSORING_FLOOR = 1e-8


def running_product(factors: Column) -> Column:
    """Cumulative product of an array (exact zeros stay zero, unlike a sum of logarithms)."""
    return F.aggregate(
        factors, F.array().cast("array<double>"),
        lambda a, f: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1.0))
                                         * f)))


def _km(origins: DataFrame, horizon: int, ended: int, keys: Sequence[str]) -> DataFrame:
    """Product-limit curve per key.

    Each origin contributes one row per period at risk; these rows are summed on the map side, so
    at most H rows per key leave a task.
    """
    y = F.col("y_tilde")
    periods = origins.select(*keys, "event", y.alias("_y"),
                             F.explode(F.sequence(F.lit(1), y.cast("int"))).alias("h"))
    last = F.col("h") == F.col("_y")
    counts = periods.groupBy(*keys, "h").agg(
        F.count(F.lit(1)).alias("_r"), F.count_if(last & (F.col("event") == ended)).alias("_d"),
        F.count_if(last).alias("_n"), F.count_if(last & (F.col("event") == 1)).alias("_e"))
    factor = F.struct("h", (1.0 - F.col("_d") / F.col("_r")).alias("f"))
    per = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n_origins"), F.sum("_e").alias("n_events"),
        F.map_from_entries(F.collect_list(factor)).alias("_f"))
    factors = F.transform(F.sequence(F.lit(1), F.lit(horizon)),
                          lambda h: F.coalesce(F.try_element_at("_f", h), F.lit(1.0)))
    return per.select(*keys, "n_origins", "n_events", running_product(factors).alias("surv"))


def kaplan_meier(origins: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    return _km(origins, horizon, 1, keys)


def censoring_curve(origins: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """Kaplan-Meier of the censoring times, floored away from zero."""
    out = _km(origins, horizon, 0, keys)
    return out.withColumn("surv", F.transform("surv", lambda g: F.greatest(
        g, F.lit(CENSORING_FLOOR))))


def apply_curve(origins: DataFrame, curve: DataFrame, method: str) -> DataFrame:
    """Give every origin the same curve (``curve`` has exactly one row)."""
    return origins.select("stream_id", "origin", "y_tilde", "event").join(
        F.broadcast(curve.select("surv"))).withColumn("method", F.lit(method))


def age_kaplan_meier(train: DataFrame, test: DataFrame, horizon: int, age: str,
                     bins: int = 5, minimum: int = 10) -> DataFrame:
    """Kaplan-Meier by age bin, cut on training ages; thin or event-free bins use the pooled curve.

    Bins are open above (an age equal to a cut belongs to the later bin).
    """
    names = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = exact_quantiles(train.withColumn("_k", F.lit(0)), ["_k"], age, names,
                           index_bucket(F.col(age)))
    cuts = freeze(cuts.select(F.array(*list(names)).alias("cuts")), "age-cuts")   # one row
    place = F.size(F.filter("cuts", lambda c: c <= F.col(age)))

    def binned(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(cuts)).withColumn("age_bin", place).drop("cuts")

    pooled = kaplan_meier(train, horizon).select(F.col("surv").alias("_pooled"))
    by_bin = kaplan_meier(binned(train), horizon, ["age_bin"]).filter(
        (F.col("n_origins") >= minimum) & (F.col("n_events") > 0)).select("age_bin", "surv")
    # At most ``bins`` rows and one row.
    out = binned(test).join(F.broadcast(by_bin), "age_bin", "left").join(F.broadcast(pooled))
    return out.select("stream_id", "origin", "y_tilde", "event",
                      F.coalesce("surv", "_pooled").alias("surv"),
                      F.lit("age_kaplan_meier").alias("method"), "age_bin")


def hazard_to_survival(hazard: Column) -> Column:
    """Survival from per-period hazards; a hazard outside [0, 1] fails the query."""
    bad = F.exists(hazard, lambda h: (h < 0) | (h > 1))
    checked = F.when(bad, F.raise_error(F.lit("hazard outside [0, 1]")).cast("array<double>")
                     ).otherwise(hazard)
    return running_product(F.transform(checked, lambda h: 1.0 - h))


def horizon_readouts(curves: DataFrame, horizon: int, alpha: float = 0.1) -> DataFrame:
    """Expected, median and lower-bound validity horizon of each curve."""
    s = F.col("surv")
    at_or_below = F.array_position(F.transform(s, lambda v: v <= 0.5), F.lit(True))
    return curves.select(
        "stream_id", "origin", "method",
        F.aggregate(s, F.lit(0.0), lambda a, v: a + v).alias("expected_horizon"),
        F.when(at_or_below > 0, at_or_below).otherwise(F.lit(horizon + 1)).cast("bigint")
         .alias("median_horizon"),
        F.size(F.filter(s, lambda v: v >= 1.0 - alpha)).cast("bigint").alias("lower_horizon"))


# -- Cox regression --------------------------------------------------------------------------
class EstimationFailed(ValueError):
    """The Cox model has no usable estimate; the message says why."""


def cox_fit(train: DataFrame, covariates: Sequence[str], horizon: int, *, penalty: float = 0.1,
            iterations: int = 25, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Ridge-penalised Cox model with Efron ties on integer times.

    Times are 1..H, so a Newton step needs only, per time and outcome, the sums of e^{xb},
    x e^{xb} and x x' e^{xb}: one aggregate over the whole table returning 2H rows. Efron's inner
    sums over tied deaths are differences of digamma and trigamma values, so their cost does not
    depend on the number of ties. The penalty acts on covariates of unit variance.
    Returns the coefficients (of the covariates as given) and the baseline cumulative hazard at 1..H.
    """
    k = len(covariates)
    moments = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(covariates)],
                        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(covariates)],
                        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == 1).alias("d")).first()
    if not moments["n"] or not moments["d"]:
        raise EstimationFailed("no training origin" if not moments["n"] else "no event in training")
    centre = np.array([moments[f"m{i}"] for i in range(k)], dtype=float)
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(k)], dtype=float)
    scale[scale <= 1e-12] = 1.0
    x = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(covariates, centre, scale)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    unit = train.select("y_tilde", "event", *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    z = [F.col(f"_x{i}") for i in range(k)]
    products = F.array(F.lit(1.0), *z, *[z[i] * z[j] for i, j in pairs])
    prepared = freeze(unit.withColumn("_p", products), "cox-products")

    def totals(weight: Column) -> dict[tuple[int, int], np.ndarray]:
        weighted = prepared.withColumn("_w", weight).select(
            "y_tilde", "event", array_to_vector(F.transform("_p", lambda p: p * F.col("_w")))
            .alias("_v"))
        rows = weighted.groupBy("y_tilde", "event").agg(
            Summarizer.sum(F.col("_v")).alias("s")).collect()          # at most 2H rows
        out: dict[tuple[int, int], np.ndarray] = {}
        for r in rows:
            at = (min(int(r["y_tilde"]), horizon), int(r["event"]))
            out[at] = out.get(at, 0.0) + np.asarray(r["s"])
        return out

    deaths, death_x = np.zeros(horizon + 1), np.zeros((horizon + 1, k))
    for (t, d), v in totals(F.lit(1.0)).items():
        if d == 1:
            deaths[t], death_x[t] = v[0], v[1:k + 1]

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = total([F.lit(float(b)) * v for b, v in zip(beta, z)])
        w0 = np.zeros((horizon + 1, 2))
        w1 = np.zeros((horizon + 1, 2, k))
        w2 = np.zeros((horizon + 1, 2, k, k))
        for (t, d), v in totals(F.exp(score)).items():
            w0[t, d], w1[t, d] = v[0], v[1:k + 1]
            for value, (i, j) in zip(v[k + 1:], pairs):
                w2[t, d, i, j] = w2[t, d, j, i] = value
        return w0, w1, w2

    def tail_sum(a: np.ndarray) -> np.ndarray:
        return a.sum(axis=1)[::-1].cumsum(axis=0)[::-1]

    beta = np.zeros(k)
    for _ in range(iterations):
        w0, w1, w2 = sums(beta)
        r0, r1, r2 = tail_sum(w0), tail_sum(w1), tail_sum(w2)
        grad, hess = np.zeros(k), np.zeros((k, k))
        for t in np.flatnonzero(deaths):
            first, second = efron_sums(deaths[t], (r0[t], r1[t], r2[t]), (w0[t, 1], w1[t, 1], w2[t, 1]))
            grad += death_x[t] - first
            hess -= second
        grad = grad / moments["n"] - penalty * beta
        hess = hess / moments["n"] - penalty * np.eye(k)
        if not np.isfinite(grad).all() or not np.isfinite(hess).all():
            raise EstimationFailed("the likelihood is not finite")
        try:
            move = np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError as e:
            raise EstimationFailed("singular information matrix") from e
        beta = beta - move
        if np.abs(move).max() < tolerance:
            break
    else:
        raise EstimationFailed(f"no convergence in {iterations} steps")
    w0, _, _ = sums(beta)
    risk = tail_sum(w0)
    base = np.where(risk[1:] > 0, deaths[1:] / np.where(risk[1:] > 0, risk[1:], 1.0), 0.0)
    own = beta / scale
    return own, base.cumsum() * np.exp(-float(own @ centre))


def polygamma_pair(x: float) -> tuple[float, float]:
    """Digamma and trigamma of a positive number: recurrence up to 10, then the asymptotic series."""
    first = second = 0.0
    while x < 10.0:
        first -= 1.0 / x
        second += 1.0 / (x * x)
        x += 1.0
    y = 1.0 / (x * x)
    first += math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    second += 1.0 / x + 0.5 * y + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return first, second


def efron_sums(m: float, risk: tuple, tied: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sums over i = 0..m-1 of a1/a0 and of a2/a0 - a1 a1'/a0^2, where a = risk - (i/m) tied.

    a0 is linear in i, so both are combinations of sum 1/(c - i) and sum 1/(c - i)^2, c = m r0/w0.
    """
    (r0, r1, r2), (w0, w1, w2) = risk, tied
    c = m * r0 / w0
    upper, lower = polygamma_pair(c + 1.0), polygamma_pair(c - m + 1.0)
    s1, s2 = upper[0] - lower[0], lower[1] - upper[1]
    share = m / w0
    u1, u2 = r1 - (r0 / w0) * w1, r2 - (r0 / w0) * w2
    first = share * (u1 * s1 + w1)
    cross = np.outer(u1, w1)
    squares = share ** 2 * (np.outer(u1, u1) * s2 + (cross + cross.T) * (s1 / m) + np.outer(w1, w1) / m)
    return first, share * (u2 * s1 + w2) - squares


def cox_predict(test: DataFrame, covariates: Sequence[str], beta: np.ndarray,
                cumulative: np.ndarray) -> DataFrame:
    score = total([F.lit(float(b)) * F.col(c) for b, c in zip(beta, covariates)])
    hazards = F.array(*[F.lit(float(c)) for c in cumulative])
    surv = bind(F.exp(score), lambda w: F.transform(hazards, lambda c: F.exp(-c * w)))
    return test.select("stream_id", "origin", "y_tilde", "event", surv.alias("surv"),
                       F.lit("cox").alias("method"))


# -- first passage ---------------------------------------------------------------------------
# Fixed values of the counter-based generator (Philox, 4 words of 32 bits, 10 rounds).
_MULTIPLY = (0xD2511F53, 0xCD9E8D57)
_WEYL = (0x9E3779B9, 0xBB67AE85)
_WORD = np.uint64(0xFFFFFFFF)
#: Origins worked on at a time by one task.
_ORIGINS = 64


def counter_words(counter: Sequence[np.ndarray], key: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Four random words of 32 bits for every counter (four words) under its key (two words)."""
    c, k = [np.asarray(x, np.uint64) for x in counter], [np.asarray(x, np.uint64) for x in key]
    half = np.uint64(32)
    for _ in range(10):
        p, q = np.uint64(_MULTIPLY[0]) * c[0], np.uint64(_MULTIPLY[1]) * c[2]
        c = [(q >> half) ^ c[1] ^ k[0], q & _WORD, (p >> half) ^ c[3] ^ k[1], p & _WORD]
        k = [(k[0] + np.uint64(_WEYL[0])) & _WORD, (k[1] + np.uint64(_WEYL[1])) & _WORD]
    return c


def counter_normals(keys: np.ndarray, draws: int, n: int) -> np.ndarray:
    """Standard normals (key, draw, n): a function of the key's two words and the position alone."""
    blocks = -(-n // 4)
    place = np.ix_(range(len(keys)), range(draws), range(blocks))
    words = counter_words([np.broadcast_to(x, (len(keys), draws, blocks)) for x in (place[1], place[2], 0, 0)],
                          [keys[:, i, None, None] for i in (0, 1)])
    u = [(w.astype(float) + 0.5) / 4294967296.0 for w in words]
    out = []
    for a, b in ((u[0], u[1]), (u[2], u[3])):
        r, angle = np.sqrt(-2.0 * np.log(a)), 6.283185307179586 * b
        out += [r * np.cos(angle), r * np.sin(angle)]
    return np.stack(out, axis=-1).reshape(len(keys), draws, -1)[:, :, :n]


def sampled_paths(forecasts: DataFrame, spread: Sequence[float], persistence: float, draws: int,
                  seed: str = "paths") -> DataFrame:
    """First-passage survival (``surv``) and mean (``pred``) of risk paths sampled around a forecast.

    ``forecasts`` has stream_id, origin, eps and ``centre``, the logit forecast of each horizon. Steps
    are autoregressive Gaussian on the logit scale. Draws come from a counter-based generator keyed by
    the origin, so paths are neither rows nor shuffled, and any layout gives the same ones.
    """
    scale, horizon = np.array(spread, float), len(spread)
    fresh = float(np.sqrt(max(0.0, 1.0 - persistence ** 2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), _ORIGINS):
                part = batch.iloc[i:i + _ORIGINS]
                z = counter_normals(part[["_k0", "_k1"]].to_numpy(np.uint64), draws, horizon)
                for h in range(1, horizon):
                    z[:, :, h] = persistence * z[:, :, h - 1] + fresh * z[:, :, h]
                path = 1.0 / (1.0 + np.exp(-(z * scale + np.stack(part["centre"].to_numpy())[:, None, :])))
                above = path > part["eps"].to_numpy(float)[:, None, None]
                alive = ~np.logical_or.accumulate(above, axis=2)
                yield part[["stream_id", "origin"]].assign(surv=list(alive.mean(axis=1)), pred=list(path.mean(axis=1)))

    digest = F.md5(F.concat_ws("|", F.lit(seed), "stream_id", F.col("origin").cast("string")))
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"_k{i}") for i in (0, 1)]
    # Few small rows become many costly draws here, so they are spread over all tasks first.
    tasks = int(forecasts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = forecasts.select("stream_id", "origin", "eps", "centre", *words).repartition(tasks, "stream_id", "origin")
    return rows.mapInPandas(run, "stream_id string, origin bigint, surv array<double>, pred array<double>")


def anchor_residuals(train: DataFrame, horizon: int) -> tuple[list[float], float]:
    """Spread per horizon and lag-one correlation of what the anchor misses on the logit scale."""
    def logit(x: Column) -> Column:
        return bind(clip(x, 1e-6, 1.0 - 1e-6), lambda p: F.log(p / (1.0 - p)))

    path = train.select(F.transform("risk_path", lambda r: logit(r) - logit(F.col("anchor"))).alias("_e"))
    long = path.select(F.posexplode("_e").alias("_h", "_v"), "_e").select("_h", "_v", F.get("_e", F.col("_h") + 1).alias("_next"))
    spread = {r["_h"]: r["s"] for r in long.groupBy("_h").agg(F.round(F.stddev_pop("_v"), 12).alias("s")).collect()}  # H rows
    rho = long.agg(F.round(F.corr("_v", "_next"), 12)).first()[0]
    return [float(spread.get(h) or 1e-3) for h in range(horizon)], float(min(max(rho or 0.0, 0.0), 0.99))


def first_passage(paths: DataFrame, eps: Column | None = None) -> DataFrame:
    """Share of sampled paths that stay at or below the threshold up to each horizon.

    A path only matters through the first horizon above the threshold, so paths are counted by it.
    """
    limit = eps if eps is not None else F.col("eps")
    first = F.array_position(F.transform("path", lambda r: r > F.col("_eps")), F.lit(True))
    crossed = paths.withColumn("_eps", limit).select(
        "stream_id", "origin", F.size("path").alias("_len"),
        F.when(first > 0, first).otherwise(F.size("path") + 1).alias("_t"))
    counts = crossed.groupBy("stream_id", "origin", "_t", "_len").agg(
        F.count(F.lit(1)).alias("_n"))
    packed = counts.groupBy("stream_id", "origin", "_len").agg(
        F.collect_list(F.struct("_t", "_n")).alias("_c"), F.sum("_n").alias("_all"))
    alive = F.transform(F.sequence(F.lit(1), F.col("_len")), lambda h: F.aggregate(
        F.filter("_c", lambda c: c["_t"] > h), F.lit(0).cast("bigint"),
        lambda s, c: s + c["_n"]) / F.col("_all"))
    return packed.select("stream_id", "origin", alive.alias("surv"))


def mean_path(paths: DataFrame) -> DataFrame:
    return _mean_array(paths, "path", "pred")


def _mean_array(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Element-wise mean of an array over the draws of each origin."""
    long = rows.select("stream_id", "origin", F.posexplode(column).alias("_i", "_v"))
    means = long.groupBy("stream_id", "origin", "_i").agg(F.avg("_v").alias("_m"))
    packed = means.groupBy("stream_id", "origin").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_p"))
    return packed.select("stream_id", "origin", F.col("_p._m").alias(out))
