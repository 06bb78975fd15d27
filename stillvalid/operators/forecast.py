"""Risk-path forecasts from the known error history alone.

Every method but the autoregression is a straight line ``level + slope * h`` cut to [0, 1], so a
candidate is two numbers per origin and tuning is one aggregate over the calibration origins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num

# Tuning grids.
MOVING_AVERAGE_GRID = (2, 3, 5, 8, 10, 15, 20)
SMOOTHING_GRID = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TREND_GRID = (5, 8, 10, 15, 20)
ORDER_GRID = (1, 2, 3, 5)


def _known(a: Column) -> Column:
    return F.filter(a, lambda r: r.isNotNull())


def _last(hist: Column) -> Column:
    return F.coalesce(F.try_element_at(_known(hist), F.lit(-1)), F.lit(0.5))


def _tail(a: Column, k: Column) -> Column:
    take = F.least(k.cast("int"), F.size(a))
    return F.when(take > 0, F.slice(a, -take, take)).otherwise(a)


def _line(method: str, setting: Column, level: Column, slope: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), setting.cast("double").alias("setting"),
                    level.alias("level"), slope.alias("slope"))


def _grid(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def persistence(hist: Column) -> Column:
    """The last known risk for every horizon."""
    return F.array(_line("persistence", F.lit(None), _last(hist), F.lit(0.0)))


def moving_average(hist: Column, grid: Sequence[int] = MOVING_AVERAGE_GRID) -> Column:
    """The mean of the last k known risks, for each k."""
    return F.transform(_grid(grid), lambda k: _line(
        "moving_average", k, F.coalesce(num.array_mean(_known(_tail(hist, k))), _last(hist)),
        F.lit(0.0)))


def exponential_smoothing(hist: Column, grid: Sequence[float] = SMOOTHING_GRID) -> Column:
    """The smoothed level, for each factor."""
    return F.transform(_grid(grid), lambda a: _line(
        "exponential_smoothing", a, F.coalesce(num.smooth(_known(hist), a), _last(hist)),
        F.lit(0.0)))


def theil_sen_trend(hist: Column, grid: Sequence[int] = TREND_GRID) -> Column:
    """Median slope and median intercept of the last k, projected from the last point."""
    def fit(y: Column, k: Column) -> Column:
        n = F.size(y)
        steps = (n - 1).cast("double")
        trend = num.bind(num.theil_sen_slope(y), lambda m: _line(
            "theil_sen_trend", k, num.array_median(
                F.transform(y, lambda v, i: v - m * i.cast("double"))) + m * steps, m))
        flat = _line("theil_sen_trend", k, F.coalesce(F.get(y, F.lit(0)), F.lit(0.5)), F.lit(0.0))
        return F.when(n >= 2, trend).otherwise(flat)

    return F.transform(_grid(grid), lambda k: num.bind(_known(_tail(hist, k)),
                                                       lambda y: fit(y, k)))


def anchor_only(anchor: Column) -> Column:
    return F.array(_line("anchor", F.lit(None), anchor, F.lit(0.0)))


def candidates(hist: Column, anchor: Column | None = None) -> Column:
    """Array of (method, setting, level, slope): every method and grid setting, in grid order."""
    parts = [persistence(hist), moving_average(hist), exponential_smoothing(hist),
             theil_sen_trend(hist)]
    if anchor is not None:
        parts.append(anchor_only(anchor))
    return F.concat(*parts)


def candidate_lines(origins: DataFrame, *keep: str) -> DataFrame:
    """One row per origin and candidate; ``position`` is its place in the grid."""
    tasks = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few rows, much work per row: spread them before the fits.
    spread = origins.repartition(tasks, "stream_id", "origin")
    out = spread.select("stream_id", "origin", *keep, F.posexplode(
        candidates(F.col("risk_hist"), F.col("anchor"))).alias("position", "line"))
    return out.select("stream_id", "origin", *keep, "position", "line.*")


def _path(length: Column) -> Column:
    return F.transform(length, lambda _, i: num.clip(
        F.col("level") + F.col("slope") * (i + 1), 0.0, 1.0))


def tune(calibration: DataFrame) -> DataFrame:
    """Best setting per method by mean absolute error; the earlier grid entry wins a tie."""
    lines = candidate_lines(calibration, "risk_path")
    gaps = F.zip_with(_path(F.col("risk_path")), "risk_path",
                      lambda p, r: F.coalesce(F.abs(p - r), F.lit(0.0)))
    scores = lines.select(
        "method", "setting", "position", F.size(_known(F.col("risk_path"))).alias("_n"),
        F.aggregate(gaps, F.lit(0.0), lambda s, e: s + e).alias("_e")).groupBy(
        "method", "setting", "position").agg(F.try_divide(F.sum("_e"), F.sum("_n")).alias("mae"))
    return _best(scores)


def _best(scores: DataFrame) -> DataFrame:
    # Settled to 12 decimals: equal candidates must not be ordered by summation noise.
    order = Window.partitionBy("method").orderBy(num.settle(F.col("mae")).asc_nulls_last(),
                                                 "position")
    return (scores.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r"))


def forecast_lines(origins: DataFrame, tuned: DataFrame | None = None) -> DataFrame:
    """(stream_id, origin, method, pred[H], target[H]); only tuned settings when given."""
    lines = candidate_lines(origins, "risk_path")
    if tuned is not None:
        # One row per method, so the broadcast side has a fixed size.
        lines = lines.join(F.broadcast(tuned.select("method", "position")), ["method", "position"])
    return lines.select("stream_id", "origin", "method", _path(F.col("risk_path")).alias("pred"),
                        F.col("risk_path").alias("target"))


# -- autoregression --------------------------------------------------------------------------
def levinson(gamma: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of each row of autocovariances (lags 0..p) by the Levinson
    recursion. A row whose prediction error vanishes on the way gets NaN; other rows are not touched."""
    p = gamma.shape[1] - 1
    a, error = np.zeros((len(gamma), p)), gamma[:, 0].copy()
    for k in range(p):
        rest = gamma[:, k + 1] - (a[:, :k] * gamma[:, k:0:-1]).sum(axis=1)
        reflection = np.divide(rest, error, out=np.full(len(gamma), np.nan),
                               where=error > 1e-12 * gamma[:, 0])
        a[:, :k] -= reflection[:, None] * a[:, :k][:, ::-1]
        a[:, k] = reflection
        error = error * (1.0 - reflection ** 2)
    return a


def yule_walker_paths(hist: np.ndarray, p: int, horizon: int) -> np.ndarray:
    """AR(p) forecasts for many full histories at once (rows of ``hist``)."""
    n = hist.shape[1]
    mean = hist.mean(axis=1, keepdims=True)
    x = hist - mean
    gamma = np.stack([(x[:, :n - k] * x[:, k:]).sum(axis=1) / n for k in range(p + 1)], axis=1)
    out = np.repeat(hist[:, -1:], horizon, axis=1)
    # A constant history has no autocovariance to solve for; it keeps its last value.
    ok = gamma[:, 0] > 0
    if ok.any():
        rho = levinson(gamma[ok])
        recent = x[ok][:, ::-1][:, :p]
        steps = np.empty((int(ok.sum()), horizon))
        for h in range(horizon):
            nxt = (rho * recent).sum(axis=1)
            steps[:, h] = nxt
            recent = np.concatenate([nxt[:, None], recent[:, :-1]], axis=1)
        path = steps + mean[ok]
        bad = ~np.isfinite(rho).all(axis=1)
        path[bad] = out[ok][bad]
        out[ok] = path
    return np.clip(out, 0.0, 1.0)


def ar_forecasts(origins: DataFrame, order: int, horizon: int) -> DataFrame:
    """Adds ``pred``: AR(order) by Yule-Walker, fitted and iterated per origin in Arrow batches."""
    @F.pandas_udf("array<double>")
    def run(hist: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(hist)
        by_length: dict[int, list[int]] = {}
        known = [np.asarray([v for v in h if v is not None and np.isfinite(v)], dtype=float)
                 for h in hist]
        for i, h in enumerate(known):
            if h.size <= order + 1:
                out[i] = np.full(horizon, np.clip(h[-1], 0.0, 1.0) if h.size else 0.5)
            else:
                by_length.setdefault(h.size, []).append(i)
        for rows in by_length.values():
            paths = yule_walker_paths(np.stack([known[i] for i in rows]), order, horizon)
            for i, path in zip(rows, paths):
                out[i] = path
        return pd.Series(out)

    return origins.withColumn("pred", run("risk_hist"))


def tune_ar(calibration: DataFrame, horizon: int, grid: Sequence[int] = ORDER_GRID) -> DataFrame:
    """Best autoregressive order on the calibration origins (one row)."""
    scores = None
    for i, p in enumerate(grid):
        errors = ar_forecasts(calibration, p, horizon).select(
            F.size(_known(F.col("risk_path"))).alias("_n"),
            F.aggregate(F.zip_with("pred", "risk_path", lambda a, r: F.coalesce(
                F.abs(a - r), F.lit(0.0))), F.lit(0.0), lambda s, e: s + e).alias("_e"))
        one = errors.agg(F.lit("ar_p").alias("method"), F.lit(float(p)).alias("setting"),
                         F.lit(i).alias("position"),
                         F.try_divide(F.sum("_e"), F.sum("_n")).alias("mae"))
        scores = one if scores is None else scores.unionByName(one)
    return _best(scores)


# -- long form and scores --------------------------------------------------------------------
def long_errors(forecasts: DataFrame) -> DataFrame:
    """One row per origin, method and horizon with a known target."""
    pairs = F.arrays_zip("pred", "target")
    out = forecasts.select("stream_id", "origin", "method", F.posexplode(pairs).alias("_i", "_p"))
    return out.select("stream_id", "origin", "method", (F.col("_i") + 1).alias("h"),
                      F.col("_p.pred").alias("pred"), F.col("_p.target").alias("target")).filter(
        F.col("target").isNotNull())


def horizon_scores(forecasts: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE per method and horizon over the origins with a known target."""
    long = forecasts.select(*keys, "method", F.posexplode(F.zip_with(
        F.slice("pred", 1, horizon), F.slice("target", 1, horizon), lambda p, t: p - t)
    ).alias("_i", "_g"))
    return long.select(*keys, "method", (F.col("_i") + 1).alias("h"), "_g").groupBy(
        *keys, "method", "h").agg(F.avg(F.abs("_g")).alias("mae"),
                                  F.sqrt(F.avg(F.col("_g") * F.col("_g"))).alias("rmse"),
                                  F.count("_g").alias("n"))


def skill(scores: DataFrame, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """``1 - MAE / MAE of the reference method`` at each horizon; NULL where that MAE is 0."""
    base = scores.filter(F.col("method") == reference).select(
        *keys, "h", F.col("mae").alias("_ref"))
    out = scores.join(base, [*keys, "h"])
    return out.withColumn("skill", 1.0 - F.try_divide(F.col("mae"), F.col("_ref"))).drop("_ref")


def score_summary(scored: DataFrame, horizons: Sequence[int] = (1, 5, 10),
                  keys: Sequence[str] = ()) -> DataFrame:
    """Means over horizons with the decision horizons broken out."""
    at = [F.max(F.when(F.col("h") == h, F.col(m))).alias(f"{m}_h{h}")
          for h in horizons for m in ("mae", "rmse", "skill")]
    return scored.groupBy(*keys, "method").agg(
        F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"),
        F.avg("skill").alias("skill_mean"), *at)


def errors_at(forecasts: DataFrame, h: int) -> DataFrame:
    """Absolute error of each origin at one horizon, where the outcome is known."""
    gap = F.abs(F.get("pred", F.lit(h - 1)) - F.get("target", F.lit(h - 1)))
    return forecasts.select("stream_id", "origin", "method", gap.alias("error")).filter(
        F.col("error").isNotNull())
