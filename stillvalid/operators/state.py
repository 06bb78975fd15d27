"""Deployment-state blocks: one row per window, computed from what is known at its end."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as num
from .ordered import halo, index_bucket, own_rows, running_sum
from .reference import long_features

KEY = ["stream_id", "window_idx"]
BLOCKS = ("pred", "rep", "unc", "dist", "fb", "ctx", "adapt")
TRAILING = 5

# Columns that describe the future or the way a shift was made.
FORBIDDEN_PREFIXES = ("risk_t_plus_", "target_", "future_")
FORBIDDEN_NAMES = (
    "true_validity_horizon", "censored", "event", "y_tilde", "shift_type", "shift_severity",
    "shift_start", "shift_end", "ground_truth_change_point", "forecastability_type",
    "risk_threshold")

_QUANTILES = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}


def assert_no_future_columns(columns: Iterable[str]) -> None:
    """Plan-time guard: refuse targets and shift descriptions among the features."""
    bad = sorted(c for c in set(columns)
                 if c in FORBIDDEN_NAMES or c.startswith(FORBIDDEN_PREFIXES))
    if bad:
        raise AssertionError(f"columns from the future among the features: {', '.join(bad)}")


def assert_same_schema(tables: dict[str, DataFrame]) -> None:
    """Plan-time guard: state tables that will be unioned must have identical columns."""
    first = None
    for name, df in tables.items():
        columns = tuple(df.columns)
        if first is None:
            first = columns
        elif columns != first:
            raise ValueError(f"state schema of {name!r} differs from the others")


# -- predictions -----------------------------------------------------------------------------
def class_prediction_block(deployment: DataFrame, behaviour: DataFrame, classes: int) -> DataFrame:
    p = F.col("proba")
    rows = deployment.select(*KEY, num.clip(F.array_max(p), num.PROBA_FLOOR, 1.0).alias("msp"),
                             num.entropy(p).alias("ent"), num.top_two_gap(p).alias("gap"),
                             num.argmax(p).alias("top"))
    n = F.count(F.lit(1))
    win = rows.groupBy(*KEY).agg(
        F.avg("msp").alias("pred_msp_mean"), F.stddev_pop("msp").alias("pred_msp_std"),
        F.percentile("msp", F.array(*[F.lit(q) for q in _QUANTILES.values()])).alias("_q"),
        F.avg("ent").alias("pred_entropy_mean"), F.stddev_pop("ent").alias("pred_entropy_std"),
        F.avg("gap").alias("pred_margin_mean"),
        F.array(*[F.count_if(F.col("top") == k) / n for k in range(classes)]).alias("_now"))
    win = win.join(behaviour, "stream_id")
    now = [num.clip(x, num.PROBA_FLOOR, 1.0) for x in num.items("_now", classes)]
    before = [num.clip(x, num.PROBA_FLOOR, 1.0) for x in num.items("prior", classes)]
    return win.select(
        *KEY, "pred_msp_mean", "pred_msp_std",
        *[F.col("_q").getItem(i).alias(f"pred_msp_{name}") for i, name in enumerate(_QUANTILES)],
        "pred_entropy_mean", "pred_entropy_std", "pred_margin_mean",
        num.total([a * F.log(a / b) for a, b in zip(now, before)]).alias("pred_class_kl"),
        (F.lit(0.5) * num.total([F.abs(a - b) for a, b in zip(now, before)]))
        .alias("pred_class_tv"),
        (F.col("pred_msp_mean") - F.col("confidence_mean")).alias("pred_conf_shift"),
        (F.col("pred_entropy_mean") - F.col("entropy_mean")).alias("pred_entropy_shift"))


def value_prediction_block(deployment: DataFrame) -> DataFrame:
    win = deployment.groupBy(*KEY).agg(
        F.avg("y_pred").alias("pred_mean"), F.stddev_pop("y_pred").alias("pred_std"),
        F.percentile("y_pred", F.array(*[F.lit(q) for q in _QUANTILES.values()])).alias("_q"),
        (F.max("y_pred") - F.min("y_pred")).alias("pred_range"))
    return win.select(*KEY, "pred_mean", "pred_std",
                      *[F.col("_q").getItem(i).alias(f"pred_{name}")
                        for i, name in enumerate(_QUANTILES)], "pred_range")


# -- uncertainty -----------------------------------------------------------------------------
def class_uncertainty_block(deployment: DataFrame) -> DataFrame:
    """Entropy, energy and the aleatoric / epistemic split over the member probabilities."""
    flat = deployment.select(
        *KEY, num.entropy(F.col("proba")).alias("ent"),
        (-num.log_sum_exp(F.col("raw"))).alias("energy"),
        F.transform("members", num.clipped).alias("_m"))
    rows = flat.select(
        *KEY, "ent", "energy",
        num.array_mean(F.transform("_m", num.entropy)).alias("alea"),
        num.entropy(num.mean_distribution(F.col("_m"))).alias("total"),
        num.array_std(F.transform("_m", lambda p: F.element_at(p, -1))).alias("sd"))
    rows = rows.withColumn("spread", F.col("sd") * F.col("sd"))
    return rows.groupBy(*KEY).agg(
        F.avg("ent").alias("unc_entropy_mean"),
        F.percentile("ent", F.lit(0.9)).alias("unc_entropy_q90"),
        F.max("ent").alias("unc_entropy_max"),
        F.avg("energy").alias("unc_energy_mean"),
        F.percentile("energy", F.lit(0.1)).alias("unc_energy_q10"),
        F.avg("alea").alias("unc_aleatoric"),
        F.avg(F.col("total") - F.col("alea")).alias("unc_epistemic"),
        F.avg("spread").alias("unc_ensemble_var"))


def value_uncertainty_block(deployment: DataFrame) -> DataFrame:
    win = deployment.groupBy(*KEY).agg(
        F.var_pop("y_pred").alias("unc_pred_var"),
        (F.percentile("y_pred", F.lit(0.75)) - F.percentile("y_pred", F.lit(0.25)))
        .alias("unc_pred_iqr"))
    zeros = [F.lit(0.0).alias(c) for c in
             ("unc_energy_mean", "unc_epistemic", "unc_aleatoric", "unc_ensemble_var")]
    return win.select(*KEY, "unc_pred_var", "unc_pred_iqr", *zeros)


# -- representation and discrepancy ----------------------------------------------------------
def moment_block(deployment: DataFrame, features: DataFrame) -> DataFrame:
    """Centroid shift, mean shift, scale ratio and PSI: one pass over exploded features."""
    long = long_features(deployment, "window_idx").join(features, ["stream_id", "feature"])
    bins = 10
    place = F.size(F.filter("cuts", lambda e: e <= F.col("value")))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    long = long.select(*KEY, "feature", "n_bins", z.alias("z"), place.alias("_bin"))
    per = long.groupBy(*KEY, "feature", "n_bins").agg(
        F.avg("z").alias("_m"), F.stddev_pop("z").alias("_s"), F.count("z").alias("_n"),
        *[F.count_if((F.col("_bin") == b) & F.col("z").isNotNull()).alias(f"_b{b}")
          for b in range(bins)])
    # The reference share is taken as 1 / bins even where equal cut points were merged.
    per = per.withColumn("_r", F.greatest(1.0 / F.col("n_bins"), F.lit(1e-6)))
    used = F.slice(F.array(*[F.col(f"_b{b}") for b in range(bins)]), 1, F.col("n_bins"))
    size = F.greatest(F.col("_n"), F.lit(1))
    shares = F.transform(used, lambda c: F.greatest(c / size, F.lit(1e-6)))
    per = per.withColumn("_psi", F.aggregate(
        shares, F.lit(0.0), lambda s, c: s + (c - F.col("_r")) * F.log(c / F.col("_r"))))
    d = F.count(F.lit(1))
    return per.groupBy(*KEY).agg(
        F.sqrt(F.sum(F.col("_m") * F.col("_m")) / d).alias("dist_mean_shift"),
        F.avg("_s").alias("dist_scale_ratio"),
        F.avg("_psi").alias("dist_psi_mean"), F.max("_psi").alias("dist_psi_max"),
        F.percentile("_psi", F.lit(0.9)).alias("dist_psi_q90"))


def representation_block(deployment: DataFrame, embed_reference: DataFrame,
                         vector: str = "z") -> DataFrame:
    """Centroid movement and norms of an embedding column.

    ``embed_reference`` has (stream_id, feature, mean, std) of the embedding on the reference.
    """
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, v: s + v * v))
    norms = deployment.select(*KEY, norm.alias("_n")).groupBy(*KEY).agg(
        F.avg("_n").alias("rep_norm_mean"), F.stddev_pop("_n").alias("rep_norm_std"))
    centroid = long_features(deployment, "window_idx", vector=vector).groupBy(
        *KEY, "feature").agg(F.avg("value").alias("_c"))
    gap = (F.col("_c") - F.col("mean")) / F.col("std")
    shift = centroid.join(embed_reference.select("stream_id", "feature", "mean", "std"),
                          ["stream_id", "feature"]).groupBy(*KEY).agg(
        F.sqrt(F.sum(gap * gap) / F.count(F.lit(1))).alias("rep_centroid_shift"))
    return norms.join(shift, KEY)


def embedding_reference(pre: DataFrame, vector: str = "z") -> DataFrame:
    """Mean and population spread of the embedding on the reference; zero spread becomes 1."""
    long = long_features(pre, vector=vector)
    out = long.groupBy("stream_id", "feature").agg(F.avg("value").alias("mean"),
                                                   num.spread(F.col("value")).alias("_s"))
    return out.select("stream_id", "feature", "mean",
                      F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0)).alias("std"))


def volatility(states: DataFrame, headlines: dict[str, str], trend: dict[str, str] | None = None,
               trailing: int = TRAILING) -> DataFrame:
    """Spread (and trend) of headline columns over the previous windows, the current one excluded."""
    chunked, by = halo(states.select(*KEY, *set([*headlines.values(), *(trend or {}).values()])),
                       ["stream_id"], "window_idx", trailing, 0)
    past = by.rowsBetween(-trailing, -1)
    out = []
    for name, c in headlines.items():
        out.append(F.when(F.count(c).over(past) >= 2, F.stddev_pop(c).over(past))
                   .otherwise(F.lit(0.0)).alias(name))
    for name, c in (trend or {}).items():
        gap = F.last_value(c).over(past) - F.first_value(c).over(past)
        out.append(F.when(F.count(c).over(past) >= 2, gap).otherwise(F.lit(0.0)).alias(name))
    return own_rows(chunked.select(*KEY, "_chunk", "_own", *out))


# -- delayed feedback ------------------------------------------------------------------------
def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of the top class per window, bins open below, closed above."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    edges[-1] = 1.0
    conf = F.array_max("proba")
    base = rows.select(*KEY, conf.alias("c"),
                       F.coalesce((num.argmax(F.col("proba")) == F.col("y")).cast("double"),
                                  F.lit(0.0)).alias("ok"))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: F.col("c") > e))
    per = base.groupBy(*KEY, place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("ok") - F.col("c")).alias("_gap"))
    # |mean(ok) - mean(c)| * count / n equals |sum(ok - c)| / n.
    return per.groupBy(*KEY).agg((F.sum(F.abs("_gap")) / F.sum("_n")).alias("ece"))


def matured_risks(risk: DataFrame, delay: int) -> DataFrame:
    """How many risks are known at each window (``n_known``): those of windows up to t - delay."""
    if delay < 0:
        raise ValueError(f"label delay must be >= 0, got {delay}")
    seen = running_sum(risk.select(*KEY, "risk"), ["stream_id"], "window_idx",
                       index_bucket(F.col("window_idx")),
                       {"upto": F.when(F.col("risk").isNotNull(), 1).otherwise(0)})
    known = seen.select("stream_id", (F.col("window_idx") + delay).alias("window_idx"),
                        F.col("upto").alias("n_known"))
    return (risk.select(*KEY).join(known, KEY, "left")
                .withColumn("n_known", F.coalesce("n_known", F.lit(0)).cast("bigint")))


def feedback_block(risk: DataFrame, reference_risk: DataFrame, delay: int, k: int = TRAILING,
                   ece: DataFrame | None = None) -> DataFrame:
    """Features of the realised risks a monitor may already know; all zero before the first one."""
    known = matured_risks(risk, delay)
    ranked = running_sum(risk.filter(F.col("risk").isNotNull()).select(*KEY, "risk"),
                         ["stream_id"], "window_idx", index_bucket(F.col("window_idx")),
                         {"rank": F.lit(1)})
    ranked = ranked.withColumn("_i", F.col("rank") - 1)
    chunked, by = halo(ranked, ["stream_id"], "_i", k, 0)
    recent = own_rows(chunked.select(
        "stream_id", F.col("rank").cast("bigint").alias("n_known"), "_chunk", "_own", "risk",
        F.lag("risk").over(by).alias("_prev"),
        F.collect_list("risk").over(by.rowsBetween(-(k - 1), 0)).alias("_r")))
    if ece is None:
        out = known.join(recent, ["stream_id", "n_known"], "left")
        ece_value = F.lit(0.0)
    else:
        late = ece.select("stream_id", (F.col("window_idx") + delay).alias("window_idx"), "ece")
        out = known.join(recent, ["stream_id", "n_known"], "left").join(late, KEY, "left")
        ece_value = F.when(F.col("n_known") > 0, F.coalesce("ece", F.lit(0.0))).otherwise(0.0)
    out = out.join(reference_risk.select("stream_id", "risk_mean"), "stream_id")
    r = F.col("_r")
    steps = F.transform(F.sequence(F.lit(1), F.size(r) - 1),
                        lambda i: F.get(r, i) - F.get(r, i - 1))
    moves = F.when(F.size(r) >= 3, F.filter(F.transform(steps, F.signum), lambda s: s != 0))
    # (previous sign, changes) folded along the non-zero moves
    changes = F.aggregate(
        moves, F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("n")),
        lambda a, s: F.struct(s.alias("last"), F.when((a["last"] != 0) & (a["last"] != s),
                                                      a["n"] + 1.0).otherwise(a["n"]).alias("n")),
        lambda a: a["n"])
    rising = F.when(F.size(r) >= 3, F.aggregate(
        steps, F.lit(0.0), lambda n, s: F.when(s > 0, n + 1.0).otherwise(F.lit(0.0))))
    raw = {
        "fb_available": F.when(F.col("n_known") > 0, 1.0),
        "fb_n_matured": F.col("n_known").cast("double"),
        "fb_risk_last": F.col("risk"),
        "fb_risk_mean": num.array_mean(r),
        "fb_risk_std": num.array_std(r),
        "fb_risk_min": F.array_min(r),
        "fb_risk_max": F.array_max(r),
        "fb_risk_slope": num.theil_sen_slope(r),
        "fb_risk_delta": F.col("risk") - F.col("_prev"),
        "fb_risk_vs_reference": F.col("risk") - F.col("risk_mean"),
        "fb_sign_changes": changes,
        "fb_increasing_run": rising,
        "fb_ece": ece_value,
    }
    has = F.col("risk").isNotNull()
    return out.select(*KEY, *[F.coalesce(F.when(has, c), F.lit(0.0)).alias(n)
                              for n, c in raw.items()])


# -- context and interventions ---------------------------------------------------------------
def context_block(windows: DataFrame, regime: str | None = None) -> DataFrame:
    """Age and calendar. Integer clocks have no calendar: their columns are zero."""
    t = F.col("window_idx").cast("double")
    clock = windows.schema["t_start"].dataType
    out = [t.alias("ctx_deployment_age"), F.log1p(t).alias("ctx_deployment_age_log")]
    if isinstance(clock, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ts = F.col("t_start")
        parts = {"hour": (F.hour(ts.cast("timestamp")), 24), "dow": (F.weekday(ts), 7),
                 "month": (F.month(ts), 12)}
        for name, (value, period) in parts.items():
            s, c = num.cyclical(value, period)
            out += [F.coalesce(s, F.lit(0.0)).alias(f"ctx_{name}_sin"),
                    F.coalesce(c, F.lit(0.0)).alias(f"ctx_{name}_cos")]
        out.append(F.coalesce((F.weekday(ts) >= 5).cast("double"), F.lit(0.0))
                   .alias("ctx_is_weekend"))
    else:
        out += [F.lit(0.0).alias(f"ctx_{n}_{f}") for n in ("hour", "dow", "month")
                for f in ("sin", "cos")]
        out.append(F.lit(0.0).alias("ctx_is_weekend"))
    shown = F.coalesce(F.col(regime).cast("double"), F.lit(0.0)) if regime else F.lit(0.0)
    return windows.select(*KEY, *out, shown.alias("ctx_regime"))


def adaptation_block(windows: DataFrame, interventions: DataFrame | None = None) -> DataFrame:
    """State of past interventions, an as-of join on their running number.

    ``interventions``: stream_id, window_idx, seq (order inside a window), magnitude, risk_delta.
    """
    t = F.col("window_idx").cast("double")
    if interventions is None:
        zero = {c: F.lit(0.0) for c in ("adapt_n_updates", "adapt_last_magnitude",
                                        "adapt_last_risk_delta", "adapt_ever_updated",
                                        "adapt_update_rate")}
        return windows.select(*KEY, t.alias("adapt_windows_since_update"),
                              *[c.alias(n) for n, c in zero.items()])
    last = interventions.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_k"),
        F.max_by(F.struct("magnitude", "risk_delta"), "seq").alias("_last"))
    grid = windows.select(*KEY).join(last, KEY, "left")
    counted = running_sum(grid, ["stream_id"], "window_idx", index_bucket(F.col("window_idx")),
                          {"n": F.coalesce("_k", F.lit(0))})
    marks = counted.filter(F.col("_k").isNotNull()).select(
        "stream_id", "n", F.col("window_idx").alias("_at"), "_last")
    out = counted.select(*KEY, "n").join(marks, ["stream_id", "n"], "left")
    seen = F.col("_at").isNotNull()
    n = F.col("n").cast("double")
    return out.select(
        *KEY, F.when(seen, t - F.col("_at")).otherwise(t).alias("adapt_windows_since_update"),
        n.alias("adapt_n_updates"),
        F.coalesce("_last.magnitude", F.lit(0.0)).alias("adapt_last_magnitude"),
        F.coalesce("_last.risk_delta", F.lit(0.0)).alias("adapt_last_risk_delta"),
        seen.cast("double").alias("adapt_ever_updated"),
        (n / F.greatest(t, F.lit(1.0))).alias("adapt_update_rate"))


# -- assembly --------------------------------------------------------------------------------
def assemble(parts: Sequence[DataFrame]) -> DataFrame:
    """Join blocks on the window; feature columns come out in sorted order."""
    joined = reduce(lambda a, b: a.join(b, KEY), parts)
    features = sorted(c for c in joined.columns if c not in KEY)
    assert_no_future_columns(features)
    return joined.select(*KEY, *features)


def select_blocks(states: DataFrame, blocks: Sequence[str]) -> DataFrame:
    unknown = set(blocks) - set(BLOCKS)
    if unknown:
        raise ValueError(f"unknown state blocks {sorted(unknown)}; choose from {BLOCKS}")
    prefixes = tuple(f"{b}_" for b in blocks)
    return states.select(*KEY, *[c for c in states.columns if c.startswith(prefixes)])


def census(states: DataFrame) -> DataFrame:
    """Per stream and block: feature columns and how many of them are zero throughout."""
    features = [c for c in states.columns if c not in KEY]
    flat = states.groupBy("stream_id").agg(
        *[F.max(F.abs(F.col(c))).alias(c) for c in features])
    long = flat.unpivot("stream_id", features, "feature", "peak")
    return long.groupBy("stream_id", F.substring_index("feature", "_", 1).alias("block")).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.coalesce(F.col("peak"), F.lit(0.0)) == 0).alias("n_constant_zero"))
