"""All row-level state blocks of a window from one scan and one shuffle.

One aggregate per window holds everything the blocks need of its rows: averages, spreads and order
statistics of row scalars, one vector of sums (class counts, calibration bins, z, z z', squares and
bin counts of every feature) and the window's own standardised rows, whose number is the window's
size. It is mergeable, so tasks shrink their rows before the shuffle; what follows works on one row a
window. The blocks equal those of :mod:`stillvalid.operators.state`, which compute them one by one.

Class scorers with inputs, whose rows lie in order, take whole windows as arrays (:mod:`.packed`) to the same columns.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from .geometry import entries
from .packed import Windows, window_pass
from .reference import PSI_BINS
from .state import _QUANTILES, KEY

CALIBRATION_BINS = 10
_Q = list(_QUANTILES.values())


def frozen_vectors(features: DataFrame, width: int) -> DataFrame:
    """One row per stream: means, spreads, cut points and bin counts as arrays in feature order.

    A feature that the reference has never seen has NULL entries.
    """
    packed = features.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("mean", "std", "cuts", "n_bins")))).alias("_f"))
    own = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.try_element_at("_f", j))
    return packed.select("stream_id", own.alias("_f")).select(
        "stream_id", *[F.col(f"_f.{c}").alias(f"_{c}") for c in ("mean", "std", "cuts", "n_bins")])


def embedding_vectors(reference: DataFrame) -> DataFrame:
    """One row per stream: means and spreads of the embedding in dimension order."""
    packed = reference.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("_e"))
    return packed.select("stream_id", F.col("_e.mean").alias("_emean"), F.col("_e.std").alias("_estd"))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _one_hot(place: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.when(b == place, 1.0).otherwise(0.0))


class WindowPass:
    """The aggregate of one monitored stream family: what goes in, and the blocks that come out.

    classes: 0 for regression; width: number of inputs (0: none are monitored); embedding: length of
    an embedding column (0: the representation is the standardised inputs); window: rows of every window, if
    predictions are those of a scorer of ours (0: a given log, whose arrays may have any form).
    """

    def __init__(self, classes: int, width: int, embedding: int = 0, window: int = 0):
        self.classes, self.width, self.embedding, self.window = classes, width, embedding, window
        self.parts: dict[str, tuple[Column, int]] = {}
        if classes:
            gap = F.when(F.col("_place") > 0, F.col("_ok") - F.col("_conf")).otherwise(0.0)
            hot = _one_hot(F.col("_place") - 1, CALIBRATION_BINS)
            self.parts["top"] = _one_hot(F.col("_top"), classes), classes
            self.parts["ece"] = F.transform(hot, lambda v: v * gap), CALIBRATION_BINS
        if width:
            whole = F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v))
            outer = F.flatten(F.transform("z", lambda a: F.transform("z", lambda b: a * b)))
            self.parts["total"] = F.when(whole, F.col("z")).otherwise(_zeros(width)), width
            self.parts["products"] = F.when(whole, outer).otherwise(_zeros(width * width)), width * width
            self.parts["known"] = F.transform("z", lambda v: v.isNotNull().cast("double")), width
            self.parts["sum"] = F.transform("z", lambda v: F.coalesce(v, F.lit(0.0))), width
            self.parts["square"] = F.transform("z", lambda v: F.coalesce(v * v, F.lit(0.0))), width
            bins = F.transform("z", lambda v, j: F.when(v.isNotNull(), F.size(F.filter(
                F.get("_cuts", j), lambda e: e <= F.get("x", j)))).otherwise(-1))
            self.parts["psi"] = F.flatten(F.transform(bins, lambda b: _one_hot(b, PSI_BINS))), width * PSI_BINS
        if embedding:
            self.parts["eknown"] = F.transform("embedding", lambda v: v.isNotNull().cast("double")), embedding
            self.parts["esum"] = F.transform("embedding", lambda v: F.coalesce(v, F.lit(0.0))), embedding

    # -- the pass ----------------------------------------------------------------------------
    def run(self, deployment: DataFrame, frozen: DataFrame | None) -> DataFrame:
        """One row per window; ``frozen`` comes from :func:`frozen_vectors`."""
        rows = deployment
        if self.window and self.classes and self.width:
            packed = Windows(self.classes, self.width, self.embedding, _Q, CALIBRATION_BINS)
            return window_pass(rows.join(frozen, "stream_id"), packed, self.window)
        if self.width:
            centred = F.zip_with("x", "_mean", lambda x, m: x - m)
            rows = rows.join(frozen, "stream_id").withColumn("z", F.zip_with(centred, "_std", lambda c, s: c / s))
        agg: list[Column] = [F.count(F.lit(1)).alias("n")]
        if self.classes:
            p, conf = F.col("proba"), F.array_max("proba")
            edges = [i * (1.0 / CALIBRATION_BINS) for i in range(CALIBRATION_BINS)]
            members = F.transform("members", num.clipped)
            rows = rows.withColumns({
                "_msp": num.clip(conf, num.PROBA_FLOOR, 1.0), "_ent": num.entropy(p), "_gap": num.top_two_gap(p),
                "_top": num.argmax(p), "_conf": conf, "_energy": -num.log_sum_exp(F.col("raw")), "_m": members,
                "_ok": F.coalesce((num.argmax(p) == F.col("y")).cast("double"), F.lit(0.0)),
                "_place": F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: conf > e))})
            rows = rows.withColumns({
                "_alea": num.array_mean(F.transform("_m", num.entropy)),
                "_mixed": num.entropy(num.mean_distribution(F.col("_m"))),
                "_sd": num.array_std(F.transform("_m", lambda q: F.element_at(q, -1)))})
            agg += [F.avg("_msp").alias("msp"), F.stddev_pop("_msp").alias("msp_std"),
                    F.percentile("_msp", F.array(*[F.lit(q) for q in _Q])).alias("msp_q"),
                    F.avg("_ent").alias("ent"), F.stddev_pop("_ent").alias("ent_std"), F.max("_ent").alias("ent_max"),
                    F.percentile("_ent", F.lit(0.9)).alias("ent_q90"), F.avg("_gap").alias("gap"),
                    F.avg("_energy").alias("energy"), F.percentile("_energy", F.lit(0.1)).alias("energy_q10"),
                    F.avg("_alea").alias("alea"), F.avg(F.col("_mixed") - F.col("_alea")).alias("epi"),
                    F.avg(F.col("_sd") * F.col("_sd")).alias("member_var")]
        else:
            agg += [F.avg("y_pred").alias("y_mean"), F.stddev_pop("y_pred").alias("y_std"),
                    F.percentile("y_pred", F.array(*[F.lit(q) for q in _Q])).alias("y_q"),
                    (F.max("y_pred") - F.min("y_pred")).alias("y_range"), F.var_pop("y_pred").alias("y_var")]
        vector = "embedding" if self.embedding else "z" if self.width else None
        if vector:
            norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, v: s + v * v))
            rows = rows.withColumn("_norm", norm)
            agg += [F.avg("_norm").alias("norm"), F.stddev_pop("_norm").alias("norm_std")]
        if self.width:
            whole = F.coalesce(F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
            agg += [F.count_if(whole).alias("n_whole"),
                    F.sort_array(F.collect_list(F.struct("seg_row", "z"))).alias("_rows")]
        if self.parts:
            sums = F.concat(*[F.coalesce(c, _zeros(n)) for c, n in self.parts.values()])
            rows = rows.withColumn("_sums", array_to_vector(sums))
            agg.append(vector_to_array(Summarizer.sum(F.col("_sums"))).alias("_sums"))
        out, at = rows.groupBy(*KEY).agg(*agg), 1
        for name, (_, n) in self.parts.items():
            out, at = out.withColumn(f"s_{name}", F.slice("_sums", at, n)), at + n
        if self.width:
            out = out.withColumns({f"z{j}": entries("_rows", j) for j in range(self.width)})
        return out.drop("_sums", "_rows")

    # -- blocks ------------------------------------------------------------------------------
    def blocks(self, windows: DataFrame, behaviour: DataFrame | None, frozen: DataFrame | None,
               embedding: DataFrame | None) -> DataFrame:
        """One row per window: the columns of the pred, unc, rep and dist blocks that rows alone give,
        and ``ece``; ``windows`` is the result of :meth:`run`."""
        out, cols = windows, []
        if self.classes:
            out = out.join(behaviour, "stream_id")
            cols += self._class_columns()
        else:
            q = {n: F.col("y_q").getItem(i) for i, n in enumerate(_QUANTILES)}
            cols += [F.col("y_mean").alias("pred_mean"), F.col("y_std").alias("pred_std"),
                     *[c.alias(f"pred_{n}") for n, c in q.items()], F.col("y_range").alias("pred_range"),
                     F.col("y_var").alias("unc_pred_var"), (q["q75"] - q["q25"]).alias("unc_pred_iqr")]
            cols += [F.lit(0.0).alias(c) for c in ("unc_energy_mean", "unc_epistemic", "unc_aleatoric", "unc_ensemble_var")]
        if self.width or self.embedding:
            out = out.join(embedding, "stream_id")
            known, total = ("s_eknown", "s_esum") if self.embedding else ("s_known", "s_sum")
            centre = F.zip_with(total, known, lambda s, n: F.when(n > 0, s / n))
            gap = F.zip_with(F.zip_with(centre, "_emean", lambda c, m: c - m), "_estd", lambda d, s: d / s)
            cols += [F.col("norm").alias("rep_norm_mean"), F.col("norm_std").alias("rep_norm_std"),
                     F.sqrt(_sum_known(F.transform(gap, lambda g: g * g)) / F.size(gap)).alias("rep_centroid_shift")]
        if self.width:
            out = out.join(frozen.select("stream_id", "_n_bins"), "stream_id")
            cols += self._moment_columns()
        return out.select(*KEY, *cols)

    def _class_columns(self) -> list[Column]:
        k, n = self.classes, F.col("n")
        now = [num.clip(c / n, num.PROBA_FLOOR, 1.0) for c in num.items("s_top", k)]
        before = [num.clip(c, num.PROBA_FLOOR, 1.0) for c in num.items("prior", k)]
        return [
            F.col("msp").alias("pred_msp_mean"), F.col("msp_std").alias("pred_msp_std"),
            *[F.col("msp_q").getItem(i).alias(f"pred_msp_{q}") for i, q in enumerate(_QUANTILES)],
            F.col("ent").alias("pred_entropy_mean"), F.col("ent_std").alias("pred_entropy_std"),
            F.col("gap").alias("pred_margin_mean"),
            num.total([a * F.log(a / b) for a, b in zip(now, before)]).alias("pred_class_kl"),
            (F.lit(0.5) * num.total([F.abs(a - b) for a, b in zip(now, before)])).alias("pred_class_tv"),
            (F.col("msp") - F.col("confidence_mean")).alias("pred_conf_shift"),
            (F.col("ent") - F.col("entropy_mean")).alias("pred_entropy_shift"),
            F.col("ent").alias("unc_entropy_mean"), F.col("ent_q90").alias("unc_entropy_q90"),
            F.col("ent_max").alias("unc_entropy_max"), F.col("energy").alias("unc_energy_mean"),
            F.col("energy_q10").alias("unc_energy_q10"), F.col("alea").alias("unc_aleatoric"),
            F.col("epi").alias("unc_epistemic"), F.col("member_var").alias("unc_ensemble_var"),
            (F.aggregate("s_ece", F.lit(0.0), lambda s, g: s + F.abs(g)) / n).alias("ece")]

    def _moment_columns(self) -> list[Column]:
        seen = F.filter(F.transform("_n_bins", lambda b, j: F.when(b.isNotNull(), j)), lambda j: j.isNotNull())

        def of(name: str, j: Column) -> Column:
            return F.get(name, j)

        mean = F.transform(seen, lambda j: F.when(of("s_known", j) > 0, of("s_sum", j) / of("s_known", j)))
        spread = F.transform(seen, lambda j: F.when(of("s_known", j) > 0, F.sqrt(F.greatest(
            of("s_square", j) / of("s_known", j) - F.pow(of("s_sum", j) / of("s_known", j), F.lit(2.0)), F.lit(0.0)))))

        def stability(j: Column) -> Column:
            r = F.greatest(1.0 / of("_n_bins", j), F.lit(1e-6))
            own = F.slice("s_psi", j * PSI_BINS + 1, of("_n_bins", j))
            size = F.greatest(of("s_known", j), F.lit(1.0))
            return F.aggregate(own, F.lit(0.0), lambda s, c: s + (F.greatest(c / size, F.lit(1e-6)) - r)
                               * F.log(F.greatest(c / size, F.lit(1e-6)) / r))

        psi = F.transform(seen, stability)
        some = F.filter(spread, lambda s: s.isNotNull())
        return [F.sqrt(_sum_known(F.transform(mean, lambda m: m * m)) / F.size(seen)).alias("dist_mean_shift"),
                num.array_mean(some).alias("dist_scale_ratio"), num.array_mean(psi).alias("dist_psi_mean"),
                F.array_max(psi).alias("dist_psi_max"), array_quantile(psi, 0.9).alias("dist_psi_q90")]

    def moments(self, windows: DataFrame) -> DataFrame:
        """The second moments of each window, as :func:`geometry.second_moments` gives them."""
        return windows.select(*KEY, "n", "n_whole", F.col("s_total").alias("total"), F.col("s_products").alias("products"))


def _sum_known(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def array_quantile(a: Column, q: float) -> Column:
    """Linear-interpolation quantile of an array without gaps; NULL when it is empty."""
    def at(s: Column) -> Column:
        place = F.lit(float(q)) * (F.size(s) - 1)
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return num.bind(F.array_sort(a), lambda s: F.when(F.size(s) > 0, at(s)))
