"""Shape of a window's cloud of points, and its discrepancies from the frozen reference.

* Shape and principal coordinates come from second moments. Spark adds up 1, z and z z' per window
  (one vector aggregate); only such sums, one row per window, reach Python.
* Kernel, neighbour and distribution distances compare every row of a window with the declared
  reference sample. Windows and sample meet in groups of ``WINDOWS_PER_GROUP`` consecutive windows
  of one stream; the sample is repeated once per group and no side is broadcast. A marginal of the
  sample is a cumulative table (values, counts below, integrals of the distribution function and of
  its square), so distances need that table at the window's own values only.

A window with a missing input has NULL geometry.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reference import scale_vectors, standardise

# Fixed value of the statistic's definition.
NEIGHBOURS = 10
WINDOWS_PER_GROUP = 64
#: Coordinates up to which second moments are plain sums; wider vectors are added up as one.
PLAIN_SUMS = 8
#: Rows compared with a whole sample in one go.
ROWS = 32
_FLOOR = 1e-12


# -- second moments --------------------------------------------------------------------------
def second_moments(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per key: rows, rows with all inputs, and the sums of z and of z z' (row by row) as arrays."""
    whole = F.coalesce(F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    if width <= PLAIN_SUMS:
        z = [F.when(F.col("_whole"), F.get("z", F.lit(j))).otherwise(0.0) for j in range(width)]
        known = [F.get("z", F.lit(j)).isNotNull() & ~F.isnan(F.get("z", F.lit(j))) for j in range(width)]
        upper = [(i, j) for i in range(width) for j in range(i, width)]
        rows = rows.select(*keys, "z", reduce(and_, known, F.col("z").isNotNull()).alias("_whole")).select(
            *keys, "_whole", *[c.alias(f"_z{j}") for j, c in enumerate(z)])
        agg = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("_whole").alias("n_whole"),
            *[F.sum(f"_z{j}").alias(f"_s{j}") for j in range(width)],
            *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_p{i}_{j}") for i, j in upper])
        return agg.select(*keys, "n", "n_whole", F.array(*[f"_s{j}" for j in range(width)]).alias("total"), F.array(
            *[f"_p{min(i, j)}_{max(i, j)}" for i in range(width) for j in range(width)]).alias("products"))
    squares = F.flatten(F.transform("z", lambda a: F.transform("z", lambda b: a * b)))
    empty = F.array_repeat(F.lit(0.0), width + width * width)
    sums = F.when(whole, F.concat("z", squares)).otherwise(empty)
    agg = rows.select(*keys, whole.alias("_whole"), array_to_vector(sums).alias("_sums")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_whole").alias("n_whole"),
        vector_to_array(Summarizer.sum(F.col("_sums"))).alias("_sums"))
    return agg.select(*keys, "n", "n_whole", F.slice("_sums", 1, width).alias("total"),
                      F.slice("_sums", width + 1, width * width).alias("products"))


def _scatter(n: np.ndarray, total: np.ndarray, products: np.ndarray,
             around: np.ndarray) -> np.ndarray:
    """Sum of (z - c)(z - c)' of each row's cloud, from its sums."""
    cross = np.einsum("wi,wj->wij", total, around)
    middle = n[:, None, None] * np.einsum("wi,wj->wij", around, around)
    return products - cross - cross.transpose(0, 2, 1) + middle


def principal_axes(moments: DataFrame, k: int, width: int) -> DataFrame:
    """Per stream: centre and leading axes of all its rows; the largest loading is positive."""
    @F.pandas_udf("centre array<double>, components array<array<double>>")
    def axes(n: pd.Series, total: pd.Series, products: pd.Series) -> pd.DataFrame:
        count = np.maximum(n.to_numpy(float), 1.0)
        sums = np.stack(total.to_numpy()).astype(float)
        centre = sums / count[:, None]
        spread = _scatter(count, sums, np.stack(products.to_numpy()).reshape(-1, width, width),
                          centre)
        _, vectors = np.linalg.eigh(spread)
        leading = vectors[:, :, ::-1][:, :, :k].transpose(0, 2, 1)
        at = np.abs(leading).argmax(axis=2)[:, :, None]
        sign = np.where(np.take_along_axis(leading, at, axis=2) < 0, -1.0, 1.0)
        return pd.DataFrame({"centre": list(centre),
                             "components": [list(a) for a in leading * sign]})

    return moments.select("stream_id", axes("n_whole", "total", "products").alias("_a")).select(
        "stream_id", "_a.centre", "_a.components")


def axis_spread(moments: DataFrame, axes: DataFrame) -> DataFrame:
    """Per stream and axis: the variance of all rows along it; and how far the axes are from
    orthonormal (sum of squared deviations of their inner products)."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def outer(a):
        return F.flatten(F.transform(a, lambda x: F.transform(a, lambda y: x * y)))

    def skew(components):
        return F.aggregate(F.flatten(F.transform(components, lambda a, i: F.transform(
            components, lambda b, j: F.pow(dot(a, b) - (i == j).cast("double"), F.lit(2.0))))),
            F.lit(0.0), lambda s, v: s + v)

    long = moments.join(axes, "stream_id").select(
        "stream_id", "n_whole", "total", "products", skew(F.col("components")).alias("skew"),
        F.posexplode("components").alias("axis", "_a"))
    return long.select("stream_id", "axis", "skew", (
        dot(outer(F.col("_a")), F.col("products")) / F.col("n_whole")
        - F.pow(dot(F.col("_a"), F.col("total")) / F.col("n_whole"), F.lit(2.0))).alias("variance"))


def shape_columns(n_axes: int) -> list[str]:
    return ["rep_cov_trace", "rep_cov_logdet", "rep_cov_condition",
            *[f"rep_pca{i + 1}_mean" for i in range(n_axes)], "rep_pca_energy"]


def window_shape(moments: DataFrame, geometry: DataFrame, width: int, n_axes: int) -> DataFrame:
    """Covariance shape and principal coordinates of each window, from its moments alone."""
    names = shape_columns(n_axes)

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def shape(n: pd.Series, total: pd.Series, products: pd.Series, centre: pd.Series,
              components: pd.Series) -> pd.DataFrame:
        count = n.to_numpy(float)
        sums = np.stack(total.to_numpy()).astype(float)
        square = np.stack(products.to_numpy()).reshape(-1, width, width)
        own = _scatter(count, sums, square, sums / count[:, None])
        single = count < 2
        cov = own / np.where(single, 1.0, count - 1.0)[:, None, None]
        ridge = np.linalg.eigvalsh(cov + 1e-9 * np.eye(width))
        ridge = np.maximum(ridge, _FLOOR)
        home = np.stack(centre.to_numpy()).astype(float)
        axes = np.stack([np.stack(c) for c in components.to_numpy()])
        about = _scatter(count, sums, square, home)
        along = np.einsum("wki,wij,wkj->w", axes, about, axes)
        means = np.einsum("wki,wi->wk", axes, sums / count[:, None] - home)
        out = {"rep_cov_trace": np.where(single, 0.0, np.trace(cov, axis1=1, axis2=2)),
               "rep_cov_logdet": np.where(single, 0.0, np.log(ridge).sum(axis=1)),
               "rep_cov_condition": np.where(single, 1.0, ridge[:, -1] / ridge[:, 0])}
        out |= {f"rep_pca{i + 1}_mean": means[:, i] for i in range(n_axes)}
        out["rep_pca_energy"] = along / np.maximum(np.trace(about, axis1=1, axis2=2), _FLOOR)
        return pd.DataFrame(out)[names]

    found = moments.filter("n_whole = n").join(geometry.select("stream_id", "centre", "components"),
                                               "stream_id")
    made = found.select("stream_id", "window_idx", shape(
        "n_whole", "total", "products", "centre", "components").alias("_s")).select(
        "stream_id", "window_idx", "_s.*")
    return moments.select("stream_id", "window_idx").join(made, ["stream_id", "window_idx"], "left")


# -- distances from the reference sample -----------------------------------------------------
class Marginal:
    """Cumulative table of one feature's sample: distribution function F and the integrals of F
    and F^2 from the smallest value on."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.n = len(values)
        level = np.arange(1, self.n + 1) / self.n
        steps = np.diff(self.values, append=self.values[-1:])
        self.area = np.concatenate([[0.0], np.cumsum(level * steps)])
        self.area2 = np.concatenate([[0.0], np.cumsum(level ** 2 * steps)])

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """F(x) and the two integrals up to x."""
        below = np.searchsorted(self.values, x, side="right")
        level = below / self.n
        last = self.values[np.maximum(below - 1, 0)]
        done = np.maximum(below - 1, 0)
        return (level, self.area[done] + level * np.where(below > 0, x - last, 0.0),
                self.area2[done] + level ** 2 * np.where(below > 0, x - last, 0.0))

    def distances(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Wasserstein-1, Kolmogorov-Smirnov and energy distance of each row of sorted values.

        Between two neighbouring values the window's function is a constant c, so the integrals of
        |c - F| and (c - F)^2 follow from the table at both ends and where F crosses c.
        """
        size = own.shape[1]
        low = np.minimum(own[:, :1], self.values[0])
        high = np.maximum(own[:, -1:], self.values[-1])
        ends = np.concatenate([low, own, high], axis=1)
        c = np.arange(size + 1) / size
        crossing = self.values[np.clip(np.ceil(c * self.n - 1e-9).astype(int) - 1, 0, self.n - 1)]
        level, area, area2 = self.at(ends)
        a, b = ends[:, :-1], ends[:, 1:]
        turn = np.clip(crossing, a, b)
        _, mid, _ = self.at(turn)
        under = c * (turn - a) - (mid - area[:, :-1])
        over = (area[:, 1:] - mid) - c * (b - turn)
        square = (c ** 2 * (b - a) - 2 * c * (area[:, 1:] - area[:, :-1])
                  + area2[:, 1:] - area2[:, :-1])
        left = np.searchsorted(self.values, own, side="left") / self.n
        # Equal values of the window form one step: its top after the last, its foot before the first.
        top = np.stack([np.searchsorted(r, r, side="right") for r in own]) / size
        foot = np.stack([np.searchsorted(r, r, side="left") for r in own]) / size
        ks = np.maximum(np.abs(level[:, 1:-1] - top), np.abs(left - foot)).max(axis=1)
        return ((under + over).sum(axis=1), ks,
                np.sqrt(np.maximum(2.0 * square.sum(axis=1), 0.0)))


def distance_columns() -> list[str]:
    return ["rep_knn_dist_mean", "rep_knn_dist_q90", "rep_knn_dist_max", "dist_mmd2", "dist_energy",
            "dist_wasserstein_mean", "dist_wasserstein_max", "dist_wasserstein_q90",
            "dist_ks_mean", "dist_ks_max", "dist_ks_q90"]


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all pairs; the last two axes are rows and coordinates."""
    cross = a @ np.swapaxes(b, -1, -2)
    cross *= -2.0
    cross += (a * a).sum(-1)[..., :, None]
    cross += (b * b).sum(-1)[..., None, :]
    return np.maximum(cross, 0.0, out=cross)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix, and the place of each row among them."""
    order = np.lexsort(rows.T)
    ranked = rows[order]
    first = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
    place = np.empty(len(rows), np.int64)
    place[order] = first.cumsum() - 1
    return ranked[first], place


def compare_windows(z: np.ndarray, sample: np.ndarray, bandwidth: float,
                    kernel_self: float) -> dict[str, np.ndarray]:
    """Distances of many equally long windows (window, row, coordinate) from one sample.

    Equal rows have equal distances, so each distinct row meets the sample once.
    """
    count, size, width = z.shape
    gamma = 0.5 / max(bandwidth, _FLOOR) ** 2
    k = max(1, min(NEIGHBOURS, len(sample) - 1))
    rows, place = distinct_rows(z.reshape(-1, width))
    near, alike = np.empty(len(rows)), np.empty(len(rows))
    for i in range(0, len(rows), ROWS):
        part = rows[i:i + ROWS]
        d2 = squared_distances(part, sample)
        close = np.argpartition(d2, k - 1, axis=1)[:, :k]
        near[i:i + ROWS] = np.sqrt(((part[:, None] - sample[close]) ** 2).sum(-1)).mean(axis=1)
        d2 *= -gamma
        alike[i:i + ROWS] = np.exp(d2, out=d2).mean(axis=1)
    near, cross = near[place].reshape(count, size), alike[place].reshape(count, size).mean(axis=1)
    own = np.exp(squared_distances(z, z) * -gamma)
    inner = (own.sum(axis=(1, 2)) - np.trace(own, axis1=1, axis2=2)) / max(size * (size - 1), 1)
    mmd2 = inner + kernel_self - 2.0 * cross
    if size < 2 or len(sample) < 2:
        mmd2 = np.zeros(count)
    per = np.stack([np.stack(Marginal(sample[:, j]).distances(np.sort(z[:, :, j], axis=1)))
                    for j in range(width)])
    out = {"dist_mmd2": mmd2, "dist_energy": per[:, 2].mean(axis=0)}
    for name, values in (("rep_knn_dist", near.T), ("dist_wasserstein", per[:, 0]),
                         ("dist_ks", per[:, 1])):
        out |= {f"{name}_mean": values.mean(axis=0), f"{name}_max": values.max(axis=0),
                f"{name}_q90": np.quantile(values, 0.9, axis=0)}
    return out


def packed_windows(deployment: DataFrame, features: DataFrame, n_features: int) -> DataFrame:
    """One row per window: its standardised inputs as one array for each feature, in row order."""
    z = standardise(deployment.select("stream_id", "window_idx", "seg_row", "x"), scale_vectors(features))
    packed = z.groupBy("stream_id", "window_idx").agg(
        F.sort_array(F.collect_list(F.struct("seg_row", "z"))).alias("_rows"))
    return packed.select("stream_id", "window_idx", *[
        entries("_rows", j).alias(f"z{j}") for j in range(n_features)])


def entries(rows: str, j: int) -> Column:
    """Entry j of z of each row in an array of rows."""
    return F.transform(rows, lambda r: F.get(r["z"], F.lit(j)))


def window_distances(windows: DataFrame, sample: DataFrame, features: DataFrame,
                     geometry: DataFrame, sizes: DataFrame, n_features: int) -> DataFrame:
    """One row per window with :func:`distance_columns`.

    ``windows`` has an array z0, z1, ... for each feature, ``sizes`` stream_id and n_windows.
    """
    columns = distance_columns()
    scales = scale_vectors(features)
    group = F.floor(F.col("window_idx") / WINDOWS_PER_GROUP).cast("bigint").alias("_group")
    names = [f"z{j}" for j in range(n_features)]
    flat = [F.get("z", F.lit(j)).alias(c) for j, c in enumerate(names)]
    rows = windows.select("stream_id", group, "window_idx", *names)
    # The number of groups is known from the sizes table, so the sample is copied once per group
    # without a join with the windows; its rows are spread over all tasks before that.
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col("n_windows") - 1) / WINDOWS_PER_GROUP).cast("bigint")
    ref = standardise(sample.select("stream_id", "rank", "x"), scales).join(
        geometry.select("stream_id", "bandwidth", "kernel_self"), "stream_id").join(
        sizes.select("stream_id", "n_windows"), "stream_id")
    ref = ref.repartition(n, "stream_id", "rank").select(
        "stream_id", "bandwidth", "kernel_self", *flat,
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_group"))

    def summarise(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = right[names].to_numpy(float)
        b = b[~np.isnan(b).any(axis=1)]
        if left.empty or not len(b):
            return pd.DataFrame(columns=["stream_id", "window_idx", *columns])
        left = left.sort_values("window_idx")
        windows = left["window_idx"].to_numpy()
        z = np.stack([np.stack(left[c].to_numpy()).astype(float) for c in names], axis=-1)
        whole = ~np.isnan(z).any(axis=(1, 2))
        out = pd.DataFrame(np.nan, index=range(len(windows)), columns=columns)
        if whole.any():
            found = compare_windows(z[whole], b, float(right["bandwidth"].iloc[0]),
                                    float(right["kernel_self"].iloc[0]))
            out.loc[whole, columns] = np.stack([found[c] for c in columns], axis=1)
        out.insert(0, "window_idx", windows)
        out.insert(0, "stream_id", key[0])
        return out.astype(object).where(out.notna(), None)

    # A fixed partition count keeps adaptive execution from merging these small but costly groups
    # into a few tasks.
    rows, ref = (df.repartition(n, "stream_id", "_group") for df in (rows, ref))
    schema = "stream_id string, window_idx bigint, " + ", ".join(f"{c} double" for c in columns)
    return (rows.groupBy("stream_id", "_group")
                .cogroup(ref.groupBy("stream_id", "_group"))
                .applyInPandas(summarise, schema))


def window_geometry(deployment: DataFrame, sample: DataFrame, features: DataFrame,
                    geometry: DataFrame, sizes: DataFrame, n_features: int,
                    n_axes: int) -> DataFrame:
    """Shape and distances of each window side by side."""
    z = standardise(deployment.select("stream_id", "window_idx", "x"), scale_vectors(features))
    moments = second_moments(z, ["stream_id", "window_idx"], n_features)
    return window_shape(moments, geometry, n_features, n_axes).join(
        window_distances(packed_windows(deployment, features, n_features), sample, features,
                         geometry, sizes, n_features), ["stream_id", "window_idx"], "left")


# -- the frozen side -------------------------------------------------------------------------
def fit_geometry(sample: DataFrame, features: DataFrame, pre: DataFrame, width: int,
                 n_axes: int) -> DataFrame:
    """Per stream: kernel bandwidth and self-similarity of the declared sample, and centre and
    principal axes of all pre-deployment rows.

    The bandwidth is the square root of half the median squared distance over all pairs of sample
    rows. The group handed to Python holds the declared sample, whatever the stream's size.
    """
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.array(pdf["z"].tolist(), dtype=float)
        z = z[~np.isnan(z).any(axis=1)]
        upper = squared_distances(z, z)[np.tri(len(z), k=-1, dtype=bool).T] if len(z) > 1 else np.zeros(0)
        half = float(np.median(upper)) / 2.0 if upper.size else 0.5
        width = np.sqrt(half) if half > 0 else 1.0
        alike = float(np.exp(upper * (-0.5 / max(width, _FLOOR) ** 2)).mean()) if upper.size else 0.0
        return pd.DataFrame([(key[0], width, alike)],
                            columns=["stream_id", "bandwidth", "kernel_self"])

    scales = scale_vectors(features)
    fitted = standardise(sample, scales).select("stream_id", "z").groupBy("stream_id").applyInPandas(
        kernel, "stream_id string, bandwidth double, kernel_self double")
    moments = second_moments(standardise(pre.select("stream_id", "x"), scales), ["stream_id"], width)
    return fitted.join(principal_axes(moments, n_axes, width), "stream_id")
