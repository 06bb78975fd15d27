"""Order-dependent building blocks that do not put a whole stream into one task.

A stream may hold a third of all rows, so no window function here is partitioned by the stream
alone. Bounded frames use overlapping chunks; running totals and ranks use two levels (a total per
bucket, then a running sum inside the bucket).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CHUNK = 4096
#: Ranges of a key's values where nothing better than their distribution is known.
RANGES = 64


def halo(df: DataFrame, keys: Sequence[str], idx: str, before: int, after: int,
         chunk: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """Copy each row into the chunks whose frames can reach it.

    ``idx`` must be dense (0, 1, 2, ...) within ``keys``. With a frame of ``before`` preceding and
    ``after`` following rows, any window function over the returned spec is exact on rows with
    ``_own``; finish with :func:`own_rows`. A row is copied at most
    ``1 + (before + after) / chunk`` times on average.
    """
    i = F.col(idx).cast("bigint")
    low = F.greatest(F.floor((i - after) / chunk), F.lit(0))
    high = F.floor((i + before) / chunk)
    out = (df.withColumn("_chunk", F.explode(F.sequence(low, high)))
             .withColumn("_own", F.col("_chunk") == F.floor(i / chunk)))
    return out, Window.partitionBy(*keys, "_chunk").orderBy(idx)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_chunk", "_own")


def with_ranges(df: DataFrame, keys: Sequence[str], order: str, ranges: int = RANGES) -> DataFrame:
    """Add ``_bucket``: the range of ``order`` between quantiles of the rows of each key.

    Edges follow the values, so outliers or a mass of close values do not fill one range. They are
    approximate (one small sketch per key); that touches the sizes of ranges, not their order.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = df.groupBy(*keys).agg(F.percentile_approx(order, shares, F.lit(1000)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(order)))
    return df.join(edges, list(keys)).withColumn("_bucket", below).drop("_edges")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, bucket: Column | None,
                sums: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys``.

    ``bucket`` must never decrease as ``order`` grows; None takes ranges between quantiles. One row
    per (keys, order) is expected, so ties must be pre-aggregated. The window over bucket totals
    holds one row per bucket.
    """
    df = with_ranges(df, keys, order) if bucket is None else df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    totals = df.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_bucket",
                         *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}")
                           for n in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    out = df.join(base, [*keys, "_bucket"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside))
    return out.drop("_bucket", *[f"_{p}_{n}" for n in sums for p in "vb"])


def unit_bucket(value: Column, buckets: int = CHUNK) -> Column:
    """Bucket of a number in [0, 1]; values outside fall into the end buckets."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * buckets)


def index_bucket(value: Column, width: int = CHUNK) -> Column:
    return F.floor(value / width)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str,
                        quantiles: Mapping[str, float], bucket: Column | None = None,
                        copies: str = "n") -> DataFrame:
    """Exact linear-interpolation quantiles per key from distinct values and their counts."""
    ranked = running_sum(counts, keys, value, bucket, {"upto": F.col(copies)})
    size = counts.groupBy(*keys).agg(F.sum(copies).alias("_size"))
    rank = {n: F.lit(float(q)) * (F.col("_size") - 1) for n, q in quantiles.items()}
    found = ranked.join(size, list(keys)).groupBy(*keys, "_size").agg(
        *[F.min(F.when(F.col("upto") > F.floor(r), F.col(value))).cast("double").alias(f"_lo_{n}")
          for n, r in rank.items()],
        *[F.min(F.when(F.col("upto") > F.ceil(r), F.col(value))).cast("double").alias(f"_hi_{n}")
          for n, r in rank.items()])
    return found.select(*keys, F.col("_size").alias("n_values"), *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (r - F.floor(r))).alias(n)
        for n, r in rank.items()])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    quantiles: Mapping[str, float], bucket: Column | None = None) -> DataFrame:
    """Exact quantiles of a column per key, without buffering a group in one task."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
                .agg(F.count(F.lit(1)).alias("n")))
    return quantiles_of_counts(counts, keys, value, quantiles, bucket)
