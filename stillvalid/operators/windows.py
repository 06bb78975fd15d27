"""Count windows and the deployment split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_count(n_rows: Column, size: int, stride: int) -> Column:
    """Complete windows in ``n_rows`` rows."""
    return (F.when(n_rows >= size, 1 + F.floor((n_rows - size) / stride))
             .otherwise(F.lit(0)).cast("bigint"))


def deployment_sizes(numbered: DataFrame, window: int, fraction: float) -> DataFrame:
    """One row per stream: rows, first deployment row (a whole number of windows), window counts.

    A stream whose pre-deployment part is shorter than one window, or takes the whole stream, has
    ``refused`` set; callers drop it rather than repair it.
    """
    n, b = F.col("n_rows"), F.col("boundary")
    sizes = numbered.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.withColumn(
        "boundary", (F.floor(F.floor(n * F.lit(float(fraction))) / window) * window).cast("bigint"))
    return (sizes.withColumn("n_pre_windows", F.floor(b / window).cast("bigint"))
                 .withColumn("n_windows", window_count(n - b, window, window))
                 .withColumn("refused", (b < window) | (b >= n) | (n - b < window)))


def assign_windows(numbered: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """Segment, position in the segment and tumbling window of every row.

    Rows of a trailing partial window get a NULL ``window_idx``. The join side has one row per
    stream.
    """
    seg_row = F.when(F.col("row_idx") < F.col("boundary"), F.col("row_idx")).otherwise(
        F.col("row_idx") - F.col("boundary"))
    out = numbered.join(sizes.filter(~F.col("refused")), "stream_id")
    out = (out.withColumn("segment", F.when(F.col("row_idx") < F.col("boundary"), "pre")
                                      .otherwise("dep"))
              .withColumn("seg_row", seg_row))
    idx = F.floor(F.col("seg_row") / window).cast("bigint")
    limit = F.when(F.col("segment") == "pre", F.col("n_pre_windows")).otherwise(F.col("n_windows"))
    return out.withColumn("window_idx", F.when(idx < limit, idx))


def sliding_windows(rows: DataFrame, sizes: DataFrame, size: int, stride: int,
                    row: str = "row_idx", n_rows: str = "n_rows") -> DataFrame:
    """Repeat each row for every complete window [i*stride, i*stride + size) that covers it."""
    r = F.col(row)
    first = F.greatest(F.ceil((r - size + 1) / F.lit(float(stride))), F.lit(0))
    last = F.least(F.floor(r / stride), window_count(F.col(n_rows), size, stride) - 1)
    out = rows.join(sizes.select("stream_id", n_rows), "stream_id")
    return (out.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint"))
               .filter(F.col("_first") <= F.col("_last"))
               .withColumn("window_idx", F.explode(F.sequence("_first", "_last")))
               .drop("_first", "_last", n_rows))


def head_rows(numbered: DataFrame, n: int) -> DataFrame:
    return numbered.filter(F.col("row_idx") < n)


def head_windows(windows: DataFrame, n: int) -> DataFrame:
    return windows.filter(F.col("window_idx") < n)
