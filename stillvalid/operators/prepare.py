"""Table preparation: validation, cleaning, ordering, targets and screens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stream_log import number_rows
from .ordered import halo, own_rows

# Window rule.
WINDOW_LADDER = (25, 50, 100, 200, 400)
MIN_WINDOWS = 120
MAX_WINDOWS = 1000
BASE_RATE_RANGE = (0.05, 0.95)


def stream_violations(numbered: DataFrame, numeric: Sequence[str], time: str = "ts") -> DataFrame:
    """Per stream: rows out of strict time order, rows with a missing number, total rows.

    ``numbered`` carries the arrival order in ``row_idx``. Problems are counted, never repaired.
    """
    missing = [c for c in (time, *numeric) if c not in numbered.columns]
    if missing:
        raise ValueError(f"stream lacks columns {missing}")
    bad_type = [c for c in numeric if numbered.schema[c].dataType.typeName() not in
                ("double", "float", "integer", "long", "short", "byte", "decimal")]
    if bad_type:
        raise TypeError(f"features must be numeric: {bad_type}")
    empty = F.lit(False)
    for c in numeric:
        empty = empty | F.col(c).isNull()
    base = numbered.select("stream_id", "row_idx", F.col(time).alias("_t"), empty.alias("_e"))
    chunked, by = halo(base, ["stream_id"], "row_idx", 1, 0)
    late = F.col("_t") <= F.lag("_t").over(by)
    marked = own_rows(chunked.withColumn("_late", F.coalesce(late, F.lit(False))))
    return marked.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("_late").alias("n_out_of_order"),
        F.count_if("_e").alias("n_missing"))


def require_valid(violations: DataFrame) -> DataFrame:
    """The same table, but reading it fails as soon as a stream has a violation."""
    bad = (F.col("n_out_of_order") > 0) | (F.col("n_missing") > 0)
    text = F.concat(F.lit("stream refused: "), F.col("stream_id"))
    return violations.withColumn("valid", F.when(bad, F.raise_error(text).cast("boolean"))
                                 .otherwise(F.lit(True)))


def long_enough(sizes: DataFrame, size: int, stride: int, horizon: int) -> DataFrame:
    """Whether each stream has rows and windows for one origin with its whole horizon."""
    n = F.col("n_rows")
    count = F.when(n >= size, 1 + F.floor((n - size) / stride)).otherwise(0)
    return sizes.withColumn("n_windows", count.cast("bigint")).withColumn(
        "long_enough", (n >= size * (horizon + 2)) & (F.col("n_windows") >= horizon + 2))


def drop_sentinel(rows: DataFrame, columns: Sequence[str], sentinel: float) -> DataFrame:
    """Drop a row when any retained column is missing or holds the sentinel."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c) != sentinel, F.lit(False))
    return rows.filter(ok)


def window_rule(sizes: DataFrame) -> DataFrame:
    """Largest ladder window giving at least 120 windows; over 1000 at the largest, thin the rows.

    A stream too short for the smallest window is refused, with the reason.
    """
    n = F.col("n_rows")
    top, low = max(WINDOW_LADDER), min(WINDOW_LADDER)
    window = F.lit(None).cast("bigint")
    for w in sorted(WINDOW_LADDER):
        window = F.when(F.floor(n / w) >= MIN_WINDOWS, F.lit(w).cast("bigint")).otherwise(window)
    many = F.floor(n / top)
    k = F.when(many > MAX_WINDOWS, F.ceil(many / F.lit(float(MAX_WINDOWS)))).when(
        window.isNotNull(), 1)
    return sizes.select("stream_id", "n_rows", window.alias("window_size"), k.cast("bigint").alias(
        "keep_every"), F.when(window.isNull(), F.lit(
            f"fewer than {MIN_WINDOWS} windows of {low} rows")).alias("refused_because"))


def thin(numbered: DataFrame, k: int | Column) -> DataFrame:
    """Keep every k-th row (a defined operator of the window rule, not a sampling shortcut)."""
    return numbered.filter(F.col("row_idx") % k == 0)


def encode_category(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Zero-based code of each category in sorted order; a missing category gets -1.

    The distinct values are numbered by range partition and joined back, so neither the rows nor a
    large dictionary passes through one task.
    """
    one = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = number_rows(one, [], [column], "categories")
    return rows.join(codes, column, "left").withColumn(
        out, F.coalesce("row_idx", F.lit(-1)).cast("bigint")).drop("row_idx")


def threshold_target(value: Column, limit: float, above: bool = True) -> Column:
    return (value > limit if above else value < limit).cast("int")


def remaining_life(rows: DataFrame, unit: str, cycle: str) -> DataFrame:
    """Cycles left until the unit's last one (an aggregate joined back, safe for a hot unit)."""
    last = rows.groupBy(unit).agg(F.max(cycle).alias("_last"))
    return rows.join(last, unit).withColumn("remaining", F.col("_last") - F.col(cycle)).drop(
        "_last")


def array_moments(values: Column) -> tuple[Column, Column]:
    """Row-wise mean and population spread of a sensor array."""
    from ..functions.numeric import array_mean, array_std

    return array_mean(values), array_std(values)


def concat_batches(parts: Mapping[int, DataFrame]) -> DataFrame:
    """Union of acquisition batches; ``batch`` keeps their order."""
    out = None
    for number, df in sorted(parts.items()):
        one = df.withColumn("batch", F.lit(number))
        out = one if out is None else out.unionByName(one)
    return out


def target_screen(rows: DataFrame, targets: Sequence[str], features: Sequence[str],
                  min_rows: int = 0) -> DataFrame:
    """Base rate, largest absolute single-feature correlation, and the admissible target to use.

    All pairs are correlations of one aggregate: rows are read once and nothing is exploded.
    """
    def known(t: str, f: str) -> tuple[Column, Column]:
        both = F.col(t).isNotNull() & F.col(f).isNotNull()
        return F.when(both, F.col(t).cast("double")), F.when(both, F.col(f).cast("double"))

    agg = rows.agg(
        *[F.avg(F.col(t).cast("double")).alias(f"rate_{i}") for i, t in enumerate(targets)],
        *[F.count(t).alias(f"n_{i}") for i, t in enumerate(targets)],
        *[F.abs(F.corr(*known(t, f))).alias(f"c_{i}_{j}") for i, t in enumerate(targets)
          for j, f in enumerate(features)])
    listed = F.array(*[F.struct(
        F.lit(t).alias("target"), F.col(f"rate_{i}").alias("base_rate"),
        F.col(f"n_{i}").alias("n_rows"),
        F.array_max(F.array(*[F.col(f"c_{i}_{j}") for j in range(len(features))]))
        .alias("max_abs_corr")) for i, t in enumerate(targets)])
    out = agg.select(F.inline(listed))
    low, high = BASE_RATE_RANGE
    ok = F.col("base_rate").between(low, high) & (F.col("n_rows") >= min_rows)
    out = out.withColumn("admissible", ok)
    best = F.min_by("target", F.when(F.col("admissible"), F.col("max_abs_corr"))).over(
        Window.partitionBy())
    return out.withColumn("selected", (F.col("target") == best) & F.col("admissible"))


def prevalence(rows: DataFrame, period: str, label: str) -> DataFrame:
    """Class share per period and the change from the first period to the last."""
    counts = rows.groupBy(period, label).agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy(period).agg(F.sum("n").alias("_size"))
    ends = counts.agg(F.min(period).alias("_first"), F.max(period).alias("_last"))   # one row
    share = counts.join(size, period).withColumn("share", F.col("n") / F.col("_size"))
    share = share.join(F.broadcast(ends))
    change = share.groupBy(label).agg(
        (F.coalesce(F.max(F.when(F.col(period) == F.col("_last"), F.col("share"))), F.lit(0.0))
         - F.coalesce(F.max(F.when(F.col(period) == F.col("_first"), F.col("share"))), F.lit(0.0)))
        .alias("change"))
    extreme = change.agg(F.min_by(label, "change").alias("largest_fall"),
                         F.max_by(label, "change").alias("largest_rise"))       # one row
    out = share.select(period, label, "n", "share").join(change, label)
    return out.join(F.broadcast(extreme))


def accuracy_drop(rows: DataFrame) -> DataFrame:
    """Accuracy of the frozen model before and after deployment, and the drop in points."""
    pre = 1.0 - F.avg(F.when(F.col("segment") == "pre", F.col("loss")))
    dep = 1.0 - F.avg(F.when(F.col("segment") == "dep", F.col("loss")))
    out = rows.groupBy("stream_id").agg(pre.alias("accuracy_pre"), dep.alias("accuracy_dep"))
    return out.withColumn("drop_points",
                          100.0 * (F.col("accuracy_pre") - F.col("accuracy_dep")))
