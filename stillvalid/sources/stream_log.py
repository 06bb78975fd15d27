"""The monitored-stream log: rows of a table numbered in time order and split at deployment.

Numbering rows per stream with ``row_number`` would sort a whole stream in one task. Instead rows
are range-partitioned on (stream, order) - which cuts even one huge stream into many partitions -
written once with their position in the partition, and numbered by adding the size of all earlier
partitions of the stream, a table of one row per (stream, partition).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..session import freeze


@dataclass(frozen=True)
class StreamSpec:
    """Everything that determines a monitored stream. Expressions are Spark SQL over ``table``."""

    name: str
    table: str
    stream: str
    order: tuple[str, ...]
    time: str
    target: str
    score_key: str
    features: tuple[str, ...] = ()
    classes: int = 0            # 0: regression
    window: int = 20
    pre_fraction: float = 0.2
    quantile: float = 0.75
    margin: float = 0.05
    horizon: int = 20
    context: int = 20
    delay: int = 1
    members: int = 5
    unique_order: bool = False  # refuse rows that no order column tells apart
    regime: str = ""            # number that names the operating regime; a window has its first row's
    # The frozen scorer: "rates" (a table of shares or means by key) or "boosted" (trees over the
    # features, whose projected leaves are the representation).
    scorer: str = "rates"
    rounds: int = 200
    depth: int = 4
    # A given prediction log: expressions for what a deployed model has written beside its inputs.
    # Empty: the frozen rate table predicts.
    y_pred: str = ""            # regression: the prediction
    proba: str = ""             # classification: array of class probabilities
    raw: str = ""               # array of scores before normalisation; default: log probabilities
    member_probas: str = ""     # array of arrays, one per ensemble member; default: proba alone
    embedding: str = ""         # array: the view of the representation block instead of the inputs
    sample_rows: int = 2000      # rows of the frozen reference sample (kernel, neighbours, marginals)
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def given(self) -> bool:
        return bool(self.proba if self.classes else self.y_pred)

    def key(self) -> str:
        """Identity of the cached log: any parameter change gives another key."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def select_stream(df: DataFrame, spec: StreamSpec) -> DataFrame:
    cols = [F.expr(spec.stream).cast("string").alias("stream_id"),
            F.expr(spec.time).alias("ts"),
            finite(F.expr(spec.target)).alias("y"),
            F.expr(spec.score_key).cast("string").alias("score_key")]
    if spec.features:
        cols.append(F.array(*[finite(F.expr(f)) for f in spec.features]).alias("x"))
    if spec.regime:
        cols.append(finite(F.expr(spec.regime)).alias("regime"))
    if spec.given:
        if spec.classes:
            cols.append(F.expr(spec.proba).cast("array<double>").alias("proba"))
            if spec.raw:
                cols.append(F.expr(spec.raw).cast("array<double>").alias("raw"))
            if spec.member_probas:
                cols.append(F.expr(spec.member_probas).cast("array<array<double>>").alias("members"))
        else:
            cols.append(finite(F.expr(spec.y_pred)).alias("y_pred"))
    if spec.embedding:
        cols.append(F.expr(spec.embedding).cast("array<double>").alias("embedding"))
    cols += [F.expr(o).alias(f"_o{i}") for i, o in enumerate(spec.order)]
    return df.select(*cols)


def doubled_keys(placed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: rows that have the same order columns as the row before them (``n_doubled``).

    ``placed`` holds sorted ranges (``_part``) with positions (``_pos``). Neighbours are compared
    inside a range, and the first row of a range with the last row of the range before it.
    """
    names = [*keys, *order]
    rows = placed.select("_part", "_pos", *names, F.struct(*names).alias("_row"))
    inside = Window.partitionBy("_part").orderBy("_pos")
    same = F.coalesce(F.col("_row").eqNullSafe(F.lag("_row").over(inside)) & F.lag("_pos").over(inside).isNotNull(), F.lit(False))
    found = rows.withColumn("_same", same).groupBy(*keys).agg(F.count_if("_same").alias("n"))
    edges = rows.groupBy("_part").agg(F.min_by("_row", "_pos").alias("_first"), F.max_by("_row", "_pos").alias("_last"))
    before = F.lag("_last").over(Window.orderBy("_part"))                  # one row for each range
    cut = edges.withColumn("_before", before).filter(F.col("_first").eqNullSafe(F.col("_before"))).select(
        *[F.col(f"_first.{k}").alias(k) for k in keys], F.lit(1).cast("bigint").alias("n"))
    return found.unionByName(cut).groupBy(*keys).agg(F.sum("n").alias("n_doubled"))


def ranged_rows(df: DataFrame, keys: list[str], order: list[str], label: str,
                partitions: int | None = None) -> DataFrame:
    """Rows in sorted ranges, written once: ``_part`` and ``_pos``.

    The random last sort key spreads rows that are equal in every order column over several ranges.
    """
    by = [*keys, *order, "_salt"]
    salted = df.withColumn("_salt", F.rand(7))
    # Without a fixed number, adaptive execution merges neighbouring small ranges; the partition
    # number is taken after that and stored with the row.
    ranged = (salted.repartitionByRange(partitions, *by) if partitions
              else salted.repartitionByRange(*by))
    ranged = (ranged
                .sortWithinPartitions(*keys, *order, "_salt")
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id())
                .drop("_salt"))
    return freeze(ranged, f"{label}-ranged")


def number_rows(df: DataFrame, keys: list[str], order: list[str], label: str,
                partitions: int | None = None, unique: bool = False) -> DataFrame:
    """Add ``row_idx`` (0-based, dense) per key in the given order, for any stream size.

    Rows that are equal in every order column are numbered in any order; with ``unique`` they are
    refused, and so is the whole table.
    """
    placed = ranged_rows(df, keys, order, label, partitions)
    if unique:
        bad = doubled_keys(placed, keys, order).filter("n_doubled > 0").orderBy(*keys).limit(10).collect()
        if bad:
            raise ValueError(f"doubled order keys: {[r.asDict() for r in bad]}")
    sizes = placed.groupBy(*keys, "_part").agg(F.min("_pos").alias("_first"),
                                               F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = freeze(sizes.select(*keys, "_part", "_first",
                                  F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")),
                     f"{label}-offsets")
    return (placed.join(offsets, [*keys, "_part"])
                  .withColumn("row_idx", F.col("_pos") - F.col("_first") + F.col("_before"))
                  .drop("_part", "_pos", "_first", "_before"))


def numbered_log(df: DataFrame, spec: StreamSpec) -> DataFrame:
    order = [f"_o{i}" for i in range(len(spec.order))]
    return number_rows(select_stream(df, spec), ["stream_id"], order, spec.name,
                       unique=spec.unique_order).drop(*order)
