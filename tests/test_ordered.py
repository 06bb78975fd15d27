import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.operators.ordered import (exact_quantiles, index_bucket, running_sum, unit_bucket)
from stillvalid.sources.stream_log import doubled_keys, number_rows, ranged_rows


def test_row_numbers_of_a_hot_stream_span_partitions(spark):
    """One stream holds nearly all rows, many of them equal; numbering stays dense and ordered."""
    rng = np.random.default_rng(0)
    rows = [("hot", int(v)) for v in rng.integers(0, 40, 4000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(rows, "stream_id string, t bigint").repartition(5)
    got = number_rows(df, ["stream_id"], ["t"], "test", partitions=8).toPandas()
    hot = got[got.stream_id == "hot"].sort_values("row_idx")
    assert list(hot.row_idx) == list(range(4000))
    assert hot.t.is_monotonic_increasing
    assert sorted(got[got.stream_id == "cold"].row_idx) == list(range(10))


def test_equal_rows_do_not_all_reach_one_partition(spark):
    df = spark.range(2000).select(F.lit("a").alias("stream_id"), F.lit(1).alias("t"))
    placed = df.withColumn("_salt", F.rand(7)).repartitionByRange(4, "stream_id", "t", "_salt")
    sizes = placed.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == 4 and sizes.max() < 1000
    got = number_rows(df, ["stream_id"], ["t"], "test", partitions=4)
    assert sorted(r["row_idx"] for r in got.collect()) == list(range(2000))


def test_running_sum_over_buckets(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(100)],
                               "k string, i bigint, v int")
    got = running_sum(df, ["k"], "i", index_bucket(F.col("i"), 7), {"s": F.col("v")}).toPandas()
    got = got.sort_values("i")
    assert list(got.s) == list(np.cumsum([i % 3 for i in range(100)]))


@pytest.mark.parametrize("n", [1, 2, 17, 400])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.random(n), 2)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("a", None)],
                               "k string, v double")
    qs = {"q10": .1, "q50": .5, "q75": .75, "q100": 1.0}
    got = exact_quantiles(df, ["k"], "v", qs, unit_bucket(F.col("v"), 8)).first()
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.quantile(v, q), abs=1e-12)
    assert got["n_values"] == n


def test_ranges_follow_concentrated_values(spark):
    """Most values within a millionth of the range, and outliers: ranges stay even, ranks exact."""
    rng = np.random.default_rng(3)
    v = np.r_[0.5 + 1e-7 * rng.random(3600), rng.normal(size=400) * 1e6]
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    from stillvalid.operators.ordered import with_ranges
    sizes = [r["count"] for r in with_ranges(df, ["k"], "v").groupBy("_bucket").count().collect()]
    assert max(sizes) < 4 * len(v) / 64
    got = exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).first()
    np.testing.assert_allclose([got["a"], got["b"], got["c"]], np.quantile(v, [0.1, 0.5, 0.93]))


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_doubled_keys_across_range_edges(spark, partitions):
    twice = spark.createDataFrame([(s, i // 2, i) for s in ("a", "b") for i in range(60)] + [("c", None, 1), ("c", None, 2), ("c", 5, 3)],
                                  "s string, t long, v long")
    found = {r.s: r.n_doubled for r in doubled_keys(ranged_rows(twice, ["s"], ["t"], "d", partitions), ["s"], ["t"]).collect()}
    assert found == {"a": 30, "b": 30, "c": 1}
    with pytest.raises(ValueError, match="doubled order keys.*'a'"):
        number_rows(twice, ["s"], ["t"], "d", partitions, unique=True)
    assert number_rows(twice, ["s"], ["t", "v"], "d", partitions, unique=True).count() == 123
