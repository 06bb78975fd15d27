"""Frozen tables."""
from pyspark.sql import functions as F

from stillvalid.session import freeze


def sorts(spark, make):
    """Sort operators in the plans that Spark executed."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = make()
    return out, sum("Sort" in e.physicalPlanDescription() for e in
                    (store.executionsList().apply(i) for i in range(before, store.executionsCount())))


def test_partitioned_tables_are_written_without_sorting_rows(spark):
    df = spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 2).alias("segment"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    out, n = sorts(spark, lambda: freeze(df, "unsorted", partition_by=("segment",)))
    assert n == 0 and out.filter("segment = 1").count() == 500 and out.agg(F.sum("id")).first()[0] == 499500
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
