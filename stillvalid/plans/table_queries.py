"""Queries on sources, table preparation, windows and losses."""

from __future__ import annotations

from pyspark.ml.feature import NGram, Normalizer, HashingTF, RegexTokenizer
from pyspark.sql import functions as F

from ..operators import prepare as prep
from ..operators import risk as rk
from ..operators import windows
from ..session import scratch_path
from ..sources.cache import TableCache
from ..sources.stream_log import doubled_keys, number_rows, ranged_rows
from ..sources.tables import read_csv, table, write_results
from .catalog import query
from .monitor import Monitor, monitor
from .specs import EVENTS, LINES


def order_totals():
    return [F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total_price"),
            F.min("o_orderkey").alias("first_key")]


@query("a1_read_parquet")
def _(spark, folder):
    """A1: parquet scan with pruned columns and a pushed filter."""
    return table(spark, folder, "orders").filter("o_totalprice > 1000").groupBy(
        "o_orderstatus").agg(*order_totals())


@query("a2_write_results")
def _(spark, folder):
    """A2: write once, skip the second write because the results exist, read back."""
    out = table(spark, folder, "orders").groupBy("o_orderpriority").agg(*order_totals())
    path = scratch_path(spark, "results")
    write_results(out, path)
    write_results(out.filter("n < 0"), path)
    return spark.read.parquet(path)


@query("a3_stream_cache")
def _(spark, folder):
    """A3: sizes of the cached stream log; a second request with the same spec reuses the files."""
    first, again = monitor(spark, folder, EVENTS), monitor(spark, folder, EVENTS)
    assert first is again
    return first.sizes.select("stream_id", "n_rows", "boundary")


@query("a3_shared_cache")
def _(spark, folder):
    """A3: the risk table of a stream that another session has published; nothing is built again."""
    root = scratch_path(spark, "cache")
    other = spark.newSession()
    there = Monitor(table(other, folder, EVENTS.table), EVENTS, TableCache(other, root))
    there.risk.limit(1).collect()
    here = Monitor(table(spark, folder, EVENTS.table), EVENTS, TableCache(spark, root))
    out = here.risk.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("window_idx").alias("last_window"))
    return out.withColumn("n_built", F.lit(len(here.cache.built)))


@query("a4_csv")
def _(spark, folder):
    """A4: delimited text with a decimal comma, projected while reading."""
    path = scratch_path(spark, "csv")
    table(spark, folder, "events").select(
        "event_id", "event_type", "user_id",
        F.regexp_replace(F.col("value").cast("string"), "\\.", ",").alias("value")).write.option(
        "header", True).option("sep", ";").csv(path)
    back = read_csv(spark, path, ["value"], sep=";", decimal=",", keep=["event_type", "value"])
    return back.groupBy("event_type").agg(F.count("value").alias("n"),
                                          F.sum("value").alias("total"))


@query("a5_stream_validation")
def _(spark, folder):
    """A5: rows out of strict time order and rows with missing numbers, per stream."""
    rows = table(spark, folder, "events").select(
        F.expr(EVENTS.stream).alias("stream_id"), "event_id", "ts", "value")
    numbered = number_rows(rows, ["stream_id"], ["event_id"], "validation")
    return prep.stream_violations(numbered, ["value"])


@query("a5_doubled_keys")
def _(spark, folder):
    """Rows that have the time of the row before them, per stream, also across range partitions."""
    rows = table(spark, folder, "lineitem").select(F.expr(LINES.stream).alias("stream_id"), "l_shipdate")
    return doubled_keys(ranged_rows(rows, ["stream_id"], ["l_shipdate"], "doubled"), ["stream_id"], ["l_shipdate"])


@query("a6_long_enough")
def _(spark, folder):
    """Enough rows and windows for one origin with a whole horizon."""
    sizes = table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("stream_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return prep.long_enough(sizes, 25, 25, 20)


@query("a7_sentinel")
def _(spark, folder):
    """Drop rows with a sentinel or missing value in a retained column."""
    kept = prep.drop_sentinel(table(spark, folder, "lineitem"), ["l_discount", "l_tax"], 0.0)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                            F.avg("l_discount").alias("mean_discount"))


@query("a8_chronology")
def _(spark, folder):
    """Rows of a newest-first archive renumbered with a documented tie-break."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("stream_id"), "o_orderkey",
        (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("_age"))
    return number_rows(rows, ["stream_id"], ["_age", "o_orderkey"], "chronology").drop("_age")


@query("a9_window_rule")
def _(spark, folder):
    """Window size and thinning from the row count, or a refusal with its reason."""
    one = table(spark, folder, "lineitem")
    parts = {"returnflag": "l_returnflag", "suppkey": "cast(l_suppkey as string)",
             "quantity": "cast(cast(l_quantity as bigint) as string)", "all": "'all'"}
    listed = F.array(*[F.concat(F.lit(k + ":"), F.expr(v)) for k, v in parts.items()])
    sizes = one.select(F.explode(listed).alias("stream_id")).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_rows"))
    # 0 stands for "refused" so that the columns stay whole numbers.
    return prep.window_rule(sizes).fillna(0, ["window_size", "keep_every"])


@query("a10_thin")
def _(spark, folder):
    """A10: uniform, order-preserving thinning."""
    rows = monitor(spark, folder, EVENTS).rows
    return prep.thin(rows, 7).select("stream_id", "row_idx", "y")


@query("a11_encode")
def _(spark, folder):
    """Category codes in sorted order."""
    coded = prep.encode_category(table(spark, folder, "orders"), "o_orderpriority", "code")
    return coded.groupBy("o_orderpriority", "code").agg(F.count(F.lit(1)).alias("n"))


@query("a12_threshold_target")
def _(spark, folder):
    """Binary target from a limit."""
    rows = table(spark, folder, "orders").withColumn(
        "target", prep.threshold_target(F.col("o_totalprice"), 250000.0))
    return rows.groupBy("o_orderstatus").agg(F.sum("target").alias("n_high"),
                                             F.count(F.lit(1)).alias("n"))


@query("a13_remaining_life")
def _(spark, folder):
    """Cycles left until the last one of the unit."""
    rows = table(spark, folder, "events").select("user_id", "event_id")
    return prep.remaining_life(rows, "user_id", "event_id")


@query("a14_array_moments")
def _(spark, folder):
    """Row-wise mean and spread of an array."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    mean, std = prep.array_moments(v)
    return table(spark, folder, "embeddings").select("vec_id", mean.alias("mean"), std.alias("std"))


@query("a15_concat")
def _(spark, folder):
    """Batches concatenated in acquisition order."""
    e = table(spark, folder, "events").select("event_type", "value")
    parts = {i: e.filter(F.col("event_type") == t)
             for i, t in enumerate(("error", "click", "purchase", "view", "signup"))}
    return prep.concat_batches(parts).groupBy("batch", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("a16_target_screen")
def _(spark, folder):
    """The least trivially solvable admissible target."""
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_extendedprice") > 50000).cast("int").alias("expensive"),
        (F.col("l_tax") > 0.079).cast("int").alias("taxed"),
        (F.col("l_quantity") > 49.5).cast("int").alias("bulk"),
        "l_quantity", "l_discount", "l_extendedprice")
    return prep.target_screen(rows, ["returned", "expensive", "taxed", "bulk"],
                              ["l_quantity", "l_discount", "l_extendedprice"])


@query("a17_text_hashing")
def _(spark, folder):
    """One- and two-word grams of the whole text hashed to 512 buckets, unit length."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\w\w+", gaps=False,
                           toLowercase=True).transform(docs)
    pairs = NGram(n=2, inputCol="w", outputCol="p").transform(words)
    grams = pairs.select("doc_id", F.concat("w", "p").alias("g"))
    tf = HashingTF(numFeatures=512, inputCol="g", outputCol="tf").transform(grams)
    unit = Normalizer(p=2.0, inputCol="tf", outputCol="v").transform(tf)
    from pyspark.ml.functions import vector_to_array

    return unit.select("doc_id", F.size("g").alias("n_grams"),
                       vector_to_array("v").alias("vector"))


@query("a18_prevalence")
def _(spark, folder):
    """Class share by year and the largest fall and rise."""
    rows = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"),
                                                 "o_orderstatus")
    return prep.prevalence(rows, "year", "o_orderstatus")


@query("a19_accuracy_drop")
def _(spark, folder):
    """Accuracy of the frozen scorer before and after deployment."""
    return prep.accuracy_drop(monitor(spark, folder, LINES).rows)


@query("w1_sliding_windows")
def _(spark, folder):
    """Overlapping count windows; partial ones are dropped."""
    m = monitor(spark, folder, EVENTS)
    sizes = m.sizes.withColumn("n_dep", F.col("n_rows") - F.col("boundary"))
    rows = m.rows.filter("segment = 'dep'").select("stream_id", "seg_row", "y")
    out = windows.sliding_windows(rows, sizes, 20, 8, row="seg_row", n_rows="n_dep")
    return out.groupBy("stream_id", "window_idx").agg(
        F.count(F.lit(1)).alias("n"), F.min("seg_row").alias("first_row"),
        F.avg("y").alias("mean_y"))


@query("w2_window_count")
def _(spark, folder):
    """Number of complete windows for several sizes and strides."""
    m = monitor(spark, folder, EVENTS)
    return m.sizes.select("stream_id", *[
        windows.window_count(F.col("n_rows"), s, k).alias(f"n_{s}_{k}")
        for s, k in ((20, 20), (20, 8), (100, 7))])


@query("w3_deployment_split")
def _(spark, folder):
    """Boundary snapped to whole windows, and rows re-indexed per segment."""
    rows = monitor(spark, folder, LINES).rows
    return rows.groupBy("stream_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"),
        F.max("seg_row").alias("last_seg_row"), F.max("window_idx").alias("last_window"),
        F.count("window_idx").alias("n_in_windows"))


@query("w4_head_rows")
def _(spark, folder):
    """The first rows of every stream, and the risk of its first windows."""
    m = monitor(spark, folder, EVENTS)
    rows = windows.head_rows(m.rows, 500).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("total_y"))
    head = windows.head_windows(m.risk, 10).groupBy("stream_id").agg(
        F.avg("risk").alias("mean_risk"))
    return rows.join(head, "stream_id")


@query("w5_row_numbers")
def _(spark, folder):
    """Dense row numbers of one huge stream, without a single-task sort."""
    rows = table(spark, folder, "events").select(F.lit("all").alias("stream_id"), "ts", "event_id")
    return number_rows(rows, ["stream_id"], ["ts", "event_id"], "numbers").select(
        "event_id", "row_idx")


@query("l1_zero_one")
def _(spark, folder):
    """L1: zero-one loss per window."""
    m = monitor(spark, folder, LINES)
    return m.deployment.groupBy("stream_id", "window_idx").agg(
        F.sum(rk.zero_one_loss(F.col("y"), F.col("y_pred"))).alias("errors"))


@query("l2_brier")
def _(spark, folder):
    """L2: squared error of the predicted probability of one class, per window."""
    m = monitor(spark, folder, LINES)
    loss = rk.brier_loss((F.col("y") == 2).cast("double"), F.col("proba").getItem(2))
    return m.deployment.groupBy("stream_id", "window_idx").agg(F.avg(loss).alias("brier"))


@query("l3_bounded_error")
def _(spark, folder):
    """L3: absolute error in units of the frozen target spread, cut at 1."""
    m = monitor(spark, folder, EVENTS)
    return m.deployment.select("stream_id", "row_idx", "scale", "y_pred", "loss")


@query("l4_window_risk")
def _(spark, folder):
    """L4: mean loss per window of both segments."""
    return monitor(spark, folder, EVENTS).all_risk.select("segment", "stream_id", "window_idx",
                                                          "risk")


@query("l5_threshold")
def _(spark, folder):
    """Frozen risk reference and the threshold."""
    m = monitor(spark, folder, EVENTS)
    return m.reference_risk.join(m.eps, "stream_id")


@query("l6_rethreshold")
def _(spark, folder):
    """Threshold at several margins, with the cap at 1 applied last."""
    m = monitor(spark, folder, EVENTS)
    return rk.rethreshold(m.reference_risk, 0.75, {"m02": 0.02, "m20": 0.2, "m90": 0.9})
