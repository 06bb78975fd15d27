"""Boosted trees: histogram splits, growth, truncations and a saved model, against direct formulas."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.operators import boosting
from stillvalid.plans.monitor import Monitor
from stillvalid.sources.stream_log import StreamSpec


def table(spark, n=400, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 3)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 4) + rng.integers(0, 3, n)) % classes if classes else x[:, 0] ** 2 - x[:, 1] + rng.normal(size=n)
    rows = [([None if (i + j) % 29 == 0 else float(v) for j, v in enumerate(r)], float(t), i) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "x array<double>, y double, row long").repartition(3), rows


def grown(rows, classes, s, edges):
    """The same trees, grown in memory without histograms."""
    x = np.array([[np.nan if v is None else v for v in r[0]] for r in rows])
    bins, y, row = boosting.binned(x, edges), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    n = len(y)
    base = np.log([((y == k).sum() + 1e-9 * n) / n for k in range(classes)]) if classes else np.array([y.mean()])
    scores, rng = np.tile(base, (n, 1)), np.random.default_rng(s.seed)
    for r in range(s.rounds):
        allowed = set(rng.permutation(x.shape[1])[:max(1, int(x.shape[1] * s.feature_share))].tolist())
        used = boosting._drawn(row, r, s.row_share, s.seed)
        g, h = boosting.gradients(scores, y, classes)
        step = np.zeros_like(scores)
        for k in range(len(base)):
            def split(mask, depth, k=k):
                fit = mask & used
                def worth(m):
                    return g[m, k].sum() ** 2 / (h[m, k].sum() + s.penalty)
                best = (0.0, None)
                if depth < s.depth:
                    for f in sorted(allowed):
                        for c in range(s.bins + 1):
                            left, right = fit & (bins[:, f] <= c), fit & (bins[:, f] > c)
                            if left.any() and right.any():
                                gain = round(worth(left) + worth(right) - worth(fit), boosting.DIGITS)
                                if gain > best[0]:
                                    best = (gain, (f, c))
                if best[1] is None:
                    step[mask, k] = -s.rate * g[fit, k].sum() / (h[fit, k].sum() + s.penalty)
                    return
                f, c = best[1]
                split(mask & (bins[:, f] <= c), depth + 1)
                split(mask & (bins[:, f] > c), depth + 1)
            split(np.ones(n, bool), 0)
        scores += step
    return scores


@pytest.mark.parametrize("classes", [3, 2, 0])
def test_trees_equal_trees_grown_in_memory(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df, rows = table(spark, classes=classes)
    s = boosting.Settings(rounds=5, depth=3, rate=0.3, row_share=0.8, feature_share=0.7, bins=12)
    edges = boosting.quantile_edges(df, s.bins)
    model = boosting.fit(df, classes=classes, settings=s, edges=edges)
    got = {r.row: r for r in boosting.score(df, model, leaves=True).collect()}
    want = grown(rows, classes, s, edges)
    assert np.allclose([got[i].raw for i in range(len(rows))], want, atol=1e-8)
    if classes:
        p = boosting.softmax(want)
        assert np.allclose([got[i].proba for i in range(len(rows))], p) and [got[i].y_pred for i in range(len(rows))] == p.argmax(1).tolist()
        assert np.allclose(got[0].members[-1], p[0]) and len(got[0].members) == 5
    sums = boosting.leaf_sums(boosting.score(df, model, leaves=True), model).collect()
    assert all(np.allclose(r.raw, r.leaf_sum) and len(r.embedding) == 32 for r in sums)


def test_saved_model_is_the_same(spark, tmp_path):
    df, _ = table(spark)
    model = boosting.fit(df, classes=3, settings=boosting.Settings(rounds=3, depth=2))
    model.save(spark, str(tmp_path))
    again = boosting.Boosted.load(spark, str(tmp_path))
    assert again.settings == model.settings and again.classes == 3
    for a, b in ((model.feature, again.feature), (model.cut, again.cut), (model.value, again.value), (model.base, again.base)):
        assert np.array_equal(a, b)
    nodes = model.nodes(spark)
    assert nodes.filter("node >= 3").count() == 3 * 3 * 4 and nodes.filter("feature >= 0 and cut > 0 and at is null").isEmpty()


def test_refusals(spark):
    df, _ = table(spark)
    with pytest.raises(ValueError, match="rows to fit"):
        boosting.fit(df.limit(10), classes=3)
    with pytest.raises(ValueError, match="one class"):
        boosting.fit(df.withColumn("y", F.lit(1.0)), classes=3)


def test_boosted_scorer_in_a_monitor(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, *map(float, rng.normal(size=2)), int(rng.integers(0, 3))) for s in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "s string, i long, u double, v double, y int")
    spec = StreamSpec(name="t", table="t", stream="s", order=("i",), time="i", target="y", score_key="'k'", features=("u", "v"),
                      classes=3, window=20, pre_fraction=0.4, scorer="boosted", rounds=4, depth=2)
    m = Monitor(df, spec)
    states = m.states.collect()
    assert len(states) == 2 * 6 and {"rep_centroid_shift", "unc_epistemic", "pred_msp_mean"} <= set(m.states.columns)
    # Deployment rows never reach the trainer.
    poisoned = Monitor(df.withColumn("y", F.when(F.col("i") >= 80, (F.col("y") + 1) % 3).otherwise(F.col("y"))), spec)
    assert np.array_equal(m.scorer_model.value, poisoned.scorer_model.value)
    with pytest.raises(ValueError, match="needs features"):
        Monitor(df, StreamSpec(name="t", table="t", stream="s", order=("i",), time="i", target="y", score_key="'k'", classes=3, scorer="boosted"))


def test_a_fit_is_a_few_jobs_and_tasks_add_up_all_rows(spark, monkeypatch):
    df, _ = table(spark, n=900)
    s = boosting.Settings(rounds=6, depth=3, bins=12)
    edges = boosting.quantile_edges(df, s.bins)
    one = boosting.fit(df, classes=3, settings=s, edges=edges)
    monkeypatch.setattr(boosting, "ROWS", 200)      # 4 tasks
    spark.sparkContext.setJobGroup("boosted-jobs", "")
    many = boosting.fit(df, classes=3, settings=s, edges=edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted-jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < s.rounds * s.depth        # not one for each level
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and np.allclose(one.value, many.value, atol=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 4, 6, 7])
def test_masks_find_the_leaves_of_a_descent(depth):
    rng, inner = np.random.default_rng(depth), (1 << depth) - 1
    feature = rng.integers(-1, 3, (5, 2, inner))
    feature[:, :, 0] = 1
    cut = rng.integers(0, 12, feature.shape)
    model = boosting.Boosted(2, boosting.Settings(rounds=5, depth=depth), [np.arange(11.0)] * 3, np.array([0.5, -0.5]), feature, cut,
                             rng.normal(size=(5, 2, inner + 1)))
    bins = rng.integers(0, 13, (2 * boosting.TILE + 7, 3)).astype(np.uint8)
    want = np.stack([[boosting.descend(bins, feature[r, k], cut[r, k], depth) for k in range(2)] for r in range(5)]).transpose(2, 0, 1)
    assert np.array_equal(model.leaves(bins), want) and np.array_equal(model.leaves(bins, 2, 4), want[:, 2:4])
    scores = np.tile(model.base, (len(bins), 1))
    for r, k in np.ndindex(5, 2):
        scores[:, k] += model.value[r, k][want[:, r, k]]
    assert np.array_equal(model.add(np.tile(model.base, (len(bins), 1)), bins, 0, 5), scores)
    assert np.allclose(boosting.leaf_totals(want.reshape(len(bins), -1), model), scores)


def test_copies_of_a_row_are_one_cell(spark, monkeypatch):
    """A task keeps distinct rows with counts, and a cell of many rows is dealt over all tasks."""
    df, rows = table(spark, n=600)
    copies = df.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), "row").withColumn("row", F.col("row") * 4 + F.col("i"))
    many = copies.unionByName(df.limit(1).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(2_000))).alias("i"), "row").withColumn(
        "row", F.col("i") + 10_000)).select("x", "y", "row")
    s = boosting.Settings(rounds=3, depth=2, bins=12)
    edges = boosting.quantile_edges(many, s.bins)
    cells = many.withColumn("y", F.col("y").cast("double")).mapInArrow(boosting._prepare(edges), "cell binary, row long")
    bins, y, row, place = boosting._cells(iter(cells.toArrow().to_batches()), 3)
    assert len(row) == 4_401 and len(bins) == cells.select("cell").distinct().count() < 600
    drawn = boosting._drawn_of(place, row, len(bins), 1, s)
    assert drawn.sum() == boosting._drawn(row, 1, s.row_share, s.seed).sum()
    sizes = [r["count"] for r in boosting.dealt(cells, 4_401, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2_000
    one = boosting.fit(many, classes=3, settings=s, edges=edges)
    monkeypatch.setattr(boosting, "ROWS", 1_000)
    more = boosting.fit(many, classes=3, settings=s, edges=edges)
    assert (one.feature == more.feature).all() and np.allclose(one.value, more.value, atol=1e-9)
    all_rows = [(r.x, r.y, r.row) for r in many.collect()]
    want = grown(all_rows, 3, s, edges)
    got = {r.row: r.raw for r in boosting.score(many, more).collect()}
    assert np.allclose([got[r[2]] for r in all_rows], want, atol=1e-8)


def test_leaf_sums_need_no_leaves_outside_the_scorer(spark):
    df, _ = table(spark)
    model = boosting.fit(df, classes=3, settings=boosting.Settings(rounds=4, depth=2))
    got = boosting.score(df, model, embedding=False, sums=True)
    assert not {"leaf", "embedding"} & set(got.columns)
    assert all(np.allclose(r.raw, r.leaf_sum) for r in got.collect())
