"""The one-pass state blocks equal the blocks computed one by one."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.operators import geometry
from stillvalid.operators import state as st
from stillvalid.plans.monitor import Monitor
from stillvalid.sources.stream_log import StreamSpec

KEY = ["stream_id", "window_idx"]


def values(df):
    rows = {(r["stream_id"], r["window_idx"]): r.asDict() for r in df.collect()}
    return {k: {c: np.nan if v is None else v for c, v in r.items() if c not in KEY} for k, r in rows.items()}


def same(got, want):
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        for c, v in row.items():
            assert np.allclose(got[k][c], v, atol=1e-9, equal_nan=True), (k, c, got[k][c], v)


def log(spark, classes):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b"):
        for i in range(150):
            x = [float(v) for v in rng.normal(size=2)] + [float(rng.integers(0, 3)), 4.0]
            x[rng.integers(0, 3)] = None if rng.random() < 0.1 else x[0]
            rows.append((s, i, *x, str(rng.integers(0, 4)), float(rng.integers(0, 3)) if classes else float(rng.normal())))
    return spark.createDataFrame(rows, "s string, i long, a double, b double, c double, d double, k string, y double").repartition(3)


SPEC = dict(name="t", table="t", stream="s", order=("i",), time="i", target="y", score_key="k", window=10, pre_fraction=0.4, sample_rows=40)


@pytest.mark.parametrize("classes", [3, 0])
def test_blocks_of_inputs(spark, classes):
    m = Monitor(log(spark, classes), StreamSpec(features=("a", "b", "c", "d"), classes=classes, **SPEC))
    dep, made = m.deployment, m.blocks()
    if classes:
        same(values(made["pred"]), values(st.class_prediction_block(dep, m.reference_behaviour, classes)))
        same(values(made["unc"]), values(st.class_uncertainty_block(dep)))
        same(values(m.row_blocks.select(*KEY, "ece")), values(st.calibration_error(dep)))
    else:
        same(values(made["pred"]), values(st.value_prediction_block(dep)))
        same(values(made["unc"]), values(st.value_uncertainty_block(dep)))
    shape = values(geometry.window_geometry(dep, m.reference_sample, m.reference_features, m.geometry, m.sizes, 4, 4))
    rep = values(st.representation_block(m.embedded(dep), m.embedding_reference))
    dist = values(st.moment_block(dep, m.reference_features))
    same(values(made["rep"]), {k: v | {c: x for c, x in shape[k].items() if c.startswith("rep_")} for k, v in rep.items()})
    same(values(made["dist"]), {k: v | {c: x for c, x in shape[k].items() if c.startswith("dist_")} for k, v in dist.items()})
    # The state table takes the columns of all blocks from the shared tables.
    want = {k: {c: v for b in made.values() for c, v in values(b)[k].items()} for k in rep}
    same({k: {c: v for c, v in r.items() if c in next(iter(want.values()))} for k, r in values(m.states).items()}, want)


def test_blocks_of_a_given_log_with_embedding(spark):
    spec = StreamSpec(y_pred="a", embedding="array(coalesce(a, 0), coalesce(b, 0), y)", **SPEC)
    m = Monitor(log(spark, 0).fillna(0.0), spec)
    made = m.blocks()
    same(values(made["rep"]), values(st.representation_block(m.embedded(m.deployment), m.embedding_reference)))
    same(values(made["pred"]), values(st.value_prediction_block(m.deployment)))


def test_the_shape_needs_sums_only(spark, monkeypatch):
    """No table of whole windows, no distances; and plain sums equal those of the vector aggregate."""
    m = Monitor(log(spark, 3), StreamSpec(features=("a", "b", "c", "d"), classes=3, **SPEC))
    made = values(m.shape_block)
    assert made and not {"windows", "distance_block", "row_blocks"} & vars(m).keys()
    z = m.embedded(m.deployment)
    plan = geometry.second_moments(z, KEY, 4)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "HashAggregate" in plan
    plain = values(geometry.second_moments(z, KEY, 4))
    monkeypatch.setattr(geometry, "PLAIN_SUMS", 0)
    same(plain, values(geometry.second_moments(z, KEY, 4)))


def test_one_shuffle_of_rows(spark):
    m = Monitor(log(spark, 3), StreamSpec(features=("a", "b", "c", "d"), classes=3, **SPEC))
    plan = m._pass.run(m.deployment, m._frozen)._jdf.queryExecution().sparkPlan().toString()
    full = m._pass.run(m.deployment, m._frozen)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "BroadcastHashJoin" in plan      # the rows, and one row per stream
    assert full.count("Exchange hashpartitioning") == 1


def flat(df):
    """Rows by window with arrays as they are, missing values as NaN."""
    def plain(v):
        return [np.nan if u is None else u for u in v] if isinstance(v, list) else np.nan if v is None else v
    return {(r["stream_id"], r["window_idx"]): {c: plain(v) for c, v in r.asDict().items() if c not in KEY} for r in df.collect()}


def test_whole_windows_as_arrays_equal_the_aggregate(spark):
    """In order, in any order, and one by one by Spark's own aggregate; only rows of cut windows are shuffled as rows."""
    from stillvalid.operators import packed
    from stillvalid.operators.fused import WindowPass, _Q

    m = Monitor(log(spark, 3), StreamSpec(features=("a", "b", "c", "d"), classes=3, **SPEC))
    rows = m.deployment.coalesce(1)
    want = flat(WindowPass(3, 4).run(rows, m._frozen))
    for some in (rows, rows.repartition(5, "row_idx"), rows.orderBy("seg_row")):
        got = flat(WindowPass(3, 4, window=10).run(some, m._frozen))
        assert set(next(iter(got.values()))) == set(next(iter(want.values())))
        same(got, want)
    # With an embedding that has gaps.
    with_gaps = rows.withColumn("embedding", F.array(F.get("x", F.lit(0)), F.lit(1.5), F.get("x", F.lit(1))))
    same(flat(WindowPass(3, 4, 3, 10).run(with_gaps, m._frozen)), flat(WindowPass(3, 4, 3).run(with_gaps, m._frozen)))
    w = packed.Windows(3, 4, 0, _Q, 10)
    assert {n for n, _ in w.fields} | set(KEY) == set(WindowPass(3, 4, window=10).run(rows, m._frozen).columns)


def test_distinct_rows_meet_the_sample_once(monkeypatch):
    rng = np.random.default_rng(3)
    z, sample = rng.integers(0, 3, (8, 10, 2)).astype(float), rng.normal(size=(50, 2))
    met = []
    plain = geometry.squared_distances
    monkeypatch.setattr(geometry, "squared_distances", lambda a, b: met.append(len(a)) or plain(a, b))
    got = geometry.compare_windows(z, sample, 1.0, 0.2)
    assert sum(met[:-1]) <= 9       # the last call is that of the windows with themselves
    d2 = ((z[:, :, None] - sample) ** 2).sum(-1)
    near = np.sqrt(np.sort(d2, axis=2)[:, :, :10]).mean(2)
    own = np.exp(-0.5 * ((z[:, :, None] - z[:, None]) ** 2).sum(-1))
    inner = (own.sum((1, 2)) - 10) / 90
    assert np.allclose(got["rep_knn_dist_mean"], near.mean(1)) and np.allclose(got["rep_knn_dist_max"], near.max(1))
    assert np.allclose(got["dist_mmd2"], inner + 0.2 - 2 * np.exp(-0.5 * d2).mean((1, 2)))
