import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.operators import geometry, reference, risk, state

REF = "stream_id string, risk_mean double"


def feedback(spark, table, delay, k=5):
    ref = spark.createDataFrame([("a", .2)], REF)
    out = state.feedback_block(table, ref, delay, k).toPandas().sort_values("window_idx")
    return out.set_index("window_idx")


@pytest.mark.parametrize("delay", [1, 2, 5])
def test_nothing_is_known_before_the_delay(spark, risk_table, delay):
    rng = np.random.default_rng(2)
    out = feedback(spark, risk_table({"a": list(rng.random(12))}), delay)
    assert (out.loc[:delay - 1].drop(columns="stream_id") == 0).all().all()
    assert (out.loc[delay:, "fb_available"] == 1).all()


def test_known_risks_follow_the_delay(spark, risk_table):
    table = risk_table({"a": [.1, .2, .3, .4, .5]})
    for delay, n in ((1, 3), (2, 2)):
        known = {r["window_idx"]: r["n_known"]
                 for r in state.matured_risks(table, delay).collect()}
        assert known[3] == n and known[0] == 0
    with pytest.raises(ValueError):
        state.matured_risks(table, -1)


def test_feedback_matches_plain_numpy_with_gaps(spark, risk_table):
    """Unknown risks are skipped however long the gap is."""
    rng = np.random.default_rng(3)
    vals = [float(v) for v in rng.random(40)]
    for i in (*range(10, 22), 30):
        vals[i] = None
    out = feedback(spark, risk_table({"a": vals}), 1)
    for t in range(40):
        known = np.array([v for v in vals[:t] if v is not None])
        row = out.loc[t]
        if known.size == 0:
            assert row["fb_available"] == 0
            continue
        r = known[-5:]
        assert row["fb_n_matured"] == known.size
        assert row["fb_risk_last"] == known[-1]
        assert row["fb_risk_mean"] == pytest.approx(r.mean())
        assert row["fb_risk_std"] == pytest.approx(r.std())
        assert row["fb_risk_delta"] == pytest.approx(known[-1] - known[-2] if known.size > 1 else 0)
        slopes = [(r[j] - r[i]) / (j - i) for i in range(len(r)) for j in range(i + 1, len(r))]
        assert row["fb_risk_slope"] == pytest.approx(np.median(slopes) if slopes else 0)
        if r.size >= 3:
            s = np.sign(np.diff(r))
            s = s[s != 0]
            assert row["fb_sign_changes"] == (s[1:] != s[:-1]).sum()
            run = 0
            for v in np.diff(r)[::-1]:
                if v <= 0:
                    break
                run += 1
            assert row["fb_increasing_run"] == run
        else:
            assert row["fb_sign_changes"] == 0 and row["fb_increasing_run"] == 0


def test_truncation_leaves_earlier_states_alone(spark, risk_table):
    rng = np.random.default_rng(4)
    vals = list(rng.random(30))
    full = feedback(spark, risk_table({"a": vals}), 2)
    part = feedback(spark, risk_table({"a": vals[:18]}), 2)
    for c in part.columns.drop("stream_id"):
        np.testing.assert_allclose(full.loc[:17, c], part[c], atol=1e-9)


def test_volatility_excludes_the_current_window(spark):
    v = [1., 5., 2., 8., 3., 9., 4.]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)],
                               "stream_id string, window_idx bigint, f double")
    out = state.volatility(df, {"vol": "f"}, {"trend": "f"}).toPandas().set_index("window_idx")
    for t in range(len(v)):
        past = np.array(v[max(0, t - 5):t])
        assert out.loc[t, "vol"] == pytest.approx(past.std() if past.size >= 2 else 0)
        assert out.loc[t, "trend"] == pytest.approx(past[-1] - past[0] if past.size >= 2 else 0)


def test_interventions_as_of(spark, risk_table):
    grid = risk_table({"a": [0.1] * 8, "b": [0.1] * 3})
    acts = spark.createDataFrame([("a", 2, 1, .5, .1), ("a", 2, 2, .7, .2), ("a", 6, 1, .9, .3)],
                                 "stream_id string, window_idx bigint, seq int, magnitude double,"
                                 " risk_delta double")
    out = state.adaptation_block(grid, acts).toPandas().set_index(["stream_id", "window_idx"])
    since, n = out["adapt_windows_since_update"], out["adapt_n_updates"]
    assert [since["a", t] for t in range(8)] == [0, 1, 0, 1, 2, 3, 0, 1]
    assert [n["a", t] for t in range(8)] == [0, 0, 2, 2, 2, 2, 3, 3]
    assert out.loc[("a", 4), "adapt_last_magnitude"] == .7
    assert out.loc[("b", 2), "adapt_ever_updated"] == 0
    assert out.loc[("a", 7), "adapt_update_rate"] == pytest.approx(3 / 7)


def test_context_of_an_integer_clock_has_no_calendar(spark):
    w = spark.createDataFrame([("a", 3, 17)], "stream_id string, window_idx bigint, t_start bigint")
    row = state.context_block(w).first().asDict()
    assert row["ctx_deployment_age"] == 3 and row["ctx_hour_cos"] == 0 and row["ctx_regime"] == 0


def test_block_choice_and_unknown_blocks(spark):
    s = spark.createDataFrame([("a", 0, 1., 2.)],
                              "stream_id string, window_idx bigint, fb_x double, ctx_y double")
    assert state.select_blocks(s, ["fb"]).columns == ["stream_id", "window_idx", "fb_x"]
    with pytest.raises(ValueError):
        state.select_blocks(s, ["nope"])
    with pytest.raises(ValueError):
        state.assert_same_schema({"p": s, "q": s.drop("fb_x")})


def test_threshold_rules(spark):
    ref = spark.createDataFrame([("a", .5, .6, .75, .8, .9, .97)],
                                "stream_id string, q50 double, q60 double, q75 double, q80 double,"
                                " q90 double, q95 double")
    assert risk.threshold(ref, .75, .05).first()["eps"] == pytest.approx(.8)
    assert risk.threshold(ref, .95, .05).first()["eps"] == 1.0
    for q, m in ((0.0, .1), (1.0, .1), (.75, -.1)):
        with pytest.raises(ValueError):
            risk.threshold(ref, q, m)
    with pytest.raises(KeyError):
        risk.threshold(ref, .33, .1)


def test_window_risk_is_unknown_with_a_missing_loss(spark):
    df = spark.createDataFrame([(1, .2), (1, None), (2, .2), (2, .4)], "w int, loss double")
    got = {r["w"]: r["r"] for r in df.groupBy("w").agg(
        risk.window_risk(F.col("loss")).alias("r")).collect()}
    assert got[1] is None and got[2] == pytest.approx(.3)
    bad = spark.createDataFrame([(1, 1.5)], "w int, loss double")
    with pytest.raises(Exception, match="outside"):
        bad.groupBy("w").agg(risk.window_risk(F.col("loss")).alias("r")).collect()


def test_geometry_matches_direct_formulas(spark):
    """All sample-based statistics of one window against plain numpy, ties included."""
    rng = np.random.default_rng(5)
    pre = np.round(rng.normal(size=(300, 3)), 1)
    win = np.round(rng.normal(loc=.4, size=(2, 30, 3)), 1)
    rows = spark.createDataFrame(
        [("a", i, 300, [float(v) for v in r]) for i, r in enumerate(pre)],
        "stream_id string, row_idx bigint, boundary bigint, x array<double>")
    dep = spark.createDataFrame(
        [("a", w, 30 * w + i, [float(v) for v in r]) for w in range(2)
         for i, r in enumerate(win[w])],
        "stream_id string, window_idx bigint, seg_row bigint, x array<double>")
    feats = reference.feature_reference(rows, 3)
    sample = reference.reference_sample(rows, 200)
    g = geometry.fit_geometry(sample, feats, rows, 3, 3)
    sizes = spark.createDataFrame([("a", 2)], "stream_id string, n_windows bigint")
    out = geometry.window_geometry(dep, sample, feats, g, sizes, 3, 3).toPandas().set_index("window_idx")
    mu, sd = pre.mean(0), pre.std(0)
    f = feats.toPandas().sort_values("feature")
    np.testing.assert_allclose(f["mean"], mu)
    np.testing.assert_allclose(f["std"], sd)
    picked = sample.toPandas().sort_values("rank")
    assert len(picked) == 200
    b = (np.array(picked["x"].tolist()) - mu) / sd
    d2 = ((b[:, None] - b[None]) ** 2).sum(-1)
    bw = np.sqrt(np.median(d2[np.triu_indices(200, 1)]) / 2)
    assert g.first()["bandwidth"] == pytest.approx(bw)
    for w in range(2):
        z = (win[w] - mu) / sd
        row = out.loc[w]
        near = np.sort(np.sqrt(((z[:, None] - b[None]) ** 2).sum(-1)), axis=1)[:, :10].mean(1)
        assert row["rep_knn_dist_mean"] == pytest.approx(near.mean())
        assert row["rep_knn_dist_max"] == pytest.approx(near.max())

        def k(p, q):
            return np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / (2 * bw ** 2))
        kaa, kbb = k(z, z), k(b, b)
        mmd = ((kaa.sum() - 30) / (30 * 29) + (kbb.sum() - 200) / (200 * 199) - 2 * k(z, b).mean())
        assert row["dist_mmd2"] == pytest.approx(mmd, abs=1e-9)
        ks, w1, en = [], [], []
        for j in range(3):
            grid = np.unique(np.r_[z[:, j], b[:, j]])
            fa = (z[:, j][None] <= grid[:, None]).mean(1)
            fb = (b[:, j][None] <= grid[:, None]).mean(1)
            ks.append(np.abs(fa - fb).max())
            w1.append((np.diff(grid) * np.abs(fa - fb)[:-1]).sum())
            en.append(np.sqrt(2 * (np.diff(grid) * (fa - fb)[:-1] ** 2).sum()))
        assert row["dist_ks_max"] == pytest.approx(max(ks))
        assert row["dist_wasserstein_mean"] == pytest.approx(np.mean(w1))
        assert row["dist_energy"] == pytest.approx(np.mean(en))
        cov = np.cov(z, rowvar=False)
        assert row["rep_cov_trace"] == pytest.approx(np.trace(cov))
        assert row["rep_cov_logdet"] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-6)
        assert row["rep_pca_energy"] == pytest.approx(1.0)      # all three axes kept


def test_psi_cut_points_and_constant_feature(spark):
    rows = spark.createDataFrame([("a", i, 100, [float(i % 4), 7.0]) for i in range(100)],
                                 "stream_id string, row_idx bigint, boundary bigint,"
                                 " x array<double>")
    f = {r["feature"]: r for r in reference.feature_reference(rows, 2).collect()}
    edges = np.unique(np.quantile(np.arange(100) % 4, np.linspace(0, 1, 11)))
    assert f[0]["cuts"] == list(edges[1:-1]) and f[0]["n_bins"] == len(edges) - 1
    assert f[1]["cuts"] == [] and f[1]["n_bins"] == 1 and f[1]["std"] == 1.0
