import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.functions import pvalues as pv
from stillvalid.operators import compare, forecast, learned, metrics, survival

ORIGINS = "stream_id string, origin bigint, y_tilde int, event int"


def origins(spark, y, e):
    return spark.createDataFrame([("a" if i % 2 else "b", i, int(a), int(b))
                                  for i, (a, b) in enumerate(zip(y, e))], ORIGINS)


def curves(spark, s, y, e, method="m"):
    rows = [("a" if i % 2 else "b", i, int(a), int(b), [float(v) for v in c], method)
            for i, (c, a, b) in enumerate(zip(s, y, e))]
    return spark.createDataFrame(rows, ORIGINS + ", surv array<double>, method string")


def test_kaplan_meier_golden(spark):
    got = survival.kaplan_meier(origins(spark, [1, 2, 3, 3], [1, 1, 0, 0]), 3).first()["surv"]
    assert got == pytest.approx([.75, .75 * 2 / 3, .75 * 2 / 3])


def test_hazards_and_readouts(spark):
    df = spark.createDataFrame([("a", 0, "m", [.1, .2, .5, .9])],
                               "stream_id string, origin bigint, method string, h array<double>")
    s = df.withColumn("surv", survival.hazard_to_survival(F.col("h")))
    row = survival.horizon_readouts(s, 4).first()
    surv = np.cumprod(1 - np.array([.1, .2, .5, .9]))
    assert row["median_horizon"] == 3
    assert row["expected_horizon"] == pytest.approx(surv.sum())
    assert row["lower_horizon"] == 1
    bad = spark.createDataFrame([([1.5],)], "h array<double>")
    with pytest.raises(Exception, match="outside"):
        bad.select(survival.hazard_to_survival(F.col("h"))).collect()


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(6)
    n, h = 120, 8
    s = np.sort(np.round(rng.random((n, h)), 1), axis=1)[:, ::-1]
    return s, rng.integers(1, h + 1, n), (rng.random(n) < .7).astype(int), h


def test_brier_weights(spark, sample):
    s, y, e, h = sample
    g, cur = [], 1.0
    for t in range(1, h + 1):
        r = (y >= t).sum()
        cur *= 1 - ((y == t) & (e == 0)).sum() / r if r else 1
        g.append(max(cur, 1e-8))
    want = []
    for t in range(1, h + 1):
        terms = []
        for i in range(len(y)):
            if y[i] <= t and e[i]:
                terms.append(s[i, t - 1] ** 2 / g[max(y[i] - 2, 0)])
            elif y[i] > t:
                terms.append((1 - s[i, t - 1]) ** 2 / g[t - 1])
        want.append(np.mean(terms))
    c = curves(spark, s, y, e)
    got = metrics.brier_by_horizon(c, origins(spark, y, e), h).toPandas().sort_values("h")
    np.testing.assert_allclose(got["brier"], want)
    ibs = metrics.integrated_brier(metrics.brier_by_horizon(c, origins(spark, y, e), h)).first()
    assert ibs["ipcw_ibs"] == pytest.approx(np.mean(want))


def test_concordance_equals_all_pairs(spark, sample):
    s, y, e, _ = sample
    good, pairs, own = 0.0, 0, {}
    for i in np.flatnonzero(e):
        later = np.flatnonzero(y > y[i])
        if later.size == 0:
            continue
        a, b = s[i, y[i] - 1], s[later, y[i] - 1]
        c = (a < b).sum() + .5 * (a == b).sum()
        own[int(i)] = c / later.size
        good, pairs = good + c, pairs + later.size
    table = curves(spark, s, y, e)
    row = metrics.concordance(table).first()
    assert row["concordance"] == pytest.approx(good / pairs) and row["n_pairs"] == pairs
    got = metrics.concordance_contributions(table).filter("contribution is not null").toPandas()
    assert dict(zip(got.origin, got.contribution)) == pytest.approx(own)


def test_d_calibration_and_p(spark, sample):
    s, y, e, _ = sample
    counts = np.zeros(10)
    for i in range(len(y)):
        v = max(s[i, y[i] - 1], 1e-8)
        if e[i]:
            counts[min(int(v * 10), 9)] += 1
        else:
            edges = np.linspace(0, 1, 11)
            counts += np.clip(np.minimum(edges[1:], v) - edges[:-1], 0, None) / v
    want = ((counts - counts.sum() / 10) ** 2 / (counts.sum() / 10)).sum()
    row = metrics.d_calibration(curves(spark, s, y, e)).first()
    assert row["chi2"] == pytest.approx(want)


def test_calibration_curve(spark, sample):
    s, y, e, _ = sample
    p = 1 - s[:, 3]
    keep = ((y <= 4) & (e == 1)) | (y > 4)
    got = metrics.calibration_curve(curves(spark, s, y, e), 4).toPandas()
    assert got["n"].sum() == keep.sum()
    assert np.average(got["predicted"], weights=got["n"]) == pytest.approx(p[keep].mean())


def test_golden_warning_metrics(spark):
    t = spark.createDataFrame([(3, 4, 1), (9, 1, 0), (5, 6, 1), (7, 2, 0)], "p int, t int, e int")
    row = metrics.horizon_error(t, "p", "t", "e").first()
    assert (row["vhmae"], row["n_uncensored"], row["censoring_rate"]) == (1.0, 2, .5)
    with pytest.raises(Exception, match="undefined"):
        metrics.horizon_error(t.filter("e = 0"), "p", "t", "e").collect()
    v = spark.createDataFrame([(10, 6), (20, None), (None, 3)], "v int, w int")
    assert [r["lead_time"] for r in metrics.lead_time(v, "v", "w").collect()] == [4]
    w = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "w int, v int")
    row = metrics.warning_scores(w, "w", "v").first()
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3)
    assert row["false_per_100"] == pytest.approx(20)


def test_p_values_against_known_numbers():
    assert pv.chi2_sf(16.918977604620448, 9) == pytest.approx(.05, abs=1e-9)
    assert pv.chi2_sf(18.307038053275146, 10) == pytest.approx(.05, abs=1e-9)
    assert pv.normal_cdf(-1.959963984540054) == pytest.approx(.025, abs=1e-12)
    # t = r sqrt((n-2)/(1-r^2)) at the two-sided 5 % point of t with 10 degrees of freedom
    t = 2.2281388519649385
    r = t / np.sqrt(10 + t * t)
    assert pv.correlation_p(r, 12) == pytest.approx(.05, abs=1e-9)
    # all eight differences negative: 1 of 2^8 sign patterns
    assert pv.signed_rank_p(0.0, 8, 0.0, 0, 8, "exact") == pytest.approx(1 / 256)
    assert pv.signed_rank_p(3.0, 4, 0.0, 0, 4) == 1.0 and pv.signed_rank_p(3.0, 9, 0, 0, 0) == 1.0


def test_signed_ranks_and_dominance_against_loops(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.random(60), 1), np.round(rng.random(60), 1)
    df = spark.createDataFrame([("k", "s", i, float(x), float(y))
                                for i, (x, y) in enumerate(zip(a, b))],
                               "k string, stream_id string, origin int, a double, b double")
    delta = np.sign(np.round(a[:, None] - b[None], 9)).mean()
    assert compare.cliffs_delta(df, ["k"]).first()["effect_delta"] == pytest.approx(delta)
    d = np.round(a - b, 9)
    m = np.abs(d)
    rank = np.array([(m < v).sum() + ((m == v).sum() + 1) / 2 for v in m])
    w = rank[d > 0].sum() + rank[d == 0].sum() / 2
    row = compare.signed_ranks(df, ["k"]).first()
    assert row["w_plus"] == pytest.approx(w) and row["n_zero"] == (d == 0).sum()
    _, t = np.unique(m, return_counts=True)
    assert row["tie_sum"] == pytest.approx((t ** 3 - t).sum())


def test_holm(spark):
    df = spark.createDataFrame([("f", "x", .01), ("f", "y", .04), ("f", "z", .03)],
                               "f string, b string, p_raw double")
    got = {r["b"]: (r["p_adjusted"], r["rejected"]) for r in compare.holm(df, ["f"]).collect()}
    assert got["x"] == (pytest.approx(.03), True)
    assert got["z"] == (pytest.approx(.06), False) and got["y"] == (pytest.approx(.06), False)


def test_bootstrap_needs_two_blocks(spark):
    one = spark.createDataFrame([("k", "s0", 1.0), ("k", "s0", 2.0)],
                                "k string, stream_id string, v double")
    row = compare.blocked_bootstrap(one, ["k"], "v", draws=50).first()
    assert row["point"] == 1.5 and row["lo"] is None
    many = spark.createDataFrame([("k", f"s{i % 8}", float(i % 8)) for i in range(80)],
                                 "k string, stream_id string, v double")
    row = compare.blocked_bootstrap(many, ["k"], "v", draws=400).first()
    assert row["lo"] < 3.5 < row["hi"] and row["point"] == pytest.approx(3.5)


def test_cox_recovers_a_known_effect(spark):
    """The fitted coefficient maximises the penalised Efron likelihood (checked on a grid)."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    u = rng.exponential(size=400) / np.exp(.8 * x)
    y = np.clip(np.ceil(u * 6), 1, 10).astype(int)
    e = (u * 6 <= 10).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(y, e, x)],
                               "y_tilde int, event int, x double")
    beta, cumulative = survival.cox_fit(df, ["x"], 10)

    def objective(b):
        w = np.exp(b * x)
        ll = 0.0
        for t in range(1, 11):
            dead, at = (y == t) & (e == 1), y >= t
            d = dead.sum()
            ll += b * x[dead].sum() - sum(
                np.log(w[at].sum() - k / d * w[dead].sum()) for k in range(d))
        return ll / len(x) - .05 * (b * x.std()) ** 2

    grid = np.linspace(beta[0] - .05, beta[0] + .05, 11)
    assert np.argmax([objective(g) for g in grid]) == 5
    assert .5 < beta[0] < .9 and (np.diff(cumulative) >= 0).all()


def test_first_passage_counts_paths(spark):
    rows = [("a", 0, .5, [.1, .6, .2]), ("a", 0, .5, [.4, .4, .4]), ("a", 0, .5, [.5, .5, .7]),
            ("a", 0, .5, [.9, .1, .1])]
    df = spark.createDataFrame(rows, "stream_id string, origin bigint, eps double,"
                                     " path array<double>")
    assert survival.first_passage(df).first()["surv"] == [.75, .5, .25]
    assert survival.first_passage(df, F.lit(.95)).first()["surv"] == [1., 1., 1.]
    assert survival.mean_path(df).first()["pred"] == pytest.approx([.475, .4, .35])


def test_forecasts_against_numpy(spark):
    rng = np.random.default_rng(9)
    hist = [[None if u < .1 else float(v) for u, v in zip(rng.random(20), rng.random(20))]
            for _ in range(12)]
    hist.append([None] * 20)
    rows = [("a", i, h, [.1] * 6, .3) for i, h in enumerate(hist)]
    df = spark.createDataFrame(rows, "stream_id string, origin bigint, risk_hist array<double>,"
                                     " risk_path array<double>, anchor double")
    got = {(r["origin"], r["method"], r["setting"]): (r["level"], r["slope"])
           for r in forecast.candidate_lines(df).collect()}
    for i, h in enumerate(hist):
        known = np.array([v for v in h if v is not None])
        last = known[-1] if known.size else .5
        assert got[i, "persistence", None] == (pytest.approx(last), 0)
        for k in (3, 10):
            t = np.array([v for v in h[-k:] if v is not None])
            want = t.mean() if t.size else last
            assert got[i, "moving_average", k][0] == pytest.approx(want)
            if t.size >= 2 and k == 10:
                sl = np.median([(t[b] - t[a]) / (b - a) for a in range(t.size)
                                for b in range(a + 1, t.size)])
                b0 = np.median(t - sl * np.arange(t.size))
                assert got[i, "theil_sen_trend", k] == (pytest.approx(b0 + sl * (t.size - 1)),
                                                        pytest.approx(sl))
        lvl = None
        for v in known:
            lvl = v if lvl is None else .2 * v + .8 * lvl
        assert got[i, "exponential_smoothing", .2][0] == pytest.approx(last if lvl is None else lvl)
    out = {r["origin"]: r["pred"] for r in forecast.ar_forecasts(df, 2, 4).collect()}
    for i, h in enumerate(hist):
        known = np.array([v for v in h if v is not None])
        if known.size == 0:
            assert out[i] == [.5] * 4
            continue
        x = known - known.mean()
        g = [np.dot(x[:len(x) - k], x[k:]) / len(x) for k in range(3)]
        rho = np.linalg.solve([[g[0], g[1]], [g[1], g[0]]], g[1:])
        buf, want = list(x), []
        for _ in range(4):
            buf.append(rho[0] * buf[-1] + rho[1] * buf[-2])
            want.append(buf[-1] + known.mean())
        assert out[i] == pytest.approx(list(np.clip(want, 0, 1)))


@pytest.mark.parametrize("m,r0,w0", [(1, 5.0, 1.3), (7, 9.0, 9.0), (4000, 5000.0, 3100.0)])
def test_efron_sums_equal_the_loop(m, r0, w0):
    rng = np.random.default_rng(m)
    r1, w1 = rng.normal(size=2) * r0, rng.normal(size=2) * w0
    r2, w2 = np.outer(r1, r1) / r0 + np.eye(2), np.outer(w1, w1) / w0 + np.eye(2)
    first, second = np.zeros(2), np.zeros((2, 2))
    for i in range(m):
        a0, a1, a2 = r0 - i / m * w0, r1 - i / m * w1, r2 - i / m * w2
        first += a1 / a0
        second += a2 / a0 - np.outer(a1, a1) / a0 ** 2
    got = survival.efron_sums(float(m), (r0, r1, r2), (w0, w1, w2))
    np.testing.assert_allclose(got[0], first, rtol=1e-8)
    np.testing.assert_allclose(got[1], second, rtol=1e-7, atol=1e-6)


def test_cox_without_events_has_no_estimate(spark):
    df = spark.createDataFrame([(5, 0, 1.0), (6, 0, 2.0)], "y_tilde bigint, event int, x double")
    with pytest.raises(survival.EstimationFailed, match="no event"):
        survival.cox_fit(df, ["x"], 10)


def test_levinson_solves_each_row_alone():
    from stillvalid.operators.forecast import levinson, yule_walker_paths

    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 40))
    gamma = np.stack([(x[:, :40 - k] * x[:, k:]).sum(1) for k in range(5)], axis=1)
    gamma[2] = 1.0                                     # perfectly predictable: no second order
    got = levinson(gamma)
    for i in (0, 1, 3, 4):
        system = gamma[i][np.abs(np.subtract.outer(np.arange(4), np.arange(4)))]
        np.testing.assert_allclose(got[i], np.linalg.solve(system, gamma[i, 1:]))
    assert np.isnan(got[2]).any()
    assert np.isfinite(yule_walker_paths(np.abs(x) / 4, 3, 6)).all()


def test_counter_generator_known_answer():
    words = survival.counter_words([np.zeros(1)] * 4, [np.zeros(1)] * 2)
    assert [int(w[0]) for w in words] == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]
    ones = [np.full(1, 0xFFFFFFFF, np.uint64)]
    assert [int(w[0]) for w in survival.counter_words(ones * 4, ones * 2)] == [0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD]


def test_sampled_paths_follow_their_model(spark):
    rows = [("a", o, 0.4, [0.1 * o - 0.5] * 6) for o in range(5)]
    df = spark.createDataFrame(rows, "stream_id string, origin long, eps double, centre array<double>")
    spread, rho = [0.2, 0.3, 0.4, 0.4, 0.5, 0.5], 0.6
    got = {r.origin: r for r in survival.sampled_paths(df, spread, rho, 4000).collect()}
    again = {r.origin: r for r in survival.sampled_paths(df.repartition(3), spread, rho, 4000).collect()}
    assert {o: (r.surv, r.pred) for o, r in got.items()} == {o: (r.surv, r.pred) for o, r in again.items()}
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 6))
    for h in range(1, 6):
        z[:, h] = rho * z[:, h - 1] + np.sqrt(1 - rho ** 2) * z[:, h]
    for _, o, eps, centre in rows:
        path = 1 / (1 + np.exp(-(z * spread + np.array(centre))))
        alive = ~np.logical_or.accumulate(path > eps, axis=1)
        assert np.allclose(got[o].pred, path.mean(0), atol=0.02) and np.allclose(got[o].surv, alive.mean(0), atol=0.04)
    x = survival.counter_normals(np.array([[1, 2], [3, 4]], np.uint64), 20_000, 5)
    assert x.shape == (2, 20_000, 5) and abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01
    assert np.abs(np.corrcoef(x.transpose(0, 2, 1).reshape(10, -1)) - np.eye(10)).max() < 0.04


def test_risk_path_residuals_need_no_join(spark, monkeypatch):
    """Spread and persistence of what the path misses come from each origin's own array, with gaps."""
    rng = np.random.default_rng(2)
    rows = [("a", i, 0.3, float(rng.random()), [None if rng.random() < 0.1 else float(rng.uniform(0.1, 0.6)) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "stream_id string, origin bigint, anchor double, u double, risk_path array<double>")
    monkeypatch.setattr(type(df), "join", lambda *a, **k: pytest.fail("a join of steps"))
    model, sigma, rho = learned.fit_risk_path(df, ["u"], 4)
    w = model.coefficients.toArray()
    e = np.array([[np.nan if r is None else np.log(r / (1 - r)) - np.log(0.3 / 0.7) - model.intercept - w[3] * u - (w[h - 1] if h else 0.0)
                   for h, r in enumerate(path)] for _, _, _, u, path in rows])
    a, b = e[:, :-1].ravel(), e[:, 1:].ravel()
    both = ~np.isnan(a + b)
    assert sigma == pytest.approx(np.nanstd(e, axis=0))
    assert rho == pytest.approx(max(np.corrcoef(a[both], b[both])[0, 1], 0.0))


def test_a_failed_cox_fit_does_not_look_like_a_result(spark, monkeypatch):
    """Every row of the query says that its curve is no estimate, and scores go by a method of their own."""
    from types import SimpleNamespace

    from stillvalid.plans import model_queries
    from stillvalid.plans.catalog import QUERIES
    from stillvalid.plans.contest import Contest

    states = spark.createDataFrame([("a", i, float(i % 3), float(i % 2)) for i in range(20)], "stream_id string, window_idx bigint, u double, v double")
    m = SimpleNamespace(states=states, spec=SimpleNamespace(horizon=5))
    origins = spark.createDataFrame([("a", i, 1 + i % 5, 0, "train" if i < 12 else "test") for i in range(20)],
                                    "stream_id string, origin bigint, y_tilde bigint, event int, split string")
    c = Contest(m)
    c.__dict__["split"] = origins
    assert {r["method"] for r in c.cox_curves(["u", "v"]).select("method").collect()} == {"cox_failed"}
    monkeypatch.setattr(model_queries, "monitor", lambda *a: m)
    monkeypatch.setattr(model_queries, "contest", lambda *a: c)
    rows = QUERIES["m11_cox"](spark, "").collect()
    assert len(rows) == 8 * 5 and {(r["status"], r["reason"]) for r in rows} == {("estimation_failed", "no event in training")}
    c.__dict__["split"] = origins.withColumn("event", (F.col("origin") % 2).cast("int"))
    rows = QUERIES["m11_cox"](spark, "").collect()
    assert len(rows) == 8 * 5 and {(r["method"], r["status"], r["reason"]) for r in rows} == {("cox", "ok", None)}
