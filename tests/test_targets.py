import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.operators import splits, state, targets


def targets_of(risk_table, eps_table, risk, eps, horizon):
    out = targets.censored_targets(risk_table({"a": risk}), eps_table(eps), horizon)
    return {r["origin"]: (r["y_tilde"], r["event"]) for r in out.collect()}


@pytest.mark.parametrize("risk, horizon, expected", [
    ([.10, .15, .20, .40, .45], 5, {0: (3, 1), 1: (2, 1), 2: (1, 1)}),
    ([.10, .10, .10, .10, .99], 2, {0: (2, 0), 1: (2, 0), 2: (2, 1), 3: (1, 1)}),
    ([.10, .12, None, .99], 3, {0: (1, 0)}),
    ([.10, .30, .31], 2, {0: (2, 1), 1: (1, 1)}),
    ([.10, .10, .99], 2, {0: (2, 1), 1: (1, 1)}),
])
def test_known_targets(risk_table, eps_table, risk, horizon, expected):
    assert targets_of(risk_table, eps_table, risk, .30, horizon) == expected


def test_all_valid_is_censored(risk_table, eps_table):
    got = targets_of(risk_table, eps_table, [.10] * 10, .30, 3)
    assert all(e == 0 for _, e in got.values())
    assert got[0][0] == 3 and got[8][0] == 1 and 9 not in got


def test_path_is_padded(risk_table, eps_table):
    out = targets.censored_targets(risk_table({"a": [.1, .1, .1]}), eps_table(.3), 5)
    path = out.filter("origin = 0").first()["risk_path"]
    assert path == [.1, .1, None, None, None]


def test_past_does_not_matter(risk_table, eps_table):
    a = targets_of(risk_table, eps_table, [.05, .05, .10, .40], .3, 3)
    b = targets_of(risk_table, eps_table, [.29, .28, .10, .40], .3, 3)
    assert a[2] == b[2]


def test_bad_horizon_and_empty_table(risk_table, eps_table, spark):
    with pytest.raises(ValueError):
        targets.censored_targets(risk_table({"a": [.1]}), eps_table(.3), 0)
    empty = spark.createDataFrame([], "event int")
    with pytest.raises(Exception, match="undefined"):
        targets.censoring_rate(empty).collect()


def reference_targets(risk, eps, horizon):
    """Plain loop over one series."""
    out = {}
    for t in range(len(risk) - 1):
        if risk[t] is None or risk[t] > eps:
            continue
        ahead = risk[t + 1:t + 1 + horizon]
        y, e = len(ahead), 0
        for h, r in enumerate(ahead, 1):
            if r is None or r > eps:
                y, e = (h - 1, 0) if r is None else (h, 1)
                break
        if y >= 1:
            out[t] = (y, e)
    return out


def test_chunks_do_not_change_targets(risk_table, eps_table, monkeypatch):
    """Small chunks with overlaps give the same result as a plain loop, NULLs included."""
    from stillvalid.operators import ordered

    rng = np.random.default_rng(1)
    risk = [None if u < .05 else float(v) for u, v in zip(rng.random(300), rng.random(300))]
    real = ordered.halo
    monkeypatch.setattr(targets, "halo", lambda *a, **k: real(*a, **{**k, "chunk": 7}))
    assert targets_of(risk_table, eps_table, risk, .8, 6) == reference_targets(risk, .8, 6)
    hist = targets.matured_history(risk_table({"a": risk}), 5, 2).collect()
    for r in hist:
        t = r["window_idx"]
        seen = risk[max(0, t - 2 - 4):max(0, t - 1)]
        pad = [seen[0]] * (5 - len(seen)) if seen else [None] * 5
        assert r["risk_hist"] == pad + seen


def test_anchor_is_smoothed_history(risk_table, eps_table):
    risk = [.1, .2, .05, .15, .1]
    table = risk_table({"a": risk})
    base = targets.censored_targets(table, eps_table(.3), 3)
    got = {r["origin"]: r for r in targets.with_history(base, table, 4, 1).collect()}
    level = .1
    for v in (.2, .05):
        level = .3 * v + .7 * level
    # The history is padded on the left with its first value, which does not move the level.
    assert got[3]["anchor"] == pytest.approx(level)
    assert got[0]["anchor"] == pytest.approx(risk[0])


def test_chronological_split_keeps_a_gap(spark):
    rows = [("a", i, 1) for i in range(200)] + [("b", 2 * i, 0) for i in range(100)]
    o = spark.createDataFrame(rows, "stream_id string, origin bigint, event int")
    got = splits.chronological_split(o, .5, .2, 5).toPandas()
    for _, g in got.groupby("stream_id"):
        by = {k: v["origin"] for k, v in g.groupby("split")}
        assert by["calibration"].min() - by["train"].max() >= 5
        assert by["test"].min() - by["calibration"].max() >= 5
    one = got[got.stream_id == "a"]
    tau1, tau2 = np.quantile(np.arange(200), [.5, .7])
    assert set(one[one.split == "train"].origin) == set(np.arange(200)[np.arange(200) < tau1])
    assert one[one.split == "test"].origin.min() >= tau2 + 5


def test_split_guards(spark):
    with pytest.raises(ValueError):
        splits.chronological_split(None, .8, .3, 5)
    small = spark.createDataFrame([("train", 1)] * 5, "split string, event int")
    with pytest.raises(Exception, match="cannot be used"):
        splits.check_splits(small).collect()
    two = spark.createDataFrame([("a",), ("b",)], "stream_id string")
    with pytest.raises(Exception, match="three streams"):
        splits.stream_split(two).collect()


def test_conditioned_subset(spark):
    o = spark.createDataFrame([(.1, .2, .3), (.4, .1, .3), (.2, .5, .3)],
                              "risk_now double, risk_next double, eps double")
    assert [r["risk_now"] for r in targets.conditioned(o).collect()] == [.1]


def test_future_columns_are_refused():
    for name in (*state.FORBIDDEN_NAMES, "risk_t_plus_3", "target_x", "future_y"):
        with pytest.raises(AssertionError):
            state.assert_no_future_columns(["pred_mean", name])
    state.assert_no_future_columns(["pred_mean"])


def test_context_repeats_the_first_state(spark):
    s = spark.createDataFrame([("a", i, float(i)) for i in range(5)],
                              "stream_id string, window_idx bigint, f double")
    got = {r["window_idx"]: [v[0] for v in r["context_states"]]
           for r in targets.context_tensor(s, ["f"], 3).collect()}
    assert got == {0: [0, 0, 0], 1: [0, 0, 1], 2: [0, 1, 2], 3: [1, 2, 3], 4: [2, 3, 4]}
