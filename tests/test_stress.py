import numpy as np
import pytest
from pyspark.sql import functions as F

from stillvalid.operators import stress
from stillvalid.operators.stress import Shift


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] + .5 * x[:, 1] > 0).astype(int)
    data = [("a", i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "stream_id string, row_idx bigint, x array<double>, y int")


def frame(df):
    p = df.orderBy("row_idx").toPandas()
    return np.array(p["x"].tolist()), p["y"].to_numpy()


def test_covariate_moves_only_named_features(rows):
    x0, y0 = frame(rows)
    x1, y1 = frame(stress.apply_shift(rows, Shift("covariate", "abrupt", .5, 0, features=(0, 2))))
    assert (x1[:, [1, 3]] == x0[:, [1, 3]]).all() and (y1 == y0).all()
    np.testing.assert_allclose(x1[:, 0] - x0[:, 0], .5 * x0[:, 0].std())


def test_conditional_flips_the_stated_share(rows):
    x0, y0 = frame(rows)
    x1, y1 = frame(stress.apply_shift(rows, Shift("conditional", "abrupt", .3, 0)))
    assert (x0 == x1).all() and abs((y0 != y1).mean() - .3) < .04


def test_ramp_never_falls_and_starts_late(rows):
    x0, _ = frame(rows)
    x1, _ = frame(stress.apply_shift(rows, Shift("covariate", "incremental", 1.0, 200, 1800,
                                                 (0,))))
    d = x1[:, 0] - x0[:, 0]
    assert (np.diff(d) >= -1e-12).all() and (d[:200] == 0).all()


def test_prior_keeps_inputs_of_the_class(rows):
    x0, y0 = frame(rows)
    x1, y1 = frame(stress.apply_shift(rows, Shift("prior", "abrupt", .6, 1000)))
    rare = int((y0 == 1).sum() < (y0 == 0).sum())
    known = {tuple(r) for r in x0[y0 == rare]}
    changed = (x1 != x0).any(axis=1)
    assert changed[:1000].sum() == 0 and .5 < changed[1000:].mean() < .7
    assert all(tuple(r) in known for r in x1[changed]) and (y1[changed] == rare).all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_sorted_by_their_few_streams(rows):
    for shift in (Shift("covariate", "abrupt", .5, 0, features=(0,)), Shift("conditional", "abrupt", .3, 0)):
        made = plan(stress.apply_shift(rows, shift))
        assert "BroadcastHashJoin" in made and "SortMergeJoin" not in made and "hashpartitioning" not in made


def test_exogenous_shift_is_invisible_before_its_point(spark, rows):
    sizes = spark.createDataFrame([("a", 2000, 400)],
                                  "stream_id string, n_rows bigint, boundary bigint")
    tau = stress.random_change_point(sizes).first()["tau"]
    x0, y0 = frame(rows)
    x1, y1 = frame(stress.exogenous_shift(rows, sizes))
    assert (x0 == x1).all() and (y0[:tau] == y1[:tau]).all() and (y0[tau:] != y1[tau:]).any()
    many = spark.createDataFrame([(f"s{i}", 2000, 400) for i in range(200)],
                                 "stream_id string, n_rows bigint, boundary bigint")
    taus = [r["tau"] for r in stress.random_change_point(many).collect()]
    assert len(set(taus)) > 100 and min(taus) >= 400 + .15 * 1600 - 1 and max(taus) <= 1600


def test_forecastability_classes():
    assert stress.forecastability("conditional", "abrupt") == "U"
    assert stress.forecastability("covariate", "incremental") == "F"
    assert stress.forecastability("covariate", "incremental", .2) == "PF"
    assert stress.forecastability("covariate", "abrupt") == "PF"
    assert stress.forecastability("prior", "gradual") == "PF"
    with pytest.raises(ValueError):
        Shift("conditional", "abrupt", .3, 0, declared_class="F")
    f, u = Shift("covariate", "gradual", 1, 0), Shift("conditional", "abrupt", 1, 0)
    assert stress.compound_forecastability([f, f]) == "F"
    assert stress.compound_forecastability([f, u]) == "PF"
    with pytest.raises(ValueError):
        stress.compound_forecastability([])


def test_shift_does_not_depend_on_the_layout(rows):
    s = Shift("noise_escalation", "gradual", 1.0, 100, 1500, (0, 1))
    a, _ = frame(stress.apply_shift(rows, s))
    b, _ = frame(stress.apply_shift(rows.repartition(7), s))
    np.testing.assert_allclose(a, b, atol=1e-12)
