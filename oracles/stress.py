from __future__ import annotations

from .prelude import normal, r6, uniform
from .streams import lines

SQL: dict[str, str] = {}
S, E = 2000, 8000
D = range(1, 5)
BASE = """raw AS (SELECT stream_id, row_idx, n_rows, x, CAST(y = 2 AS INTEGER) AS y FROM seg JOIN
 (SELECT stream_id, n_rows FROM sizes) USING (stream_id)),
sc AS (SELECT stream_id, """ + ", ".join(
    f"CASE WHEN stddev_pop(x[{i}]) > 0 THEN stddev_pop(x[{i}]) ELSE 1e0 END AS sd{i}, avg(x[{i}]) AS mu{i}" for i in D) + """
 FROM raw GROUP BY stream_id),
r AS (SELECT * FROM raw JOIN sc USING (stream_id))"""
RAMP = f"least(greatest((row_idx - {S}) / {E - S}e0, 0), 1)"


def season(period: int) -> str:
    return (f"CASE WHEN row_idx >= {S} AND row_idx < {E} THEN 0.5e0 * (1 - cos(6.283185307179586::DOUBLE * (row_idx - {S})"
            f" / {period}e0)) ELSE 0 END")


def square(period: int) -> str:
    return (f"CASE WHEN row_idx >= {S} AND row_idx < {E} THEN ((row_idx - {S}) // {period // 2}) % 2 ELSE 0 END")


STEP = f"CASE WHEN row_idx >= {S} THEN 1e0 ELSE 0e0 END"


def digest(xs: dict[int, str], y: str = "y", source: str = "q") -> str:
    cols = ", ".join(f"{r6(f'avg({xs.get(i, f'x[{i + 1}]')}) / {1000 if i == 1 else 1}')} AS x{i}" for i in range(4))
    return (f"SELECT stream_id, row_idx // 97 AS block, {cols}, {r6(f'avg({y})')} AS y FROM {source} "
            "GROUP BY stream_id, row_idx // 97")


def with_m(w: str, level: float) -> str:
    return BASE + f", q AS (SELECT *, ({w}) * {level}e0 AS m FROM r)"


SQL["x1_severity"] = lines("SELECT stream_id, row_idx // 97 AS block, " + ", ".join(f"{r6(f'avg({e})')} AS {n}" for n, e in {
    "abrupt": STEP, "incremental": RAMP, "recurring": square(500), "seasonal": season(700),
    "jump": f"least(greatest(0.6e0 * {RAMP} + 0.4e0 * CASE WHEN row_idx >= {S} + floor({uniform('jump', 'stream_id')} * {E - S})"
            " THEN 1e0 ELSE 0e0 END, 0), 1)"}.items()) + " FROM r GROUP BY stream_id, row_idx // 97", BASE)
SQL["x2_covariate"] = lines(digest({0: "x[1] + m * sd1", 2: "x[3] + m * sd3"}), with_m(RAMP, 0.9))
SQL["x2_regime"] = lines(digest({1: "x[2] * (1 - 2 * m) + 3 * m * sd2"}), with_m(STEP, 0.8))
SQL["x2_sensor_corruption"] = lines(digest({i: f"x[{i + 1}] * (1 + 0.5e0 * m) + 0.75e0 * m * sd{i + 1}" for i in (0, 3)}),
                                    with_m(season(900), 0.7))
SQL["x2_feature_dropout"] = lines(digest({1: "(1 - m) * x[2] + m * mu2"}), with_m(square(600), 1.0))
SQL["x3_noise_escalation"] = lines(digest({i: f"x[{i + 1}] + {normal('shift/noise', 'stream_id', 'row_idx', str(i))} * m * sd{i + 1}"
                                           for i in (0, 1)}), with_m(RAMP, 1.0))
FLIP = f"CASE WHEN {uniform('shift/flip', 'stream_id', 'row_idx')} < m THEN 1 - y ELSE y END"
SQL["x4_conditional"] = lines(digest({}, FLIP), with_m(STEP, 0.3))
SQL["x5_prior"] = lines(digest({i: f"coalesce(px[{i + 1}], x[{i + 1}])" for i in range(4)}, "coalesce(py, y)", "taken"),
    with_m(STEP, 0.5) + f""", rare AS (SELECT stream_id, CASE WHEN sum(y) < count(*) - sum(y) THEN 1 ELSE 0 END AS rare,
 least(sum(y), count(*) - sum(y)) AS pool FROM q GROUP BY stream_id),
pool AS (SELECT q.stream_id, x AS px, y AS py, row_number() OVER (PARTITION BY q.stream_id ORDER BY row_idx) - 1 AS pick
 FROM q JOIN rare USING (stream_id) WHERE y = rare),
taken AS (SELECT q.*, px, py FROM (SELECT q.*, CASE WHEN {uniform('shift/take', 'stream_id', 'row_idx')} < m
 THEN floor({uniform('shift/pick', 'stream_id', 'row_idx')} * pool) END AS pick FROM q JOIN rare USING (stream_id)) q
 LEFT JOIN pool ON pool.stream_id = q.stream_id AND pool.pick = q.pick)""")
SQL["x6_gradual"] = lines(digest({0: "x[1] + m * sd1"}), with_m(
    f"CASE WHEN {uniform('shift/mix', 'stream_id', 'row_idx')} < {RAMP} THEN 1e0 ELSE 0e0 END", 1.0))
SQL["x8_exogenous"] = lines(digest({}, f"CASE WHEN row_idx >= tau AND {uniform('tau/flip', 'stream_id', 'row_idx')} < 0.45e0 "
                                       "THEN 1 - y ELSE y END"), BASE + f""", q AS (SELECT r.*, boundary
 + floor((0.15e0 + CAST({0.75 - 0.15!r} AS DOUBLE) * {uniform('tau', 'r.stream_id')}) * (r.n_rows - boundary)) AS tau FROM r
 JOIN (SELECT stream_id, boundary FROM sizes) USING (stream_id))""")
SQL["x9_compound"] = lines(digest({0: f"x[1] + 0.5e0 * least(greatest((row_idx - {S}) / 4000e0, 0), 1) * sd1"},
    f"CASE WHEN row_idx >= 3000 AND {uniform('shift1/flip', 'stream_id', 'row_idx')} < 0.2e0 THEN 1 - y ELSE y END", "r"), BASE)
