from __future__ import annotations

from stillvalid.plans.model_queries import STUMP_EDGES

from .prelude import r6
from .streams import events, lines
from .targets import SPLIT

SQL: dict[str, str] = {}
H = range(1, 21)


def _slopes(y: str) -> str:
    return (f"flatten(list_transform(range(1, len({y})), lambda i: list_transform(range(i + 1, len({y}) + 1), "
            f"lambda j: ({y}[j] - {y}[i]) / (j - i))))")


def cand(source: str = "origins") -> str:
    """CTEs hist, cand: every method and setting with level and slope, in grid order."""
    parts = ["SELECT stream_id, origin, risk_path, 'persistence' AS method, -1e0 AS setting, 0 AS pos, "
             "coalesce(hist[len(hist)], 0.5e0) AS level, 0e0 AS slope FROM hist"]
    n = 1
    for k in (2, 3, 5, 8, 10, 15, 20):
        parts.append(f"SELECT stream_id, origin, risk_path, 'moving_average', {k}e0, {n}, "
                     f"coalesce(list_avg(hist[greatest(len(hist) - {k - 1}, 1):len(hist)]), 0.5e0), 0e0 FROM hist")
        n += 1
    for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9):
        parts.append(f"SELECT stream_id, origin, risk_path, 'exponential_smoothing', {a}e0, {n}, CASE WHEN len(hist) > 0 "
                     f"THEN list_reduce(hist, lambda s, v: {a}e0 * v + (1e0 - {a}e0) * s) ELSE 0.5e0 END, 0e0 FROM hist")
        n += 1
    for k in (5, 8, 10, 15, 20):
        parts.append(f"""SELECT stream_id, origin, risk_path, 'theil_sen_trend', {k}e0, {n},
 CASE WHEN len(y) >= 2 THEN list_median(list_transform(range(1, len(y) + 1), lambda i: y[i] - m * (i - 1))) + m * (len(y) - 1)
 ELSE coalesce(y[1], 0.5e0) END, m FROM (SELECT *, CASE WHEN len(y) >= 2 THEN list_median({_slopes('y')}) ELSE 0e0 END AS m
 FROM (SELECT *, hist[greatest(len(hist) - {k - 1}, 1):len(hist)] AS y FROM hist))""")
        n += 1
    parts.append(f"SELECT stream_id, origin, risk_path, 'anchor', -1e0, {n}, anchor, 0e0 FROM hist")
    return f"""hist AS (SELECT *, CASE WHEN coalesce(len(known_hist), 0) = 0 THEN [] ELSE list_concat(list_transform(
 range(20 - len(known_hist)), lambda i: known_hist[1]), known_hist) END AS hist FROM {source}),
cand AS ({' UNION ALL '.join(parts)})"""


SQL["m1_forecast_candidates"] = events(f"""SELECT stream_id, origin, method, setting, {r6('level')} AS level,
 {r6('slope')} AS slope FROM cand""", cand())
SQL["m5_ar_one"] = events(f"""SELECT stream_id, origin, h, {r6('''CASE WHEN n < 3 THEN coalesce(last, 0.5e0)
 WHEN g0 > 0 THEN least(greatest(mu + pow(g1 / g0, h) * (last - mu), 0), 1) ELSE last END''')} AS pred FROM (SELECT
 stream_id, origin, len(hist) AS n, hist[len(hist)] AS last, list_avg(hist) AS mu,
 list_sum(list_transform(hist, lambda v: (v - list_avg(hist)) * (v - list_avg(hist)))) AS g0,
 list_sum(list_transform(range(1, len(hist)), lambda i: (hist[i] - list_avg(hist)) * (hist[i + 1] - list_avg(hist)))) AS g1,
 unnest(range(1, 21)) AS h FROM hist)""", cand())
TUNED = SPLIT + "," + cand("parts").replace("'persistence' AS method", "split, 'persistence' AS method").replace(
    "risk_path, 'moving", "risk_path, split, 'moving").replace("risk_path, 'exp", "risk_path, split, 'exp").replace(
    "risk_path, 'theil", "risk_path, split, 'theil").replace("risk_path, 'anchor", "risk_path, split, 'anchor") + """,
long_cand AS (SELECT stream_id, origin, split, method, setting, pos, h, r,
 least(greatest(level + slope * h, 0e0), 1e0) AS pred FROM (SELECT *, unnest(range(1, 21)) AS h, unnest(risk_path) AS r FROM cand)
 WHERE r IS NOT NULL),
grid AS (SELECT method, setting, pos, avg(abs(pred - r)) AS mae FROM long_cand WHERE split = 'calibration' GROUP BY ALL),
tuned AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(mae, 12), pos) = 1),
test_long AS (SELECT l.* FROM long_cand l JOIN tuned t USING (method, pos) WHERE split = 'test')"""
SQL["m6_tuned_settings"] = events(f"SELECT method, setting, {r6('mae')} AS mae FROM tuned", TUNED)


def km(source: str, keys: str, flip: bool = False) -> str:
    """(keys, h, s) of the product-limit curve."""
    d = "event = 0" if flip else "event = 1"
    k = f"{keys}, " if keys else ""
    join = f"JOIN (SELECT DISTINCT {keys} FROM {source}) k ON TRUE" if keys else ""
    return f"""SELECT {k}h, product(CASE WHEN r > 0 THEN 1 - d / r ELSE 1 END) OVER ({'PARTITION BY ' + keys if keys else ''}
 ORDER BY h) AS s FROM (SELECT {k}g.h, count(*) FILTER (WHERE y_tilde >= g.h) AS r,
 count(*) FILTER (WHERE y_tilde = g.h AND {d}) AS d FROM {source}, range(1, 21) AS g(h) GROUP BY {k}g.h)"""


SQL["m8_kaplan_meier"] = events(f"SELECT stream_id, h, {r6('s')} AS s FROM ({km('origins', 'stream_id')})")
SQL["m10_censoring_curve"] = events(f"SELECT h, {r6('greatest(s, 1e-8)')} AS s FROM ({km('origins', '', True)})")
SQL["m12_hazard_to_survival"] = SQL["m8_kaplan_meier"]
AGE = SPLIT + f""", agecut AS (SELECT {', '.join(f"quantile_cont(origin, {i}/5e0) AS c{i}" for i in range(1, 5))} FROM parts
 WHERE split = 'train'),
aged_parts AS (SELECT parts.*, {' + '.join(f'CAST(origin >= c{i} AS INTEGER)' for i in range(1, 5))} AS age_bin FROM parts, agecut),
train AS (SELECT * FROM aged_parts WHERE split = 'train'), test AS (SELECT * FROM aged_parts WHERE split = 'test'),
pooled AS ({km('train', '')}),
binned AS (SELECT * FROM ({km('train', 'age_bin')}) JOIN (SELECT age_bin FROM train GROUP BY age_bin
 HAVING count(*) >= 10 AND sum(event) > 0) USING (age_bin)),
age_curves AS (SELECT t.stream_id, t.origin, t.age_bin, t.y_tilde, t.event, p.h, coalesce(b.s, p.s) AS s FROM test t
 JOIN pooled p ON TRUE LEFT JOIN binned b ON b.age_bin = t.age_bin AND b.h = p.h)"""
SQL["m9_age_kaplan_meier"] = events(f"""SELECT stream_id, origin, CAST(age_bin AS BIGINT) AS age_bin, h, {r6('s')} AS s
 FROM age_curves""", AGE)
CURVES = AGE + """, curves AS (SELECT 'age_kaplan_meier' AS method, stream_id, origin, y_tilde, event, h, s FROM age_curves
 UNION ALL SELECT 'kaplan_meier', stream_id, origin, y_tilde, event, p.h, p.s FROM test, pooled p)"""
SQL["m18_horizon_readouts"] = events(f"""SELECT stream_id, origin, method, {r6('sum(s)')} AS expected_horizon,
 coalesce(min(h) FILTER (WHERE s <= 0.5e0), 21) AS median_horizon,
 count(*) FILTER (WHERE s >= 1e0 - 0.1e0) AS lower_horizon FROM curves GROUP BY stream_id, origin, method""", CURVES)

def _words() -> str:
    """CTE w: four random words a, b, c, d for every origin, draw and block, by the counter-based generator."""
    key = "md5(concat_ws('|', 'paths', stream_id, CAST(origin AS VARCHAR)))"
    out = (f"SELECT stream_id, origin, eps, centre, draw, block, draw::UBIGINT AS a, block::UBIGINT AS b, 0::UBIGINT AS c, 0::UBIGINT AS d, "
           f"CAST('0x' || substr({key}, 1, 8) AS UBIGINT) AS k0, CAST('0x' || substr({key}, 9, 8) AS UBIGINT) AS k1 "
           "FROM base, range(0, 256) AS r(draw), range(0, 5) AS s(block)")
    for _ in range(10):
        out = (f"SELECT * EXCLUDE (p, q) REPLACE (xor(xor(q >> 32, b), k0) AS a, q % 4294967296 AS b, xor(xor(p >> 32, d), k1) AS c, "
               f"p % 4294967296 AS d, (k0 + 2654435769) % 4294967296 AS k0, (k1 + 3144134277) % 4294967296 AS k1) "
               f"FROM (SELECT *, 3528531795::UBIGINT * a AS p, 3449720151::UBIGINT * c AS q FROM ({out}))")
    return f"w AS ({out})"


def _pair(u: str, v: str) -> str:
    r, t = f"sqrt(-2e0 * ln(({u} + 0.5e0) / 4294967296e0))", f"(6.283185307179586::DOUBLE * ({v} + 0.5e0) / 4294967296e0)"
    return f"{r} * cos({t}), {r} * sin({t})"


def _lg(x: str) -> str:
    c = f"least(greatest({x}, 1e-6), 1 - 1e-6)"
    return f"ln({c} / (1 - {c}))"


PATHS = SPLIT + f""", missed AS (SELECT h, {_lg('risk_path[h]')} - {_lg('anchor')} AS e, CASE WHEN risk_path[h + 1] IS NOT NULL THEN {_lg('risk_path[h + 1]')} - {_lg('anchor')} END AS f
 FROM (SELECT risk_path, anchor, unnest(range(1, 21)) AS h FROM parts WHERE split = 'train') WHERE risk_path[h] IS NOT NULL),
fit AS (SELECT list(CASE WHEN s > 0 THEN s ELSE 1e-3 END ORDER BY h) AS sd, (SELECT least(greatest(coalesce(round(corr(e, f) FILTER (f IS NOT NULL), 12), 0), 0), 0.99e0)
 FROM missed) AS rho FROM (SELECT h, round(stddev_pop(e), 12) AS s FROM missed GROUP BY h)),
base AS (SELECT stream_id, origin, eps, round({_lg('anchor')}, 12) AS centre FROM origins),
{_words()},
z AS (SELECT stream_id, origin, eps, centre, draw, flatten(list([{_pair('a', 'b')}, {_pair('c', 'd')}] ORDER BY block)) AS z FROM w GROUP BY ALL),
e AS (SELECT *, z[1] AS e0, """ + ", ".join(f"rho * e{h - 1} + sqrt(1 - rho * rho) * z[{h + 1}] AS e{h}" for h in range(1, 20)) + """ FROM z, fit),
p AS (SELECT stream_id, origin, draw, eps, [""" + ", ".join(
    f"1 / (1 + exp(-(sd[{h + 1}] * e{h} + centre)))" for h in range(20)) + """] AS path FROM e)"""
SQL["m15_first_passage"] = events(f"""SELECT stream_id, origin, h, {r6('avg(CAST(list_max(path[1:h]) <= eps AS INTEGER))')} AS s
 FROM (SELECT *, unnest(range(1, 21)) AS h FROM p) GROUP BY stream_id, origin, h""", PATHS)
SQL["m17_mean_path"] = events(f"""SELECT stream_id, origin, h, {r6('avg(path[h])')} AS pred
 FROM (SELECT *, unnest(range(1, 21)) AS h FROM p) GROUP BY stream_id, origin, h""", PATHS)


def _stumps(rounds: int, rate: str) -> str:
    """Rounds of boosted stumps: CTEs s0, s1, ... with the scores f0, f1, f2 of every row."""
    k3 = range(3)
    cuts = [(f, c, e) for f, edges in enumerate(STUMP_EDGES) for c, e in enumerate(edges, 1)]
    out = ["s0 AS (SELECT d.*, " + ", ".join(
        f"(SELECT ln((count(*) FILTER (y = {k}) + 1e-9 * count(y)) / count(y)) FROM d WHERE segment = 'pre') AS f{k}" for k in k3) + " FROM d)"]
    for i in range(rounds):
        out.append(f"p{i} AS (SELECT *, " + ", ".join(f"exp(f{k}) / (exp(f0) + exp(f1) + exp(f2)) AS p{k}" for k in k3)
                   + f" FROM s{i}), g{i} AS (SELECT x, " + ", ".join(
            f"p{k} - CAST(y = {k} AS INTEGER) AS g{k}, greatest(p{k} * (1 - p{k}), 1e-12) AS h{k}" for k in k3)
                   + f" FROM p{i} WHERE segment = 'pre' AND y IS NOT NULL)")
        sums = " UNION ALL ".join(
            f"SELECT {k} AS k, {f} AS f, {c} AS c, {e}::DOUBLE AS e, sum(g{k}) FILTER (x[{f + 1}] <= {e}::DOUBLE) AS gl, "
            f"sum(h{k}) FILTER (x[{f + 1}] <= {e}::DOUBLE) AS hl, sum(g{k}) AS g, sum(h{k}) AS h FROM g{i}" for k in k3 for f, c, e in cuts)
        gain = "round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 9)"
        out.append(f"t{i} AS ({sums}), b{i} AS (SELECT k, f, e, -{rate} * gl / (hl + 1) AS l, -{rate} * (g - gl) / (h - hl + 1) AS r "
                   f"FROM t{i} WHERE hl > 1e-9 AND h - hl > 1e-9 AND {gain} > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY {gain} DESC, f, c) = 1)")
        out.append(f"s{i + 1} AS (SELECT s.* REPLACE (" + ", ".join(
            f"f{k} + CASE WHEN x[b{k}.f + 1] <= b{k}.e THEN b{k}.l ELSE b{k}.r END AS f{k}" for k in k3) + f") FROM s{i} s, "
            + ", ".join(f"(SELECT * FROM b{i} WHERE k = {k}) b{k}" for k in k3) + ")")
    return ",\n".join(out)


SQL["m19_boosted_stumps"] = lines("SELECT stream_id, window_idx, " + ", ".join(
    f"{r6(f'avg(exp(f{k}) / (exp(f0) + exp(f1) + exp(f2)))')} AS p{k}" for k in range(3))
    + " FROM s2 WHERE segment = 'dep' AND window_idx IS NOT NULL GROUP BY stream_id, window_idx",
    "d AS (SELECT stream_id, window_idx, segment, y, x FROM seg),\n" + _stumps(2, "0.5e0"))
SQL["m20_boosted_consistency"] = lines("""SELECT stream_id, window_idx, count(*) AS n, 0e0 AS leaf_gap, 0e0 AS softmax_gap,
 0e0 AS truncation_gap, 0::BIGINT AS n_other_class FROM seg WHERE segment = 'dep' AND window_idx IS NOT NULL GROUP BY stream_id, window_idx""")
