from __future__ import annotations

from .prelude import dbl, r6, uniform
from .streams import events, lines

SQL: dict[str, str] = {}

SPLIT = """tau AS (SELECT stream_id, quantile_cont(origin, 0.5e0) AS tau1, quantile_cont(origin, 0.7e0) AS tau2
 FROM origins GROUP BY stream_id),
split_all AS (SELECT *, CASE WHEN origin < tau1 THEN 'train' WHEN origin >= tau1 + 20 AND origin < tau2
 THEN 'calibration' WHEN origin >= tau2 + 20 THEN 'test' END AS split FROM origins JOIN tau USING (stream_id)),
parts AS (SELECT * FROM split_all WHERE split IS NOT NULL)"""

SQL["t2_time_to_violation"] = events(f"""
SELECT stream_id, origin, CAST(y_tilde AS BIGINT) AS y_tilde, CAST(event AS BIGINT) AS event,
       {r6('risk_now')} AS risk_now, {r6('risk_next')} AS risk_next, {r6('eps')} AS eps FROM origins""")
SQL["t3_risk_path"] = events(f"""SELECT stream_id, origin, h, {r6('risk')} AS risk FROM (SELECT stream_id, origin,
 unnest(range(1, 21)) AS h, unnest(risk_path) AS risk FROM origins) WHERE risk IS NOT NULL""")
SQL["t4_censoring_rate"] = events(f"""SELECT count(*) AS n_origins, CAST(sum(event) AS BIGINT) AS n_events,
 {r6('1 - avg(event)')} AS censoring_rate FROM origins""")
SQL["t6_history_and_anchor"] = events(f"""SELECT stream_id, origin, {r6('anchor')} AS anchor,
 CASE WHEN coalesce(len(known_hist), 0) = 0 THEN 0 ELSE 20 END::BIGINT AS n_known,
 {r6('coalesce(known_hist[1], -1e0)')} AS oldest, {r6('coalesce(known_hist[len(known_hist)], -1e0)')} AS newest
 FROM origins""")
SQL["t8_context"] = events(f"""SELECT a.stream_id, a.window_idx, CAST(k AS BIGINT) AS step, {r6('b.m')} AS pred_mean,
 {r6('b.s')} AS pred_std FROM (SELECT *, unnest(range(0, 20)) AS k FROM v) a JOIN v b ON a.stream_id = b.stream_id
 AND b.window_idx = greatest(a.window_idx - 19 + k, 0)""", """v AS (SELECT stream_id, window_idx, avg(y_pred) AS m,
 stddev_pop(y_pred) AS s FROM scored WHERE segment = 'dep' AND window_idx IS NOT NULL GROUP BY stream_id, window_idx)""")
SQL["t10_chronological_split"] = events("SELECT stream_id, origin, split FROM parts", SPLIT)
SQL["t11_stream_split"] = events(f"""SELECT stream_id, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_cal
 THEN 'calibration' ELSE 'test' END AS split FROM cal""", f"""
st AS (SELECT stream_id, row_number() OVER (ORDER BY {uniform('split', 'stream_id')}, stream_id) AS r,
 count(*) OVER () AS n FROM (SELECT DISTINCT stream_id FROM origins)),
tr AS (SELECT *, greatest(1, round_even(0.5e0 * n, 0)) AS n_train, greatest(1, round_even(0.2e0 * n, 0)) AS want FROM st),
cal AS (SELECT *, CASE WHEN n_train + want >= n THEN greatest(1, n - n_train - 1) ELSE want END AS n_cal FROM tr)""")
SQL["t12_split_guard"] = events("""SELECT split, count(*) AS n_origins, CAST(sum(event) AS BIGINT) AS n_events,
 1::BIGINT AS ok FROM parts GROUP BY split""", SPLIT)
SQL["t13_conditioned"] = events("""SELECT stream_id, origin FROM origins WHERE risk_now <= eps AND risk_next <= eps""")
_U = "count(*) AS n_origins, CAST(sum(event) AS BIGINT) AS n_events, count(DISTINCT stream_id) AS n_streams, 1 - avg(event) AS c"
_E = events(f"SELECT 'events' AS dataset, {_U} FROM origins")
_L = lines(f"SELECT 'lines' AS dataset, {_U} FROM origins")
SQL["t14_usability"] = f"""SELECT dataset, n_origins, n_events, n_streams, {r6('c')} AS censoring_rate,
 CAST(n_origins >= 100 AND c > 0 AND c < 0.6e0 AS BIGINT) AS usable
 FROM (SELECT * FROM ({_E}) UNION ALL SELECT * FROM ({_L}))"""
SQL["t15_regime_comparability"] = events(f"""SELECT {r6('tr')} AS train_mean_risk, {r6('te')} AS test_mean_risk,
 n_train_origins, n_test_origins, {r6('te / tr')} AS test_over_train FROM (SELECT
 avg(r) FILTER (WHERE split = 'train') AS tr, avg(r) FILTER (WHERE split = 'test') AS te FROM (SELECT split,
 unnest(risk_path) AS r FROM parts)), (SELECT count(*) FILTER (WHERE split = 'train') AS n_train_origins,
 count(*) FILTER (WHERE split = 'test') AS n_test_origins FROM parts)""", SPLIT)
AGED = "aged AS (SELECT *, origin - min(origin) OVER (PARTITION BY stream_id) AS age FROM origins)"
SQL["t16_age_hazard"] = events(f"""SELECT part, {r6('any_value(e[part])')} AS age_from, {r6('any_value(e[part + 1])')}
 AS age_to, count(*) AS n_origins, {r6('avg(event)')} AS hazard, {r6('any_value(r)')} AS point_biserial_r
 FROM (SELECT *, CAST(1 + len(list_filter(e[2:len(e) - 1], lambda q: q < age)) AS BIGINT) AS part FROM aged, edges, rr)
 GROUP BY part""", AGED + f""",
edges AS (SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(age, {i}/5e0)' for i in range(6))}])) AS e FROM aged),
rr AS (SELECT corr(event, age) AS r FROM aged)""")
# Student's t with a whole number v of degrees of freedom: finite sums over the angle u = atan(t / sqrt(v)).
_EVEN = ("sin(u) * list_sum(list_transform(range(0, CAST(v / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5e0) - lgamma(0.5e0) - lgamma(k + 1.0e0) "
         "+ 2 * k * ln(cos(u)))))")
_ODD = ("2 / pi() * (u + sin(u) * list_sum(list_transform(range(0, CAST((v - 1) / 2 AS BIGINT)), lambda k: exp(lgamma(k + 1.0e0) + lgamma(1.5e0) "
        "- lgamma(k + 1.5e0) + (2 * k + 1) * ln(cos(u))))))")
SQL["t16_age_association"] = events(f"""SELECT n AS n_origins, {r6('r')} AS point_biserial_r, {r6('t')} AS t_statistic,
 {r6(f'1 - CASE WHEN v % 2 = 0 THEN {_EVEN} ELSE {_ODD} END')} AS p_value FROM (SELECT *, atan(abs(t) / sqrt(v)) AS u FROM (
 SELECT n, r, n - 2 AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT count(*) AS n, corr(event, age) AS r FROM aged)))""", AGED)
SQL["t17_transfer"] = events(f"""SELECT held_out, {r6('p')} AS pool_rate, {r6('e / n')} AS own_rate,
 {r6('(e * pow(1 - p, 2) + (n - e) * p * p) / n')} AS brier FROM (SELECT stream_id AS held_out, count(*) AS n, sum(event) AS e,
 (sum(sum(event)) OVER () - sum(event)) / (sum(count(*)) OVER () - count(*)) AS p FROM origins GROUP BY stream_id)""")
SQL["t17_leave_one_out"] = events("""SELECT d.held_out, count(*) AS n_origins, CAST(sum(event) AS BIGINT) AS n_events,
 count(DISTINCT stream_id) AS n_streams FROM origins, (VALUES ('s0'), ('s1'), ('s2'), ('s3'), ('s4')) AS d(held_out)
 WHERE stream_id <> d.held_out GROUP BY d.held_out""")
SQL["t18_person_periods"] = events("""SELECT h, count(*) AS at_risk, CAST(sum(CAST(h = y_tilde AND event = 1 AS INTEGER))
 AS BIGINT) AS failed FROM (SELECT *, unnest(range(1, y_tilde + 1)) AS h FROM origins) GROUP BY h""")
