from __future__ import annotations

from .prelude import dbl, r6
from .streams import events, lines

SQL: dict[str, str] = {}

_TOTALS = f"count(*) AS n, {r6('sum(o_totalprice)')} AS total_price, min(o_orderkey) AS first_key"
SQL["a1_read_parquet"] = f"""SELECT o_orderstatus, {_TOTALS} FROM orders
WHERE o_totalprice > 1000 GROUP BY o_orderstatus"""
SQL["a2_write_results"] = f"SELECT o_orderpriority, {_TOTALS} FROM orders GROUP BY o_orderpriority"
SQL["a3_stream_cache"] = events("SELECT stream_id, n_rows, boundary FROM sizes")
SQL["a3_shared_cache"] = events("""SELECT stream_id, count(*) AS n_windows, max(window_idx) AS last_window, 0 AS n_built
 FROM risk GROUP BY stream_id""")
SQL["a4_csv"] = f"""SELECT event_type, count(value) AS n, {r6('sum(value)')} AS total FROM events
GROUP BY event_type"""
SQL["a5_stream_validation"] = """WITH o AS (SELECT 's' || CAST(user_id % 5 AS VARCHAR) AS stream_id,
 value, ts, lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS before FROM events)
SELECT stream_id, count(*) AS n_rows, count(*) FILTER (WHERE ts <= before) AS n_out_of_order,
 count(*) FILTER (WHERE ts IS NULL AND FALSE OR value IS NULL) AS n_missing FROM o GROUP BY stream_id"""
SQL["a6_long_enough"] = """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS stream_id, count(*) AS n_rows
 FROM lineitem GROUP BY l_suppkey), c AS (SELECT *, CASE WHEN n_rows >= 25 THEN 1 + (n_rows - 25) // 25
 ELSE 0 END AS n_windows FROM s)
SELECT stream_id, n_rows, CAST(n_windows AS BIGINT) AS n_windows,
 CAST(n_rows >= 25 * 22 AND n_windows >= 22 AS BIGINT) AS long_enough FROM c"""
SQL["a7_sentinel"] = f"""SELECT l_returnflag, count(*) AS n, {r6('avg(l_discount)')} AS mean_discount
FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0 GROUP BY l_returnflag"""
SQL["a8_chronology"] = """SELECT o_orderstatus AS stream_id, o_orderkey, row_number() OVER (PARTITION BY
 o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) - 1 AS row_idx FROM orders"""
SQL["a9_window_rule"] = """WITH s AS (SELECT 'returnflag:' || l_returnflag AS stream_id FROM lineitem
 UNION ALL SELECT 'suppkey:' || CAST(l_suppkey AS VARCHAR) FROM lineitem
 UNION ALL SELECT 'quantity:' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem
 UNION ALL SELECT 'all:all' FROM lineitem), c AS (SELECT stream_id, count(*) AS n_rows FROM s
 GROUP BY stream_id), w AS (SELECT *, CAST(CASE WHEN n_rows // 400 >= 120 THEN 400
 WHEN n_rows // 200 >= 120 THEN 200 WHEN n_rows // 100 >= 120 THEN 100 WHEN n_rows // 50 >= 120 THEN 50
 WHEN n_rows // 25 >= 120 THEN 25 END AS BIGINT) AS window_size FROM c)
SELECT stream_id, n_rows, coalesce(window_size, 0) AS window_size, CAST(CASE WHEN n_rows // 400 > 1000 THEN
 ceil((n_rows // 400) / 1000e0) WHEN window_size IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS keep_every,
 CASE WHEN window_size IS NULL THEN 'fewer than 120 windows of 25 rows' END AS refused_because FROM w"""
SQL["a10_thin"] = events(f"SELECT stream_id, row_idx, {r6('y')} AS y FROM seg WHERE row_idx % 7 = 0")
SQL["a11_encode"] = """WITH c AS (SELECT DISTINCT o_orderpriority FROM orders), k AS (SELECT *,
 row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM c)
SELECT o_orderpriority, code, count(*) AS n FROM orders JOIN k USING (o_orderpriority) GROUP BY ALL"""
SQL["a12_threshold_target"] = """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000)
 AS n_high, count(*) AS n FROM orders GROUP BY o_orderstatus"""
SQL["a13_remaining_life"] = """SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id)
 - event_id AS remaining FROM events"""
SQL["a14_array_moments"] = f"""WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v
 FROM embeddings) SELECT vec_id, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std FROM u
 GROUP BY vec_id"""
SQL["a15_concat"] = f"""SELECT CAST(list_position(['error', 'click', 'purchase', 'view', 'signup'], event_type) - 1
 AS BIGINT) AS batch, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM events GROUP BY event_type"""

_TARGETS = {"returned": "l_returnflag = 'R'", "expensive": "l_extendedprice > 50000",
            "taxed": "l_tax > 0.079e0", "bulk": "l_quantity > 49.5e0"}
_F = ("l_quantity", "l_discount", "l_extendedprice")
SQL["a16_target_screen"] = "WITH t AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS target, avg(CAST(({c}) AS INTEGER)) AS rate, count(*) AS n_rows, greatest("
    + ", ".join(f"abs(corr(CAST(({c}) AS INTEGER), {f}))" for f in _F) + ") AS worst FROM lineitem"
    for n, c in _TARGETS.items()) + f"""), a AS (SELECT *, rate BETWEEN {dbl(0.05)} AND {dbl(0.95)}
 AS ok FROM t), b AS (SELECT min(worst) AS best FROM a WHERE ok)
SELECT target, {r6('rate')} AS base_rate, n_rows, {r6('worst')} AS max_abs_corr,
 CAST(ok AS BIGINT) AS admissible, CAST(ok AND worst = best AS BIGINT) AS selected FROM a, b"""
SQL["a18_prevalence"] = f"""WITH c AS (SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n
 FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share FROM c),
 d AS (SELECT o_orderstatus, coalesce(max(share) FILTER (WHERE year = (SELECT max(year) FROM c)), 0)
 - coalesce(max(share) FILTER (WHERE year = (SELECT min(year) FROM c)), 0) AS change FROM s
 GROUP BY o_orderstatus), e AS (SELECT min_by(o_orderstatus, change) AS largest_fall,
 max_by(o_orderstatus, change) AS largest_rise FROM d)
SELECT CAST(year AS BIGINT) AS year, o_orderstatus, n, {r6('share')} AS share, {r6('change')} AS change,
 largest_fall, largest_rise FROM s JOIN d USING (o_orderstatus), e"""
SQL["a19_accuracy_drop"] = lines(f"""SELECT stream_id,
 {r6("1 - avg(loss) FILTER (WHERE segment = 'pre')")} AS accuracy_pre,
 {r6("1 - avg(loss) FILTER (WHERE segment = 'dep')")} AS accuracy_dep,
 {r6("100 * ((1 - avg(loss) FILTER (WHERE segment = 'pre')) - (1 - avg(loss) FILTER (WHERE segment = 'dep')))")}
 AS drop_points FROM scored GROUP BY stream_id""")
SQL["w1_sliding_windows"] = events(f"""SELECT stream_id, w AS window_idx, count(*) AS n,
 min(seg_row) AS first_row, {r6('avg(y)')} AS mean_y
 FROM (SELECT seg.*, unnest(range(0, (n_rows - seg.boundary - 20) // 8 + 1)) AS w FROM seg
       JOIN sizes USING (stream_id) WHERE segment = 'dep')
 WHERE seg_row >= w * 8 AND seg_row < w * 8 + 20 GROUP BY stream_id, w""")
SQL["w2_window_count"] = events("SELECT stream_id, " + ", ".join(
    f"CAST(CASE WHEN n_rows >= {s} THEN 1 + (n_rows - {s}) // {k} ELSE 0 END AS BIGINT) AS n_{s}_{k}"
    for s, k in ((20, 20), (20, 8), (100, 7))) + " FROM sizes")
SQL["w3_deployment_split"] = lines("""SELECT stream_id, segment, count(*) AS n, min(row_idx) AS first_row,
 max(seg_row) AS last_seg_row, max(window_idx) AS last_window, count(window_idx) AS n_in_windows
 FROM seg GROUP BY stream_id, segment""")
SQL["w4_head_rows"] = events(f"""SELECT * FROM (SELECT stream_id, count(*) AS n_rows, {r6('sum(y)')}
 AS total_y FROM seg WHERE row_idx < 500 GROUP BY stream_id) JOIN (SELECT stream_id, {r6('avg(risk)')}
 AS mean_risk FROM risk WHERE window_idx < 10 GROUP BY stream_id) USING (stream_id)""")
SQL["w5_row_numbers"] = "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events"
_DEP = "scored WHERE segment = 'dep' AND window_idx IS NOT NULL"
SQL["l1_zero_one"] = lines(f"""SELECT stream_id, window_idx, {r6('sum(loss)')} AS errors FROM {_DEP}
 GROUP BY stream_id, window_idx""")
SQL["l2_brier"] = lines(f"""SELECT stream_id, window_idx,
 {r6('avg((proba[3] - CAST(y = 2 AS INTEGER)) * (proba[3] - CAST(y = 2 AS INTEGER)))')} AS brier
 FROM {_DEP} GROUP BY stream_id, window_idx""")
SQL["l3_bounded_error"] = events(f"""SELECT stream_id, row_idx, {r6('scale')} AS scale, {r6('y_pred')} AS y_pred,
 {r6('loss')} AS loss FROM {_DEP}""")
SQL["l4_window_risk"] = events(f"SELECT segment, stream_id, window_idx, {r6('risk')} AS risk FROM all_risk")
_Q = {"q50": 0.5, "q60": 0.6, "q75": 0.75, "q80": 0.8, "q90": 0.9, "q95": 0.95}
SQL["l5_threshold"] = events("SELECT stream_id, " + r6("avg(risk)") + " AS risk_mean, "
                             + r6("stddev_pop(risk)") + " AS risk_std, " + ", ".join(
    r6(f"quantile_cont(risk, {dbl(q)})") + f" AS {n}" for n, q in _Q.items())
    + ", " + r6("any_value(eps)") + " AS eps FROM pre_risk JOIN eps USING (stream_id) GROUP BY stream_id")
SQL["l6_rethreshold"] = events(" UNION ALL ".join(
    f"SELECT stream_id, {r6(f'least(quantile_cont(risk, 0.75e0) + {dbl(v)}, 1e0)')} AS eps, '{n}' AS margin "
    "FROM pre_risk GROUP BY stream_id" for n, v in (("m02", .02), ("m20", .2), ("m90", .9))))
SQL["a5_doubled_keys"] = """SELECT 's' || CAST(l_suppkey % 5 AS VARCHAR) AS stream_id, count(*) - count(DISTINCT l_shipdate) AS n_doubled
 FROM lineitem GROUP BY 1"""
