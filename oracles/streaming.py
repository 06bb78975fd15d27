from __future__ import annotations

from stillvalid.plans.stream_queries import BATCHES, JITTER, STRAY

from .prelude import r6, uniform
from .states import _FBC as FEEDBACK_SQL
from .states import _fb as feedback_ctes
from .streams import events

SQL: dict[str, str] = {}

LABELS = f"""lab AS (SELECT 's' || CAST(user_id % 5 AS VARCHAR) AS stream_id, event_id, value AS label,
 floor({uniform('late', 'event_id')} * 7200) AS late FROM events WHERE {uniform('missing', 'event_id')} >= 0.05e0),
ev AS (SELECT event_id, ts AS ets, user_id, event_type FROM events),
pred AS (SELECT 's' || CAST(user_id % 5 AS VARCHAR) AS stream_id, event_id, ets, scale, coalesce(key_mean, stream_mean) AS y_pred
 FROM ev JOIN stream_mean s ON s.stream_id = 's' || CAST(user_id % 5 AS VARCHAR) LEFT JOIN key_mean k
 ON k.stream_id = s.stream_id AND k.score_key = event_type)"""
SQL["r1_label_join"] = events(f"""SELECT pred.stream_id, pred.event_id, {r6('label')} AS label, {r6('y_pred')} AS y_pred
 FROM pred JOIN lab USING (event_id) WHERE late <= 3600""", LABELS)


def risk(hours: int, step: int) -> str:
    """Windows of rows that come by batch; strays come in the last one, behind its watermark or not."""
    h = 3600 * 1000000
    n = hours // step
    place = (f"CASE WHEN {uniform('stray', 'event_id')} < {STRAY}e0 THEN {BATCHES - 1} ELSE least(floor((us + floor({uniform('jitter', 'event_id')} * "
             f"{JITTER}000000) - t0) * {BATCHES} / (t1 - t0 + 1)), {BATCHES - 1}) END")
    return events(f"""SELECT stream_id, w AS w_start, w + {hours * h} AS w_end, count(*) FILTER (NOT late) AS n,
 count(loss) FILTER (NOT late) AS n_known, {r6('coalesce(avg(loss) FILTER (NOT late), -1)')} AS risk, count(*) FILTER (late) AS n_late
 FROM (SELECT stream_id, loss, w, coalesce(b = {BATCHES - 1} AND w + {hours * h} <= mark, FALSE) AS late FROM (
  SELECT *, (us // {step * h} - k) * {step * h} AS w FROM placed, range(0, {n}) AS r(k)), mark) GROUP BY stream_id, w""",
    f"""ids AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS t0, max(epoch_us(ts)) OVER () AS t1
 FROM (SELECT s.stream_id, s.ts, s.loss, e.event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY row_idx) AS i FROM scored) s
 JOIN (SELECT event_id, 's' || CAST(user_id % 5 AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events) e
 USING (stream_id, i))),
placed AS (SELECT *, {place} AS b FROM ids),
mark AS (SELECT max(us) FILTER (b < {BATCHES - 1}) - 600000000 AS mark FROM placed)""")


SQL["r2_tumbling_risk"] = risk(1, 1)
SQL["r3_sliding_risk"] = risk(3, 1)
_SIX = 6 * 3600 * 1000000
SQL["r4_missing_labels"] = events(f"""SELECT stream_id, w AS w_start, w + {_SIX} AS w_end, count(*) AS n, count(loss) AS n_known,
 0::BIGINT AS n_late, {r6('CASE WHEN count(*) = count(loss) THEN avg(loss) ELSE -1 END')} AS risk FROM (SELECT pred.stream_id,
 epoch_us(ets) // {_SIX} * {_SIX} AS w, CASE WHEN label IS NOT NULL THEN least(abs(label - y_pred) / scale, 1e0) END AS loss
 FROM pred LEFT JOIN (SELECT * FROM lab WHERE late <= 3600) lab USING (event_id)) GROUP BY stream_id, w""", LABELS)
SQL["r5_feedback"] = events("SELECT stream_id, window_idx, " + ", ".join(
    f"(round(CAST(CASE WHEN n > 0 THEN {e} ELSE 0 END AS DOUBLE), 6) + 0e0) AS {c}" for c, e in FEEDBACK_SQL.items())
    + " FROM signs", feedback_ctes(2))
SQL["r5_feedback_gaps"] = events("SELECT stream_id, window_idx, CAST(n AS DOUBLE) AS fb_n_matured, " + ", ".join(
    f"{r6(f'CASE WHEN n > 0 THEN {e} ELSE 0 END')} AS {c}" for c, e in (
        ("fb_risk_last", "r[len(r)]"), ("fb_risk_mean", "list_avg(r)"), ("fb_risk_max", "list_max(r)")))
    + """ FROM (SELECT g.stream_id, g.window_idx, count(k.risk) AS n, coalesce(list(k.risk ORDER BY k.window_idx) FILTER (k.risk IS NOT NULL), [])[-5:] AS r
 FROM risk g LEFT JOIN given k ON k.stream_id = g.stream_id AND k.window_idx <= g.window_idx - 2 WHERE g.window_idx <= (
 SELECT max(window_idx) FROM given q WHERE q.stream_id = g.stream_id) GROUP BY g.stream_id, g.window_idx)""",
    "given AS (SELECT * FROM risk WHERE window_idx % 13 <> 6)")
SQL["r6_count_windows"] = events(f"""SELECT stream_id, row_idx // 20 AS window_idx, {r6('avg(loss)')} AS risk FROM scored
 GROUP BY 1, 2 HAVING count(*) = 20""")
SQL["r7_alarms"] = events("""SELECT v.stream_id, v.window_idx AS violation_at, coalesce(min(w.window_idx), -1) AS warning_at,
 coalesce(v.window_idx - min(w.window_idx), -1) AS lead_time FROM viol v LEFT JOIN (SELECT * FROM risk JOIN eps USING (stream_id)
 WHERE risk <= eps AND risk > eps - 0.03e0) w ON w.stream_id = v.stream_id AND w.window_idx < v.window_idx
 AND w.window_idx > coalesce(v.prev, -1) GROUP BY v.stream_id, v.window_idx""", """viol AS (SELECT stream_id, window_idx,
 lag(window_idx) OVER (PARTITION BY stream_id ORDER BY window_idx) AS prev FROM risk JOIN eps USING (stream_id) WHERE risk > eps)""")
