from __future__ import annotations

from .models import CURVES, TUNED, km
from .prelude import normal_tail, r6, uniform
from .streams import events, lines
from .targets import SPLIT

SQL: dict[str, str] = {}

SCORES = TUNED + """, hs AS (SELECT method, h, avg(abs(pred - r)) AS mae, sqrt(avg((pred - r) * (pred - r))) AS rmse,
 count(*) AS n FROM test_long GROUP BY method, h),
sk AS (SELECT hs.*, 1 - hs.mae / nullif(b.mae, 0) AS skill FROM hs JOIN hs b ON b.h = hs.h AND b.method = 'persistence')"""
SQL["e1_horizon_scores"] = events(f"""SELECT method, h, {r6('mae')} AS mae, {r6('rmse')} AS rmse, n, {r6('skill')} AS skill
 FROM sk""", SCORES)
SQL["e3_origin_errors"] = events(f"""SELECT stream_id, origin, method, {r6('abs(pred - r)')} AS error FROM test_long
 WHERE h = 5""", TUNED)
SQL["e4_score_summary"] = events("SELECT method, " + ", ".join(
    f"{r6(f'avg({m})')} AS {m}_mean" for m in ("mae", "rmse", "skill")) + ", " + ", ".join(
    f"{r6(f'max({m}) FILTER (WHERE h = {h})')} AS {m}_h{h}" for h in (1, 5, 10) for m in ("mae", "rmse", "skill"))
    + " FROM sk GROUP BY method", SCORES)


def brier(curves: str, test: str) -> str:
    return f"""g AS (SELECT h, greatest(s, 1e-8) AS g FROM ({km(test, '', True)})),
brier AS (SELECT method, c.h, count(*) FILTER (WHERE (y_tilde <= c.h AND event = 1) OR y_tilde > c.h) AS n,
 sum(CASE WHEN y_tilde <= c.h AND event = 1 THEN s * s / gb.g WHEN y_tilde > c.h THEN (s - 1) * (s - 1) / gh.g END) /
 nullif(count(*) FILTER (WHERE (y_tilde <= c.h AND event = 1) OR y_tilde > c.h), 0) AS brier
 FROM {curves} c JOIN g gb ON gb.h = greatest(y_tilde - 1, 1) JOIN g gh ON gh.h = c.h GROUP BY method, c.h)"""


BRIER = CURVES + "," + brier("curves", "test")
SQL["e5_brier"] = events(f"SELECT method, h, n, {r6('brier')} AS brier FROM brier", BRIER)
SQL["e6_integrated_brier"] = events(f"SELECT method, {r6('avg(brier)')} AS ipcw_ibs FROM brier GROUP BY method", BRIER)


def pairs(curves: str = "curves") -> str:
    """Brute-force comparison of every event with every later origin."""
    return f"""conc AS (SELECT i.method, i.stream_id, i.origin, sum(CASE WHEN i.s < j.s THEN 1e0 WHEN i.s = j.s THEN 0.5e0
 ELSE 0 END) AS good, count(*) AS n FROM {curves} i JOIN {curves} j ON i.method = j.method AND i.h = j.h
 AND j.y_tilde > i.y_tilde WHERE i.event = 1 AND i.h = i.y_tilde GROUP BY ALL)"""


SQL["e7_concordance"] = events(f"""SELECT method, {r6('sum(good) / sum(n)')} AS concordance, CAST(sum(n) AS BIGINT) AS n_pairs
 FROM conc GROUP BY method""", CURVES + "," + pairs())
SQL["e8_contributions"] = events(f"SELECT stream_id, origin, method, {r6('good / n')} AS contribution FROM conc",
                                 CURVES + "," + pairs())


def dcal(bins: int, curves: str = "curves") -> str:
    share = (f"CASE WHEN event = 1 THEN CAST(least(floor(s * {bins}), {bins - 1}) = b AS INTEGER) WHEN s <= 1e-8 THEN "
             f"CAST(b = 0 AS INTEGER) ELSE greatest(least((b + 1) / {bins}e0, s) - b / {bins}e0, 0) / s END")
    return f"""at_time AS (SELECT method, event, greatest(least(s, 1e0), 1e-8) AS s FROM {curves} WHERE h = y_tilde),
bins AS (SELECT method, b, sum({share}) AS c FROM at_time, range(0, {bins}) AS r(b) GROUP BY method, b),
dcal AS (SELECT method, sum(pow(c - e, 2) / e) AS chi2, max(abs(c - e)) / any_value(e) AS max_deviation FROM (SELECT *,
 sum(c) OVER (PARTITION BY method) / {bins} AS e FROM bins) GROUP BY method)"""


SQL["e9_d_calibration"] = events(f"""SELECT method, {r6('chi2')} AS chi2, {r6('max_deviation')} AS max_deviation,
 9::BIGINT AS df FROM dcal""", CURVES + "," + dcal(10))
_P9 = (f"(2 * {normal_tail('(-sqrt(chi2))')} + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2) * (1 + chi2 / 3 + pow(chi2, 2) / 15 "
       "+ pow(chi2, 3) / 105))")
# The series of normal_tail has 2,000 terms, too few for a statistic over 4,000; the tail beyond 1,400 is under 1e-290.
_P9_LARGE = f"CASE WHEN chi2 > 1400 THEN 0e0 ELSE {_P9} END"
SQL["e9_d_calibration_p"] = events(f"""SELECT method, {r6('chi2')} AS chi2, {r6('max_deviation')} AS max_deviation,
 9::BIGINT AS df, {r6(_P9_LARGE)} AS p FROM dcal""", CURVES + "," + dcal(10))
SQL["e10_calibration_curve"] = events(f"""SELECT method, bin, {r6('predicted')} AS predicted, {r6('observed')} AS observed, n,
 {r6('sum(n * abs(predicted - observed)) OVER (PARTITION BY method) / sum(n) OVER (PARTITION BY method)')} AS ece
 FROM per""", CURVES + f""", per AS (SELECT method, CAST(len(list_filter({[i * 0.1 for i in range(10)]!r}::DOUBLE[],
 lambda e: 1 - s >= e)) - 1 AS BIGINT) AS bin, avg(1 - s) AS predicted,
 avg(CAST(y_tilde <= 10 AND event = 1 AS INTEGER)) AS observed, count(*) AS n FROM curves WHERE h = 10 AND
 ((y_tilde <= 10 AND event = 1) OR y_tilde > 10) GROUP BY 1, 2)""")
SQL["e11_horizon_error"] = events(f"""SELECT {r6('avg(abs(m - y_tilde)) FILTER (WHERE event = 1)')} AS vhmae,
 count(*) FILTER (WHERE event = 1) AS n_uncensored, {r6('1 - avg(event)')} AS censoring_rate FROM (SELECT stream_id, origin,
 any_value(y_tilde) AS y_tilde, any_value(event) AS event, coalesce(min(h) FILTER (WHERE s <= 0.5e0), 21) AS m FROM curves
 WHERE method = 'age_kaplan_meier' GROUP BY stream_id, origin)""", CURVES)
WARN = """warn AS (SELECT stream_id, origin, anchor > eps - 0.03e0 AS warned, event = 1 AND y_tilde <= 3 AS violates,
 event, y_tilde FROM origins)"""
SQL["e12_lead_time"] = events("""SELECT stream_id, origin, CAST(y_tilde AS BIGINT) AS lead_time FROM warn
 WHERE warned AND event = 1""", WARN)
SQL["e13_warning_scores"] = events(f"""SELECT stream_id, {r6('count(*) FILTER (WHERE warned AND violates) / nullif(count(*) FILTER (WHERE warned), 0)')}
 AS precision, {r6('count(*) FILTER (WHERE warned AND violates) / nullif(count(*) FILTER (WHERE violates), 0)')} AS recall,
 {r6('100 * count(*) FILTER (WHERE warned AND NOT violates) / count(*)')} AS false_per_100 FROM warn GROUP BY stream_id""", WARN)

PAIRS = TUNED + """, ab AS (SELECT x.stream_id, x.origin, x.h, y.method AS baseline, abs(x.pred - x.r) AS a,
 abs(y.pred - y.r) AS b FROM test_long x JOIN test_long y ON x.stream_id = y.stream_id AND x.origin = y.origin AND x.h = y.h
 AND y.method <> x.method WHERE x.method = 'exponential_smoothing' AND x.h IN (1, 5, 10))"""
SQL["e14_cliffs_delta"] = events(f"""SELECT x.h, x.baseline, {r6('avg(sign(round(x.a, 12) - round(y.b, 12)))')} AS effect_delta
 FROM ab x JOIN ab y ON x.h = y.h AND x.baseline = y.baseline GROUP BY x.h, x.baseline""", PAIRS)
SQL["e15_paired_d"] = events(f"""SELECT h, baseline, {r6('''CASE WHEN count(*) < 2 THEN NULL WHEN stddev_samp(a - b) > 0 THEN
 avg(a - b) / stddev_samp(a - b) ELSE 0 END''')} AS effect_d FROM ab GROUP BY h, baseline""", PAIRS)
SQL["e16_signed_ranks"] = events(f"""SELECT h, baseline, {r6('sum(rk * CASE WHEN d > 0 THEN 1 WHEN d = 0 THEN 0.5e0 ELSE 0 END)')}
 AS w_plus, count(*) AS n_pairs, {r6('CAST(sum(t * t - 1) AS DOUBLE)')} AS tie_sum, count(*) FILTER (WHERE d = 0) AS n_zero,
 count(*) FILTER (WHERE far) AS n_far FROM (SELECT *, rank() OVER (PARTITION BY h, baseline ORDER BY abs(d))
 + (count(*) OVER (PARTITION BY h, baseline, abs(d)) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY h, baseline, abs(d)) AS t
 FROM (SELECT h, baseline, round(a - b, 12) AS d, abs(a - b) > 1e-8 + 1e-5 * abs(b) AS far FROM ab)) GROUP BY h, baseline""", PAIRS)
SQL["e19_comparison"] = events(f"""SELECT h, baseline, {r6('method_mean')} AS method_mean, {r6('baseline_mean')} AS baseline_mean, n_pairs,
 {r6('p')} AS p_raw, {r6('effect_delta')} AS effect_delta, {r6('effect_d')} AS effect_d, {r6('adj')} AS p_adjusted,
 CAST(adj <= 0.05e0 AS BIGINT) AS rejected, CAST(adj <= 0.05e0 AND abs(effect_delta) >= 0.147e0 AS BIGINT) AS beats
 FROM (SELECT *, least(max((n - i + 1) * p) OVER (PARTITION BY h ORDER BY i), 1e0) AS adj FROM (SELECT *,
 row_number() OVER (PARTITION BY h ORDER BY p) AS i, count(*) OVER (PARTITION BY h) AS n FROM tested))
 JOIN means USING (h, baseline) JOIN delta USING (h, baseline)""", PAIRS + f""",
ranked AS (SELECT *, rank() OVER (PARTITION BY h, baseline ORDER BY abs(d)) + (count(*) OVER (PARTITION BY h, baseline, abs(d)) - 1) / 2e0 AS rk,
 count(*) OVER (PARTITION BY h, baseline, abs(d)) AS t FROM (SELECT h, baseline, round(a - b, 12) AS d, abs(a - b) > 1e-8 + 1e-5 * abs(b) AS far FROM ab)),
w AS (SELECT h, baseline, sum(rk * CASE WHEN d > 0 THEN 1 WHEN d = 0 THEN 0.5e0 ELSE 0 END) AS w, CAST(count(*) AS DOUBLE) AS m,
 CAST(sum(t * t - 1) AS DOUBLE) AS ties, count(*) FILTER (WHERE far) AS n_far FROM ranked GROUP BY h, baseline),
zs AS (SELECT *, (w - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - 0.5e0 * ties) / 24) AS z FROM w),
tested AS (SELECT h, baseline, CAST(m AS BIGINT) AS n_pairs, CASE WHEN m < 5 OR n_far = 0 THEN 1e0 ELSE {normal_tail('z')} END AS p FROM zs),
means AS (SELECT h, baseline, avg(a) AS method_mean, avg(b) AS baseline_mean, CASE WHEN count(*) < 2 THEN NULL WHEN stddev_samp(a - b) > 0 THEN
 avg(a - b) / stddev_samp(a - b) ELSE 0 END AS effect_d FROM ab GROUP BY h, baseline),
delta AS (SELECT x.h, x.baseline, avg(sign(round(x.a, 12) - round(y.b, 12))) AS effect_delta FROM ab x JOIN ab y ON x.h = y.h
 AND x.baseline = y.baseline GROUP BY x.h, x.baseline)""")
SQL["e18_blocked_bootstrap"] = events(f"""SELECT p.method, {r6('point')} AS point, {r6('lo')} AS lo, {r6('hi')} AS hi, n_blocks
 FROM (SELECT method, sum(s) / sum(n) AS point, count(*) AS n_blocks FROM blocks GROUP BY method) p JOIN (SELECT method,
 quantile_cont(m, (1e0 - 0.95e0) / 2) AS lo, quantile_cont(m, 1e0 - (1e0 - 0.95e0) / 2) AS hi FROM (SELECT k.method, draw,
 sum(s) / sum(n) AS m FROM picks k JOIN blocks b ON b.method = k.method AND b.id = k.pick GROUP BY k.method, draw)
 GROUP BY method) q USING (method)""", TUNED + f""",
blocks AS (SELECT method, sum(abs(pred - r)) AS s, count(*) AS n, row_number() OVER (PARTITION BY method ORDER BY
 {uniform('block', 'stream_id')}, stream_id) - 1 AS id, count(*) OVER (PARTITION BY method) AS nb FROM test_long WHERE h = 5
 GROUP BY method, stream_id),
picks AS (SELECT method, draw, CAST(floor({uniform('boot', 'method', 'draw', 'id')} * nb) AS BIGINT) AS pick
 FROM blocks, range(0, 2000) AS d(draw))""")
# Bit draw % 128 of the digest of a block's name and draw // 128.
_FLIP = ("(CAST('0x' || substr(md5(concat_ws('|', 'flip', CAST(h AS VARCHAR), baseline, stream_id, CAST(draw // 128 AS VARCHAR))), "
         "CAST(1 + draw % 128 // 4 AS BIGINT), 1) AS INTEGER) >> CAST(3 - draw % 4 AS INTEGER)) % 2 = 1")
MM = """,
mm AS (SELECT *, avg(m) OVER (PARTITION BY h, baseline) AS obs, count(*) OVER (PARTITION BY h, baseline) AS nb FROM
 (SELECT h, baseline, stream_id, round(avg(a - b), 12) AS m FROM ab GROUP BY h, baseline, stream_id))"""
SQL["e20_blocked_permutation"] = events(f"""SELECT h, baseline, {r6('any_value(obs)')} AS observed, any_value(nb) AS n_blocks,
 {r6('greatest(avg(CAST(abs(nul) >= abs(obs) - 1e-12 AS INTEGER)), 1 / 20000)')} AS p_value,
 {r6('pow(2e0, 1 - any_value(nb))')} AS min_attainable_p FROM (SELECT h, baseline, draw, any_value(obs) AS obs, any_value(nb)
 AS nb, avg(CASE WHEN {_FLIP} THEN -m ELSE m END) AS nul
 FROM mm, range(0, 20000) AS d(draw) GROUP BY h, baseline, draw) GROUP BY h, baseline""", PAIRS + MM)
SQL["e17_holm"] = events(f"""SELECT h, baseline, {r6('p')} AS p_raw, {r6('adj')} AS p_adjusted, CAST(adj <= 0.05e0 AS BIGINT)
 AS rejected FROM (SELECT *, least(max((n - i + 1) * p) OVER (PARTITION BY h ORDER BY i), 1e0) AS adj FROM (SELECT *,
 row_number() OVER (PARTITION BY h ORDER BY p) AS i, count(*) OVER (PARTITION BY h) AS n FROM flips))""", PAIRS + MM + f""",
flips AS (SELECT h, baseline, greatest(avg(CAST(abs(nul) >= abs(obs) - 1e-12 AS INTEGER)), 1 / 20000) AS p FROM (
 SELECT h, baseline, draw, any_value(obs) AS obs,
 avg(CASE WHEN {_FLIP} THEN -m ELSE m END) AS nul
 FROM mm, range(0, 20000) AS d(draw) GROUP BY h, baseline, draw) GROUP BY h, baseline)""")
TAGGED = CURVES + """, tagged AS (SELECT method || '|' || stream_id AS method, stream_id, origin, y_tilde, event, h, s FROM curves)"""
RESULTS = (TAGGED + "," + pairs("tagged") + "," + dcal(10, "tagged") + "," + brier("tagged", "test") + f""",
results AS (SELECT split_part(method, '|', 1) AS method, concordance, ibs, {_P9} AS p FROM dcal JOIN (SELECT method,
 sum(good) / sum(n) AS concordance FROM conc GROUP BY method) USING (method) JOIN (SELECT method, avg(brier) AS ibs FROM brier
 GROUP BY method) USING (method))""")
SQL["e21_seed_summary"] = events(f"""SELECT method, count(*) AS n_seeds, {r6('avg(concordance)')} AS c_mean,
 {r6('stddev_pop(concordance)')} AS c_sd, {r6('avg(ibs)')} AS ibs_mean, {r6('stddev_pop(ibs)')} AS ibs_sd,
 {r6('median(p)')} AS d_cal_p_median, count(*) FILTER (WHERE p < 0.05e0) AS d_cal_rejected_seeds,
 {r6('avg(concordance - 0.5e0)')} AS mean_delta, 0.01e0 AS mean_p_adj, count(*) FILTER (WHERE concordance > 0.5e0)
 AS seeds_beaten FROM results GROUP BY method""", RESULTS.replace(_P9, _P9_LARGE))
SQL["e23_equivalence"] = events(f"""SELECT method, {r6('avg(concordance)')} AS mean_value,
 {r6('abs(avg(concordance) - 0.5e0)')} AS deviation, CAST(abs(avg(concordance) - 0.5e0) > 0.1e0 AS BIGINT) AS outside_band
 FROM results GROUP BY method""", RESULTS)
_EO = events("SELECT 'events:' || stream_id AS d, 'SOCIAL' AS c, count(*) AS n, avg(event) AS share FROM origins GROUP BY stream_id")
_LO = lines("SELECT 'lines:' || stream_id AS d, 'PHYSICAL' AS c, count(*) AS n, avg(event) AS share FROM origins GROUP BY stream_id")
SQL["e22_verdict"] = f"""SELECT *, CASE WHEN n_physical < 3 THEN 'UNDECIDED' WHEN n_social_beaten > 0 THEN 'REFUTED'
 WHEN n_physical_beaten >= 2 THEN 'SUPPORTED' ELSE 'REFUTED' END AS verdict FROM (SELECT
 count(*) FILTER (WHERE n >= 60 AND d <> 'lines:s4' AND c = 'PHYSICAL') AS n_physical,
 count(*) FILTER (WHERE n >= 60 AND d <> 'lines:s4' AND share > 0.95e0 AND c = 'PHYSICAL') AS n_physical_beaten,
 count(*) FILTER (WHERE n >= 60 AND d <> 'lines:s4' AND share > 0.95e0 AND c = 'SOCIAL') AS n_social_beaten
 FROM (SELECT * FROM ({_EO}) UNION ALL SELECT * FROM ({_LO})))"""
SQL["e22_tiers"] = events("""SELECT stream_id AS dataset, CASE WHEN stream_id = 's1' THEN 'NONE' ELSE 'PHYSICAL' END AS drift_class,
 CAST(count(*) >= 70 AS BIGINT) AS usable, CASE WHEN stream_id IN ('s0', 's1') OR count(*) < 70 THEN 'SECONDARY' ELSE 'PRIMARY'
 END AS tier, CASE WHEN stream_id = 's0' THEN 'hypothesis-generating' WHEN stream_id = 's1' THEN 'drift class not in the test'
 WHEN count(*) < 70 THEN 'fails the usability screen' ELSE 'usable and classified' END AS tier_reason FROM origins
 GROUP BY stream_id""")
SQL["e24_rank_auc"] = events(f"""SELECT p.stream_id, {r6('avg(CASE WHEN p.risk_now > q.risk_now THEN 1e0 WHEN p.risk_now = q.risk_now THEN 0.5e0 ELSE 0 END)')}
 AS auc FROM (SELECT * FROM origins WHERE event = 1 AND y_tilde <= 5) p JOIN (SELECT * FROM origins WHERE NOT (event = 1 AND
 y_tilde <= 5)) q USING (stream_id) GROUP BY p.stream_id""")
SQL["contest_survival"] = lines(f"""SELECT method, {r6('concordance')} AS concordance, n_pairs, {r6('ibs')} AS ipcw_ibs,
 {r6('chi2')} AS chi2, {r6('max_deviation')} AS max_deviation, 9::BIGINT AS df FROM dcal JOIN (SELECT method,
 sum(good) / sum(n) AS concordance, CAST(sum(n) AS BIGINT) AS n_pairs FROM conc GROUP BY method) USING (method) JOIN (SELECT
 method, avg(brier) AS ibs FROM brier GROUP BY method) USING (method)""",
    CURVES + "," + pairs() + "," + dcal(10) + "," + brier("curves", "test"))
