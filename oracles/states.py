from __future__ import annotations

from .prelude import entropy, r6, uniform
from .streams import events, given, lines
from .targets import SPLIT

SQL: dict[str, str] = {}
D = range(1, 5)
_DEP = "scored WHERE segment = 'dep' AND window_idx IS NOT NULL"

FEATURES = """
pre_long AS (SELECT stream_id, CAST(i - 1 AS BIGINT) AS feature, x[i] AS value FROM seg,
        range(1, 5) AS r(i) WHERE segment = 'pre'),
fref AS (SELECT stream_id, feature, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN
        stddev_pop(value) ELSE 1e0 END AS std, list_sort(list_distinct([""" + ", ".join(
    f"quantile_cont(value, {i}/10e0)" for i in range(11)) + """])) AS q
        FROM pre_long GROUP BY stream_id, feature),
fcut AS (SELECT stream_id, feature, greatest(len(q) - 1, 1) AS n_bins,
        CASE WHEN len(q) > 2 THEN q[2:len(q) - 1] ELSE [] END AS cuts FROM fref),
sample AS (SELECT * FROM (SELECT stream_id, row_idx, x, row_number() OVER (PARTITION BY stream_id
        ORDER BY """ + uniform("reference", "row_idx") + """, row_idx) AS rank FROM seg
        WHERE segment = 'pre') WHERE rank <= 2000),
scale AS (SELECT stream_id, """ + ", ".join(
    f"max(mean) FILTER (WHERE feature = {i - 1}) AS m{i}, max(std) FILTER (WHERE feature = {i - 1}) AS d{i}"
    for i in D) + """ FROM fref GROUP BY stream_id),
zpre AS (SELECT stream_id, row_idx, """ + ", ".join(f"(x[{i}] - m{i}) / d{i} AS z{i}" for i in D) + """
        FROM seg JOIN scale USING (stream_id) WHERE segment = 'pre'),
zsample AS (SELECT stream_id, rank, """ + ", ".join(f"(x[{i}] - m{i}) / d{i} AS z{i}" for i in D) + """
        FROM sample JOIN scale USING (stream_id)),
zdep AS (SELECT stream_id, window_idx, seg_row, """ + ", ".join(
    f"(x[{i}] - m{i}) / d{i} AS z{i}" for i in D) + """ FROM seg JOIN scale USING (stream_id)
        WHERE segment = 'dep' AND window_idx IS NOT NULL)"""


def _d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.z{i} - {b}.z{i}) * ({a}.z{i} - {b}.z{i})" for i in D) + ")"


SQL["f1_feature_moments"] = lines(f"SELECT stream_id, feature, {r6('mean')} AS mean, {r6('std')} AS std FROM fref", FEATURES)
SQL["f2_psi_edges"] = lines(f"""SELECT stream_id, feature, CAST(n_bins AS BIGINT) AS n_bins,
 CAST(i - 1 AS BIGINT) AS position, {r6('cuts[i]')} AS cut FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS i
 FROM fcut)""", FEATURES)
SQL["f3_reference_sample"] = lines("SELECT stream_id, rank, row_idx FROM sample", FEATURES)
BAND = f"""band AS (SELECT a.stream_id, sqrt(median({_d2('a', 'b')}) / 2e0) AS bandwidth
 FROM zsample a JOIN zsample b ON a.stream_id = b.stream_id AND a.rank < b.rank
 GROUP BY a.stream_id)"""
SQL["f4_bandwidth"] = lines(f"SELECT stream_id, {r6('bandwidth')} AS bandwidth FROM band", FEATURES + "," + BAND)
EREF = """eref AS (SELECT stream_id, CAST(i - 1 AS BIGINT) AS feature, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0
 THEN stddev_pop(v) ELSE 1e0 END AS std FROM (SELECT stream_id, unnest([1,2,3,4]) AS i, unnest([z1,z2,z3,z4]) AS v
 FROM zpre) GROUP BY ALL)"""
SQL["f5_embedding_moments"] = lines(f"SELECT stream_id, feature, {r6('mean')} AS mean, {r6('std')} AS std FROM eref",
                                    FEATURES + "," + EREF)
P = [f"proba[{i}]" for i in (1, 2, 3)]
C = [f"least(greatest(proba[{i}], 1e-12), 1e0)" for i in (1, 2, 3)]
BEHAVE = "behave AS (SELECT stream_id, " + ", ".join(
    f"count(*) FILTER (WHERE top = {k}) / count(*) AS prior_{k}" for k in range(3)) + f""",
 avg(list_max(proba)) AS confidence_mean, avg({entropy(P)}) AS entropy_mean FROM scored
 WHERE segment = 'pre' GROUP BY stream_id)"""
SQL["f8_behaviour"] = lines("SELECT stream_id, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ("prior_0", "prior_1", "prior_2", "confidence_mean", "entropy_mean"))
    + " FROM behave", BEHAVE)

_QS = (("q10", .1), ("q25", .25), ("q50", .5), ("q75", .75), ("q90", .9))
PRED = f"""pred_rows AS (SELECT stream_id, window_idx, top, greatest({', '.join(C)}) AS msp, {entropy(P)} AS ent,
 list_sort([{', '.join(C)}], 'DESC') AS ranked FROM {_DEP}),
pred AS (SELECT stream_id, window_idx, avg(msp) AS pred_msp_mean, stddev_pop(msp) AS pred_msp_std, """ + ", ".join(
    f"quantile_cont(msp, {q}e0) AS pred_msp_{n}" for n, q in _QS) + """, avg(ent) AS pred_entropy_mean,
 stddev_pop(ent) AS pred_entropy_std, avg(ranked[1] - ranked[2]) AS pred_margin_mean, """ + ", ".join(
    f"least(greatest(count(*) FILTER (WHERE top = {k}) / count(*), 1e-12), 1e0) AS now_{k}" for k in range(3)) + """
 FROM pred_rows GROUP BY stream_id, window_idx)"""
_B = [f"least(greatest(prior_{k}, 1e-12), 1e0)" for k in range(3)]
_PCOLS = ["pred_msp_mean", "pred_msp_std"] + [f"pred_msp_{n}" for n, _ in _QS] + [
    "pred_entropy_mean", "pred_entropy_std", "pred_margin_mean"]
SQL["s1_prediction_block"] = lines("SELECT stream_id, window_idx, " + ", ".join(f"{r6(c)} AS {c}" for c in _PCOLS)
    + ", " + r6(" + ".join(f"now_{k} * ln(now_{k} / {_B[k]})" for k in range(3))) + " AS pred_class_kl, "
    + r6("0.5e0 * (" + " + ".join(f"abs(now_{k} - {_B[k]})" for k in range(3)) + ")") + " AS pred_class_tv, "
    + r6("pred_msp_mean - confidence_mean") + " AS pred_conf_shift, "
    + r6("pred_entropy_mean - entropy_mean") + " AS pred_entropy_shift FROM pred JOIN behave USING (stream_id)",
    BEHAVE + "," + PRED)
SQL["s6_value_predictions"] = events("SELECT stream_id, window_idx, " + r6("avg(y_pred)") + " AS pred_mean, "
    + r6("stddev_pop(y_pred)") + " AS pred_std, " + ", ".join(
        r6(f"quantile_cont(y_pred, {q}e0)") + f" AS pred_{n}" for n, q in _QS) + ", "
    + r6("max(y_pred) - min(y_pred)") + " AS pred_range, " + r6("var_pop(y_pred)") + " AS unc_pred_var, "
    + r6("quantile_cont(y_pred, 0.75e0) - quantile_cont(y_pred, 0.25e0)") + " AS unc_pred_iqr, "
    + ", ".join(f"0e0 AS {c}" for c in ("unc_energy_mean", "unc_epistemic", "unc_aleatoric", "unc_ensemble_var"))
    + f" FROM {_DEP} GROUP BY stream_id, window_idx")


def _members(m: int) -> list[str]:
    return [f"least(greatest(members[{m}][{k}], 1e-12), 1e0)" for k in (1, 2, 3)]


_MEAN = ["((" + " + ".join(_members(m)[k] for m in range(1, 6)) + ") / 5)" for k in range(3)]
_ALEA = "((" + " + ".join(entropy(_members(m)) for m in range(1, 6)) + ") / 5)"
_LAST = "((" + " + ".join(_members(m)[2] for m in range(1, 6)) + ") / 5)"
_SPREAD = "((" + " + ".join(f"({_members(m)[2]} - {_LAST}) * ({_members(m)[2]} - {_LAST})" for m in range(1, 6)) + ") / 5)"
UNC = f"""unc_rows AS (SELECT stream_id, window_idx, {entropy(P)} AS ent,
 -(list_max(raw) + ln(exp(raw[1] - list_max(raw)) + exp(raw[2] - list_max(raw)) + exp(raw[3] - list_max(raw)))) AS energy,
 {_ALEA} AS alea, {entropy(_MEAN)} AS tot, {_SPREAD} AS spread FROM {_DEP}),
unc AS (SELECT stream_id, window_idx, avg(ent) AS unc_entropy_mean, quantile_cont(ent, 0.9e0) AS unc_entropy_q90,
 max(ent) AS unc_entropy_max, avg(energy) AS unc_energy_mean, quantile_cont(energy, 0.1e0) AS unc_energy_q10,
 avg(alea) AS unc_aleatoric, avg(tot - alea) AS unc_epistemic, avg(spread) AS unc_ensemble_var
 FROM unc_rows GROUP BY stream_id, window_idx)"""
_UC = ["unc_entropy_mean", "unc_entropy_q90", "unc_entropy_max", "unc_energy_mean", "unc_energy_q10",
       "unc_aleatoric", "unc_epistemic", "unc_ensemble_var"]
SQL["s14_uncertainty"] = lines("SELECT stream_id, window_idx, " + ", ".join(f"{r6(c)} AS {c}" for c in _UC)
                               + " FROM unc", UNC)
SQL["s17_members"] = lines("SELECT stream_id, window_idx, " + ", ".join(
    r6(f"avg(members[{i + 1}][3])") + f" AS member_{i}" for i in range(5))
    + f" FROM {_DEP} GROUP BY stream_id, window_idx")


def _vol(c: str) -> str:
    return f"CASE WHEN count({c}) OVER p >= 2 THEN stddev_pop({c}) OVER p ELSE 0e0 END"


SQL["s7_volatility"] = lines(f"""SELECT stream_id, window_idx, {r6(_vol('pred_msp_mean'))} AS pred_volatility,
 {r6(_vol('unc_entropy_mean'))} AS unc_volatility, {r6('''CASE WHEN count(pred_msp_mean) OVER p >= 2 THEN
 last_value(pred_msp_mean) OVER p - first_value(pred_msp_mean) OVER p ELSE 0e0 END''')} AS pred_trend
 FROM pred JOIN unc USING (stream_id, window_idx)
 WINDOW p AS (PARTITION BY stream_id ORDER BY window_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", PRED + "," + UNC)
_NORM = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in D) + ")"
SQL["s9_representation"] = lines(f"""SELECT stream_id, window_idx, {r6(f'avg({_NORM})')} AS rep_norm_mean,
 {r6(f'stddev_pop({_NORM})')} AS rep_norm_std, {r6('sqrt((' + ' + '.join(
    f'pow((avg(z{i}) - any_value(e{i}.mean)) / any_value(e{i}.std), 2)' for i in D) + ') / 4)')} AS rep_centroid_shift
 FROM zdep """ + " ".join(f"JOIN eref e{i} ON e{i}.stream_id = zdep.stream_id AND e{i}.feature = {i - 1}" for i in D)
    .replace("zdep.stream_id AND", "zdep.stream_id AND") + " GROUP BY ALL", FEATURES + "," + EREF).replace(
    "SELECT stream_id, window_idx, (round(avg(sqrt", "SELECT zdep.stream_id, window_idx, (round(avg(sqrt")
SQL["s11_covariance_trace"] = lines("SELECT stream_id, window_idx, " + r6(" + ".join(f"var_samp(z{i})" for i in D))
    + " AS rep_cov_trace FROM zdep GROUP BY stream_id, window_idx", FEATURES)


def _logdet(ridge: float = 0.0) -> str:
    """Logarithm of the determinant of the 4 x 4 matrix of cov(zi, zj), by 2 x 2 minors."""
    m = lambda i, j: f"(m{min(i, j)}{max(i, j)}" + (f" + {ridge!r}::DOUBLE)" if i == j else ")")
    minor = lambda a, b, i, j: f"({m(a, i)} * {m(b, j)} - {m(b, i)} * {m(a, j)})"
    pairs = [(1, 2, 3, 4, "+"), (1, 3, 2, 4, "-"), (1, 4, 2, 3, "+"), (2, 3, 1, 4, "+"), (2, 4, 1, 3, "-"), (3, 4, 1, 2, "+")]
    return "ln(0e0 " + " ".join(f"{s} {minor(1, 2, i, j)} * {minor(3, 4, k, l)}" for i, j, k, l, s in pairs) + ")"


def _cov(kind: str) -> str:
    return ", ".join(f"{kind}(z{i}, z{j}) AS m{i}{j}" for i in D for j in D if i <= j)


SQL["s11_covariance_logdet"] = lines(f"SELECT stream_id, window_idx, {r6(_logdet(1e-9))} AS rep_cov_logdet FROM (SELECT stream_id, "
    f"window_idx, {_cov('covar_samp')} FROM zdep GROUP BY stream_id, window_idx)", FEATURES)
SQL["f6_axis_invariants"] = lines(f"SELECT stream_id, {r6('m11 + m22 + m33 + m44')} AS trace, {r6(_logdet())} AS log_determinant, "
    f"0e0 AS skew FROM (SELECT stream_id, {_cov('covar_pop')} FROM zpre GROUP BY stream_id)", FEATURES)
SQL["s12_coordinate_invariants"] = lines("SELECT zdep.stream_id, window_idx, 1e0 AS rep_pca_energy, " + r6(" + ".join(
    f"pow(avg(zdep.z{i}) - any_value(c.m{i}), 2)" for i in D)) + " AS distance2 FROM zdep JOIN (SELECT stream_id, "
    + ", ".join(f"avg(z{i}) AS m{i}" for i in D) + " FROM zpre GROUP BY stream_id) c USING (stream_id) "
    "GROUP BY zdep.stream_id, window_idx", FEATURES)
SQL["s13_neighbour_distance"] = lines(f"""SELECT stream_id, window_idx, {r6('avg(d)')} AS rep_knn_dist_mean,
 {r6('quantile_cont(d, 0.9e0)')} AS rep_knn_dist_q90, {r6('max(d)')} AS rep_knn_dist_max FROM (
 SELECT a.stream_id, a.window_idx, a.seg_row, list_avg(list_transform(min({_d2('a', 'b')}, 10), lambda v: sqrt(v))) AS d
 FROM zdep a JOIN zsample b ON a.stream_id = b.stream_id GROUP BY ALL) GROUP BY stream_id, window_idx""", FEATURES)
SQL["s19_kernel_discrepancy"] = lines(f"""SELECT stream_id, window_idx, {r6('kaa + kbb - 2 * kab')} AS dist_mmd2
 FROM aa JOIN bb USING (stream_id) JOIN ab USING (stream_id, window_idx)""", FEATURES + "," + BAND + f""",
bb AS (SELECT a.stream_id, avg(exp(-{_d2('a', 'b')} / (2 * bandwidth * bandwidth))) AS kbb FROM zsample a
 JOIN zsample b ON a.stream_id = b.stream_id AND a.rank <> b.rank JOIN band ON band.stream_id = a.stream_id GROUP BY a.stream_id),
aa AS (SELECT a.stream_id, a.window_idx, avg(exp(-{_d2('a', 'b')} / (2 * bandwidth * bandwidth))) AS kaa FROM zdep a
 JOIN zdep b ON a.stream_id = b.stream_id AND a.window_idx = b.window_idx AND a.seg_row <> b.seg_row
 JOIN band ON band.stream_id = a.stream_id GROUP BY a.stream_id, a.window_idx),
ab AS (SELECT a.stream_id, a.window_idx, avg(exp(-{_d2('a', 'b')} / (2 * bandwidth * bandwidth))) AS kab FROM zdep a
 JOIN zsample b ON a.stream_id = b.stream_id JOIN band ON band.stream_id = a.stream_id
 GROUP BY a.stream_id, a.window_idx)""")


def _ecdf(tag: str) -> str:
    return f"""
{tag}_s AS (SELECT stream_id, window_idx, f, v, count(*) AS na, 0 AS nb FROM (SELECT stream_id, window_idx,
  unnest([1,2,3,4]) AS f, unnest([z1,z2,z3,z4]) AS v FROM zdep) GROUP BY ALL
 UNION ALL SELECT w.stream_id, w.window_idx, f, v, 0, n FROM (SELECT DISTINCT stream_id, window_idx FROM zdep) w JOIN
  (SELECT stream_id, f, v, count(*) AS n FROM (SELECT stream_id, unnest([1,2,3,4]) AS f, unnest([z1,z2,z3,z4]) AS v
   FROM zsample) GROUP BY ALL) r ON r.stream_id = w.stream_id),
{tag}_c AS (SELECT stream_id, window_idx, f, v, sum(na) AS na, sum(nb) AS nb FROM {tag}_s GROUP BY ALL),
{tag}_f AS (SELECT stream_id, window_idx, f, lead(v) OVER o - v AS dx, sum(na) OVER o / sum(na) OVER t
  - sum(nb) OVER o / sum(nb) OVER t AS gap FROM {tag}_c WINDOW o AS (PARTITION BY stream_id, window_idx, f ORDER BY v),
  t AS (PARTITION BY stream_id, window_idx, f)),
{tag} AS (SELECT stream_id, window_idx, f, sum(dx * abs(gap)) AS w1, max(abs(gap)) AS ks,
  sqrt(2 * sum(dx * gap * gap)) AS en FROM {tag}_f GROUP BY ALL)"""


SQL["s20_distribution_distances"] = lines("SELECT full_set.stream_id, full_set.window_idx, " + ", ".join(
    f"{r6(f'avg(full_set.{c})')} AS dist_{n}_mean, {r6(f'max(full_set.{c})')} AS dist_{n}_max, "
    f"{r6(f'quantile_cont(full_set.{c}, 0.9e0)')} AS dist_{n}_q90" for n, c in (("wasserstein", "w1"), ("ks", "ks")))
    + ", " + r6("avg(full_set.en)") + """ AS dist_energy FROM full_set
 GROUP BY full_set.stream_id, full_set.window_idx""",
    FEATURES + "," + _ecdf("full_set"))
SQL["s23_stability_index"] = lines("SELECT stream_id, window_idx, " + r6("sqrt(avg(m * m))") + " AS dist_mean_shift, "
    + r6("avg(s)") + " AS dist_scale_ratio, " + r6("avg(psi)") + " AS dist_psi_mean, " + r6("max(psi)")
    + " AS dist_psi_max, " + r6("quantile_cont(psi, 0.9e0)") + " AS dist_psi_q90 FROM per GROUP BY stream_id, window_idx",
    FEATURES + """, long_dep AS (SELECT s.stream_id, s.window_idx, f.feature, n_bins, (s.x[f.feature + 1] - f.mean) / f.std AS z,
 len(list_filter(cuts, lambda e: e <= s.x[f.feature + 1])) AS bin FROM seg s JOIN fref f USING (stream_id)
 JOIN fcut c ON c.stream_id = f.stream_id AND c.feature = f.feature WHERE segment = 'dep' AND window_idx IS NOT NULL),
per AS (SELECT stream_id, window_idx, feature, avg(z) AS m, stddev_pop(z) AS s, """ + " + ".join(
    f"CASE WHEN n_bins > {b} THEN (greatest(count(*) FILTER (WHERE bin = {b}) / count(*), 1e-6) - 1e0 / n_bins) * "
    f"ln(greatest(count(*) FILTER (WHERE bin = {b}) / count(*), 1e-6) / (1e0 / n_bins)) ELSE 0 END" for b in range(10))
    + " AS psi FROM long_dep GROUP BY stream_id, window_idx, feature, n_bins)")

FB = """known AS (SELECT r.stream_id, r.window_idx, risk_mean, k.rs AS rs FROM risk r
 JOIN (SELECT stream_id, avg(risk) AS risk_mean FROM pre_risk GROUP BY stream_id) USING (stream_id)
 LEFT JOIN (SELECT stream_id, window_idx + {d} AS window_idx, list(risk) OVER (PARTITION BY stream_id ORDER BY window_idx)
 AS rs FROM risk) k USING (stream_id, window_idx)),
recent AS (SELECT *, coalesce(len(rs), 0) AS n, CASE WHEN len(rs) > 0 THEN rs[greatest(len(rs) - 4, 1):len(rs)] END AS r FROM known),
moves AS (SELECT *, list_transform(range(2, len(r) + 1), lambda i: r[i] - r[i - 1]) AS d FROM recent),
signs AS (SELECT *, list_filter(list_transform(d, lambda v: sign(v)), lambda s: s <> 0) AS sg FROM moves)"""


def _fb(delay: int) -> str:
    return FB.replace("{d}", str(delay))


_SLOPES = ("flatten(list_transform(range(1, len(r)), lambda i: list_transform(range(i + 1, len(r) + 1), "
           "lambda j: (r[j] - r[i]) / (j - i))))")
_FBC = {"fb_available": "1e0", "fb_n_matured": "n", "fb_risk_last": "r[len(r)]", "fb_risk_mean": "list_avg(r)",
        "fb_risk_std": "list_stddev_pop(r)", "fb_risk_min": "list_min(r)", "fb_risk_max": "list_max(r)",
        "fb_risk_slope": f"CASE WHEN len(r) >= 2 THEN list_median({_SLOPES}) ELSE 0 END",
        "fb_risk_delta": "CASE WHEN len(r) >= 2 THEN r[len(r)] - r[len(r) - 1] ELSE 0 END",
        "fb_risk_vs_reference": "r[len(r)] - risk_mean",
        "fb_sign_changes": "CASE WHEN len(r) >= 3 THEN len(list_filter(range(2, len(sg) + 1), "
                           "lambda i: sg[i] <> sg[i - 1])) ELSE 0 END",
        "fb_increasing_run": "CASE WHEN len(r) >= 3 THEN CASE WHEN len(list_filter(d, lambda v: v <= 0)) = 0 "
                             "THEN len(d) ELSE len(d) - list_max(list_filter(range(1, len(d) + 1), "
                             "lambda i: d[i] <= 0)) END ELSE 0 END"}
SQL["s25_matured"] = events("SELECT stream_id, window_idx, CAST(n AS BIGINT) AS n_known FROM recent", _fb(2))
SQL["s26_feedback"] = events("SELECT stream_id, window_idx, " + ", ".join(
    f"(round(CAST(CASE WHEN n > 0 THEN {e} ELSE 0 END AS DOUBLE), 6) + 0e0) AS {c}" for c, e in _FBC.items())
    + ", 0e0 AS fb_ece FROM signs", _fb(2))
_NORMED = ("fb_risk_last", "fb_risk_mean", "fb_n_matured")
SQL["f11_normaliser"] = events("SELECT f.stream_id, f.window_idx, " + ", ".join(
    r6(f"({c} - (SELECT avg({c}) FROM trained)) / (SELECT stddev_pop({c}) FROM trained)") + f" AS {c}" for c in _NORMED)
    + " FROM f", _fb(1) + "," + SPLIT + """, f AS (SELECT stream_id, window_idx, """ + ", ".join(
        f"CAST(CASE WHEN n > 0 THEN {_FBC[c]} ELSE 0 END AS DOUBLE) AS {c}" for c in _NORMED) + """ FROM signs),
trained AS (SELECT f.* FROM f JOIN parts p ON p.stream_id = f.stream_id AND p.origin = f.window_idx WHERE p.split = 'train')""")
_EDGES = [i * 0.1 for i in range(10)] + [1.0]
SQL["s30_calibration_error"] = lines(f"""SELECT r.stream_id, r.window_idx, {r6('coalesce(ece, 0e0)')} AS fb_ece
 FROM risk r LEFT JOIN ece e ON e.stream_id = r.stream_id AND e.window_idx + 1 = r.window_idx""",
    f"""conf AS (SELECT stream_id, window_idx, list_max(proba) AS c, 1 - loss AS ok FROM {_DEP}),
binned AS (SELECT stream_id, window_idx, len(list_filter({_EDGES!r}::DOUBLE[], lambda e: c > e)) AS b, count(*) AS n,
 abs(avg(ok) - avg(c)) AS gap FROM conf GROUP BY ALL),
ece AS (SELECT stream_id, window_idx, sum(n * gap) / sum(n) AS ece FROM binned GROUP BY stream_id, window_idx)""")
_T = "6.283185307179586::DOUBLE"
_CTX = {"ctx_deployment_age": "CAST(window_idx AS DOUBLE)", "ctx_deployment_age_log": "ln(1 + window_idx)"}
for _n, _e, _p in (("hour", "hour(t_start)", 24), ("dow", "(isodow(t_start) - 1)", 7), ("month", "month(t_start)", 12)):
    _CTX[f"ctx_{_n}_sin"] = f"sin({_T} * ({_e} % {_p}) / {_p})"
    _CTX[f"ctx_{_n}_cos"] = f"cos({_T} * ({_e} % {_p}) / {_p})"
_CTX |= {"ctx_is_weekend": "CAST(isodow(t_start) >= 6 AS DOUBLE)", "ctx_regime": "0e0"}
SQL["s31_context"] = events("SELECT stream_id, window_idx, " + ", ".join(f"{r6(e)} AS {c}" for c, e in _CTX.items())
                            + " FROM risk")
_EMB = (1, 2, 3)
_GIVEN_STATE = ({"pred_mean": "p.m", "pred_std": "p.s", "pred_range": "p.g", "unc_pred_var": "p.v", "unc_pred_iqr": "p.iqr",
                 "rep_norm_mean": "p.nm", "rep_norm_std": "p.ns", "rep_centroid_shift": "p.shift"}
                | {f"pred_{n}": f"p.{n}" for n, _ in _QS}
                | {c: "0e0" for c in ("unc_energy_mean", "unc_epistemic", "unc_aleatoric", "unc_ensemble_var", "fb_ece")}
                | {c: f"CAST(CASE WHEN n > 0 THEN {e} ELSE 0 END AS DOUBLE)" for c, e in _FBC.items()}
                | {"adapt_windows_since_update": "CAST(p.window_idx AS DOUBLE)"}
                | {c: "0e0" for c in ("adapt_n_updates", "adapt_last_magnitude", "adapt_last_risk_delta", "adapt_ever_updated", "adapt_update_rate")}
                | {"pred_volatility": "p.pred_vol", "unc_volatility": "p.unc_vol", "rep_volatility": "p.rep_vol", "risk": "risk.risk"})
SQL["s39_given_log"] = given("SELECT p.stream_id, p.window_idx, " + ", ".join(
    f"{r6(e)} AS {c}" for c, e in (_GIVEN_STATE | {c: e.replace('window_idx', 'p.window_idx') for c, e in _CTX.items()}).items())
    + " FROM pv p JOIN signs USING (stream_id, window_idx) JOIN risk USING (stream_id, window_idx)",
    _fb(1) + ", eref AS (SELECT stream_id, " + ", ".join(
        f"avg(x[{i}]) AS em{i}, CASE WHEN stddev_pop(x[{i}]) > 0 THEN stddev_pop(x[{i}]) ELSE 1e0 END AS es{i}" for i in _EMB)
    + " FROM seg WHERE segment = 'pre' GROUP BY stream_id), p AS (SELECT scored.stream_id, window_idx, avg(y_pred) AS m, "
    "stddev_pop(y_pred) AS s, max(y_pred) - min(y_pred) AS g, var_pop(y_pred) AS v, "
    "quantile_cont(y_pred, 0.75e0) - quantile_cont(y_pred, 0.25e0) AS iqr, "
    + ", ".join(f"quantile_cont(y_pred, {q}e0) AS {n}" for n, q in _QS)
    + ", avg(nrm) AS nm, stddev_pop(nrm) AS ns, sqrt((" + " + ".join(
        f"pow((avg(x[{i}]) - any_value(em{i})) / any_value(es{i}), 2)" for i in _EMB) + ") / 3) AS shift FROM (SELECT *, sqrt("
    + " + ".join(f"x[{i}] * x[{i}]" for i in _EMB) + ") AS nrm FROM " + _DEP + ") scored JOIN eref USING (stream_id) "
    "GROUP BY scored.stream_id, window_idx), pv AS (SELECT *, " + ", ".join(
        f"{_vol(c)} AS {n}" for c, n in (("m", "pred_vol"), ("v", "unc_vol"), ("shift", "rep_vol")))
    + " FROM p WINDOW p AS (PARTITION BY stream_id ORDER BY window_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))")
SQL["s34_interventions"] = events("SELECT stream_id, window_idx, " + ", ".join(f"{r6(e)} AS {c}" for c, e in {
    "adapt_windows_since_update": "CAST(window_idx - coalesce(seen_at, 0) AS DOUBLE)", "adapt_n_updates": "CAST(n AS DOUBLE)",
    "adapt_last_magnitude": "coalesce(magnitude, 0e0)", "adapt_last_risk_delta": "coalesce(risk_delta, 0e0)",
    "adapt_ever_updated": "CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END",
    "adapt_update_rate": "n / greatest(window_idx, 1)"}.items()) + " FROM seen", """
steps AS (SELECT stream_id, window_idx, risk, eps, lag(risk) OVER w AS before, lead(risk) OVER w AS after FROM risk
 JOIN eps USING (stream_id) WINDOW w AS (PARTITION BY stream_id ORDER BY window_idx)),
hits AS (SELECT *, CASE WHEN risk > eps AND before <= eps THEN window_idx END AS hit FROM steps),
seen AS (SELECT stream_id, window_idx, count(hit) OVER w AS n, last_value(hit IGNORE NULLS) OVER w AS seen_at,
 last_value(CASE WHEN hit IS NOT NULL THEN risk - eps END IGNORE NULLS) OVER w AS magnitude,
 last_value(CASE WHEN hit IS NOT NULL THEN coalesce(after - risk, 0) END IGNORE NULLS) OVER w AS risk_delta FROM hits
 WINDOW w AS (PARTITION BY stream_id ORDER BY window_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
SQL["s35_block_selection"] = events("SELECT stream_id, window_idx, " + ", ".join(
    [f"{r6(e)} AS {c}" for c, e in _CTX.items()] + [f"0e0 AS {c}" for c in (
        "adapt_n_updates", "adapt_last_magnitude", "adapt_last_risk_delta", "adapt_ever_updated", "adapt_update_rate")]
    + ["CAST(window_idx AS DOUBLE) AS adapt_windows_since_update"]) + " FROM risk")
SQL["s36_state_and_risk"] = events("SELECT stream_id, window_idx, " + ", ".join(
    f"(round(CAST(CASE WHEN n > 0 THEN {_FBC[c]} ELSE 0 END AS DOUBLE), 6) + 0e0) AS {c}"
    for c in ("fb_risk_last", "fb_n_matured")) + f", CAST(window_idx AS DOUBLE) AS ctx_deployment_age, {r6('risk')} AS risk"
    + " FROM signs JOIN risk USING (stream_id, window_idx)", _fb(1))
SQL["s38_census"] = events("SELECT stream_id, 'pred' AS block, 8::BIGINT AS n_columns, CAST(" + " + ".join(
    f"CAST(max(abs({e})) = 0 AS INTEGER)" for e in ["m", "s", "g"] + [f"q{i}" for i in range(5)])
    + """ AS BIGINT) AS n_constant_zero FROM v GROUP BY stream_id UNION ALL SELECT stream_id, 'unc', 6, CAST(4
 + CAST(max(s) = 0 AS INTEGER) + CAST(max(abs(iqr)) = 0 AS INTEGER) AS BIGINT) FROM v GROUP BY stream_id""",
    "v AS (SELECT stream_id, window_idx, avg(y_pred) AS m, stddev_pop(y_pred) AS s, max(y_pred) - min(y_pred) AS g, "
    "quantile_cont(y_pred, 0.75e0) - quantile_cont(y_pred, 0.25e0) AS iqr, "
    + ", ".join(f"quantile_cont(y_pred, {q}e0) AS q{i}" for i, (_, q) in enumerate(_QS))
    + f" FROM {_DEP} GROUP BY stream_id, window_idx)")
SQL["s33_regime"] = events("""SELECT stream_id, window_idx, arg_min(CASE WHEN hour(ts) >= 12 THEN 1e0 ELSE 0e0 END, seg_row) AS ctx_regime
 FROM scored WHERE segment = 'dep' AND window_idx IS NOT NULL GROUP BY stream_id, window_idx""")
