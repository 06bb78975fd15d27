"""Shared SQL of the checks: the monitored stream of a spec, restated for a plain SQL engine."""

from __future__ import annotations

from stillvalid.sources.stream_log import StreamSpec


def r6(expr: str) -> str:
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, 6) + 0e0)"


def _fraction(seed: str, keys: tuple[str, ...], part: int) -> str:
    text = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return (f"(CAST('0x' || substr(md5(concat_ws('|', {text})), {8 * part + 1}, 8) AS BIGINT)"
            " / 4294967296e0)")


def uniform(seed: str, *keys: str) -> str:
    return _fraction(seed, keys, 0)


def normal(seed: str, *keys: str) -> str:
    u1 = f"({_fraction(seed, keys, 0)} + {2.0 ** -33!r}::DOUBLE)"
    return (f"(sqrt(-2e0 * ln({u1})) * cos(6.283185307179586::DOUBLE * "
            f"{_fraction(seed, keys, 1)}))")


def normal_tail(z: str) -> str:
    """P(Z <= z) from a series of positive terms."""
    x = f"(abs({z}) / sqrt(2e0))"
    term = (f"exp(k * ln(2e0) + (2 * k + 1) * ln({x}) - {x} * {x} - (k + 1) * ln(2e0) - lgamma(k + 1.5e0) + 0.5e0 * ln(pi()))")
    erf = f"CASE WHEN {z} = 0 THEN 0 ELSE least(2 / sqrt(pi()) * list_sum(list_transform(range(0, 2000), lambda k: {term})), 1e0) END"
    return f"(0.5e0 * (1 + sign({z}) * ({erf})))"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def entropy(p: list[str]) -> str:
    c = [f"least(greatest({x}, 1e-12), 1e0)" for x in p]
    return "(-(" + " + ".join(f"{x} * ln({x})" for x in c) + "))"


def numbered(spec: StreamSpec, sql: dict[str, str]) -> str:
    """CTEs ``src``, ``numbered``, ``sizes``, ``seg`` for a spec with its expressions in SQL."""
    order = ", ".join(sql["order"])
    x = ", ".join(f"CAST({f} AS DOUBLE)" for f in sql.get("features", []))
    xs = f", [{x}] AS x" if x else ""
    w = spec.window
    return f"""
src AS (SELECT {sql['stream']} AS stream_id, {sql['time']} AS ts, CAST({sql['target']} AS DOUBLE) AS y,
        {sql['score_key']} AS score_key{xs}, row_number() OVER (PARTITION BY {sql['stream']}
        ORDER BY {order}) - 1 AS row_idx FROM {spec.table}),
sizes_all AS (SELECT stream_id, count(*) AS n_rows,
        CAST(floor(floor(count(*) * {dbl(spec.pre_fraction)}) / {w}) * {w} AS BIGINT) AS boundary
        FROM src GROUP BY stream_id),
sizes AS (SELECT *, boundary // {w} AS n_pre_windows, (n_rows - boundary) // {w} AS n_windows
        FROM sizes_all WHERE boundary >= {w} AND n_rows - boundary >= {w}),
seg AS (SELECT src.*, boundary, CASE WHEN row_idx < boundary THEN 'pre' ELSE 'dep' END AS segment,
        CASE WHEN row_idx < boundary THEN row_idx ELSE row_idx - boundary END AS seg_row,
        CASE WHEN row_idx < boundary THEN row_idx // {w}
             WHEN (row_idx - boundary) // {w} < n_windows THEN (row_idx - boundary) // {w} END
        AS window_idx FROM src JOIN sizes USING (stream_id))"""


def scored_means() -> str:
    return """
stream_mean AS (SELECT stream_id, avg(y) AS stream_mean, stddev_pop(y) AS scale FROM seg
        WHERE segment = 'pre' GROUP BY stream_id),
key_mean AS (SELECT stream_id, score_key, avg(y) AS key_mean FROM seg WHERE segment = 'pre'
        GROUP BY stream_id, score_key),
scored AS (SELECT seg.*, scale, coalesce(key_mean, stream_mean) AS y_pred,
        CASE WHEN y IS NOT NULL THEN least(abs(y - coalesce(key_mean, stream_mean))
             / CASE WHEN scale > 0 THEN scale ELSE 1e0 END, 1e0) END AS loss
        FROM seg JOIN stream_mean USING (stream_id)
        LEFT JOIN key_mean USING (stream_id, score_key))"""


def scored_classes(spec: StreamSpec) -> str:
    k, m = spec.classes, spec.members
    cut = [f"row_idx < floor(boundary * {i + 1} / {float(m)!r})" for i in range(m)]
    by_key = ", ".join(f"CAST(count(*) FILTER (WHERE {cut[i]} AND y = {c}) AS DOUBLE) AS c{i}_{c}"
                       for i in range(m) for c in range(k))
    by_stream = ", ".join(f"sum(c{i}_{c}) AS s{i}_{c}" for i in range(m) for c in range(k))

    def shares(p: str, i: int) -> str:
        n = "(" + " + ".join(f"{p}{i}_{c}" for c in range(k)) + ")"
        s = "(" + " + ".join(f"s{i}_{c}" for c in range(k)) + ")"
        return "[" + ", ".join(
            f"CASE WHEN coalesce({n}, 0) > 0 THEN {p}{i}_{c} / {n} "
            f"WHEN {s} > 0 THEN s{i}_{c} / {s} ELSE 1e0 / {k} END" for c in range(k)) + "]"

    members = "[" + ", ".join(shares("c", i) for i in range(m)) + "]"
    proba = f"members[{m}]"
    return f"""
key_counts AS (SELECT stream_id, score_key, {by_key} FROM seg WHERE segment = 'pre'
        GROUP BY stream_id, score_key),
stream_counts AS (SELECT stream_id, {by_stream} FROM key_counts GROUP BY stream_id),
with_members AS (SELECT seg.*, {members} AS members FROM seg JOIN stream_counts USING (stream_id)
        LEFT JOIN key_counts USING (stream_id, score_key)),
with_proba AS (SELECT *, {proba} AS proba FROM with_members),
with_pred AS (SELECT *, list_position(proba, list_max(proba)) - 1 AS top,
        list_transform(proba, lambda q: ln(least(greatest(q, 1e-12), 1e0))) AS raw FROM with_proba),
scored AS (SELECT *, CAST(top AS DOUBLE) AS y_pred, CAST(y <> top AS DOUBLE) AS loss
        FROM with_pred)"""


def risks(spec: StreamSpec) -> str:
    h, L, d = spec.horizon, spec.context, spec.delay
    path = ", ".join(f"lead(risk, {i}) OVER w AS r{i}" for i in range(1, h + 1))
    arr = ", ".join(f"r{i}" for i in range(1, h + 1))
    hist = ", ".join(f"lag(risk, {i}) OVER w" for i in range(d + L - 1, d - 1, -1))
    return f"""
all_risk AS (SELECT segment, stream_id, window_idx, CASE WHEN count(loss) = count(*) THEN
        round(avg(loss), 12) END AS risk, min(ts) AS t_start, max(ts) AS t_stop
        FROM scored WHERE window_idx IS NOT NULL GROUP BY segment, stream_id, window_idx),
pre_risk AS (SELECT * EXCLUDE segment FROM all_risk WHERE segment = 'pre'),
risk AS (SELECT * EXCLUDE segment FROM all_risk WHERE segment = 'dep'),
eps AS (SELECT stream_id, round(least(quantile_cont(risk, {dbl(spec.quantile)})
        + {dbl(spec.margin)}, 1e0), 12) AS eps FROM pre_risk GROUP BY stream_id),
ahead AS (SELECT stream_id, window_idx, risk, eps,
        count(*) OVER f AS n_ahead,
        min(CASE WHEN risk > eps THEN window_idx END) OVER f AS violated,
        min(CASE WHEN risk IS NULL THEN window_idx END) OVER f AS unknown_at, {path},
        CASE WHEN row_number() OVER w > {d} THEN [{hist}] END AS hist_raw
        FROM risk JOIN eps USING (stream_id)
        WINDOW w AS (PARTITION BY stream_id ORDER BY window_idx),
        f AS (PARTITION BY stream_id ORDER BY window_idx ROWS BETWEEN 1 FOLLOWING
              AND {h} FOLLOWING)),
origins_all AS (SELECT stream_id, window_idx AS origin, eps, risk AS risk_now, r1 AS risk_next,
        [{arr}] AS risk_path, list_filter(hist_raw, lambda v: v IS NOT NULL) AS known_hist,
        (violated IS NOT NULL AND (unknown_at IS NULL OR violated < unknown_at)) AS hit,
        CASE WHEN violated IS NOT NULL AND (unknown_at IS NULL OR violated < unknown_at)
             THEN violated - window_idx WHEN unknown_at IS NOT NULL
             THEN unknown_at - window_idx - 1 ELSE n_ahead END AS y_tilde
        FROM ahead WHERE risk <= eps AND n_ahead > 0),
origins AS (SELECT *, CAST(hit AS INTEGER) AS event, coalesce(
        CASE WHEN len(known_hist) > 0 THEN
             list_reduce(known_hist, lambda s, v: 0.3e0 * v + (1e0 - 0.3e0) * s) END,
        risk_now, 0.5e0) AS anchor
        FROM origins_all WHERE y_tilde >= 1)"""
