"""The stored streams in SQL."""

from __future__ import annotations

from stillvalid.plans.specs import EVENTS, GIVEN, LINES

from .prelude import numbered, risks, scored_classes, scored_means

EVENTS_SQL = {"stream": "('s' || CAST(user_id % 5 AS VARCHAR))", "order": ["ts", "event_id"],
              "time": "ts", "target": "value", "score_key": "event_type"}
LINES_SQL = {"stream": "('s' || CAST(l_suppkey % 5 AS VARCHAR))", "order": list(LINES.order),
             "time": "l_shipdate",
             "target": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END",
             "score_key": "l_linestatus || CAST(l_linenumber AS VARCHAR)",
             "features": list(LINES.features)}


def events(body: str, more: str = "") -> str:
    """A query over the events stream; ``more`` adds CTEs."""
    return ("WITH " + ",".join([numbered(EVENTS, EVENTS_SQL), scored_means(), risks(EVENTS)])
            + (("," + more) if more else "") + "\n" + body)


GIVEN_SQL = {"stream": "('s' || CAST(l_suppkey % 5 AS VARCHAR))", "order": list(GIVEN.order),
             "time": "l_shipdate", "target": "l_extendedprice / 1000", "score_key": "l_linestatus",
             "features": ["l_quantity", "l_discount * 10", "l_tax * 10"]}


def given(body: str, more: str = "") -> str:
    """A query over the given prediction log; its embedding is ``x``."""
    scored = """
target_scale AS (SELECT stream_id, stddev_pop(y) AS scale FROM seg WHERE segment = 'pre' GROUP BY stream_id),
scored AS (SELECT seg.*, x[1] * 1.5e0 AS y_pred, least(abs(y - x[1] * 1.5e0) / CASE WHEN scale > 0 THEN scale ELSE 1e0 END, 1e0)
        AS loss FROM seg JOIN target_scale USING (stream_id))"""
    return ("WITH " + ",".join([numbered(GIVEN, GIVEN_SQL), scored, risks(GIVEN)])
            + (("," + more) if more else "") + "\n" + body)


def lines(body: str, more: str = "") -> str:
    return ("WITH " + ",".join([numbered(LINES, LINES_SQL), scored_classes(LINES), risks(LINES)])
            + (("," + more) if more else "") + "\n" + body)
