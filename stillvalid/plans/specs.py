"""Monitored streams defined over the stored tables."""

from __future__ import annotations

from dataclasses import replace

from ..sources.stream_log import StreamSpec

EVENTS = StreamSpec(
    name="events", table="events", stream="concat('s', cast(user_id % 5 as string))",
    order=("ts", "event_id"), time="ts", target="value", score_key="event_type",
    window=5, margin=0.05)

# The events with a known operating regime: the second half of the day.
SHIFTS = replace(EVENTS, name="shifts", regime="cast(hour(ts) >= 12 as double)")

# Ties in the ship date are broken by every other column: the table has no unique key.
_LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

LINES = StreamSpec(
    name="lines", table="lineitem", stream="concat('s', cast(l_suppkey % 5 as string))",
    order=_LINE_ORDER, time="l_shipdate",
    target="case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end",
    score_key="concat(l_linestatus, cast(l_linenumber as string))",
    features=("l_quantity", "l_extendedprice", "l_discount", "l_tax"), classes=3, window=25,
    margin=0.02)

# A log that a deployed model has written: its predictions and its embedding come with the rows.
GIVEN = StreamSpec(
    name="given", table="lineitem", stream="concat('s', cast(l_suppkey % 5 as string))",
    order=_LINE_ORDER, time="l_shipdate", target="l_extendedprice / 1000", score_key="l_linestatus",
    y_pred="l_quantity * 1.5", embedding="array(l_quantity, l_discount * 10, l_tax * 10)",
    window=25, margin=0.02)

# The same lines under a frozen model of boosted trees, 200 rounds for three classes.
BOOSTED = replace(LINES, name="boosted", scorer="boosted")

VECTORS = StreamSpec(
    name="vectors", table="embeddings", stream="concat('s', cast(vec_id % 2 as string))",
    order=("vec_id",), time="vec_id", target="label", score_key="cast(embedding[0] > 0 as string)",
    features=tuple(f"embedding[{i}]" for i in range(64)), window=20, margin=0.05, pre_fraction=0.4)


def small(spec: StreamSpec, window: int) -> StreamSpec:
    """The same stream cut into smaller windows (for small tables)."""
    return replace(spec, window=window)
