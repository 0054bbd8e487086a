"""Event-log operators: union, per-time dedupe, gap sessions.

Gap sessions without a hot-key task
-----------------------------------
A new session starts where the gap to the previous event exceeds ``gap``.
Cut the time axis into blocks of width ``gap``: two events of one block are
less than ``gap`` apart, so a block never splits.  Sessions are therefore
built in two steps:

1. an aggregate per ``(key, block)`` (partial aggregation map-side, then a
   shuffle on ``(key, block)``), giving first/last time and the merged
   payload of the block;
2. a window over the *block table* per key (lag of the last time, running
   sum of new-session flags).

Step 2 sees one row per non-empty block, i.e. at most one row per ``gap`` of
a key's time span, however many events the key has; a key holding a third
of all events does not make a third of the data go through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelog.functions.util import col

# Merge functions for payloads: applied per block, then again per session.
_MERGE = {
    "max": (F.max, F.max),
    "min": (F.min, F.min),
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "any": (lambda c: F.max(c.cast("boolean")), F.max),
}


def union_events(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; columns missing in a branch are typed NULLs."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_events(df: DataFrame, keys: list[str], code: str = "code",
                  flag: str | None = None, marker_code: int = -1,
                  marker_name: str = "supp_oxygen") -> DataFrame:
    """One row per ``keys``: max code, max flag and whether any event carried
    ``marker_code`` (FALSE, not NULL, when none did).  NULL codes are dropped."""
    aggs = [F.max(code).alias(code)]
    if flag:
        aggs.append(F.max(flag).alias(flag))
    aggs.append((F.count_if(F.col(code) == marker_code) > 0).alias(marker_name))
    return df.filter(F.col(code).isNotNull()).groupBy(*keys).agg(*aggs)


def _block_table(df: DataFrame, key: str, t: str, gap, payload: dict[str, tuple[str, Column]],
                 where: Column | None = None):
    block = F.floor(col(t) / F.lit(gap)).cast("bigint")
    if where is None:
        df = df.filter(col(t).isNotNull())
        tt, pay = col(t), payload
    else:
        # conditional aggregation: rows failing ``where`` count for nothing
        tt = F.when(where, col(t))
        pay = {n: (how, F.when(where, c)) for n, (how, c) in payload.items()}
    aggs = [F.min(tt).alias("_first"), F.max(tt).alias("_last")]
    aggs += [_MERGE[how][0](c).alias(name) for name, (how, c) in pay.items()]
    out = df.groupBy(key, block.alias("_block")).agg(*aggs)
    return out if where is None else out.filter(F.col("_first").isNotNull())


def _number_blocks(blocks: DataFrame, key: str, gap, session: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("_block")
    prev_last = F.lag("_last", 1).over(w)
    new = F.when(prev_last.isNull() | ((F.col("_first") - prev_last) > F.lit(gap)), 1).otherwise(0)
    return (blocks.withColumn("_new", new)
            .withColumn(session, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def sessions(df: DataFrame, key: str, t: str, gap, payload: dict[str, tuple[str, Column]] | None = None,
             session: str = "session_id", start: str = "start", last: str = "last",
             where: Column | None = None) -> DataFrame:
    """One row per ``(key, session)``: ``start`` (first time), ``last`` (last
    time) and each payload merged over the session.

    ``payload`` maps output name -> (merge, Column) with merge one of
    ``max min sum count any``.  A new session begins when the time since the
    previous event is strictly greater than ``gap``.  ``where`` keeps only the
    rows that satisfy it (evaluated inside the aggregate).
    """
    payload = payload or {}
    blocks = _number_blocks(_block_table(df, key, t, gap, payload, where), key, gap, session)
    aggs = [F.min("_first").alias(start), F.max("_last").alias(last)]
    aggs += [_MERGE[how][1](name).alias(name) for name, (how, _) in payload.items()]
    return blocks.groupBy(key, session).agg(*aggs)


def sessionize(df: DataFrame, key: str, t: str, gap, session: str = "session_id") -> DataFrame:
    """Event-level session numbers (1, 2, ... per key in time order).

    Events join back to their block's number on ``(key, block)``, an equi-join
    whose keys spread a heavy key over its blocks.
    """
    numbered = _number_blocks(_block_table(df, key, t, gap, {}), key, gap, session)
    ev = df.withColumn("_block", F.floor(col(t) / F.lit(gap)).cast("bigint"))
    return (ev.join(numbered.select(key, "_block", session), [key, "_block"], "left")
            .drop("_block"))


def session_summary(sess: DataFrame, key: str, start: str = "start", last: str = "last",
                    active: str | None = None, discharge: str | None = None,
                    tail: int = 60, per_hour: int = 60) -> DataFrame:
    """Session end, duration (hours) and the key's first session start.

    End = last event + ``tail`` minutes; when the session is flagged active at
    discharge and the discharge time lies later, the discharge time.
    """
    end_default = F.col(last) + F.lit(tail)
    if active and discharge:
        end = F.when(F.col(active) & (end_default < F.col(discharge)), F.col(discharge)).otherwise(end_default)
    else:
        end = end_default
    w = Window.partitionBy(key)
    return (sess.withColumn("end", end)
            .withColumn("duration_h", (F.col("end") - F.col(start)) / F.lit(per_hour))
            .withColumn("first_start", F.min(start).over(w)))
