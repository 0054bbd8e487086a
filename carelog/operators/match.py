"""Nearest-event matching, interval filters and top-1 picks.

Nearest event in the same bucket (as-of join without the pair product)
----------------------------------------------------------------------
Anchors and candidates of one ``(key, bucket)`` are reduced to one row per
time (smallest payload first), sorted once by time, and each anchor reads
the closest candidate before it (``last ... ignorenulls``) and after it
(``first ... ignorenulls``).  Cost is a sort, not |anchors| x |candidates|;
no pair of a group is ever emitted.  Ties go to the earlier candidate, then
to the smaller payload.

Top-1 per group
---------------
``pick_first`` is ``min_by(struct(values), struct(order))`` - an aggregate,
so a heavy group is combined map-side and never sent whole to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelog.functions.util import col


def pick_first(df: DataFrame, keys, order: list, values: list[str], desc: bool = False) -> DataFrame:
    """One row per ``keys``: the ``values`` of the row that sorts first by
    ``order`` (a list of columns; NULLs sort first, as in ascending SQL).

    ``order`` must be a total order inside a group for a deterministic pick;
    callers append tie-break columns.  ``desc=True`` takes the last row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ordering = F.struct(*[col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    payload = F.struct(*[F.col(v) for v in values])
    pick = F.max_by(payload, ordering) if desc else F.min_by(payload, ordering)
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, *[F.col(f"_p.{v}").alias(v) for v in values])


def rank_filter(df: DataFrame, partition: list, order: list, n: int = 1, rank_col: str | None = None) -> DataFrame:
    """``row_number() over (...) <= n`` (QUALIFY-style).  Catalyst plans a
    partial ``WindowGroupLimit`` before the shuffle, so heavy partitions are
    cut map-side."""
    w = Window.partitionBy(*partition).orderBy(*order)
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def nearest_events(df: DataFrame, by: list[str], time: str, anchor: Column,
                   candidates: dict[str, Column]) -> DataFrame:
    """For every anchor time in ``df``, the nearest candidate of each kind.

    ``df`` holds rows of a long table: ``anchor`` is a struct (or NULL when the
    row is not an anchor), each ``candidates[name]`` a struct (or NULL).  Rows
    are grouped by ``by + [time]`` first: the anchor of a time is its smallest
    anchor struct and each candidate its smallest struct.

    Returns one row per ``(by, time)`` holding an anchor: ``by``, ``time``,
    ``anchor`` (struct) and for each candidate name a struct
    ``{t: candidate time, v: candidate struct}`` or NULL when the group has no
    such candidate.
    """
    g = _reduce_per_time(df, by, time, {"anchor": anchor, **candidates})
    w = Window.partitionBy(*by).orderBy(time)
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = F.col(time)
    out = g
    for n in candidates:
        tagged = F.when(F.col(n).isNotNull(), F.struct(t.alias("t"), F.col(n).alias("v")))
        out = out.withColumn(f"_{n}_tag", tagged)
    for n in candidates:
        out = (out.withColumn(f"_{n}_prev", F.last(f"_{n}_tag", ignorenulls=True).over(before))
                  .withColumn(f"_{n}_next", F.first(f"_{n}_tag", ignorenulls=True).over(after)))
    out = out.filter(F.col("anchor").isNotNull())
    for n in candidates:
        p, q = F.col(f"_{n}_prev"), F.col(f"_{n}_next")
        take_prev = q.isNull() | (p.isNotNull() & ((t - p["t"]) <= (q["t"] - t)))
        out = out.withColumn(n, F.when(take_prev, p).otherwise(q))
    return out.select(*by, time, "anchor", *candidates.keys())


def _reduce_per_time(df: DataFrame, by: list[str], time: str, structs: dict[str, Column]) -> DataFrame:
    """Smallest struct of each kind per (by, time).  One-field structs of a
    fixed-width type are reduced field-wise (hash aggregation; min over a
    struct would force a sort-based aggregate): a present struct with a NULL
    field still wins, as NULL sorts first in the struct order."""
    fixed = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
             T.BooleanType, T.DateType, T.TimestampType)
    types = df.select(*[c.alias(n) for n, c in structs.items()]).schema
    aggs, post = [], []
    for n, c in structs.items():
        st = types[n].dataType
        f = st.fields[0] if isinstance(st, T.StructType) and len(st.fields) == 1 else None
        small = f is not None and (isinstance(f.dataType, fixed) or (
            isinstance(f.dataType, T.DecimalType) and f.dataType.precision <= 18))
        if not small:
            aggs.append(F.min(c).alias(n))
            post.append(F.col(n))
            continue
        v = c[f.name]
        aggs += [F.count_if(c.isNotNull()).alias(f"_{n}_n"), F.count_if(c.isNotNull() & v.isNull()).alias(f"_{n}_z"),
                 F.min(v).alias(f"_{n}_m")]
        rebuilt = (F.when(F.col(f"_{n}_n") == 0, F.lit(None))
                   .when(F.col(f"_{n}_z") > 0, F.struct(F.lit(None).cast(f.dataType).alias(f.name)))
                   .otherwise(F.struct(F.col(f"_{n}_m").alias(f.name))))
        post.append(rebuilt.alias(n))
    return df.groupBy(*by, time).agg(*aggs).select(*by, time, *post)


def within_window(events: DataFrame, windows: DataFrame, key: str, t: str, start: str, length: int) -> DataFrame:
    """Events of ``key`` whose time lies in ``[start, start + length]`` of at
    least one window row of the same key (each event once).

    Windows are of one length, so an event is covered if the latest start at or
    before it is not further back than that: one running maximum over starts and events
    sorted by time replaces the pairs.  Time is cut into blocks of that length: a
    window lies in the block of its start and the next one, so a key's events are
    sorted block by block, and a hot key spreads over many tasks.  Starts are reduced to
    one for each key, block and time first.  Rows without key or time match nothing.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(max(length, 1)))
    taken = [*events.columns, key]
    at, first, cell, is_event = (_free(taken, n) for n in ("_at", "_start", "_block", "_event"))
    starts = (windows.filter(F.col(key).isNotNull() & F.col(start).isNotNull())
              .select(F.col(key), F.col(start).alias(first)).distinct()
              .select(key, first, F.col(first).alias(at), F.explode(F.array(block(first), block(first) + 1)).alias(cell), F.lit(False).alias(is_event)))
    rows = (events.filter(F.col(key).isNotNull() & F.col(t).isNotNull())
            .withColumns({at: F.col(t), cell: block(t), is_event: F.lit(True)}))
    both = rows.unionByName(starts, allowMissingColumns=True)
    w = (Window.partitionBy(key, cell).orderBy(at, is_event)  # a start before the events of its time
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = _free([*taken, at, first, cell, is_event], "_last")
    return (both.withColumn(last, F.max(first).over(w))
            .filter(F.col(is_event) & (F.col(at) <= F.col(last) + F.lit(length))).select(*events.columns))


def _free(taken: list[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name
