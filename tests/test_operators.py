"""Event and matching operators: edge rows and property tests against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelog.operators.events import dedupe_events, session_summary, sessions, sessionize, union_events
from carelog.operators.match import nearest_events, pick_first, rank_filter, within_window
from tests.conftest import rows


def brute_sessions(events, gap):
    out = {}
    for k in sorted({e[0] for e in events}):
        ts = sorted(t for kk, t in events if kk == k)
        sid, prev = 0, None
        for t in ts:
            if prev is None or t - prev > gap:
                sid += 1
                out[(k, sid)] = [t, t]
            out[(k, sid)][1] = t
            prev = t
    return sorted((k, s, a, b) for (k, s), (a, b) in out.items())


def test_session_gap_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (1, 1440), (1, 2881)], "k int, t bigint")
    ev = sessionize(df, "k", "t", 1440)
    assert rows(ev, "t", "session_id") == [(0, 1), (1440, 1), (2881, 2)]


def test_session_end_rule(spark):
    s = spark.createDataFrame([(1, 0, 100, True, 150), (2, 0, 100, True, 200), (3, 0, 100, None, 900)],
                              "k int, start bigint, last bigint, active boolean, disch bigint")
    out = session_summary(s, "k", active="active", discharge="disch")
    assert rows(out, "k", "end") == [(1, 160), (2, 200), (3, 160)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-100, 9000)), min_size=1, max_size=60),
       st.sampled_from([10, 100, 1440]))
def test_sessions_match_brute_force(spark, events, gap):
    df = spark.createDataFrame(events, "k int, t bigint")
    got = rows(sessions(df, "k", "t", gap), "k", "session_id", "start", "last")
    assert got == brute_sessions(events, gap)


def test_dedupe_and_union(spark):
    a = spark.createDataFrame([(1, 5, 2)], "k int, t int, code int")
    b = spark.createDataFrame([(1, 5, -1, True), (1, 6, None, True)], "k int, t int, code int, flag boolean")
    u = union_events(a, b)
    d = dedupe_events(u, ["k", "t"], "code", flag="flag")
    assert rows(d) == [(1, 5, 2, True, True)]


def brute_nearest(anchors, cands):
    out = []
    for (k, b, t, v) in anchors:
        cs = [(abs(ct - t), ct, cv) for (kk, bb, ct, cv) in cands if kk == k and bb == b]
        if cs:
            d, ct, cv = min(cs)
            out.append((k, b, t, ct, cv))
    return sorted(set(out))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 50), st.integers(0, 9)), max_size=25),
       st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 50), st.integers(0, 9)), max_size=25))
def test_nearest_matches_brute_force(spark, anchors, cands):
    # anchors reduced to one per time (smallest value), as the operator does
    a_min = {}
    for k, b, t, v in anchors:
        a_min[(k, b, t)] = min(v, a_min.get((k, b, t), 99))
    anchors = [(k, b, t, v) for (k, b, t), v in a_min.items()]
    data = [(k, b, t, v, None) for k, b, t, v in anchors] + [(k, b, t, None, v) for k, b, t, v in cands]
    if not data:
        return
    df = spark.createDataFrame(data, "k int, b int, t int, av int, cv int")
    m = nearest_events(df, ["k", "b"], "t", anchor=F.when(F.col("av").isNotNull(), F.struct("av")),
                       candidates={"c": F.when(F.col("cv").isNotNull(), F.struct("cv"))})
    got = sorted(set(rows(m.filter(F.col("c").isNotNull()).select("k", "b", "t", F.col("c.t").alias("ct"),
                                                                  F.col("c.v.cv").alias("cv")))))
    assert got == brute_nearest(anchors, cands)


def test_pick_first_and_rank_filter(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 1, 7), (1, 1, 5), (2, 2, 9)], "k int, t int, v int")
    assert rows(pick_first(df, "k", ["t", "v"], ["v"])) == [(1, 5), (2, 9)]
    assert rows(pick_first(df, "k", ["t", "v"], ["v"], desc=True)) == [(1, None), (2, 9)]
    assert rows(rank_filter(df, ["k"], ["t", "v"]), "k", "v") == [(1, 5), (2, 9)]


def test_within_window(spark):
    ev = spark.createDataFrame([(1, 0), (1, 100), (1, 1500), (2, 5)], "k int, t int")
    w = spark.createDataFrame([(1, 50), (1, 60)], "k int, s int")
    assert rows(within_window(ev, w, "k", "t", "s", 1440)) == [(1, 100), (1, 1500)]


def test_sessions_hot_key_spreads_over_blocks(spark):
    # one key with many events: the per-key window sees one row per block
    random.seed(1)
    ev = [(0, random.randint(0, 20000)) for _ in range(3000)] + [(1, 5)]
    df = spark.createDataFrame(ev, "k int, t bigint")
    got = rows(sessions(df, "k", "t", 1440), "k", "session_id", "start", "last")
    assert got == brute_sessions(ev, 1440)


def test_nearest_reduction_is_hash_aggregated(spark):
    df = spark.createDataFrame([(1, 0, 5, 1.0, None), (1, 0, 7, None, 2.0)], "k int, b int, t int, av double, cv double")
    m = nearest_events(df, ["k", "b"], "t", anchor=F.when(F.col("av").isNotNull(), F.struct("av")),
                       candidates={"c": F.when(F.col("cv").isNotNull(), F.struct("cv"))})
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    r = m.first()
    assert (r.t, r.c.t, r.c.v.cv) == (5, 7, 2.0)


def test_windows_are_swept_without_pairs(spark):
    """One key holds half of all events and 1,000 windows; nulls, ties and both ends of a window."""
    import random

    from carelog.operators.match import within_window
    rng = random.Random(4)
    events = [(k if k % 2 else 0, rng.randint(-500, 200_000), k) for k in range(4000)]
    events += [(0, None, -1), (None, 5, -2), (7, 100, -3), (7, 110, -4), (7, 111, -5), (7, 99, -6), (7, 100, -7)]
    windows = [(0, rng.randint(-500, 200_000)) for _ in range(1000)] + [(k, rng.randint(0, 200_000)) for k in range(1, 4000, 7)]
    windows += [(7, 100), (7, 100), (None, 5), (7, None)]
    e = spark.createDataFrame(events, "key long, t int, _start int")
    w = spark.createDataFrame(windows, "key long, s int")
    for length in (10, 0, 1440):
        out = within_window(e, w, "key", "t", "s", length)
        assert out.columns == e.columns
        starts = {}
        for k, s in windows:
            if k is not None and s is not None:
                starts.setdefault(k, set()).add(s)
        want = sorted(x for k, t, x in events if t is not None and any(s <= t <= s + length for s in starts.get(k, ())))
        assert sorted(r["_start"] for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
