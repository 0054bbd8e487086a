"""Catalogue queries over the driver tables (events, orders, lineitem,
customer, part, conversations, documents, labels): each applies one library
operator to whole tables, with a DuckDB oracle where SQL can express it."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.functions.parse import digits_only, safe_decimal, safe_double, safe_int
from carelog.functions.rules import oxygen_support_code
from carelog.functions.util import first_match, float_ratio, typed_null
from carelog.operators import stats as S
from carelog.operators.events import dedupe_events, session_summary, sessions, union_events
from carelog.operators.flags import any_flags
from carelog.operators.match import nearest_events, pick_first, rank_filter, within_window
from carelog.plans.oracle_sql import LOGIT_COLUMNS, logit_sql, profile_sql, rounded, rule_case, safe_dbl, safe_dec, safe_int as sql_int, spline_sql, t_tail
from carelog.plans.registry import register, round_doubles
from carelog.sources.tables import create_view, export_csv, read_csv, read_table, write_table

# event time in whole minutes since the first day of the log
MINUTE_SPARK = "timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
MINUTE_SQL = "cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 60000000.0) as bigint)"
EV_SQL = f"(select *, {MINUTE_SQL} as minute from events)"
PHENO = C.PHENOTYPE_NAMES


def _ev(spark, sf):
    return read_table(spark, sf, "events").withColumn("minute", F.expr(MINUTE_SPARK))


def _t(spark, sf, name):
    return read_table(spark, sf, name)


def _band_sql(x: str, hi: float, lo: float) -> str:
    return (f"case when {x} > {hi} then 'Type L' when {x} between {lo} and {hi} then 'Intermediate phenotype' "
            f"when {x} <= {lo} then 'Type H' end")


def _band(x, hi, lo):
    x = F.col(x) if isinstance(x, str) else x
    return first_match([(x > hi, PHENO[0]), (x.between(lo, hi), PHENO[1]), (x <= lo, PHENO[2])])


# ------------------------------------------------------------ sessions
@register("gap_sessions", f"""
with e as (select user_id, minute m, event_id, value, event_type from {EV_SQL} x),
l as (select *, lag(m) over (partition by user_id order by m, event_id) pm from e),
n as (select *, sum(case when pm is null or m - pm > 1440 then 1 else 0 end)
        over (partition by user_id order by m, event_id rows between unbounded preceding and current row) sid from l)
select user_id, cast(sid as bigint) session_id, min(m) session_start, max(m) session_last, max(m) + 60 session_end,
       round((max(m) + 60 - min(m)) / 60, 6) duration_h, min(min(m)) over (partition by user_id) first_start,
       count(event_id) n_events, round(max(value), 6) max_value, bool_or(event_type = 'purchase') any_purchase
from n group by user_id, sid""")
def gap_sessions(spark, sf):
    """CL6/CL7/WIN1-3: 24-hour gap sessions of each user's events."""
    ev = _ev(spark, sf)
    s = sessions(ev, "user_id", "minute", 1440,
                 payload={"n_events": ("count", F.col("event_id")), "max_value": ("max", F.col("value")),
                          "any_purchase": ("any", F.col("event_type") == "purchase")},
                 session="session_id", start="session_start", last="session_last")
    s = session_summary(s, "user_id", "session_start", "session_last")
    return round_doubles(s.select("user_id", F.col("session_id").cast("bigint").alias("session_id"),
                                  "session_start", "session_last", F.col("end").alias("session_end"),
                                  "duration_h", F.col("first_start"), "n_events", "max_value", "any_purchase"))


@register("event_sessionize", f"""
with e as (select event_id, user_id, minute m from {EV_SQL} x),
l as (select *, lag(m) over (partition by user_id order by m, event_id) pm from e)
select event_id, user_id, m as minute, cast(sum(case when pm is null or m - pm > 1440 then 1 else 0 end)
  over (partition by user_id order by m, event_id rows between unbounded preceding and current row) as bigint) session_id
from l""")
def event_sessionize(spark, sf):
    """CL6 at event grain: session number of every event."""
    from carelog.operators.events import sessionize
    ev = _ev(spark, sf).select("event_id", "user_id", "minute")
    out = sessionize(ev, "user_id", "minute", 1440)
    return out.select("event_id", "user_id", "minute", F.col("session_id").cast("bigint").alias("session_id"))


@register("event_union_dedupe", f"""
with u as (
  select user_id, minute, 2 code, cast(null as boolean) flag from {EV_SQL} a where event_type = 'click'
  union all select user_id, minute, 1, null from {EV_SQL} b where event_type = 'view'
  union all select user_id, minute, -1, value > 50 from {EV_SQL} c where event_type = 'purchase'
  union all select user_id, minute, null, null from {EV_SQL} d where event_type = 'error')
select user_id, minute, max(code) code, max(flag) flag, count(case when code = -1 then 1 end) > 0 any_marker
from u where code is not null group by user_id, minute""")
def event_union_dedupe(spark, sf):
    """SET1/CL2/CL5/AGG4-5: typed-null union of event branches, dedupe per minute."""
    ev = _ev(spark, sf)
    br = [ev.filter(F.col("event_type") == "click").select("user_id", "minute", F.lit(2).alias("code")),
          ev.filter(F.col("event_type") == "view").select("user_id", "minute", F.lit(1).alias("code")),
          ev.filter(F.col("event_type") == "purchase").select("user_id", "minute", F.lit(-1).alias("code"),
                                                              (F.col("value") > 50).alias("flag")),
          ev.filter(F.col("event_type") == "error").select("user_id", "minute", typed_null("int").alias("code"))]
    u = union_events(*br)
    return dedupe_events(u, ["user_id", "minute"], "code", flag="flag", marker_name="any_marker")


# ---------------------------------------------------- rules and parsing
@register("classify_text", f"""
select {rule_case('lower(text)')} code, count(*) n from conversations group by 1""")
def classify_text(spark, sf):
    """CL1/FLT3/FLT4/FLT8: ordered rule classification of free text."""
    t = _t(spark, sf, "conversations")
    return t.groupBy(oxygen_support_code(F.col("text")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


_K_SPARK = r'"k":\s*(-?[0-9]+)'


@register("safe_parse", f"""
with k as (select event_type, regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) k from events)
select event_type, count(*) n, count({sql_int('k')}) n_int, count({sql_int("k || '.5'")}) n_int_half,
       count({safe_dec("k || '.5'")}) n_dec_half, round(cast(sum({safe_dec("k || '.5'")}) as double), 6) sum_dec_half,
       count({safe_dbl("k || 'd'")}) n_dbl_suffix, count(case when regexp_matches(k, '^[0-9]{{1,2}}$') then 1 end) n_two_digits,
       count({sql_int("''")}) n_empty
from k group by event_type""")
def safe_parse(spark, sf):
    """FN3-FN6/FLT5: integer, decimal and double parsing of text with traps
    ('69.5' is no integer, '69d' no double, '' nothing)."""
    k = _t(spark, sf, "events").select("event_type", F.regexp_extract("props", _K_SPARK, 1).alias("k"))
    half = F.concat("k", F.lit(".5"))
    return round_doubles(k.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(safe_int("k")).alias("n_int"),
        F.count(safe_int(half)).alias("n_int_half"), F.count(safe_decimal(half)).alias("n_dec_half"),
        F.sum(safe_decimal(half)).cast("double").alias("sum_dec_half"),
        F.count(safe_double(F.concat("k", F.lit("d")))).alias("n_dbl_suffix"),
        F.count_if(digits_only("k", 1, 2)).alias("n_two_digits"),
        F.count(safe_int(F.lit(""))).alias("n_empty")))


@register("unit_normalise", """
select l_suppkey, round(cast(max(case when p_type like '%ECONOMY%' then round(cast(l_quantity as decimal(18,9)) / 3, 3)
    when p_type like '%PROMO%' then round(cast(l_quantity as decimal(18,9)) / 300, 3)
    when p_type like '%SMALL%' then round(cast(l_quantity as decimal(18,9)) / 80, 3)
    when p_type like '%STANDARD%' then cast(l_quantity as decimal(18,9)) end) as double), 6) max_rate
from lineitem join part on l_partkey = p_partkey group by l_suppkey""")
def unit_normalise(spark, sf):
    """CL9/CL21/FN7: unit taken from a name, converted and rounded to 3 places, max per key."""
    li = _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    pt = _t(spark, sf, "part").select("p_partkey", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    rate = C.unit_rate("p_type", F.col("l_quantity").cast("decimal(18,9)"),
                       [("ECONOMY", 3), ("PROMO", 300), ("SMALL", 80), ("STANDARD", None)], lower=False)
    return round_doubles(j.groupBy("l_suppkey").agg(F.max(rate).cast("double").alias("max_rate")))


# ----------------------------------------------------- windows / top-1
@register("first_stay", """
select o_custkey, o_orderkey, o_totalprice, icu_rank from (
  select o_custkey, o_orderkey, o_totalprice,
         row_number() over (partition by o_custkey order by o_orderdate nulls first, o_orderkey) icu_rank
  from orders) x where icu_rank = 1""")
def first_stay(spark, sf):
    """WIN4d/FLT9: first row per group by time (row_number = 1)."""
    o = _t(spark, sf, "orders")
    out = rank_filter(o.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"],
                      [F.col("o_orderdate").asc_nulls_first(), "o_orderkey"], 1, rank_col="icu_rank")
    return out.select("o_custkey", "o_orderkey", "o_totalprice", F.col("icu_rank").cast("int").alias("icu_rank"))


@register("top_value_nulls_first", """
select l_suppkey, first_value from (
  select l_suppkey, case when l_quantity < 50 then l_quantity end first_value,
         row_number() over (partition by l_suppkey
           order by case when l_quantity < 50 then l_quantity end nulls first, l_orderkey, l_linenumber) rn
  from lineitem) x where rn = 1""")
def top_value_nulls_first(spark, sf):
    """WIN4a: smallest value per group with NULL sorting first (any NULL wins)."""
    li = _t(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_quantity") < 50, F.col("l_quantity")))
    out = pick_first(li, "l_suppkey", ["v", "l_orderkey", "l_linenumber"], ["v"])
    return out.withColumnRenamed("v", "first_value")


@register("max_in_window", """
select l_suppkey, max(l_quantity) max_qty from lineitem where l_shipdate <= timestamp '1997-01-01'
group by l_suppkey""")
def max_in_window(spark, sf):
    """WIN4b: top-1 descending inside an upper time bound = max."""
    li = _t(spark, sf, "lineitem")
    return (li.filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'"))
            .groupBy("l_suppkey").agg(F.max("l_quantity").alias("max_qty")))


@register("last_row", """
select l_suppkey, last_value from (
  select l_suppkey, case when l_returnflag = 'R' then l_quantity end last_value,
         row_number() over (partition by l_suppkey order by l_shipdate desc nulls last, l_orderkey desc,
                            l_linenumber desc) rn
  from lineitem) x where rn = 1""")
def last_row(spark, sf):
    """WIN4c: value of the last-charted row (sparse: NULL unless that row carries it)."""
    li = _t(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    out = pick_first(li, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], ["v"], desc=True)
    return out.withColumnRenamed("v", "last_value")


@register("first_then_notnull", f"""
select user_id, v first_value from (
  select user_id, case when event_type <> 'error' then value end v,
         row_number() over (partition by user_id order by ts nulls first, event_id) rn from events) x
where rn = 1 and v is not null""")
def first_then_notnull(spark, sf):
    """WIN4g: first observation per key, then the NULL test (a NULL first value drops the key)."""
    ev = _t(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    out = pick_first(ev, "user_id", ["ts", "event_id"], ["v"])
    return out.filter(F.col("v").isNotNull()).withColumnRenamed("v", "first_value")


@register("first_vitals_all_signs", """
select user_id, value, event_id from (
  select user_id, value, event_id, row_number() over (partition by user_id order by ts nulls first, event_id) rn
  from events where event_type = 'view') x where rn = 1""")
def first_vitals_all_signs(spark, sf):
    """WIN4h/T2: one min_by pass returns several columns of the first row."""
    ev = _t(spark, sf, "events").filter(F.col("event_type") == "view")
    return pick_first(ev, "user_id", ["ts", "event_id"], ["value", "event_id"])


# ---------------------------------------------------- buckets / matches
@register("bucket_counts", f"""
select 'T' || cast(greatest(1, ceil((minute % 1440) / 240.0)) as bigint) bucket, count(*) n
from {EV_SQL} x where minute % 1440 between 0 and 1440 group by 1""")
def bucket_counts(spark, sf):
    """CL20: inclusive-edge 4-hour bucket labels T1..T6 of the minute of day."""
    ev = _ev(spark, sf)
    b = C.bucket_label(F.col("minute") % 1440, 240, 6)
    return ev.filter(b.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _nearest_sql(anchor_type, cand_type, width):
    return f"""
with a as (select user_id, minute // {width} bk, minute, min(value) av from {EV_SQL} x
           where event_type = '{anchor_type}' group by 1, 2, 3),
c as (select user_id, minute // {width} bk, minute, min(value) cv from {EV_SQL} y
      where event_type = '{cand_type}' group by 1, 2, 3)"""


@register("nearest_in_bucket", f"""{_nearest_sql('purchase', 'click', 240)}
select user_id, purchase_minute, purchase_value, click_minute, click_value from (
  select a.user_id, a.minute purchase_minute, a.av purchase_value, c.minute click_minute, c.cv click_value,
         row_number() over (partition by a.user_id, a.minute order by abs(c.minute - a.minute), c.minute) rn
  from a join c on a.user_id = c.user_id and a.bk = c.bk) x where rn = 1""")
def nearest_in_bucket(spark, sf):
    """JN7/WIN4e: each purchase with the nearest click of the same user and 4-hour bucket."""
    ev = _ev(spark, sf).withColumn("bk", F.floor(F.col("minute") / 240))
    m = nearest_events(ev, ["user_id", "bk"], "minute",
                       anchor=F.when(F.col("event_type") == "purchase", F.struct(F.col("value").alias("v"))),
                       candidates={"c": F.when(F.col("event_type") == "click", F.struct(F.col("value").alias("v")))})
    return m.filter(F.col("c").isNotNull()).select(
        "user_id", F.col("minute").alias("purchase_minute"), F.col("anchor.v").alias("purchase_value"),
        F.col("c.t").alias("click_minute"), F.col("c.v.v").alias("click_value"))


@register("three_way_match", f"""{_nearest_sql('purchase', 'click', 1440)},
v as (select user_id, minute // 1440 bk, minute, min(value) vv from {EV_SQL} z
      where event_type = 'view' group by 1, 2, 3),
ac as (select a.*, c.minute cm, c.cv, row_number() over (partition by a.user_id, a.minute
         order by abs(c.minute - a.minute), c.minute) rn from a join c on a.user_id = c.user_id and a.bk = c.bk),
av as (select a.user_id, a.minute, v.minute vm, v.vv, row_number() over (partition by a.user_id, a.minute
         order by abs(v.minute - a.minute), v.minute) rn from a join v on a.user_id = v.user_id and a.bk = v.bk)
select ac.user_id, ac.minute purchase_minute, ac.cm click_minute, av.vm view_minute,
       round(ac.av / nullif(ac.cv - av.vv, 0), 6) ratio
from ac join av on ac.user_id = av.user_id and ac.minute = av.minute and av.rn = 1 where ac.rn = 1""")
def three_way_match(spark, sf):
    """JN8/CL22: anchor with nearest candidates of two kinds in one window pass."""
    ev = _ev(spark, sf).withColumn("bk", F.floor(F.col("minute") / 1440))
    et = F.col("event_type")
    m = nearest_events(ev, ["user_id", "bk"], "minute",
                       anchor=F.when(et == "purchase", F.struct(F.col("value").alias("v"))),
                       candidates={"c": F.when(et == "click", F.struct(F.col("value").alias("v"))),
                                   "w": F.when(et == "view", F.struct(F.col("value").alias("v")))})
    m = m.filter(F.col("c").isNotNull() & F.col("w").isNotNull())
    ratio = F.col("anchor.v") / F.nullif(F.col("c.v.v") - F.col("w.v.v"), F.lit(0.0))
    return round_doubles(m.select("user_id", F.col("minute").alias("purchase_minute"),
                                  F.col("c.t").alias("click_minute"), F.col("w.t").alias("view_minute"),
                                  ratio.alias("ratio")))


@register("interval_join", f"""
with s as (select user_id, min(minute) fs from {EV_SQL} x where event_type = 'signup' group by 1)
select e.event_id, e.user_id, e.minute from {EV_SQL} e
where exists (select 1 from s where s.user_id = e.user_id and e.minute between s.fs and s.fs + 1440)""")
def interval_join(spark, sf):
    """JN6/JN4: events within 24 h after the user's first signup (range semi-join)."""
    ev = _ev(spark, sf)
    first = ev.filter(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("minute").alias("fs"))
    return within_window(ev, first, "user_id", "minute", "fs", 1440).select("event_id", "user_id", "minute")


@register("interval_pick", f"""
with e as (select * from {EV_SQL} x),
l as (select user_id, minute m, event_id, lag(minute) over (partition by user_id order by minute, event_id) pm from e),
n as (select *, sum(case when pm is null or m - pm > 1440 then 1 else 0 end)
        over (partition by user_id order by m, event_id rows between unbounded preceding and current row) sid from l),
s as (select user_id, min(m) vs from n group by user_id, sid having max(m) + 60 - min(m) > 48 * 60),
cl as (select distinct user_id, minute, value from e where event_type = 'click'
       and exists (select 1 from s where s.user_id = e.user_id and e.minute between s.vs and s.vs + 1440)),
pu as (select distinct user_id, minute, value from e where event_type = 'purchase'
       and exists (select 1 from s where s.user_id = e.user_id and e.minute between s.vs and s.vs + 1440)),
p as (select c.user_id, c.minute cm, p.minute pm, c.value cv, p.value pv,
        row_number() over (partition by c.user_id order by abs(c.minute - p.minute), c.minute, p.minute, c.value, p.value) rn
      from cl c join pu p on c.user_id = p.user_id and c.minute // 240 = p.minute // 240)
select user_id, cm click_minute, pm purchase_minute, round(100 * pv / cv, 6) ratio from p where rn = 1""")
def interval_pick(spark, sf):
    """CL26/CL27: inside the first 24 h of each long (> 48 h) session, the
    closest same-bucket click/purchase pair per user."""
    ev = _ev(spark, sf)
    s = session_summary(sessions(ev, "user_id", "minute", 1440, start="vs", last="vl"), "user_id", "vs", "vl")
    s = s.filter(F.col("duration_h") > 48)
    cl = within_window(ev.filter(F.col("event_type") == "click"), s, "user_id", "minute", "vs", 1440)
    pu = within_window(ev.filter(F.col("event_type") == "purchase"), s, "user_id", "minute", "vs", 1440)
    rows = (cl.select("user_id", "minute", F.struct(F.col("value").alias("cv")).alias("a"),
                      F.lit(None).cast("struct<pv:double>").alias("c"))
            .unionByName(pu.select("user_id", "minute", F.lit(None).cast("struct<cv:double>").alias("a"),
                                   F.struct(F.col("value").alias("pv")).alias("c")))
            .withColumn("bk", F.floor(F.col("minute") / 240)))
    m = nearest_events(rows, ["user_id", "bk"], "minute", anchor=F.col("a"), candidates={"p": F.col("c")})
    m = m.filter(F.col("p").isNotNull()).select(
        "user_id", F.col("minute").alias("click_minute"), F.col("p.t").alias("purchase_minute"),
        F.col("anchor.cv").alias("cv"), F.col("p.v.pv").alias("pv"))
    best = pick_first(m, "user_id", [F.abs(F.col("click_minute") - F.col("purchase_minute")), "click_minute",
                                     "purchase_minute", "cv", "pv"], ["click_minute", "purchase_minute", "cv", "pv"])
    return round_doubles(best.select("user_id", "click_minute", "purchase_minute",
                                     float_ratio(100 * F.col("pv"), "cv").alias("ratio")))


@register("pair_days", f"""
with e as (select user_id, minute, value, event_id from {EV_SQL} x),
d1 as (select user_id, value day1 from (select *, row_number() over (partition by user_id
         order by abs(minute), minute, value, event_id) rn from e) y where rn = 1 and abs(minute) < 1440),
d2 as (select user_id, min(value) day2 from e where minute between 1440 and 2820 group by 1)
select d1.user_id, d1.day1, d2.day2, {_band_sql('d1.day1', 50, 40)} day1_label, {_band_sql('d2.day2', 50, 40)} day2_label
from d1 join d2 on d1.user_id = d2.user_id""")
def pair_days(spark, sf):
    """CL31/WIN4i: day-1 value nearest time zero and day-2 minimum, labelled."""
    ev = _ev(spark, sf)
    d1 = (pick_first(ev, "user_id", [F.abs("minute"), "minute", "value", "event_id"], ["minute", "value"])
          .filter(F.abs("minute") < 1440).select("user_id", F.col("value").alias("day1")))
    d2 = ev.filter(F.col("minute").between(1440, 2820)).groupBy("user_id").agg(F.min("value").alias("day2"))
    return d1.join(d2, "user_id").select("user_id", "day1", "day2", _band("day1", 50, 40).alias("day1_label"),
                                         _band("day2", 50, 40).alias("day2_label"))


@register("day_bucket_sum", f"""
select user_id, round(sum(value), 6) day1_sum from (
  select distinct user_id, minute, value from {EV_SQL} x where minute between 0 and 5760) d
where minute between 0 and 1440 group by user_id""")
def day_bucket_sum(spark, sf):
    """AGG7/AGG11/CL17: day-1 sum over distinct (key, time, value) rows."""
    ev = _ev(spark, sf).filter(F.col("minute").between(0, 1440)).select("user_id", "minute", "value").distinct()
    return round_doubles(ev.groupBy("user_id").agg(F.sum("value").alias("day1_sum")))


# ------------------------------------------------------------- joins
@register("semi_join_cohort", """
select c_custkey, c_name, c_mktsegment from customer
where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def semi_join_cohort(spark, sf):
    """JN5: keys with a qualifying row (left semi join)."""
    c = _t(spark, sf, "customer")
    o = _t(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name", "c_mktsegment")


@register("multikey_join", """
with a as (select l_suppkey, l_returnflag, sum(l_quantity) qty from lineitem group by 1, 2),
b as (select l_suppkey, l_returnflag, count(case when l_discount > 0.05 then 1 end) n_disc from lineitem group by 1, 2)
select a.l_suppkey, a.l_returnflag, round(a.qty, 6) qty, b.n_disc from a join b
  on a.l_suppkey = b.l_suppkey and a.l_returnflag = b.l_returnflag""")
def multikey_join(spark, sf):
    """JN2: join of two aggregates on (key, bucket)."""
    li = _t(spark, sf, "lineitem")
    a = li.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("qty"))
    b = li.groupBy("l_suppkey", "l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n_disc"))
    return round_doubles(a.join(b, ["l_suppkey", "l_returnflag"]))


@register("argmin_joinback", """
select l_suppkey, min(l_extendedprice) min_price from lineitem group by l_suppkey""")
def argmin_joinback(spark, sf):
    """JN9: rows equal to the group minimum, deduplicated = the group minimum."""
    return _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("min_price"))


@register("left_spine_scores", """
with a as (select o_custkey, count(*) n, max(o_totalprice) mx, count(case when o_orderpriority = '1-URGENT' then 1 end) u
           from orders group by 1),
s as (select c_custkey,
  case when n >= 15 then 4 when n >= 10 then 3 when n >= 5 then 2 when n >= 1 then 1 else 0 end s_n,
  case when mx > 400000 then 4 when mx > 300000 then 3 when mx > 200000 then 2 when mx > 100000 then 1 else 0 end s_mx,
  case when u >= 4 then 2 when u >= 1 or c_acctbal < 0 then 1 else 0 end s_u
  from customer left join a on a.o_custkey = c_custkey)
select c_custkey, s_n, s_mx, s_u, s_n + s_mx + s_u total from s""")
def left_spine_scores(spark, sf):
    """JN3/CL11/CL19/FLT8: left-join aggregates onto the key spine, banded
    scores (missing input scores 0), total."""
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    o = _t(spark, sf, "orders")
    a = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("mx"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    j = c.join(a, "c_custkey", "left")
    n, mx, u = F.col("n"), F.col("mx"), F.col("u")
    s_n = first_match([(n >= 15, 4), (n >= 10, 3), (n >= 5, 2), (n >= 1, 1)], otherwise=0)
    s_mx = first_match([(mx > 400000, 4), (mx > 300000, 3), (mx > 200000, 2), (mx > 100000, 1)], otherwise=0)
    s_u = first_match([(u >= 4, 2), ((u >= 1) | (F.col("c_acctbal") < 0), 1)], otherwise=0)
    return j.select("c_custkey", s_n.alias("s_n"), s_mx.alias("s_mx"), s_u.alias("s_u"),
                    (s_n + s_mx + s_u).alias("total"))


# -------------------------------------------------------- aggregations
@register("conditional_aggs", """
select o_custkey, max(case when o_orderstatus = 'F' then o_totalprice end) max_f,
       min(case when o_orderstatus = 'O' then o_totalprice end) min_o,
       max(case when o_orderpriority = '1-URGENT' then 1 end) urgent,
       round(sum(case when o_orderstatus = 'P' then o_totalprice end), 6) sum_p
from orders group by o_custkey""")
def conditional_aggs(spark, sf):
    """AGG3/AGG6: conditional max/min/sum and 1-or-NULL indicators in one pass."""
    o = _t(spark, sf, "orders")
    st, pr, v = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    return round_doubles(o.groupBy("o_custkey").agg(
        F.max(F.when(st == "F", v)).alias("max_f"), F.min(F.when(st == "O", v)).alias("min_o"),
        F.max(F.when(pr == "1-URGENT", F.lit(1))).alias("urgent"), F.sum(F.when(st == "P", v)).alias("sum_p")))


@register("any_flags", """
select o_custkey, count(case when o_orderpriority = '1-URGENT' then 1 end) > 0 has_urgent,
       count(case when o_orderstatus = 'O' then 1 end) > 0 has_open,
       count(case when o_totalprice > 300000 then 1 end) > 0 has_big,
       count(case when o_orderpriority like '5%' then 1 end) > 0 has_low
from orders group by o_custkey""")
def any_flags_q(spark, sf):
    """AGG4/CL28: any-match flags (FALSE, not NULL, when nothing matches)."""
    o = _t(spark, sf, "orders")
    return any_flags(o, "o_custkey", {
        "has_urgent": F.col("o_orderpriority") == "1-URGENT", "has_open": F.col("o_orderstatus") == "O",
        "has_big": F.col("o_totalprice") > 300000, "has_low": F.col("o_orderpriority").startswith("5")})


@register("having_subquery", """
select l_suppkey, max(l_quantity) max_qty from lineitem group by 1 having max(l_quantity) > 49""")
def having_subquery(spark, sf):
    """AGG10: filter on an aggregate result."""
    li = _t(spark, sf, "lineitem")
    return li.groupBy("l_suppkey").agg(F.max("l_quantity").alias("max_qty")).filter(F.col("max_qty") > 49)


@register("distinct_keys", """
select distinct o_custkey, o_orderstatus from orders""")
def distinct_keys(spark, sf):
    """AGG7/AGG9: DISTINCT rows / GROUP BY used to deduplicate."""
    return _t(spark, sf, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


# ------------------------------------------------------------ report
def _oc(spark, sf):
    o = _t(spark, sf, "orders")
    c = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey)


_OC_SQL = "(select * from orders join customer on o_custkey = c_custkey)"


@register("strat_mean_sd", f"""
select c_mktsegment, count(*) n, round(avg(o_totalprice), 6) o_totalprice_mean,
       round(stddev_samp(o_totalprice), 6) o_totalprice_sd, round(avg(c_acctbal), 6) c_acctbal_mean,
       round(stddev_samp(c_acctbal), 6) c_acctbal_sd from {_OC_SQL} x group by 1""")
def strat_mean_sd(spark, sf):
    """AGG12: stratified mean and SD of several variables in one pass."""
    return round_doubles(S.stratified_mean_sd(_oc(spark, sf), "c_mktsegment", ["o_totalprice", "c_acctbal"]))


@register("strat_props", f"""
select c_mktsegment, o_orderstatus, n, round(n / sum(n) over (partition by c_mktsegment), 3) prop from (
  select c_mktsegment, o_orderstatus, count(*) n from {_OC_SQL} x where o_orderstatus is not null group by 1, 2) y""")
def strat_props(spark, sf):
    """AGG15: within-stratum proportions, 3 decimals."""
    return S.proportions(_oc(spark, sf), "c_mktsegment", "o_orderstatus")


@register("flag_prevalence", f"""
with l as (
  select c_mktsegment, 'is_finished' flag, o_orderstatus = 'F' value from {_OC_SQL} a
  union all select c_mktsegment, 'is_urgent', o_orderpriority = '1-URGENT' from {_OC_SQL} b
  union all select c_mktsegment, 'is_big', o_totalprice > 200000 from {_OC_SQL} c)
select c_mktsegment, flag, value, n, round(n / sum(n) over (partition by c_mktsegment, flag), 3) prop from (
  select c_mktsegment, flag, value, count(*) n from l where value is not null group by 1, 2, 3) y""")
def flag_prevalence(spark, sf):
    """AGG16: FALSE/TRUE shares of several flags per stratum (stack + proportions)."""
    d = _oc(spark, sf).select("c_mktsegment", (F.col("o_orderstatus") == "F").alias("is_finished"),
                              (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"),
                              (F.col("o_totalprice") > 200000).alias("is_big"))
    return S.flag_prevalence(d, "c_mktsegment", ["is_finished", "is_urgent", "is_big"])


@register("six_number", f"""
select c_mktsegment, round(min(o_totalprice) / 1000, 7) min, round(quantile_cont(o_totalprice, 0.25) / 1000, 7) q1,
       round(quantile_cont(o_totalprice, 0.5) / 1000, 7) median, round(avg(o_totalprice) / 1000, 7) mean,
       round(quantile_cont(o_totalprice, 0.75) / 1000, 7) q3, round(max(o_totalprice) / 1000, 7) max,
       count(case when o_totalprice is null then 1 end) n_na
from {_OC_SQL} x group by 1""")
def six_number(spark, sf):
    """AGG17: min, quartiles (exact, distributed), mean, max and NA count, scaled.
    Rounded to 7 places: quartiles of cent values / 1000 end in ...5 at the 6th."""
    return round_doubles(S.six_number(_oc(spark, sf), "c_mktsegment", "o_totalprice", scale=1000), 7)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("crosstab", f"""
select o_orderstatus, {', '.join(f"count(case when c_mktsegment = '{s}' then 1 end) as {s}" for s in _SEGMENTS)}
from {_OC_SQL} x where o_orderstatus is not null and c_mktsegment is not null group by 1""")
def crosstab(spark, sf):
    """AGG14: two-way contingency table over a fixed level list."""
    return S.crosstab(_oc(spark, sf), "o_orderstatus", "c_mktsegment", _SEGMENTS)


@register("freq_table", """
select o_orderpriority, count(*) n from orders where o_orderpriority is not null group by 1""")
def freq_table(spark, sf):
    """AGG13: frequency table, NA excluded."""
    return S.frequency(_t(spark, sf, "orders"), "o_orderpriority")


@register("scrub_recode", """
select c_custkey, case when c_acctbal < 0 or c_acctbal > 9000 then null else c_acctbal end acctbal,
       case when c_mktsegment = 'BUILDING' then 0 when c_mktsegment = 'AUTOMOBILE' then 1 end segment_code
from customer""")
def scrub_recode(spark, sf):
    """FLT11/FLT12: out-of-range values to NULL; two categories to 0/1, others NULL."""
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", C.scrub("c_acctbal", 0, 9000).alias("acctbal"),
                    C.recode("c_mktsegment", {"BUILDING": 0, "AUTOMOBILE": 1}).alias("segment_code"))


# ----------------------------------------------------- tests and models
_PRIO_CLASS = "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' else 'other' end"


@register("chisq", f"""
with c as (select o_orderstatus r, {_PRIO_CLASS} k, count(*) n from orders group by 1, 2),
e as (select c.*, sum(n) over (partition by r) rt, sum(n) over (partition by k) ct, sum(n) over () nn from c)
select round(max(nn) * sum(cast(n as double) * n / (rt * ct)) - max(nn), 6) statistic,
       cast((count(distinct r) - 1) * (count(distinct k) - 1) as bigint) df,
       round(exp(-(max(nn) * sum(cast(n as double) * n / (rt * ct)) - max(nn)) / 2), 6) p_value from e""")
def chisq(spark, sf):
    """ST1: Pearson chi-square of status x priority class (df 2: p = exp(-x/2))."""
    o = _t(spark, sf, "orders").withColumn("k", F.expr(_PRIO_CLASS))
    return round_doubles(S.chisq_test(o, "o_orderstatus", "k"))


@register("welch_t", f"""
with v as (select c_mktsegment = 'BUILDING' first, o_totalprice x from {_OC_SQL} x where c_mktsegment in ('BUILDING', 'AUTOMOBILE')),
g as (select avg(x) filter (first) a, avg(x) filter (not first) b, var_samp(x) filter (first) / count(x) filter (first) ea,
             var_samp(x) filter (not first) / count(x) filter (not first) eb, count(x) filter (first) - 1 fa,
             count(x) filter (not first) - 1 fb from v),
w as (select a mean_a, b mean_b, (a - b) / sqrt(ea + eb) t, (ea + eb) * (ea + eb) / (ea * ea / fa + eb * eb / fb) df from g)
select round(mean_a, 6) mean_a, round(mean_b, 6) mean_b, round(t, 6) t, round(df, 6) df, round({t_tail("t", "df")}, 6) p_value from w""")
def welch_t(spark, sf):
    """ST3: Welch two-sample t-test with its two-sided p-value."""
    return round_doubles(S.welch_t_test(_oc(spark, sf), "o_totalprice", "c_mktsegment", "BUILDING", "AUTOMOBILE"))


_LANGS = ["en", "de", "es", "fr"]
_LD_SQL = "(select l.*, d.lang, d.n_chars from labels l join documents d on l.doc_id = d.doc_id)"


@register("odds_ratio", f"""
with c as (select lang, count(case when quality = 1 then 1 end) e, count(case when quality = 0 then 1 end) n
           from {_LD_SQL} x where lang in {tuple(_LANGS)} group by 1),
r as (select e re, n rn from c where lang = 'en'),
k as (select c.lang, c.e events, c.n nonevents, r.re, r.rn from c, r where c.lang <> 'en'),
g as (select *, case when events > 0 and nonevents > 0 and re > 0 and rn > 0 then
        ln((cast(events as double) * rn) / (cast(nonevents as double) * re)) end lor,
        case when events > 0 and nonevents > 0 and re > 0 and rn > 0 then
        sqrt(1.0 / events + 1.0 / nonevents + 1.0 / re + 1.0 / rn) end se from k)
select lang, events, nonevents, round(exp(lor), 6) odds_ratio, round(se, 6) se_log_or,
       round(exp(lor - 1.959963984540054 * se), 6) ci_low, round(exp(lor + 1.959963984540054 * se), 6) ci_high from g""")
def odds_ratio(spark, sf):
    """ST4/ST5 (single factor): odds ratios against the reference level with Wald CI."""
    lab = _t(spark, sf, "labels")
    doc = _t(spark, sf, "documents").select("doc_id", "lang")
    d = lab.join(doc, "doc_id")
    return round_doubles(S.odds_ratios(d, "quality", "lang", _LANGS))


_LOGIT_ROWS = f"""select quality y, cast(1 as double) x0, {", ".join(f"cast(lang = '{v}' as double) x{i}" for i, v in enumerate(_LANGS[1:], start=1))},
       n_chars / 1000.0 x4, cast(toxic as double) x5 from {_LD_SQL} z
where lang in {tuple(_LANGS)} and quality is not null and n_chars is not null and toxic is not null"""


def _quality_rows(spark, sf):
    lab = _t(spark, sf, "labels")
    doc = _t(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") / 1000.0).alias("kchars"))
    return lab.join(doc, "doc_id").filter(F.col("lang").isin(*_LANGS))


@register("logistic_adjusted", f"""select * replace ({", ".join(f"round({c}, 6) as {c}" for c in LOGIT_COLUMNS)})
from ({logit_sql(_LOGIT_ROWS, ["(Intercept)", *[f"lang_{v}" for v in _LANGS[1:]], "kchars", "toxic"])}) m""")
def logistic_adjusted(spark, sf):
    """ST4/ST5/ST8: adjusted binomial GLM by shared Newton passes, odds ratios and Wald intervals."""
    fit = S.logistic_regression(_quality_rows(spark, sf), "quality", ["kchars", "toxic"], factor="lang", levels=_LANGS)
    return round_doubles(fit.drop("profile_low", "profile_high", "steps"))


_CELLS = f"""select lang as level, count(*) filter (quality = 1) e, count(*) filter (quality = 0) n from {_LD_SQL} x where lang in {tuple(_LANGS)} group by 1"""


@register("odds_ratio_profile", f"""select term, round(estimate, 6) estimate, round(odds_ratio, 6) odds_ratio, round(profile_low, 6) profile_low,
       round(profile_high, 6) profile_high, separated from ({profile_sql(_CELLS, "en", "lang_")}) m""")
def odds_ratio_profile(spark, sf):
    """ST5 (single factor): odds ratios against the reference level with profile-likelihood intervals."""
    fit = S.logistic_regression(_quality_rows(spark, sf), "quality", [], factor="lang", levels=_LANGS, profile=True)
    return round_doubles(fit.filter("term <> '(Intercept)'").select("term", "estimate", "odds_ratio", "profile_low", "profile_high", "separated"))


# ----------------------------------------------------------- transitions
_HALF = "TIMESTAMP_NTZ'1998-05-01 00:00:00'"


def _halves(spark, sf):
    o = _t(spark, sf, "orders")
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    early = F.col("o_orderdate") < F.expr(_HALF)
    h = o.groupBy("o_custkey").agg(F.avg(F.when(early, F.col("o_totalprice"))).alias("a1"),
                                   F.avg(F.when(~early, F.col("o_totalprice"))).alias("a2"))
    j = h.join(c, h.o_custkey == c.c_custkey)
    return j.select("o_custkey", _band("a1", 160000, 140000).alias("day1"),
                    _band("a2", 160000, 140000).alias("day2"),
                    F.when(F.col("c_acctbal") < 0, "Expired").otherwise("Alive").alias("status"),
                    F.col("c_acctbal"))


_HALF_SQL = f"""
with h as (select o_custkey, avg(case when o_orderdate < timestamp '1998-05-01' then o_totalprice end) a1,
                  avg(case when o_orderdate >= timestamp '1998-05-01' then o_totalprice end) a2 from orders group by 1),
t as (select o_custkey, {_band_sql('a1', 160000, 140000)} day1, {_band_sql('a2', 160000, 140000)} day2,
             case when c_acctbal < 0 then 'Expired' else 'Alive' end status, c_acctbal
      from h join customer on o_custkey = c_custkey),
g as (select * from (values {', '.join(f"('{a}', '{b}')" for a in PHENO for b in PHENO)}) v(day1, day2))"""


@register("transitions", f"""{_HALF_SQL},
c as (select day1, day2, count(*) n from t where day1 is not null and day2 is not null group by 1, 2),
f as (select g.day1, g.day2, coalesce(c.n, 0) n from g left join c on c.day1 = g.day1 and c.day2 = g.day2)
select day1, day2, n, case when sum(n) over (partition by day1) > 0 then round(n / sum(n) over (partition by day1), 3)
  end prop from f""")
def transitions(spark, sf):
    """ST9: day-1 -> day-2 band transition counts and row proportions."""
    return S.transition_matrix(_halves(spark, sf), "day1", "day2", list(PHENO))


@register("transition_outcomes", f"""{_HALF_SQL},
c as (select day1, day2, count(*) n, count(case when status = 'Expired' then 1 end) events,
             avg(c_acctbal) mean_value from t where status is not null group by 1, 2)
select g.day1, g.day2, coalesce(c.n, 0) n, coalesce(c.events, 0) events, round(c.mean_value, 6) mean_value,
       case when coalesce(c.n, 0) > 0 then round(c.events / c.n, 3) end rate
from g left join c on c.day1 = g.day1 and c.day2 = g.day2""")
def transition_outcomes(spark, sf):
    """ST10: per-transition patients, events, event rate and mean value over the full grid."""
    return round_doubles(S.transition_outcomes(_halves(spark, sf), "day1", "day2", "status", "Expired",
                                               "c_acctbal", list(PHENO)))


@register("transition_chisq", f"""{_HALF_SQL},
c as (select day2 target, case when day1 = day2 then 'stay' else 'enter' end src, status, count(*) n
      from t where day1 is not null and day2 is not null group by 1, 2, 3),
e as (select c.*, sum(n) over (partition by target, src) rt, sum(n) over (partition by target, status) ct,
             sum(n) over (partition by target) nn from c)
select target, round(max(nn) * sum(cast(n as double) * n / (rt * ct)) - max(nn), 6) statistic,
       cast((count(distinct src) - 1) * (count(distinct status) - 1) as bigint) df from e group by target""")
def transition_chisq(spark, sf):
    """ST2: 2x2 chi-square per destination band (stayed vs entered) x outcome,
    computed from the transitions instead of typed counts."""
    t = _halves(spark, sf).filter(F.col("day1").isNotNull() & F.col("day2").isNotNull())
    t = t.withColumn("src", F.when(F.col("day1") == F.col("day2"), "stay").otherwise("enter"))
    counts = t.groupBy(F.col("day2").alias("target"), "src", "status").agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(S.chisq_from_counts(counts, "src", "status", by=["target"]).drop("p_value"))


# --------------------------------------------------------------- splines
def _doc_quality(spark, sf):
    lab = _t(spark, sf, "labels")
    doc = _t(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("kchars"))
    return lab.join(doc, "doc_id")


@register("spline_fit")
def spline_fit(spark, sf):
    """ST6/ST8: binomial penalised spline quality ~ s(kchars) + toxic (summary table)."""
    from carelog.operators.splines import gam_fit, summary_frame
    fit = gam_fit(_doc_quality(spark, sf), "quality", "kchars", ["toxic"], family="binomial")
    return round_doubles(summary_frame(spark, fit))


_PRICES = "select l_extendedprice / 1000 y, cast(l_quantity as double) x, cast(l_discount as double) z from lineitem"


def _price_fit(spark, sf):
    from carelog.operators.splines import gam_fit
    d = _t(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").cast("double").alias("x"),
                                         F.col("l_discount").cast("double").alias("z"))
    return d, gam_fit(d, "y", "x", ["z"], intervals=4, penalty=0.5)


@register("spline_coefficients", f"""select term, round(estimate, 6) estimate, round(edf, 6) edf, round(deviance, 3) deviance
from ({spline_sql(_PRICES, 4, 0.5)}) x""")
def spline_coefficients(spark, sf):
    """ST6: gaussian P-spline of price on quantity with a given penalty; SQL solves the normal equations."""
    from carelog.operators.splines import coefficient_frame
    out = coefficient_frame(spark, _price_fit(spark, sf)[1]).select("term", "estimate", "edf", F.round("deviance", 3).alias("deviance"))
    return round_doubles(out)


@register("curve_points", f"""with c as materialized ({spline_sql(_PRICES, 4, 0.5)}),
w as (select {", ".join(f"max(estimate) filter (term = 's(x).{i + 1}') b{i}" for i in range(7))}, max(estimate) filter (term = 'z') bz from c),
d as (select y, x, z, quantile_disc(z, 0.5) over () mid, (x - min(x) over ()) / ((max(x) over () - min(x) over ()) / 4) u from ({_PRICES}) q),
f as (select d.*, bz, {" + ".join(
    f"b{j} * (" + " + ".join(f"({s}) * power(greatest(u - {j - 3 + k}, 0), 3)" for k, s in enumerate((1, -4, 6, -4, 1))) + ") / 6" for j in range(7))} + bz * mid curve from d, w),
p as (select x, curve, y - curve - bz * (z - mid) residual, bz from f)
select x, round(avg(curve), 6) curve, count(*) n, round(avg(curve + residual), 5) partial,
       cast(sum(case when residual > 0 then 1 else 0 end) as bigint) above from p group by x""")
def curve_points(spark, sf):
    """ST7: partial residuals and rug sides of the fitted curve, summed up by quantity (every row enters)."""
    from carelog.operators.splines import points
    d, fit = _price_fit(spark, sf)
    p = points(d, fit).groupBy("x").agg(F.avg("curve").alias("curve"), F.count("*").alias("n"), F.avg("partial").alias("partial"),
                                        F.count_if(F.col("rug") == "above").alias("above"))
    return round_doubles(p.withColumn("partial", F.round("partial", 5)))


@register("partial_effect")
def partial_effect_q(spark, sf):
    """ST7: fitted smooth with a 95% band on a grid (the data behind the plot)."""
    from carelog.operators.splines import curve, gam_fit
    fit = gam_fit(_doc_quality(spark, sf), "quality", "kchars", ["toxic"], family="binomial")
    return round_doubles(curve(spark, fit))


# ------------------------------------------------------ sources and sinks
def _io_folder(spark, sf, name):
    from carelog.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/carelog-io/{name}-{hashlib.sha1(str(sf).encode()).hexdigest()[:8]}"


_CSV_SQL = """select c_custkey, case when c_mktsegment <> 'BUILDING' then c_mktsegment end segment,
       case when c_acctbal >= 0 then c_acctbal end balance, round(c_acctbal, 2) < 100 low from customer"""


def _csv_back(spark, sf, na, name):
    """Writes customers as CSV and reads them back, with ``na`` as the text of NULL."""
    customers = _t(spark, sf, "customer")
    customers = customers.selectExpr("c_custkey", "case when c_mktsegment <> 'BUILDING' then c_mktsegment end segment",
                                     "case when c_acctbal >= 0 then c_acctbal end balance", "round(c_acctbal, 2) < 100 low")
    path = _io_folder(spark, sf, name)
    export_csv(customers, path, na=na)
    return read_csv(spark, path, schema=customers.schema, na=na)


@register("csv_empty_na", _CSV_SQL)
def csv_empty_na(spark, sf):
    """SRC4, SNK3: CSV export and read, an empty field is NULL."""
    return _csv_back(spark, sf, "", "csv-empty")


@register("csv_na", _CSV_SQL)
def csv_na(spark, sf):
    """SRC5, SNK3: CSV export and read, ``NA`` is NULL."""
    return _csv_back(spark, sf, "NA", "csv-na")


@register("table_and_view", """select o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total,
       count(distinct o_custkey) customers from orders where o_totalprice > 1000 group by 1""")
def table_and_view(spark, sf):
    """SNK1, SNK2: a written table, a view over it, and a query of the view."""
    path = _io_folder(spark, sf, "orders")
    write_table(_t(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_totalprice"), f"{path}/large.parquet")
    create_view(read_table(spark, path, "large").filter("o_totalprice > 1000"), "large_orders")
    return spark.sql("""select o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total,
                               count(distinct o_custkey) customers from large_orders group by o_orderstatus""")
