"""Oxygen-therapy sessions per ICU stay.

Support events come from nurse charting (text value, O2 flow), respiratory
charting (label text, device value, FiO2) and treatments.  Each source table
is scanned once: a row's codes from all rules are merged on the row
(highest code, and whether any rule gave -1), which is what the per-minute
dedupe would do with the separate branches.  Sessions split where the gap
between events exceeds 24 h (see ``operators.events``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelog.functions.parse import safe_double, safe_int
from carelog.functions.rules import DEVICE_LABELS, oxygen_support_code
from carelog.functions.util import first_match
from carelog.operators.events import dedupe_events, session_summary, sessions, union_events

MIN_OFFSET = -60      # events from one hour before admission
SESSION_GAP = 24 * 60  # minutes
STAY = "patientunitstayid"


def flow_code(label, value) -> Column:
    """-1 (extra oxygen) for an ``O2 L/%`` entry holding an integer in (0, 100]."""
    v = safe_int(value)
    return F.when((F.col(label) == "O2 L/%") & (v > 0) & (v <= 100), F.lit(-1))


def fio2_code(label, value) -> Column:
    """FiO2 outside room air: 0.22 < x <= 1 or x > 22 -> -1; x < 0.2 or
    0.22 < x < 20 -> 0; anything else (room air, unparsable) -> NULL."""
    x = safe_double(value)
    is_fio2 = F.lower(F.col(label)).isin("fio2", "fio2 (%)")
    keep = (x < 0.2) | ((x > 0.22) & (x < 20)) | (x > 22)
    return F.when(is_fio2 & keep,
                  first_match([((x <= 1) & (x > 0.22), -1), (x > 22, -1)], otherwise=0))


def _merged(df: DataFrame, codes: dict[str, Column], keep: list) -> DataFrame:
    """Evaluate each rule code once (own projection), then merge them: highest
    code, and whether any rule gave -1.  Two projections keep Catalyst from
    inlining the large rule CASE into every use."""
    staged = df.select(*keep, *[c.cast("int").alias(n) for n, c in codes.items()])
    names = list(codes)
    code = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    supp = F.lit(False)
    for n in names:
        supp = supp | F.coalesce(F.col(n) == -1, F.lit(False))
    return staged.select(*keep, code.alias("code"), supp.alias("supp"))


def support_events(resp: DataFrame, nurse: DataFrame, treatment: DataFrame,
                   min_offset: int = MIN_OFFSET) -> DataFrame:
    """Rows (stay, charttime, code, supp, active): one per source row; ``code``
    is NULL where no rule matched (callers aggregate conditionally instead of
    filtering, so the rule CASE is never copied into a pushed-down filter)."""
    r = (resp.filter(F.col("respchartoffset") >= min_offset)
         .select(F.col(STAY), F.col("respchartoffset").alias("charttime"),
                 F.lower("respchartvaluelabel").alias("_label"), F.lower("respchartvalue").alias("_value"),
                 F.col("respchartvaluelabel"), F.col("respchartvalue")))
    r = _merged(r, {"_c_label": oxygen_support_code("_label", lower=False),
                    "_c_device": F.when(F.col("_label").isin(*DEVICE_LABELS),
                                        oxygen_support_code("_value", lower=False)),
                    "_c_fio2": fio2_code("respchartvaluelabel", "respchartvalue")},
                [STAY, "charttime"])
    n = (nurse.filter(F.col("nursingchartoffset") >= min_offset)
         .select(F.col(STAY), F.col("nursingchartoffset").alias("charttime"),
                 F.lower("nursingchartvalue").alias("_value"),
                 F.col("nursingchartcelltypevallabel"), F.col("nursingchartvalue")))
    n = _merged(n, {"_c_value": oxygen_support_code("_value", lower=False),
                    "_c_flow": flow_code("nursingchartcelltypevallabel", "nursingchartvalue")},
                [STAY, "charttime"])
    t = (treatment.filter(F.col("treatmentoffset") >= min_offset)
         .select(F.col(STAY), F.col("treatmentoffset").alias("charttime"),
                 F.lower("treatmentstring").alias("_value"),
                 F.col("activeupondischarge").cast("boolean").alias("active")))
    t = _merged(t, {"_c_value": oxygen_support_code("_value", lower=False)}, [STAY, "charttime", "active"])
    return union_events(r, n, t)


def deduped_support_events(resp, nurse, treatment, min_offset: int = MIN_OFFSET) -> DataFrame:
    """One row per (stay, charttime): max code, max active flag, supp_oxygen."""
    ev = support_events(resp, nurse, treatment, min_offset)
    has = F.col("code").isNotNull()
    return (ev.groupBy(STAY, "charttime")
            .agg(F.max("code").alias("oxygen_therapy_type"),
                 F.max(F.when(has, F.col("active"))).alias("activeupondischarge"),
                 F.max(F.when(has, F.col("supp"))).alias("supp_oxygen"))
            .filter(F.col("oxygen_therapy_type").isNotNull()))


def oxygen_therapy(resp: DataFrame, nurse: DataFrame, treatment: DataFrame, patient: DataFrame,
                   gap: int = SESSION_GAP, min_offset: int = MIN_OFFSET) -> DataFrame:
    """One row per (stay, support session): icustay_id, ventnum, vent_end,
    vent_start, oxygen_therapy_type, supp_oxygen, vent_duration (hours),
    vent_start_first.  All sessions are returned, not only the first."""
    ev = support_events(resp, nurse, treatment, min_offset)
    sess = sessions(ev, STAY, "charttime", gap,
                    payload={"oxygen_therapy_type": ("max", F.col("code")),
                             "supp_oxygen": ("any", F.col("supp")),
                             "active": ("max", F.col("active"))},
                    session="ventnum", start="vent_start", last="_last", where=F.col("code").isNotNull())
    pat = patient.select(STAY, "unitdischargeoffset")
    joined = sess.join(pat, STAY, "left")
    out = session_summary(joined, STAY, start="vent_start", last="_last", active="active",
                          discharge="unitdischargeoffset")
    return out.select(F.col(STAY).alias("icustay_id"), F.col("ventnum").cast("bigint").alias("ventnum"),
                      F.col("end").cast("bigint").alias("vent_end"), F.col("vent_start").cast("bigint").alias("vent_start"),
                      F.col("oxygen_therapy_type").cast("int").alias("oxygen_therapy_type"),
                      F.col("supp_oxygen"), F.col("duration_h").cast("double").alias("vent_duration"),
                      F.col("first_start").cast("bigint").alias("vent_start_first"))


def support_code_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["support_events", "deduped_support_events", "oxygen_therapy", "flow_code", "fio2_code",
           "dedupe_events"]
