"""Ventilated cohort and its index PaO2/FiO2 ratio.

Cohort: the first ICU stay of each hospital stay, intubated on day 1, with
an oxygen-support session longer than 48 h.  Index P/F: among PaO2 and FiO2
values charted in the first 24 h of such a session, the closest pair inside
one 4-hour bucket of the first day (T1..T6); ties go to the earlier FiO2,
then earlier PaO2, then smaller values, then the earliest session.  Stays
whose index P/F is above 300 or that lack an ARDS-type diagnosis drop out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.functions.parse import safe_decimal
from carelog.operators.match import nearest_events, pick_first, within_window

STAY = "patientunitstayid"
MIN_SESSION_H = 48
GAS_WINDOW = 24 * 60
BUCKET_MIN, N_BUCKETS = 240, 6

# FiO2 labels of respiratory charting and ARDS diagnosis markers.
FIO2_LABELS = ("Set Fraction of Inspired Oxygen (FIO2)", "FiO2", "FIO2 (%)")
ARDS_TEXT = "ARDS"
ARDS_ICD = ("518.82", "518.5", "518.81")


def stays(patient: DataFrame) -> DataFrame:
    """Stay attributes and the rank of the stay inside its hospital stay
    (ordered by hospital admit offset, then stay id)."""
    first = pick_first(patient, "patienthealthsystemstayid",
                       ["hospitaladmitoffset", STAY], [STAY]).withColumn("ICU_rank", F.lit(1))
    return patient.join(first.select(STAY, "ICU_rank"), STAY, "left").select(
        STAY, "gender", safe_decimal("age").cast("double").alias("age"), "ethnicity",
        F.col("unitdischargeoffset").alias("unit_duration"),
        (F.col("hospitaldischargeoffset") - F.col("hospitaladmitoffset")).alias("hospital_duration"),
        F.col("unitadmitsource").alias("unitAdmitSource"), "unitdischargestatus", "hospitaldischargestatus",
        "admissionheight", "admissionweight", "dischargeweight",
        F.coalesce("ICU_rank", F.lit(None).cast("int")).alias("ICU_rank"))


def ventilated_cohort(patient: DataFrame, apachepredvar: DataFrame, oxygen: DataFrame,
                      ibw_formula: str = "study") -> DataFrame:
    """One row per (first ICU stay intubated on day 1, session > 48 h)."""
    s = stays(patient).filter(F.col("ICU_rank") == 1)
    intubated = apachepredvar.filter(F.col("oobintubday1") == 1).select(STAY)
    sess = (oxygen.filter(F.col("vent_duration") > MIN_SESSION_H)
            .select(F.col("icustay_id").alias(STAY), "vent_start", "vent_duration"))
    return (s.join(intubated, STAY, "left_semi").join(sess, STAY)
            .withColumn("IBW_calculated", C.ideal_body_weight("gender", "admissionheight", ibw_formula))
            .withColumn("bmi", C.bmi("admissionweight", "dischargeweight", "admissionheight")))


def gas_events(lab: DataFrame, resp: DataFrame, cohort: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PaO2 (lab) and FiO2 (%, charting) values in the first 24 h of a cohort
    session and inside the first-day buckets."""
    day1 = (0, BUCKET_MIN * N_BUCKETS)
    pao2 = (lab.filter(F.col("labresultoffset").between(*day1) & F.lower("labname").startswith("pao2")
                       & F.col("labresult").isNotNull())
            .select(STAY, F.col("labresultoffset").alias("t"), F.col("labresult").alias("pao2")))
    pao2 = within_window(pao2, cohort, STAY, "t", "vent_start", GAS_WINDOW)
    fio2 = (resp.filter(F.col("respchartoffset").between(*day1) & F.col("respchartvaluelabel").isin(*FIO2_LABELS))
            .select(STAY, F.col("respchartoffset").alias("t"), safe_decimal("respchartvalue").alias("_v"))
            .select(STAY, "t", C.fio2_percent("_v").alias("fio2"))
            .filter(F.col("fio2").isNotNull() & (F.col("fio2") > 0)))
    fio2 = within_window(fio2, cohort, STAY, "t", "vent_start", GAS_WINDOW)
    return pao2, fio2


def index_pf(lab: DataFrame, resp: DataFrame, cohort: DataFrame) -> DataFrame:
    """Per stay: the closest same-bucket FiO2/PaO2 pair."""
    pao2, fio2 = gas_events(lab, resp, cohort)
    rows = (fio2.select(STAY, "t", F.struct(F.col("fio2").cast("double").alias("fio2")).alias("a"),
                        F.lit(None).cast("struct<pao2:double>").alias("c"))
            .unionByName(pao2.select(STAY, "t", F.lit(None).cast("struct<fio2:double>").alias("a"),
                                     F.struct(F.col("pao2").cast("double").alias("pao2")).alias("c"))))
    rows = rows.withColumn("bucket", C.bucket_label("t", BUCKET_MIN, N_BUCKETS))
    m = nearest_events(rows, [STAY, "bucket"], "t", anchor=F.col("a"), candidates={"p": F.col("c")})
    m = m.filter(F.col("p").isNotNull()).select(
        STAY, F.col("t").alias("fio2_offset"), F.col("p.t").alias("pao2_offset"),
        F.col("anchor.fio2").alias("fio2"), F.col("p.v.pao2").alias("pao2"), F.col("bucket"))
    best = pick_first(m, STAY, [F.abs(F.col("fio2_offset") - F.col("pao2_offset")), "fio2_offset",
                                "pao2_offset", "fio2", "pao2"],
                      ["fio2", "pao2", "fio2_offset", "pao2_offset", "bucket"])
    return best


def ards_stays(diagnosis: DataFrame) -> DataFrame:
    code = F.col("icd9code")
    pred = F.col("diagnosisstring").contains(ARDS_TEXT)
    for c in ARDS_ICD:
        pred = pred | code.contains(c)
    return diagnosis.filter(pred).select(STAY).distinct()


def first_pfratio(t: dict[str, DataFrame], oxygen: DataFrame, ibw_formula: str = "study", step=None) -> DataFrame:
    """The study's ``patient_first_pfratio`` table (one row per stay).

    The cohort (one row per qualifying stay-session) feeds three branches.  With
    ``step(name, make)`` (see ``session.step_table``) it is a written table, so the
    oxygen sessions behind it are computed once instead of per branch."""
    make = lambda: ventilated_cohort(t["patient"], t["apachepredvar"], oxygen, ibw_formula)
    cohort = step("ventilated_cohort", make) if step else make()
    best = index_pf(t["lab"], t["respiratorycharting"], cohort)
    # earliest qualifying session of the stay carries the session columns
    first_session = pick_first(cohort, STAY, ["vent_start", "vent_duration"],
                               [c for c in cohort.columns if c != STAY])
    out = first_session.join(best, STAY)
    out = out.withColumn("pfratio", 100 * F.col("pao2") / F.col("fio2"))
    out = out.filter(F.col("pfratio").isNotNull() & (F.col("pfratio") <= 300))
    out = out.join(ards_stays(t["diagnosis"]), STAY, "left_semi")
    return out.select(
        STAY, "gender", "age", "ethnicity", "unit_duration", "hospital_duration", "unitAdmitSource",
        "unitdischargestatus", "hospitaldischargestatus", "admissionheight", "admissionweight",
        "dischargeweight", "ICU_rank", "vent_start", "vent_duration", "IBW_calculated", "bmi",
        "fio2", "pao2", "pfratio", "fio2_offset", "pao2_offset",
        F.col("bucket").alias("fio2_time"), F.col("bucket").alias("pao2_time"),
        C.ards_severity("pfratio").alias("ARDS_severity"))
