"""Analysis table (one row per stay) and day-1/day-2 compliance pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.operators.flags import ICD_FLAGS, icd_flags
from carelog.operators.match import nearest_events, pick_first

STAY = "patientunitstayid"
DAY2 = (24 * 60, 47 * 60)  # the study's day-2 window ends at 47 h


def first_vitals(vitalperiodic: DataFrame, skip_nulls: bool = False) -> DataFrame:
    """Per stay: temperature, heart rate, respiration and MAP of the first
    observation (ties: smaller readings first).  A NULL in that first row
    stays NULL unless ``skip_nulls`` takes each sign's first non-NULL value."""
    vp = vitalperiodic.withColumn("mean_arterial_pressure",
                                  C.mean_arterial_pressure("systemicsystolic", "systemicdiastolic"))
    signs = ["temperature", "heartrate", "respiration", "mean_arterial_pressure"]
    if skip_nulls:
        out = None
        for s in signs:
            p = pick_first(vp.filter(F.col(s).isNotNull()), STAY, ["observationoffset", s], [s])
            out = p if out is None else out.join(p, STAY, "full")
        return out
    order = ["observationoffset", "heartrate", "respiration", "systemicsystolic", "systemicdiastolic",
             "temperature"]
    return pick_first(vp, STAY, order, signs)


def first_lab(lab: DataFrame, name: str, alias: str) -> DataFrame:
    """First result of an exactly named lab (ties: the smaller result)."""
    return (pick_first(lab.filter(F.col("labname") == name), STAY, ["labresultoffset", "labresult"], ["labresult"])
            .withColumnRenamed("labresult", alias))


def combined(first_pf: DataFrame, lungcompliance: DataFrame, sofa: DataFrame, vitalperiodic: DataFrame,
             lab: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """The study's ``combined_firstpf_compliance``: each index P/F row with the
    compliance row of the same bucket nearest in time (ties: earlier TV, then
    earlier PEEP), SOFA, first vitals and labs, and comorbidity flags
    (NULL for stays without any diagnosis row)."""
    p = first_pf
    lc = lungcompliance
    lung_cols = ["max_peep", "peep", "tidal_volume", "plateau_pressure", "compliance_level", "lung_compliance",
                 "TV_IBW", "first_tv"]
    rows = (p.select(STAY, F.col("fio2_time").alias("bucket"), F.col("fio2_offset").alias("t"),
                     F.struct(F.lit(1).alias("a")).alias("a"),
                     F.lit(None).cast(lc.select(F.struct("Peep_offset", *lung_cols)).schema[0].dataType).alias("c"))
            .unionByName(lc.select(STAY, F.col("lung_time").alias("bucket"), F.col("TV_offset").alias("t"),
                                   F.lit(None).cast("struct<a:int>").alias("a"),
                                   F.struct("Peep_offset", *lung_cols).alias("c"))))
    m = nearest_events(rows, [STAY, "bucket"], "t", anchor=F.col("a"), candidates={"l": F.col("c")})
    m = m.filter(F.col("l").isNotNull()).select(
        STAY, F.col("l.t").alias("lung_offset"), *[F.col(f"l.v.{c}").alias(c) for c in lung_cols])
    v1 = (p.join(m, STAY)
          .withColumn("TV_IBW_calculated", F.col("first_tv") / F.col("IBW_calculated"))
          .withColumn("ranked_by_minute_diff", F.lit(1)).drop("first_tv"))
    vit = first_vitals(vitalperiodic)
    paco2 = first_lab(lab, "paCO2", "paco2")
    ph = first_lab(lab, "pH", "PH")
    flags = icd_flags(diagnosis)
    out = (v1.join(sofa, STAY, "left").join(vit, STAY, "left").join(paco2, STAY, "left")
           .join(ph, STAY, "left").join(flags, STAY, "left"))
    cols = (list(first_pf.columns) + ["max_peep", "peep", "tidal_volume", "plateau_pressure", "lung_offset",
                                      "compliance_level", "lung_compliance", "TV_IBW", "TV_IBW_calculated",
                                      "ranked_by_minute_diff", "sofatotal", "temperature", "heartrate",
                                      "respiration", "mean_arterial_pressure", "paco2", "PH"]
            + [f[0] for f in ICD_FLAGS])
    return out.select(*cols)


def day12(lungcompliance: DataFrame, combined_df: DataFrame, day2=DAY2) -> DataFrame:
    """Stays of the analysis table with compliance on day 1 (the value nearest
    admission, within 24 h; ties: earlier TV, then earlier PEEP) and day 2 (the
    lowest value with TV offset in the day-2 window), with phenotype labels
    and the index P/F ratio."""
    cohort = combined_df.select(STAY, "hospitaldischargestatus", "pfratio")
    lc = lungcompliance.join(cohort.select(STAY), STAY, "left_semi")
    d1 = (pick_first(lc, STAY, [F.abs("TV_offset"), "TV_offset", "Peep_offset"], ["TV_offset", "lung_compliance"])
          .filter(F.abs("TV_offset") < 24 * 60)
          .select(STAY, F.col("lung_compliance").alias("day1")))
    d2 = (lc.filter(F.col("TV_offset").between(*day2)).groupBy(STAY)
          .agg(F.min("lung_compliance").alias("day2")))
    names = C.PHENOTYPE_NAMES
    return (cohort.join(d1, STAY).join(d2, STAY)
            .select(STAY, "hospitaldischargestatus", "day1", "day2",
                    C.compliance_level("day1", names).alias("day1_compliance"),
                    C.compliance_level("day2", names).alias("day2_compliance"), "pfratio"))
