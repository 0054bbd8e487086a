"""Static lung compliance per PEEP charting time.

For every PEEP entry in the first 48 h (4-hour buckets T1..T12), the
nearest tidal volume and the nearest plateau pressure of the same bucket
give ``compliance = TV / (plateau - PEEP)``; values in (7.4, 100) are kept.

Plan: one aggregate of the charting rows per (stay, bucket, offset) holding
the PEEP, TV and plateau value of that minute, then one window per
(stay, bucket) that finds, for each PEEP minute, the closest TV and plateau
minute before and after it.  Cost is a sort of P + T + L rows instead of
the P x T x L product, and the pick is deterministic: nearest time, then
the earlier time, then the smaller value; the PEEP of a minute is its
smallest value.  Per-stay reference values (first TV, max day-1 PEEP,
last-charted TV/IBW) come from one aggregate per stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.functions.parse import safe_decimal
from carelog.operators.match import nearest_events

STAY = "patientunitstayid"
BUCKET_MIN, N_BUCKETS = 240, 12

# Charting labels of the study.
TIDAL_VOLUME_LABELS = ("Tidal Volume Observed (VT)", "Exhaled TV (patient)", "Exhaled Vt",
                       "Tidal Volume (set)", "Tidal Volume, Delivered", "Spont TV",
                       "Set Vt (Servo,LTV)", "Exhaled TV (machine)")
PEEP_LABELS = ("PEEP", "PEEP/CPAP")
PLATEAU_LABEL = "Plateau Pressure"
TV_IBW_LABEL = "TV/kg IBW"
COMPLIANCE_RANGE = (7.4, 100)


def _typed(resp: DataFrame) -> DataFrame:
    # parse once in its own projection; the typed columns below reuse it
    resp = resp.select(STAY, "respchartoffset", "respchartvaluelabel",
                       safe_decimal("respchartvalue").alias("_v"))
    label = F.col("respchartvaluelabel")
    v = F.col("_v")
    is_tv = label.isin(*TIDAL_VOLUME_LABELS)
    return resp.select(
        F.col(STAY), F.col("respchartoffset").alias("offset"),
        F.when(label.isin(*PEEP_LABELS), v).alias("peep"),
        is_tv.alias("is_tv"),
        # values are at most 2000 ml: decimal(18,9) keeps them fixed-width
        F.when(is_tv, C.tidal_volume_ml(v).cast("decimal(18,9)")).alias("tidal_volume"),
        F.when(label == PLATEAU_LABEL, v).alias("plateau_pressure"),
        F.when(label == TV_IBW_LABEL, v).alias("TV_IBW"))


def stay_reference_values(resp: DataFrame) -> DataFrame:
    """Per stay: ``first_tv`` (the smallest tidal volume, NULL when any TV entry
    is out of range - NULLs sort first), ``max_peep`` (day 1, offset <= 1440)
    and ``TV_IBW`` of the last-charted row of any label (NULL unless that row
    is a TV/IBW entry; ties at the last minute take the largest value).

    The last minute is a plain maximum over all rows; only TV/IBW entries are
    parsed to find the value charted at it."""
    label = F.col("respchartvaluelabel")
    t = _typed(resp.filter(label.isin(*TIDAL_VOLUME_LABELS, *PEEP_LABELS)))
    ranges = t.groupBy(STAY).agg(
        F.when(F.count_if(F.col("is_tv") & F.col("tidal_volume").isNull()) > 0, F.lit(None))
         .otherwise(F.min("tidal_volume")).alias("first_tv"),
        F.max(F.when(F.col("offset") <= 1440, F.col("peep"))).alias("max_peep"))
    last = resp.groupBy(STAY).agg(F.max("respchartoffset").alias("offset"))
    ibw = _typed(resp.filter(label == TV_IBW_LABEL)).groupBy(STAY, "offset").agg(F.max("TV_IBW").alias("TV_IBW"))
    return ranges.join(last.join(ibw, [STAY, "offset"]).select(STAY, "TV_IBW"), STAY, "left")


def lung_compliance(resp: DataFrame) -> DataFrame:
    """Rows of (stay, PEEP minute) with matched TV and plateau, compliance and
    phenotype label (L > 50, I 40..50, H < 40)."""
    entries = resp.filter(F.col("respchartvaluelabel").isin(*TIDAL_VOLUME_LABELS, *PEEP_LABELS, PLATEAU_LABEL))
    t = (_typed(entries).filter(F.col("offset").between(0, BUCKET_MIN * N_BUCKETS))
         .filter(F.col("peep").isNotNull() | F.col("tidal_volume").isNotNull()
                 | F.col("plateau_pressure").isNotNull())
         .withColumn("lung_time", C.bucket_label("offset", BUCKET_MIN, N_BUCKETS)))
    m = nearest_events(
        t, [STAY, "lung_time"], "offset",
        anchor=F.when(F.col("peep").isNotNull(), F.struct(F.col("peep").alias("peep"))),
        candidates={"tv": F.when(F.col("tidal_volume").isNotNull(), F.struct(F.col("tidal_volume").alias("x"))),
                    "pp": F.when(F.col("plateau_pressure").isNotNull(),
                                 F.struct(F.col("plateau_pressure").alias("x")))})
    m = m.filter(F.col("tv").isNotNull() & F.col("pp").isNotNull()).select(
        STAY, F.col("tv.t").alias("TV_offset"), F.col("offset").alias("Peep_offset"),
        F.col("pp.t").alias("Plateau_offset"), "lung_time",
        F.col("tv.v.x").alias("tidal_volume"), F.col("pp.v.x").alias("plateau_pressure"),
        F.col("anchor.peep").alias("peep"))
    comp = F.col("tidal_volume") / F.nullif(F.col("plateau_pressure") - F.col("peep"), F.lit(0))
    m = m.withColumn("lung_compliance", comp)
    lo, hi = COMPLIANCE_RANGE
    m = m.filter((F.col("lung_compliance") > lo) & (F.col("lung_compliance") < hi))
    ref = stay_reference_values(resp)
    out = m.join(ref, STAY, "left")
    return out.select(
        STAY, "TV_offset", "Peep_offset", "Plateau_offset", "lung_time",
        F.col("tidal_volume").cast("double").alias("tidal_volume"),
        F.col("plateau_pressure").cast("double").alias("plateau_pressure"),
        F.col("peep").cast("double").alias("peep"),
        F.col("TV_IBW").cast("double").alias("TV_IBW"),
        F.col("max_peep").cast("double").alias("max_peep"),
        F.col("first_tv").cast("double").alias("first_tv"),
        F.lit(1).alias("ranked_tv_diff"), F.lit(1).alias("ranked_pp_diff"),
        F.col("lung_compliance").cast("double").alias("lung_compliance"),
        C.compliance_level("lung_compliance").alias("compliance_level"))
