"""Day-1 SOFA score per ICU stay.

Every source table is aggregated once per stay with conditional aggregates
(lab: PaO2, creatinine, bilirubin, platelets; vitals: MAP, SaO2; infusions:
dopamine, norepinephrine, dobutamine), then the per-stay rows are joined to
the stay spine.  All aggregates shuffle on the stay id with partial
aggregation first, and the joins reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.functions.parse import digits_only, safe_decimal, safe_int, to_numeric
from carelog.functions.util import first_match

STAY = "patientunitstayid"
DAY1 = (-1440, 1440)        # most sources: 24 h either side of admission
DRUG_WINDOW = (-120, 1440)  # infusions and FiO2

# Treatment strings that mean an invasive or non-invasive airway.
VENTILATION_TREATMENTS = (
    "pulmonary|ventilation and oxygenation|mechanical ventilation",
    "pulmonary|ventilation and oxygenation|tracheal suctioning",
    "pulmonary|ventilation and oxygenation|ventilator weaning",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|assist controlled",
    "pulmonary|radiologic procedures / bronchoscopy|endotracheal tube",
    "pulmonary|ventilation and oxygenation|oxygen therapy (> 60%)",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|tidal volume 6-10 ml/kg",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|volume controlled",
    "surgery|pulmonary therapies|mechanical ventilation",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|synchronized intermittent",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy|performed during current admission for ventilatory support",
    "pulmonary|ventilation and oxygenation|ventilator weaning|active",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|pressure controlled",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|pressure support",
    "pulmonary|ventilation and oxygenation|ventilator weaning|slow",
    "surgery|pulmonary therapies|ventilator weaning",
    "surgery|pulmonary therapies|tracheal suctioning",
    "pulmonary|radiologic procedures / bronchoscopy|reintubation",
    "pulmonary|ventilation and oxygenation|lung recruitment maneuver",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy|planned",
    "surgery|pulmonary therapies|ventilator weaning|rapid",
    "pulmonary|ventilation and oxygenation|prone position",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy|conventional",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|permissive hypercapnea",
    "surgery|pulmonary therapies|mechanical ventilation|synchronized intermittent",
    "pulmonary|medications|neuromuscular blocking agent",
    "surgery|pulmonary therapies|mechanical ventilation|assist controlled",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|volume assured",
    "surgery|pulmonary therapies|mechanical ventilation|tidal volume 6-10 ml/kg",
    "surgery|pulmonary therapies|mechanical ventilation|pressure support",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation|face mask",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation|nasal mask",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation|face mask",
    "surgery|pulmonary therapies|non-invasive ventilation",
    "surgery|pulmonary therapies|non-invasive ventilation|face mask",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation|nasal mask",
    "surgery|pulmonary therapies|non-invasive ventilation|nasal mask",
    "surgery|pulmonary therapies|mechanical ventilation|non-invasive ventilation",
    "surgery|pulmonary therapies|mechanical ventilation|non-invasive ventilation|face mask",
)
# Airway types that mean an invasive airway, and ventilator text
# fragments of respiratory-charting values (case-sensitive, as charted).
INVASIVE_AIRWAYS = ("Oral ETT", "Nasal ETT", "Tracheostomy")
VENTILATOR_TEXT = ("ventilator", "vent", "bipap", "840", "cpap", "drager", "servo")
VENTILATOR_PREFIX = ("mv",)


def _between(c, lo_hi):
    return F.col(c).between(*lo_hi)


def vital_aggregates(vitalaperiodic: DataFrame, vitalperiodic: DataFrame, window=DAY1) -> DataFrame:
    """Per stay: lowest MAP (non-invasive first) and lowest SaO2 over the window."""
    vp = (vitalperiodic.filter(_between("observationoffset", window))
          .groupBy(STAY).agg(F.min("systemicmean").alias("_im"), F.min("sao2").alias("sao2")))
    va = (vitalaperiodic.filter(_between("observationoffset", window))
          .groupBy(STAY).agg(F.min("noninvasivemean").alias("_nim")))
    return (vp.join(va, STAY, "full")
            .select(STAY, F.coalesce("_nim", "_im").alias("map"), "sao2"))


def infusion_aggregates(infusiondrug: DataFrame, window=DRUG_WINDOW, strict: bool = False) -> DataFrame:
    """Per stay: max dopamine and norepinephrine rate (mcg/kg/min) and whether
    dobutamine ran at a non-zero rate.  Rates must be integer text of up to
    five digits."""
    name = F.lower("drugname")
    rate_ok = digits_only("drugrate", 1, 5)
    rate = to_numeric("drugrate", strict)
    dopa = F.when(name.contains("dopamine"), C.vasopressor_rate("drugname", rate, "dopamine"))
    norepi = F.when(name.contains("norepinephrine"), C.vasopressor_rate("drugname", rate, "norepinephrine"))
    dobu = F.when(name.contains("dobutamin") & (F.col("drugrate") != "0"), F.lit(1))
    return (infusiondrug.filter(_between("infusionoffset", window) & rate_ok)
            .groupBy(STAY).agg(F.max(dopa).alias("dopa"), F.max(norepi).alias("norepi"),
                               F.max(dobu).alias("dobu")))


def lab_aggregates(lab: DataFrame, window=DAY1) -> DataFrame:
    """Per stay: lowest PaO2, highest creatinine, highest total bilirubin,
    lowest platelets over the window (lower-cased name prefixes)."""
    name = F.lower("labname")
    v = F.col("labresult")
    wanted = name.startswith("pao2") | name.startswith("creatin") | name.startswith("total bili") | name.startswith("platelet")
    return (lab.filter(_between("labresultoffset", window) & wanted)
            .groupBy(STAY).agg(F.min(F.when(name.startswith("pao2"), v)).alias("pao2"),
                               F.max(F.when(name.startswith("creatin"), v)).alias("creat"),
                               F.max(F.when(name.startswith("total bili"), v)).alias("bili"),
                               F.min(F.when(name.startswith("platelet"), v)).alias("plt")))


def fio2_pick(resp: DataFrame, nurse: DataFrame, window=DRUG_WINDOW) -> DataFrame:
    """Per stay FiO2 (%): highest two-digit respiratory value above 20, else
    highest nurse FiO2 above 20, else 100 when either maximum is 1."""
    rc = (resp.filter(_between("respchartoffset", window) & digits_only("respchartvalue", 1, 2))
          .groupBy(STAY).agg(F.max(safe_decimal("respchartvalue")).alias("rcfio2"))
          .filter(F.col("rcfio2") > 20))
    nc = (nurse.filter(_between("nursingchartentryoffset", window)
                       & F.lower("nursingchartcelltypevallabel").contains("fio2")
                       & digits_only("nursingchartvalue", 0, 2))
          .groupBy(STAY).agg(F.max(safe_decimal("nursingchartvalue")).alias("ncfio2")))
    both = rc.join(nc, STAY, "full")
    fio2 = first_match([(F.col("rcfio2") > 20, F.col("rcfio2")), (F.col("ncfio2") > 20, F.col("ncfio2")),
                        ((F.col("rcfio2") == 1) | (F.col("ncfio2") == 1), F.lit(100).cast("decimal(18,9)"))])
    return both.select(STAY, fio2.alias("fio2"))


def urine_day1(intakeoutput: DataFrame) -> DataFrame:
    """Day-1 urine output: sum over distinct (offset, total) rows in [0, 1440]."""
    io = (intakeoutput.filter(F.col("intakeoutputoffset").between(0, 1440))
          .select(STAY, "intakeoutputoffset", "outputtotal").distinct())
    return io.groupBy(STAY).agg(F.sum("outputtotal").alias("uo"))


def gcs_sum(physicalexam: DataFrame, window=DAY1, how: str = "study", strict: bool = False) -> DataFrame:
    """GCS per stay from eye/verbal/motor entries in the window.

    ``study``: the sum of all entries of the window (may exceed 15, as the
    study computes it); ``worst``: the lowest total charted at one exam time."""
    path = F.lower("physicalexampath")
    is_gcs = path.contains("gcs/eyes") | path.contains("gcs/verbal") | path.contains("gcs/motor")
    rows = physicalexam.filter(is_gcs & _between("physicalexamoffset", window))
    if how == "worst":
        per_exam = rows.groupBy(STAY, "physicalexamoffset").agg(F.sum(to_numeric("physicalexamvalue", strict)).alias("_t"))
        return per_exam.groupBy(STAY).agg(F.min("_t").alias("gcs"))
    return rows.groupBy(STAY).agg(F.sum(to_numeric("physicalexamvalue", strict)).alias("gcs"))


def mech_vent(respiratorycare: DataFrame, resp: DataFrame, treatment: DataFrame,
              patient: DataFrame, window=DAY1, compat: bool = True) -> DataFrame:
    """Mechanical-ventilation indicator (1 or NULL) per stay from airway type,
    ventilator text in respiratory charting and ventilation treatments.

    With ``compat`` the charting branch applies the time window to the last
    text test only, as the study's predicate groups it (OR binds looser than
    AND); ``compat=False`` applies it to every text test."""
    airway = (respiratorycare.filter(_between("respcarestatusoffset", window))
              .groupBy(STAY).agg(F.max(F.when(F.col("airwaytype").isin(*INVASIVE_AIRWAYS), 1)).alias("airway")))
    v = F.col("respchartvalue")
    text = F.lit(False)
    for s in VENTILATOR_TEXT:
        text = text | v.contains(s)
    for s in VENTILATOR_PREFIX:
        text = text | v.startswith(s)
    if compat:
        text = text | (v.contains("peep") & _between("respchartoffset", window))
    else:
        text = (text | v.contains("peep")) & _between("respchartoffset", window)
    vent = resp.filter(text).select(STAY).distinct().withColumn("ventilator", F.lit(1))
    iface = (treatment.filter(_between("treatmentoffset", window))
             .groupBy(STAY).agg(F.max(F.when(F.col("treatmentstring").isin(*VENTILATION_TREATMENTS), 1)).alias("interface")))
    spine = patient.select(STAY)
    j = spine.join(airway, STAY, "left").join(vent, STAY, "left").join(iface, STAY, "left")
    any_ = F.col("airway").isNotNull() | F.col("ventilator").isNotNull() | F.col("interface").isNotNull()
    return j.select(STAY, F.when(any_, F.lit(1)).alias("mechvent"))


def sofa_components(t: dict[str, DataFrame], gcs: str = "study", strict: bool = False) -> DataFrame:
    """Per stay inputs and the six sub-scores (stay spine = patient table).

    ``strict`` casts drug rates and exam values hard: malformed text fails the
    query instead of counting as missing."""
    spine = t["patient"].select(STAY)
    vit = vital_aggregates(t["vitalaperiodic"], t["vitalperiodic"])
    inf = infusion_aggregates(t["infusiondrug"], strict=strict)
    lab = lab_aggregates(t["lab"])
    fio2 = fio2_pick(t["respiratorycharting"], t["nursecharting"])
    uo = urine_day1(t["intakeoutput"])
    gcs = gcs_sum(t["physicalexam"], how=gcs, strict=strict)
    j = (spine.join(vit, STAY, "left").join(inf, STAY, "left").join(lab, STAY, "left")
         .join(fio2, STAY, "left").join(uo, STAY, "left").join(gcs, STAY, "left"))
    pf = C.ratio_with_defaults("pao2", "fio2")
    sf = C.ratio_with_defaults("sao2", "fio2")
    return j.select(
        STAY, "map", "dopa", "norepi", "dobu", "pao2", "sao2", "fio2", "creat", "uo", "bili", "plt", "gcs",
        C.sofa_cardiovascular("map", "dopa", "norepi", "dobu").alias("sofa_cv"),
        C.sofa_respiratory(pf, sf).alias("sofa_respi"),
        C.sofa_renal("uo", "creat").alias("sofarenal"),
        C.sofa_coagulation("plt").alias("sofacoag"),
        C.sofa_liver("bili").alias("sofaliver"),
        C.sofa_cns("gcs").alias("sofacns"))


def sofa(t: dict[str, DataFrame], gcs: str = "study", strict: bool = False) -> DataFrame:
    """patientunitstayid, sofatotal (every stay of the patient table)."""
    c = sofa_components(t, gcs, strict)
    total = (F.col("sofa_cv") + F.col("sofa_respi") + F.col("sofarenal") + F.col("sofacoag")
             + F.col("sofaliver") + F.col("sofacns"))
    return c.select(STAY, total.cast("int").alias("sofatotal"))
