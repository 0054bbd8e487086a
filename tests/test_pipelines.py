"""Pipelines on hand-made rows: SURVEY section 2.11 semantics."""

from carelog.plans import compliance as CMP
from carelog.plans import oxygen as OX
from carelog.plans.combined import day12, first_vitals


def _resp(spark, rows):
    return spark.createDataFrame(rows, "patientunitstayid bigint, respchartoffset bigint, "
                                       "respchartvaluelabel string, respchartvalue string")


def test_compliance_match_and_filters(spark):
    rows = [
        (1, 100, "PEEP", "5"), (1, 90, "Exhaled TV (machine)", "450"), (1, 130, "Exhaled TV (machine)", "500"),
        (1, 100, "Plateau Pressure", "30"),                       # compliance 450/25 = 18 -> H
        (2, 10, "PEEP", "20"), (2, 10, "Exhaled TV (machine)", "0.45"), (2, 12, "Plateau Pressure", "20"),
        (3, 10, "PEEP", "5"), (3, 20, "Exhaled TV (machine)", "400"), (3, 30, "Plateau Pressure", "13"),
        (3, 300, "Exhaled TV (machine)", "5000"),                  # out of range TV -> first_tv NULL
        (4, 250, "PEEP", "5"), (4, 200, "Exhaled TV (machine)", "400"), (4, 250, "Plateau Pressure", "13"),
    ]
    lc = {r.patientunitstayid: r for r in CMP.lung_compliance(_resp(spark, rows)).collect()}
    assert lc[1].TV_offset == 90 and lc[1].lung_compliance == 18.0 and lc[1].compliance_level == "H"
    assert 2 not in lc                      # plateau == PEEP: no compliance
    assert lc[3].lung_compliance == 50.0 and lc[3].compliance_level == "I" and lc[3].first_tv is None
    assert 4 not in lc                      # TV in T1, PEEP/plateau in T2: no same-bucket match


def test_oxygen_sessions_end_at_discharge(spark):
    resp = _resp(spark, [(1, 0, "PEEP", "5"), (1, 1440, "PEEP", "5"), (1, 2881, "PEEP", "5")])
    nurse = spark.createDataFrame([], "patientunitstayid bigint, nursingchartoffset bigint, "
                                      "nursingchartentryoffset bigint, nursingchartcelltypevallabel string, "
                                      "nursingchartvalue string")
    treat = spark.createDataFrame([(1, 2900, "pulmonary|ventilation and oxygenation|mechanical ventilation", True)],
                                  "patientunitstayid bigint, treatmentoffset bigint, treatmentstring string, "
                                  "activeupondischarge boolean")
    pat = spark.createDataFrame([(1, 5000)], "patientunitstayid bigint, unitdischargeoffset bigint")
    ox = sorted(OX.oxygen_therapy(resp, nurse, treat, pat).collect(), key=lambda r: r.ventnum)
    assert [(r.ventnum, r.vent_start, r.vent_end) for r in ox] == [(1, 0, 1500), (2, 2881, 5000)]
    # "mechanical ventilation" has no invasive keyword: the "vent" rule gives 2
    assert all(r.vent_start_first == 0 for r in ox) and ox[1].oxygen_therapy_type == 2


def test_first_vitals_null_first_reading(spark):
    vp = spark.createDataFrame([(1, 0, None, 80, 12, 120, 70), (1, 5, 37.0, 81, 13, 121, 71)],
                               "patientunitstayid bigint, observationoffset bigint, temperature double, "
                               "heartrate int, respiration int, systemicsystolic int, systemicdiastolic int")
    r = first_vitals(vp).first()
    assert r.temperature is None and r.heartrate == 80
    assert first_vitals(vp, skip_nulls=True).first().temperature == 37.0


def test_day12_windows(spark):
    lc = spark.createDataFrame([(1, 100, 100, 55.0), (1, 1440, 1440, 30.0), (1, 2820, 2820, 45.0),
                                (1, 2821, 2821, 10.0)],
                               "patientunitstayid bigint, TV_offset bigint, Peep_offset bigint, lung_compliance double")
    cm = spark.createDataFrame([(1, "Alive", 150.0)], "patientunitstayid bigint, hospitaldischargestatus string, "
                                                     "pfratio double")
    r = day12(lc, cm).first()
    assert (r.day1, r.day2, r.day1_compliance, r.day2_compliance) == (55.0, 30.0, "Type L", "Type H")


def test_gcs_options_and_vent_grouping(spark):
    from carelog.plans.sofa import gcs_sum, mech_vent
    pe = spark.createDataFrame([(1, 0, "notes/Neurologic/GCS/Eyes Score", "4"),
                                (1, 0, "notes/Neurologic/GCS/Motor Score", "6"),
                                (1, 60, "notes/Neurologic/GCS/Eyes Score", "2"),
                                (1, 60, "notes/Neurologic/GCS/Motor Score", "3")],
                               "patientunitstayid bigint, physicalexamoffset bigint, physicalexampath string, "
                               "physicalexamvalue string")
    assert float(gcs_sum(pe).first().gcs) == 15.0
    assert float(gcs_sum(pe, how="worst").first().gcs) == 5.0
    rc = spark.createDataFrame([], "patientunitstayid bigint, respcarestatusoffset bigint, airwaytype string")
    tr = spark.createDataFrame([], "patientunitstayid bigint, treatmentoffset bigint, treatmentstring string")
    pat = spark.createDataFrame([(1,), (2,)], "patientunitstayid bigint")
    resp = _resp(spark, [(1, 9000, "Vent Mode", "ventilator"), (2, 9000, "x", "peep 5")])
    study = {r.patientunitstayid: r.mechvent for r in mech_vent(rc, resp, tr, pat).collect()}
    strict = {r.patientunitstayid: r.mechvent for r in mech_vent(rc, resp, tr, pat, compat=False).collect()}
    assert study == {1: 1, 2: None} and strict == {1: None, 2: None}


def test_strict_casts_fail_on_bad_text(spark):
    import pytest

    from carelog.plans.sofa import gcs_sum
    exams = spark.createDataFrame([(1, 10, "notes/GCS/Eyes Score/4", "4"), (1, 10, "notes/GCS/Motor Score/x", "six")],
                                  "patientunitstayid long, physicalexamoffset int, physicalexampath string, physicalexamvalue string")
    assert gcs_sum(exams).first().gcs == 4
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|six"):
        gcs_sum(exams, strict=True).collect()
