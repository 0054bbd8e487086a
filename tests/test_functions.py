"""Column builders on hand-made edge rows (expected values worked out by hand)."""

from decimal import Decimal

from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.functions.parse import digits_only, safe_decimal, safe_double, safe_int
from carelog.functions.rules import OXYGEN_SUPPORT_RULES, classify, oxygen_support_code, rules_sql
from carelog.operators.flags import icd_flags
from carelog.plans.oxygen import fio2_code, flow_code


def one_col(spark, values, dtype, expr_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr_fn(F.col("v"))).collect()]


def test_classifier_rule_order(spark):
    texts = ["Venturi Mask", "pressure support", "adult con setting set rr", "hyperventilation", "lpm o2", None,
             "niv", "bi-pap", "nc", "ps", "spontaneous", "mask leak", "prevent falls", "feeding tube"]
    want = [2, 2, 4, None, -1, None, 3, 3, 1, 0, 0, 3, 2, 4]
    assert one_col(spark, texts, "string", oxygen_support_code) == want
    # the SQL-compiled form agrees with the Column form
    df = spark.createDataFrame([(t.lower() if t else None,) for t in texts], "t string")
    got = [r[0] for r in df.select(classify("t", OXYGEN_SUPPORT_RULES, lower=False)).collect()]
    assert got == want
    assert rules_sql("t", OXYGEN_SUPPORT_RULES).startswith("CASE WHEN")


def test_fio2_event_codes(spark):
    vals = ["0.21", "0.22", "0.5", "1", "5", "20", "21", "22", "40", "0.1", "NaN", "5d"]
    df = spark.createDataFrame([(i, "FiO2", v) for i, v in enumerate(vals)], "i int, l string, v string")
    got = [r[0] for r in df.orderBy("i").select(fio2_code("l", "v")).collect()]
    assert got == [None, None, -1, -1, 0, None, None, None, -1, 0, None, None]


def test_flow_event(spark):
    vals = ["0", "1", "100", "101", "2.5"]
    df = spark.createDataFrame([(i, "O2 L/%", v) for i, v in enumerate(vals)], "i int, l string, v string")
    assert [r[0] for r in df.orderBy("i").select(flow_code("l", "v")).collect()] == [None, -1, -1, None, None]


def test_bucket_edges(spark):
    got = one_col(spark, [-1, 0, 240, 241, 2880, 2881], "bigint", lambda c: C.bucket_label(c, 240, 12))
    assert got == [None, "T1", "T1", "T2", "T12", None]


def test_tidal_volume(spark):
    got = one_col(spark, ["0.45", "5", "10", "11", "2000", "2001", "0"], "string",
                  lambda c: C.tidal_volume_ml(safe_decimal(c)))
    assert [None if g is None else float(g) for g in got] == [450.0, None, None, 11.0, 2000.0, None, None]


def test_fio2_percent_exact(spark):
    got = one_col(spark, ["0.29", "0.4", "1", "40", "100", "101"], "string", lambda c: C.fio2_percent(safe_decimal(c)))
    assert [None if g is None else float(g) for g in got] == [29.0, 40.0, 100.0, 40.0, 100.0, None]


def test_bands(spark):
    assert one_col(spark, [50.1, 50.0, 40.5, 40.0, 39.9], "double", C.compliance_level) == ["L", "I", "I", "I", "H"]
    assert one_col(spark, [100.0, 100.5, 200.0, 300.0, 301.0], "double", C.ards_severity) == \
        ["severe", "moderate", "moderate", "mild", None]


def test_safe_parsers(spark):
    vals = ["12", " 42 ", "1.5", "0x1A", "", "5d", "NaN", "038", None, "12\n"]
    ints = one_col(spark, vals, "string", safe_int)
    # surrounding whitespace (a trailing newline too) is trimmed by the parsers
    assert ints == [12, 42, None, None, None, None, None, 38, None, 12]
    dbls = one_col(spark, vals, "string", safe_double)
    assert dbls == [12.0, 42.0, 1.5, None, None, None, None, 38.0, None, 12.0]
    # the digits-only test is anchored at the true end of input: "12\n" fails
    assert one_col(spark, ["12", "123", "", "1.5", "12\n"], "string",
                   lambda c: digits_only(c, 0, 2)) == [True, False, True, False, False]
    assert one_col(spark, ["0.29"], "string", safe_decimal) == [Decimal("0.290000000")]


def test_vasopressor_rates(spark):
    df = spark.createDataFrame([("Norepinephrine (ml/hr)", "30"), ("Norepinephrine (mcg/min)", "8"),
                                ("Dopamine (ml/hr)", "10")], "d string, r string")
    got = df.select(C.vasopressor_rate("d", safe_decimal("r"), "norepinephrine").alias("n"),
                    C.vasopressor_rate("d", safe_decimal("r"), "dopamine").alias("p")).collect()
    assert float(got[0].n) == 0.1 and float(got[1].n) == 0.1 and float(got[2].p) == 3.333


def test_sofa_scores(spark):
    cv = spark.createDataFrame([(None, None, 0.1, None), (None, None, 0.101, None), (None, 0.0, None, None),
                                (69, None, None, None), (None, None, None, None)],
                               "m int, d double, n double, b int")
    assert [r[0] for r in cv.select(C.sofa_cardiovascular("m", "d", "n", "b")).collect()] == [3, 4, 2, 1, 0]
    pf = C.ratio_with_defaults(F.lit(None), F.lit(None))
    assert spark.range(1).select(C.sofa_respiratory(pf, pf)).first()[0] == 0
    ren = spark.createDataFrame([(199.0, None), (None, 2.0), (None, 3.6), (None, None)], "u double, c double")
    assert [r[0] for r in ren.select(C.sofa_renal("u", "c")).collect()] == [4, 2, 3, 0]
    assert one_col(spark, [15, 18, 2, None], "int", C.sofa_cns) == [0, 1, 0, 0]


def test_icd_flags(spark):
    d = spark.createDataFrame([(1, "038.9"), (2, "518.81, J96.00"), (3, "V58")], "patientunitstayid int, icd9code string")
    f = {r.patientunitstayid: r for r in icd_flags(d).collect()}
    assert f[1].has_sepsis is True and f[1].has_stroke_disease is False
    assert not any(f[2][k] for k in f[2].asDict() if k != "patientunitstayid")
    assert not any(f[3][k] for k in f[3].asDict() if k != "patientunitstayid")


def test_scrub_recode(spark):
    assert one_col(spark, [5.0, 101.0, 9.0, None], "double", lambda c: C.scrub(c, 10, 100)) == [None, None, None, None]
    assert one_col(spark, [50.0], "double", lambda c: C.scrub(c, 10, 100)) == [50.0]
    assert one_col(spark, ["Alive", "Expired", "x", None], "string",
                   lambda c: C.recode(c, {"Alive": 0, "Expired": 1})) == [0, 1, None, None]


def test_ibw(spark):
    df = spark.createDataFrame([("Female", 170.0), ("Male", 170.0), ("Unknown", 170.0)], "g string, h double")
    got = [r[0] for r in df.select(C.ideal_body_weight("g", "h")).collect()]
    assert abs(got[0] - (50 + 0.91 * 170 - 152.4)) < 1e-9 and abs(got[1] - (45.5 + 0.91 * 170 - 152.4)) < 1e-9
    assert got[2] is None


def test_bucket_formula_equals_case_chain(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def chain(t, w=240, n=12):
        # the literal inclusive CASE chain: first matching [k*w, (k+1)*w] wins
        for k in range(n):
            if k * w <= t <= (k + 1) * w:
                return f"T{k + 1}"
        return None

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.integers(-300, 3200), min_size=1, max_size=200))
    def check(ts):
        got = one_col(spark, ts, "bigint", lambda c: C.bucket_label(c, 240, 12))
        assert got == [chain(t) for t in ts]

    check()
