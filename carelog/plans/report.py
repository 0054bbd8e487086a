"""The study report: stratified tables, tests, models and transitions.

Reads the analysis table (one row per stay) and the day-1/day-2 pairs as
DataFrames; every table is a distributed aggregate and only its few result
rows are small.  Deviations from the notebook that a reader would otherwise
trip over are deliberate and listed in the README (columns chosen by name,
each flag over its own total, proportions to 3 places, no duplicated linear
term in the smooth).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelog.functions import clinical as C
from carelog.operators import stats as S
from carelog.operators.stats import t_pvalue

LEVELS = ["L", "I", "H"]
PHENO = list(C.PHENOTYPE_NAMES)

# The study's table variables.
MEAN_SD_VARS = ["age", "bmi", "sofatotal", "temperature", "heartrate", "mean_arterial_pressure", "respiration",
                "pao2", "pfratio", "paco2", "PH", "fio2", "plateau_pressure", "peep", "driving_pressure",
                "tidal_volume", "TV_IBW_calculated"]
PROPORTION_VARS = ["gender", "unitAdmitSource", "ARDS_severity", "unitdischargestatus", "hospitaldischargestatus"]
COMORBIDITY_FLAGS = ["has_atrial_fibrillation_disease", "has_cancer_disease", "CHF", "CKD",
                     "has_chronic_liver_disease", "has_copd_disease", "has_diabetes_mellitus_disease",
                     "has_hypertension_disease", "has_ischemic_heart_disease", "has_sepsis", "has_stroke_disease"]
DURATIONS = [("lung_compliance", 1.0), ("vent_duration", 24.0), ("unit_duration", 1440.0),
             ("hospital_duration", 1440.0)]
ADJUSTERS = ["pfratio", "age", "bmi", "sofatotal"]


def prepare(combined: DataFrame) -> DataFrame:
    """Outcome codes, outlier scrub, driving pressure; stays with unknown
    hospital outcome are left out."""
    df = combined.select(
        "*",
        C.recode("hospitaldischargestatus", {"Alive": 0, "Expired": 1}).alias("mortality_num"),
        C.recode("unitdischargestatus", {"Alive": 0, "Expired": 1}).alias("icu_mortality"))
    df = df.withColumns({
        "bmi": C.scrub("bmi", 10, 100),
        "tidal_volume": C.scrub("tidal_volume", None, 1000),
        "TV_IBW_calculated": C.scrub("TV_IBW_calculated", 0, 20),
        "max_peep": C.scrub("max_peep", None, 20),
    })
    return (df.filter(F.col("mortality_num").isNotNull())
            .withColumn("driving_pressure", F.col("plateau_pressure") - F.col("peep")))


def mean_sd_table(df: DataFrame, variables=MEAN_SD_VARS) -> DataFrame:
    """Long table (compliance_level, variable, mean, sd) from one aggregate pass."""
    wide = S.stratified_mean_sd(df, "compliance_level", variables)
    pairs = ", ".join(f"'{v}', `{v}_mean`, `{v}_sd`" for v in variables)
    return wide.select("compliance_level",
                       F.expr(f"stack({len(variables)}, {pairs}) as (variable, mean, sd)"))


def proportion_table(df: DataFrame, variables=PROPORTION_VARS) -> DataFrame:
    """Long table (compliance_level, variable, value, n, prop) of within-level shares."""
    pairs = ", ".join(f"'{v}', cast(`{v}` as string)" for v in variables)
    long = df.select("compliance_level", F.expr(f"stack({len(variables)}, {pairs}) as (variable, value)"))
    counts = (long.filter(F.col("value").isNotNull())
              .groupBy("compliance_level", "variable", "value").agg(F.count(F.lit(1)).alias("n")))
    from pyspark.sql import Window
    w = Window.partitionBy("compliance_level", "variable")
    return counts.withColumn("prop", F.round(F.col("n") / F.sum("n").over(w), 3))


def comorbidity_table(df: DataFrame, flags=COMORBIDITY_FLAGS) -> DataFrame:
    return S.flag_prevalence(df, "compliance_level", flags)


def duration_table(df: DataFrame, durations=DURATIONS) -> DataFrame:
    """Six-number summaries per level (durations in days)."""
    out = None
    for var, scale in durations:
        t = S.six_number(df, "compliance_level", var, scale).withColumn("variable", F.lit(var))
        out = t if out is None else out.unionByName(t)
    return out


def mortality_tests(df: DataFrame) -> DataFrame:
    """Chi-square of ICU and hospital outcome by compliance level."""
    a = S.chisq_test(df, "unitdischargestatus", "compliance_level").withColumn("outcome", F.lit("icu"))
    b = S.chisq_test(df, "hospitaldischargestatus", "compliance_level").withColumn("outcome", F.lit("hospital"))
    return a.unionByName(b)


def odds_ratio_models(df: DataFrame, profile: bool = True, adjusted: tuple[bool, ...] = (False, True)) -> DataFrame:
    """Unadjusted and adjusted logistic models of hospital and ICU death on the
    compliance level (reference L), fitted together; odds ratios with Wald and
    profile-likelihood intervals."""
    from carelog.operators.glm import Model, logistic_models
    names = {f"{y}{'+adjusted' * more}": (y, more) for y in ("mortality_num", "icu_mortality") for more in adjusted}
    models = [Model(name, y, tuple(ADJUSTERS) if more else (), "compliance_level", tuple(LEVELS)) for name, (y, more) in names.items()]
    fits = logistic_models(df, models, profile=profile)
    return fits.select(F.substring_index("model", "+", 1).alias("outcome"), F.endswith("model", F.lit("+adjusted")).alias("adjusted"),
                       *[c for c in fits.columns if c != "model"])


def transition_tables(day12: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Day-1 -> day-2 phenotype transition matrix and per-cell mortality / mean P/F."""
    tm = S.transition_matrix(day12, "day1_compliance", "day2_compliance", PHENO)
    to = S.transition_outcomes(day12, "day1_compliance", "day2_compliance", "hospitaldischargestatus",
                               "Expired", "pfratio", PHENO)
    return tm, to


def transition_pf_tests(day12: DataFrame) -> DataFrame:
    """Welch t-tests of P/F: for each day-1 phenotype, staying/moving to L or I
    against moving to H (the notebook's six comparisons).

    One aggregate gives count, mean and variance of each cell; the tests are joins of
    its few rows.  A cell without rows leaves its tests empty.
    """
    cells = day12.groupBy(F.col("day1_compliance").alias("d1"), F.col("day2_compliance").alias("d2")).agg(
        F.avg("pfratio").alias("m"), F.var_samp("pfratio").alias("v"), F.count("pfratio").alias("n"))
    pairs = day12.sparkSession.createDataFrame([(a, b, PHENO[2]) for a in PHENO for b in PHENO[:2]], "d1 string, to_a string, to_b string")
    side = lambda s: cells.select("d1", F.col("d2").alias(f"to_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("m", "v", "n")])
    found = pairs.join(side("a"), ["d1", "to_a"], "left").join(side("b"), ["d1", "to_b"], "left")
    tests = S.welch_from_moments(found, ("m_a", "v_a", "n_a"), ("m_b", "v_b", "n_b"))
    name = lambda c: F.concat_ws(" -> ", "d1", c)
    return tests.select(name("to_a").alias("group_a"), name("to_b").alias("group_b"), "mean_a", "mean_b", "t", "df", t_pvalue("t", "df").alias("p_value"))


#: The study's smooth models: name, outcome, smooth term, linear terms, family.
#: The linear P/F term that one of them has beside the P/F smooth is left out:
#: the smooth already contains every straight line.
SMOOTH_MODELS = [
    ("compliance~s(pfratio)", "lung_compliance", "pfratio", [], "gaussian"),
    ("compliance~s(pfratio)+adjusted", "lung_compliance", "pfratio", ["sofatotal", "age", "bmi"], "gaussian"),
    ("mortality~s(lung_compliance)+adjusted", "mortality_num", "lung_compliance", ADJUSTERS, "binomial"),
    ("mortality~s(lung_compliance)", "mortality_num", "lung_compliance", [], "binomial"),
]


def smooth_models(df: DataFrame) -> DataFrame:
    """The four fits as a table of (model, fit): what summaries, curves and points are made from."""
    import json

    from carelog.operators.splines import gam_fit
    rows = []
    for name, y, x, z, family in SMOOTH_MODELS:
        fit = gam_fit(df, y, x, list(z), family=family)
        rows.append((name, json.dumps(fit | {k: fit[k].tolist() for k in ("beta", "cov")})))
    return df.sparkSession.createDataFrame(rows, "model string, fit string")


def _fits(table: DataFrame) -> list[tuple[str, dict]]:
    """Fits of ``smooth_models``, by name (one row a model)."""
    import json

    import numpy as np
    found = {r["model"]: json.loads(r["fit"]) for r in table.collect()}
    return [(name, found[name] | {k: np.array(found[name][k]) for k in ("beta", "cov")}) for name, *_ in SMOOTH_MODELS]


def smooth_summaries(fits: DataFrame) -> DataFrame:
    from carelog.operators.splines import summary_frame
    tables = [summary_frame(fits.sparkSession, fit).withColumn("model", F.lit(name)) for name, fit in _fits(fits)]
    return reduce(DataFrame.unionByName, tables)


def smooth_curves(fits: DataFrame) -> DataFrame:
    """The four curves on 100 points, other terms at their medians."""
    from carelog.operators.splines import curve
    tables = [curve(fits.sparkSession, fit).withColumn("model", F.lit(name)) for name, fit in _fits(fits)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def smooth_points(df: DataFrame, fits: DataFrame) -> DataFrame:
    """Points and rug of the four curves: a row for each complete case of each model."""
    from carelog.operators.splines import points
    tables = [points(df, fit, ["patientunitstayid"]).withColumn("model", F.lit(name)) for name, fit in _fits(fits)]
    return reduce(DataFrame.unionByName, tables)


def transition_chisq(day12: DataFrame) -> DataFrame:
    """For each day-2 phenotype, each other day-1 phenotype against those that were
    in it on day 1: 2x2 chi-square (without correction) of being there on day 2.

    One count table; each row of it enters the tests of its destination.
    """
    known = day12.filter(F.col("day1_compliance").isNotNull() & F.col("day2_compliance").isNotNull())
    counts = known.groupBy(F.col("day1_compliance").alias("origin"), F.col("day2_compliance").alias("reached")).agg(
        F.count(F.lit(1)).alias("c"))
    goals = F.array(*[F.lit(p) for p in PHENO])
    tests = counts.select("*", F.explode(goals).alias("destination"))
    others = F.when(F.col("origin") == F.col("destination"),
                    F.array_remove(goals, F.col("destination"))).otherwise(F.array("origin"))
    cells = (tests.select("destination", F.explode(others).alias("against"), "origin",
                          (F.col("reached") == F.col("destination")).alias("there"), "c")
             .groupBy("destination", "against", "origin", "there").agg(F.sum("c").alias("n")))
    return S.chisq_from_counts(cells, "origin", "there", by=["destination", "against"])
