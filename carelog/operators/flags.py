"""Any-match flags and presence indicators per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelog.functions.parse import safe_int
from carelog.functions.util import col


def any_flags(df: DataFrame, key: str, spec: dict[str, Column]) -> DataFrame:
    """One row per key; each flag is TRUE when any row satisfies its predicate
    and FALSE (not NULL) otherwise - ``count_if(p) > 0``, unlike ``bool_or``
    which is NULL when every predicate is NULL."""
    return df.groupBy(key).agg(*[(F.count_if(p) > 0).alias(name) for name, p in spec.items()])


def presence(df: DataFrame, key: str, predicate: Column | None = None, name: str = "present") -> DataFrame:
    """Distinct keys having a row that satisfies ``predicate``, with a constant 1."""
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(key).distinct().withColumn(name, F.lit(1))


def icd_prefix(code) -> Column:
    """First three characters of an ICD-9 text as an integer (``'038.9'`` -> 38);
    NULL for non-numeric prefixes such as ``'V58'``."""
    return safe_int(F.substring(col(code), 1, 3))


# Comorbidity flags by ICD-9 three-digit range (inclusive) or by
# a substring of the full code text, in the study's column order.
ICD_FLAGS: tuple[tuple[str, str, object], ...] = (
    ("has_atrial_fibrillation_disease", "range", (427, 427)),
    ("AF", "text", "427.31"),
    ("has_cancer_disease", "range", (140, 209)),
    ("CHF", "text", "428"),
    ("CKD", "text", "585"),
    ("has_chronic_liver_disease", "range", (571, 571)),
    ("has_copd_disease", "range", (490, 496)),
    ("has_diabetes_mellitus_disease", "range", (250, 250)),
    ("has_hypertension_disease", "range", (401, 405)),
    ("has_ischemic_heart_disease", "range", (410, 414)),
    ("has_sepsis", "range", (38, 38)),
    ("has_stroke_disease", "range", (434, 434)),
)


def icd_flag_spec(code_col: str = "icd9code", flags=ICD_FLAGS) -> dict[str, Column]:
    prefix = icd_prefix(code_col)
    spec = {}
    for name, kind, arg in flags:
        if kind == "range":
            spec[name] = prefix.between(arg[0], arg[1])
        else:
            spec[name] = col(code_col).contains(arg)
    return spec


def icd_flags(diagnosis: DataFrame, key: str = "patientunitstayid", code_col: str = "icd9code",
              flags=ICD_FLAGS) -> DataFrame:
    return any_flags(diagnosis, key, icd_flag_spec(code_col, flags))
