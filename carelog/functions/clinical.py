"""Clinical Column builders: time buckets, bands, unit normalisation, scores.

Thresholds below are fixed values of the study; they are kept together and
in the study's rule order because CASE order decides overlapping edges
(e.g. compliance 40 is "I", P/F 100 is "severe").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelog.functions.util import col, first_match


# ---------------------------------------------------------------- buckets
def bucket_index(t, width: int = 240, n: int = 12) -> Column:
    """1-based bucket of ``t`` in ``[0, n*width]``; edges are inclusive and the
    lower bucket wins, so ``[0,w]`` is 1, ``(w,2w]`` is 2 ...; outside -> NULL."""
    t = col(t)
    return F.when(t.between(0, n * width),
                  F.greatest(F.lit(1), F.ceil(t / F.lit(width))).cast("int"))


def bucket_label(t, width: int = 240, n: int = 12, prefix: str = "T") -> Column:
    """``T1``..``Tn`` label of :func:`bucket_index`."""
    return F.concat(F.lit(prefix), bucket_index(t, width, n).cast("string"))


# ------------------------------------------------------------ data hygiene
def scrub(x, lo=None, hi=None) -> Column:
    """Set values outside ``[lo, hi]`` to NULL (either bound optional)."""
    x = col(x)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (x < lo)
    if hi is not None:
        bad = bad | (x > hi)
    return F.when(bad, F.lit(None)).otherwise(x)


def recode(x, mapping: dict, dtype: str = "int") -> Column:
    """Map listed categories to values; every other value (and NULL) -> NULL."""
    x = col(x)
    return first_match([(x == k, F.lit(v).cast(dtype)) for k, v in mapping.items()])


# ------------------------------------------------------- unit normalisers
def tidal_volume_ml(v) -> Column:
    """Values in (0, 1] are litres (x1000); (10, 2000] are ml; else NULL."""
    v = col(v)
    return first_match([((v > 0) & (v <= 1), v * 1000), ((v > 10) & (v <= 2000), v)])


def fio2_percent(v) -> Column:
    """FiO2 as a fraction (<= 1) -> percent; 1..100 kept; above 100 -> NULL."""
    v = col(v)
    return first_match([(v <= 1, v * 100), (v.between(1, 100), v)])


# Vasopressor rate conversions to mcg/kg/min
# (drug, unit text in the drug name, divisor; None = already mcg/kg/min).
VASOPRESSOR_UNITS = {
    "dopamine": [("(ml/hr)", 3), ("(mcg/kg/min)", None)],
    "norepinephrine": [("(ml/hr)", 300), ("(mcg/min)", 80), ("(mcg/kg/min)", None)],
}


def unit_rate(name, rate, units, lower: bool = True, digits: int = 3) -> Column:
    """Convert ``rate`` by the unit text found in ``name``: ``units`` is an
    ordered list of (substring, divisor or None); the first listed unit present
    wins; a division is rounded to ``digits``; no listed unit -> NULL."""
    n = F.lower(col(name)) if lower else col(name)
    r = col(rate)
    return first_match([(n.contains(u), r if d is None else F.round(r / F.lit(d), digits)) for u, d in units])


def vasopressor_rate(drugname, rate, drug: str) -> Column:
    """Rate in mcg/kg/min from the unit written in the drug name."""
    return unit_rate(drugname, rate, VASOPRESSOR_UNITS[drug])


# ------------------------------------------------------------ body size
def ideal_body_weight(gender, height_cm, formula: str = "study") -> Column:
    """IBW in kg.  ``study``: the study's arrangement of the constants;
    ``standard``: 50 / 45.5 + 0.91*(h - 152.4) (Devine, male / female)."""
    g, h = col(gender), col(height_cm)
    if formula == "study":
        return first_match([(g == "Female", 50 + (0.91 * h - 152.4)),
                            (g == "Male", 45.5 + (0.91 * h - 152.4))])
    return first_match([(g == "Male", 50 + 0.91 * (h - 152.4)),
                        (g == "Female", 45.5 + 0.91 * (h - 152.4))])


def bmi(weight, fallback_weight, height_cm) -> Column:
    h2 = F.pow(col(height_cm) / 100, 2)
    return F.coalesce(col(weight), col(fallback_weight)) / F.nullif(h2, F.lit(0.0))


def mean_arterial_pressure(systolic, diastolic) -> Column:
    return col(systolic) * 1 / 3 + col(diastolic) * 2 / 3


# ----------------------------------------------------------------- bands
def compliance_level(c, labels=("L", "I", "H")) -> Column:
    """Compliance phenotype: > 50 high-compliance (L), 40..50 intermediate,
    below (H); exactly 40 falls to the intermediate band first."""
    c = col(c)
    lo, mid, hi = labels
    return first_match([(c > 50, lo), (c.between(40, 50), mid), (c <= 40, hi)])


PHENOTYPE_NAMES = ("Type L", "Intermediate phenotype", "Type H")


def ards_severity(pf) -> Column:
    pf = col(pf)
    return first_match([(pf <= 100, "severe"), (pf.between(100, 200), "moderate"),
                        (pf.between(200, 300), "mild")])


# ---------------------------------------------------------- SOFA bands
def sofa_cardiovascular(map_, dopa, norepi, dobu) -> Column:
    m, d, n, b = col(map_), col(dopa), col(norepi), col(dobu)
    return first_match([
        ((d >= 15) | (n > 0.1), 4),
        ((d > 5) | ((n > 0) & (n <= 0.1)), 3),
        ((d <= 5) | (b > 0), 2),
        (m < 70, 1),
    ], otherwise=0)


def sofa_respiratory(pf, sf) -> Column:
    """P/F and S/F here are ratios to FiO2 in percent (P/F of 300 mmHg is 3)."""
    pf, sf = col(pf), col(sf)
    return first_match([
        ((pf < 1) | (sf < 0.67), 4),
        (pf.between(1, 2) | sf.between(0.67, 1.41), 3),
        (pf.between(2, 3) | sf.between(1.42, 2.2), 2),
        (pf.between(3, 4) | sf.between(2.21, 3.01), 1),
    ], otherwise=0)


def sofa_renal(urine_ml, creatinine) -> Column:
    uo, cr = col(urine_ml), col(creatinine)
    return first_match([
        ((uo < 200) | (cr > 5), 4),
        ((uo < 500) | (cr > 3.5), 3),
        (cr.between(2, 3.5), 2),
        (cr.between(1.2, 2), 1),
    ], otherwise=0)


def sofa_coagulation(platelets) -> Column:
    p = col(platelets)
    return first_match([(p < 20, 4), (p < 50, 3), (p < 100, 2), (p < 150, 1)], otherwise=0)


def sofa_liver(bilirubin) -> Column:
    b = col(bilirubin)
    return first_match([(b > 12, 4), (b > 6, 3), (b > 2, 2), (b > 1.2, 1)], otherwise=0)


def sofa_cns(gcs) -> Column:
    g = col(gcs)
    return first_match([(g == 15, 0), (g >= 13, 1), (g >= 10, 2), (g >= 6, 3), (g >= 3, 4)],
                       otherwise=0)


def ratio_with_defaults(numerator, fio2, num_default: float = 100, fio2_default: float = 21) -> Column:
    """``coalesce(x, 100) / coalesce(nullif(fio2, 0), 21)`` as a double."""
    return (F.coalesce(col(numerator).cast("double"), F.lit(float(num_default)))
            / F.coalesce(F.nullif(col(fio2).cast("double"), F.lit(0.0)), F.lit(float(fio2_default))))
