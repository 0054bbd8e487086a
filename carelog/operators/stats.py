"""Study statistics as Spark jobs.

Every statistic is a distributed aggregate (counts, sums, moments, exact
quantiles, GLM fits); only finished tables of a few rows (strata x
statistics, or a p x p moment matrix) are small enough to look at.
Distribution tail probabilities are evaluated by an Arrow-batched pandas
UDF on those few-row results (math only; no data passes through Python).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelog.functions.util import col


# ----------------------------------------------------- tail probabilities
def chisq_sf(stat: float, dof: float) -> float:
    """P(X > stat) of the chi-square distribution with a whole number of degrees of freedom.

    The finite sum of Poisson terms (even) or of half-integer terms after the
    normal tail (odd), added up in logarithms.
    """
    if stat is None or dof is None or math.isnan(stat) or stat < 0 or dof <= 0 or dof != int(dof):
        return float("nan")
    if stat == 0:
        return 1.0
    h = stat / 2
    odd = int(dof) % 2
    terms = int(dof) // 2
    tail = math.erfc(math.sqrt(h)) if odd else 0.0
    if not terms:
        return tail
    first = -h + (0.5 * math.log(h) - math.lgamma(1.5) if odd else 0.0)
    ratios = math.log(h) - np.log(np.arange(1, terms) + (0.5 if odd else 0.0))
    logs = first + np.concatenate([[0.0], np.cumsum(ratios)])
    return min(1.0, tail + float(np.exp(logs).sum()))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|), by Gauss-Legendre integration of the density beyond |t|.

    The half line is mapped to (0, 1) by u = |t| + s y / (1 - y), cut into panels
    that narrow towards 1, where heavy tails end.
    """
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return float("nan")
    t = abs(t)
    if math.isinf(t):
        return 0.0
    half = dof / 2
    if half > 1e5:  # gamma(half + 1/2) / gamma(half) by its asymptotic series
        log_ratio = 0.5 * math.log(half) + math.log1p(-1 / (8 * half) + 1 / (128 * half * half))
    else:
        log_ratio = math.lgamma(half + 0.5) - math.lgamma(half)
    constant = log_ratio - 0.5 * math.log(dof * math.pi)
    edges = np.concatenate([np.linspace(0, 0.9, 31), 1 - 0.1 * 0.5 ** np.arange(1, 60), [1.0]])
    a, b = edges[:-1, None], edges[1:, None]
    y = (a + b) / 2 + (b - a) / 2 * _NODES
    scale = 1 / (1 + t)  # tails fall within about 1/t
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        u = t + scale * y / (1 - y)
        density = np.exp(constant - (dof + 1) / 2 * np.log1p(u * u / dof))
        part = density * scale / (1 - y) ** 2 * _WEIGHTS * (b - a) / 2
    return min(1.0, 2 * float(np.nan_to_num(part).sum()))


# The UDFs below and the helpers they call ship to the Python workers by
# value, so workers need not import this package (executors may run without it).
_cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.DoubleType())
def chisq_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chisq_sf(float(s), float(d)) if pd.notna(s) and pd.notna(d) else None
                      for s, d in zip(stat, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(t, dof)], dtype="float64")


# --------------------------------------------------------- summaries
def stratified_mean_sd(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Per stratum: mean and sample SD of every column (NULLs ignored), one pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def frequency(df: DataFrame, column: str) -> DataFrame:
    """``table(x)``: counts per value, NULL excluded."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def listed(df: DataFrame, levels: list, *columns: str) -> DataFrame:
    """``df``; reading it raises where a column has a value that is in none of the levels
    (NULL passes): such rows would be lost from a table of the levels without a word."""
    for c in columns:
        known = F.col(c).isNull() | F.col(c).isin(*levels)
        message = F.concat(F.lit(f"a value of {c} is in none of the levels: "), F.col(c).cast("string"))
        df = df.filter(F.when(known, True).otherwise(F.raise_error(message).cast("boolean")))
    return df


def crosstab(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Two-way table, one output column per listed level of ``column`` (0 when
    empty); rows or columns with NULL are left out, a value outside the levels raises."""
    return (listed(df, levels, column).filter(F.col(row).isNotNull() & F.col(column).isNotNull())
            .groupBy(row).pivot(column, levels).count().na.fill(0))


def proportions(df: DataFrame, by: str, column: str, digits: int = 3) -> DataFrame:
    """Within-stratum share of each value of ``column`` (NULL excluded),
    rounded; the window runs over the small (stratum, value) count table."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    return counts.withColumn("prop", F.round(F.col("n") / F.sum("n").over(w), digits))


def flag_prevalence(df: DataFrame, by: str, flags: list[str], digits: int = 3) -> DataFrame:
    """For each boolean flag, the within-stratum share of FALSE and TRUE (each
    flag over its own non-NULL total)."""
    pairs = ", ".join(f"'{_quoted(f)}', cast(`{f}` as boolean)" for f in flags)
    long = df.select(by, F.expr(f"stack({len(flags)}, {pairs}) as (flag, value)"))
    counts = long.filter(F.col("value").isNotNull()).groupBy(by, "flag", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by, "flag")
    return counts.withColumn("prop", F.round(F.col("n") / F.sum("n").over(w), digits))


def exact_quantiles(df: DataFrame, by: str, value: str, probs=(0.25, 0.5, 0.75),
                    with_summary: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles (R type 7) per stratum.

    The input is read once, into counts per (stratum, value).  Those are sorted by
    ranges, so ties and strata of any size spread over the tasks; the counts of
    each range give the ranks at which it begins, and only the range that holds a
    wanted rank is searched for it.
    """
    counts = (df.select(F.col(by).alias("_s"), F.col(value).cast("double").alias("_x"))
              .groupBy("_s", "_x").agg(F.count(F.lit(1)).alias("_c")))
    counts = (counts.repartitionByRange(F.col("_s"), F.col("_x")).withColumn("_range", F.spark_partition_id())
              .persist(StorageLevel.MEMORY_AND_DISK))
    known = counts.filter(F.col("_x").isNotNull())
    # what a range adds, and the rank at which it begins (few rows: ranges x strata)
    sizes = known.groupBy("_s", "_range").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy("_s")
    starts = sizes.select("_s", "_range", F.sum("_c").over(w).alias("_n"),
                          (F.sum("_c").over(w.orderBy("_range")) - F.col("_c")).alias("_from"), F.col("_c").alias("_size"))
    wanted = starts.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_k", "_p"))
    wanted = wanted.select("*", ((F.col("_n") - 1) * F.col("_p")).alias("_h"))
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_r"))
    wanted = wanted.filter((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_from") + F.col("_size")))
    inside = known.select("_s", "_range", "_x", "_c",
                          F.sum("_c").over(Window.partitionBy("_s", "_range").orderBy("_x")).alias("_upto"))
    found = wanted.join(inside, (wanted["_s"].eqNullSafe(inside["_s"])) & (wanted["_range"] == inside["_range"])
                        & (F.col("_r") < F.col("_from") + F.col("_upto"))
                        & (F.col("_r") >= F.col("_from") + F.col("_upto") - inside["_c"]))
    ends = found.groupBy(wanted["_s"].alias("_s"), "_k", "_h").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    q = ends.select("_s", "_k", (F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a"))).alias("q"))
    out = q.groupBy("_s").pivot("_k", list(range(len(probs)))).agg(F.first("q"))
    names = [f"q{int(round(p * 100))}" for p in probs]
    out = out.select("_s", *[F.col(str(i)).alias(c) for i, c in enumerate(names)])
    if not with_summary:
        return out.withColumnRenamed("_s", by)
    # a stratum whose values are all NULL has no quantile row: keep it
    summary = counts.groupBy("_s").agg(
        F.min("_x").alias("min"), (F.sum(F.col("_x") * F.col("_c")) / F.sum(F.when(F.col("_x").isNotNull(), F.col("_c")))).alias("mean"),
        F.max("_x").alias("max"), F.sum(F.when(F.col("_x").isNull(), F.col("_c")).otherwise(0)).alias("n_na"))
    right = out.withColumnRenamed("_s", "_q")
    return summary.join(right, F.col("_s").eqNullSafe(F.col("_q")), "left").drop("_q").withColumnRenamed("_s", by)


def six_number(df: DataFrame, by: str, value: str, scale: float = 1.0) -> DataFrame:
    """Min, Q1, median, mean, Q3, max (divided by ``scale``) and the NULL count
    (not scaled) per stratum."""
    j = exact_quantiles(df, by, value, with_summary=True)
    s = F.lit(float(scale))
    return j.select(by, (F.col("min") / s).alias("min"), (F.col("q25") / s).alias("q1"),
                    (F.col("q50") / s).alias("median"), (F.col("mean") / s).alias("mean"),
                    (F.col("q75") / s).alias("q3"), (F.col("max") / s).alias("max"), "n_na")


# ----------------------------------------------------------------- tests
def chisq_from_counts(counts: DataFrame, row: str, column: str, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Pearson chi-square (no continuity correction) of a long count table
    (row, column, n): statistic, degrees of freedom and p-value; one test for
    each group of ``by``.

    Uses sum((o-e)^2/e) = N * sum(o^2 / (row_total * col_total)) - N, so only
    observed cells are visited.  Margins are windows over the small count table,
    so the data behind it are read once."""
    by = list(by or [])
    key = [F.col(c) for c in by]
    total = lambda *more: F.sum(n).over(Window.partitionBy(*key, *more))
    cell = counts.filter(F.col(n) > 0).select("*", total(row).alias("_rt"), total(column).alias("_ct"))
    s = cell.groupBy(*by).agg(F.sum(n).cast("double").alias("_N"),
                              F.sum(F.col(n).cast("double") ** 2 / (F.col("_rt") * F.col("_ct"))).alias("_S"),
                              F.countDistinct(row).alias("_r"), F.countDistinct(column).alias("_c"))
    stat = s.select(*by, (F.col("_N") * F.col("_S") - F.col("_N")).alias("statistic"),
                    ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("long").alias("df"))
    return stat.withColumn("p_value", chisq_pvalue("statistic", F.col("df").cast("double")))


def chisq_test(df: DataFrame, row: str, column: str) -> DataFrame:
    counts = (df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
              .groupBy(row, column).agg(F.count(F.lit(1)).alias("n")))
    return chisq_from_counts(counts, row, column)


def welch_t(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Welch two-sample t-test of ``value`` between groups ``a`` and ``b``."""
    s = (df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
         .groupBy().agg(*[f(F.when(F.col(group) == g, F.col(value))).alias(f"{nm}_{i}")
                          for i, g in enumerate((a, b))
                          for nm, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]))
    return welch_from_moments(s, ("m_0", "v_0", "n_0"), ("m_1", "v_1", "n_1")).select("mean_a", "mean_b", "t", "df")


def welch_from_moments(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    """Adds mean_a, mean_b, t and df of the Welch test, from columns with (mean, variance, count) of two groups."""
    (ma, va, na), (mb, vb, nb) = ([F.col(c) for c in g] for g in (a, b))
    ea, eb = F.try_divide(va, na), F.try_divide(vb, nb)
    freedom = F.try_divide((ea + eb) ** 2, F.try_divide(ea ** 2, na - 1) + F.try_divide(eb ** 2, nb - 1))
    return df.withColumns({"mean_a": ma, "mean_b": mb, "t": F.try_divide(ma - mb, F.sqrt(ea + eb)), "df": freedom})


def welch_t_test(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    out = welch_t(df, value, group, a, b)
    return out.withColumn("p_value", t_pvalue("t", "df"))


def _quoted(text) -> str:
    """Text inside a SQL string literal."""
    return str(text).replace("\\", "\\\\").replace("'", "\\'")


def odds_ratios(df: DataFrame, outcome: str, group: str, levels: list, z: float = 1.959963984540054) -> DataFrame:
    """Unadjusted odds ratio of ``outcome`` (0/1) for each level of ``group``
    against the first level: cross-product ratio and Wald 95% CI.  Equal to the
    logistic-regression estimate with the group as the only predictor.

    One aggregate over the data gives the 2 x k counts as a single row; the
    ratios are column expressions, unpivoted with ``stack``."""
    y = F.col(outcome)
    aggs = []
    for i, lv in enumerate(levels):
        g = F.col(group) == F.lit(lv)
        aggs += [F.count_if(g & (y == 1)).alias(f"e{i}"), F.count_if(g & (y == 0)).alias(f"n{i}")]
    other = F.count_if(~F.col(group).isin(*levels) & y.isNotNull()).alias("_other")
    c = df.groupBy().agg(*aggs, other)
    # a value outside the levels would be lost without a word
    c = c.filter(F.when(F.col("_other") == 0, True).otherwise(
        F.raise_error(F.concat(F.col("_other").cast("string"), F.lit(f" rows of {group} are in none of the levels"))).cast("boolean")))
    parts = []
    for i, lv in enumerate(levels[1:], start=1):
        parts.append(f"'{_quoted(lv)}', e{i}, n{i}, e0, n0")
    long = c.select(F.expr(f"stack({len(parts)}, {', '.join(parts)}) as ({group}, events, nonevents, _re, _rn)"))
    # an empty cell leaves the ratio undefined (NULL), not an error
    ok = (F.col("events") > 0) & (F.col("nonevents") > 0) & (F.col("_re") > 0) & (F.col("_rn") > 0)
    e, ne, re, rn = (F.col(c).cast("double") for c in ("events", "nonevents", "_re", "_rn"))
    lor = F.when(ok, F.log((e * rn) / (ne * re)))
    se = F.when(ok, F.sqrt(1 / e + 1 / ne + 1 / re + 1 / rn))
    return long.select(group, "events", "nonevents", F.exp(lor).alias("odds_ratio"), se.alias("se_log_or"),
                       F.exp(lor - z * se).alias("ci_low"), F.exp(lor + z * se).alias("ci_high"))


def logistic_regression(df: DataFrame, label: str, numeric: list[str], factor: str | None = None,
                        levels: list | None = None, z: float = 1.959963984540054, profile: bool = False) -> DataFrame:
    """One binomial GLM (logit), a row for each term; see ``glm.logistic_models``."""
    from carelog.operators.glm import Model, logistic_models
    model = Model(label, label, tuple(numeric), factor, tuple(levels or ()))
    return logistic_models(df, [model], profile=profile, z=z).drop("model")


# ----------------------------------------------------------- transitions
def level_grid(spark: SparkSession, a: str, b: str, levels: list[str]) -> DataFrame:
    """All (a, b) pairs of a fixed level list (a literal, not data)."""
    return spark.createDataFrame([(x, y) for x in levels for y in levels], f"{a} string, {b} string")


def transition_matrix(df: DataFrame, src: str, dst: str, levels: list[str], digits: int = 3) -> DataFrame:
    """Counts and row-normalised proportions of src -> dst over the full level grid; a value outside the levels raises."""
    counts = (listed(df, levels, src, dst).filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
              .groupBy(src, dst).agg(F.count(F.lit(1)).alias("n")))
    g = level_grid(df.sparkSession, src, dst, levels).join(counts, [src, dst], "left").fillna({"n": 0})
    w = Window.partitionBy(src)
    tot = F.sum("n").over(w)
    return g.withColumn("prop", F.when(tot > 0, F.round(F.col("n") / tot, digits)))


def transition_outcomes(df: DataFrame, src: str, dst: str, status: str, event_value: str, mean_of: str,
                        levels: list[str], digits: int = 3) -> DataFrame:
    """Per transition cell: patients, events, event rate and mean of ``mean_of``; a value outside the levels raises."""
    agg = (listed(df, levels, src, dst).filter(F.col(status).isNotNull()).groupBy(src, dst)
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == event_value).alias("events"),
                F.avg(mean_of).alias("mean_value")))
    g = level_grid(df.sparkSession, src, dst, levels).join(agg, [src, dst], "left").fillna({"n": 0, "events": 0})
    return g.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("events") / F.col("n"), digits)))
