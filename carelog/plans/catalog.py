"""Query catalogue: every operator run over the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB
SQL over the same parquet, views pre-registered).  Double columns are
rounded to 6 places on both sides so the value hashes compare numbers, not
last-bit noise.  Pipelines run on the eICU-shaped tables derived from the
driver tables (``sources.fixtures``).
"""

from __future__ import annotations

import hashlib
from functools import cache
from pathlib import Path

from pyspark.sql import functions as F

from carelog.plans import combined as CB
from carelog.plans import compliance as CMP
from carelog.plans import oracle_sql as O
from carelog.plans import oxygen as OX
from carelog.plans import pf as PF
from carelog.plans import sofa as SOFA
from carelog.session import step_table
from carelog.sources.fixtures import STAY, derive, source_key, stay_buckets

from carelog.plans.registry import ORACLE, QUERIES, register, round_doubles  # noqa: F401


# ------------------------------------------------------------- pipelines
#: The tables that the operators of a plan read.
OXYGEN_TABLES = ("respiratorycharting", "nursecharting", "treatment", "patient")
PF_TABLES = (*OXYGEN_TABLES, "apachepredvar", "lab", "diagnosis")
SOFA_TABLES = ("patient", "vitalaperiodic", "vitalperiodic", "infusiondrug", "lab", "respiratorycharting", "nursecharting",
               "intakeoutput", "physicalexam")
VENT_TABLES = ("respiratorycare", "respiratorycharting", "treatment", "patient")


def _t(spark, sf_dir, *names):
    return derive(spark, sf_dir, names or None)


def _oxygen(t):
    return OX.oxygen_therapy(t["respiratorycharting"], t["nursecharting"], t["treatment"], t["patient"])


#: The study's table steps: the modules of ``plans`` that make each, and the steps that it reads.
STEPS = {
    "lungcompliance": (["compliance"], []),
    "ventilated_cohort": (["pf", "oxygen"], []),
    "first_pfratio": (["pf", "oxygen"], ["ventilated_cohort"]),
    "sofa": (["sofa"], []),
    "combined": (["combined"], ["lungcompliance", "first_pfratio", "sofa"]),
    "day12": (["combined"], ["lungcompliance", "combined"]),
    "analysis": (["report"], ["combined"]),
    "smooth_fits": (["report"], ["analysis"]),
}


@cache
def _code(*modules: str) -> str:
    """Names this version of some plan modules and of the functions and operators that all of them use."""
    here = Path(__file__).resolve().parent.parent
    shared = [p for d in ("functions", "operators", "sources") for p in sorted((here / d).glob("*.py"))]
    own = [here / "plans" / f"{m}.py" for m in modules]
    return hashlib.sha1(b"".join(p.read_bytes() for p in [*shared, *own])).hexdigest()


@cache
def step_version(name: str) -> str:
    """Changes with the code of a step and of all steps before it, and with no other."""
    modules, inputs = STEPS[name]
    return hashlib.sha1("".join([name, _code(*modules), *map(step_version, inputs)]).encode()).hexdigest()[:8]


class Study:
    """The study's steps over one folder of tables: each is written once for the state of its sources and code.

    A step that is already written is read without looking at those before it.
    """

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self.key = spark, sf_dir, source_key(spark, sf_dir)
        self.buckets = stay_buckets(spark, sf_dir)

    def step(self, name, make, by=STAY):
        """All steps but the fits are laid out by stay, so that joins between them need no shuffle."""
        return step_table(self.spark, name, f"{self.key}-{step_version(name)}", make, by, self.buckets)

    def tables(self, *names):
        return _t(self.spark, self.sf_dir, *names)

    def lungcompliance(self):
        return self.step("lungcompliance", lambda: CMP.lung_compliance(self.tables("respiratorycharting")["respiratorycharting"]))

    def first_pfratio(self):
        def make():
            t = self.tables(*PF_TABLES)
            return PF.first_pfratio(t, _oxygen(t), step=self.step)
        return self.step("first_pfratio", make)

    def sofa(self):
        return self.step("sofa", lambda: SOFA.sofa(self.tables(*SOFA_TABLES)))

    def combined(self):
        def make():
            t = self.tables("vitalperiodic", "lab", "diagnosis")
            return CB.combined(self.first_pfratio(), self.lungcompliance(), self.sofa(), t["vitalperiodic"], t["lab"], t["diagnosis"])
        return self.step("combined", make)

    def day12(self):
        return self.step("day12", lambda: CB.day12(self.lungcompliance(), self.combined()))

    def analysis(self):
        return self.step("analysis", lambda: R.prepare(self.combined()))

    def smooth_fits(self):
        """The fitted smooth models, shared by their summaries, curves and points."""
        return self.step("smooth_fits", lambda: R.smooth_models(self.analysis()), by=None)


@register("pipe_oxygen", O.oxygen_sql())
def pipe_oxygen(spark, sf_dir):
    return round_doubles(_oxygen(_t(spark, sf_dir, *OXYGEN_TABLES)))


@register("pipe_support_dedupe", O.dedupe_sql())
def pipe_support_dedupe(spark, sf_dir):
    t = _t(spark, sf_dir, *OXYGEN_TABLES[:3])
    return OX.deduped_support_events(t["respiratorycharting"], t["nursecharting"], t["treatment"])


@register("pipe_sofa", O.sofa_sql())
def pipe_sofa(spark, sf_dir):
    c = SOFA.sofa_components(_t(spark, sf_dir, *SOFA_TABLES))
    total = (F.col("sofa_cv") + F.col("sofa_respi") + F.col("sofarenal") + F.col("sofacoag")
             + F.col("sofaliver") + F.col("sofacns"))
    return c.select("patientunitstayid", "sofa_cv", "sofa_respi", "sofarenal", "sofacoag", "sofaliver", "sofacns",
                    total.cast("int").alias("sofatotal"))


@register("pipe_mech_vent", O.mech_vent_sql())
def pipe_mech_vent(spark, sf_dir):
    t = _t(spark, sf_dir, *VENT_TABLES)
    return SOFA.mech_vent(t["respiratorycare"], t["respiratorycharting"], t["treatment"], t["patient"])


@register("pipe_compliance", O.compliance_sql())
def pipe_compliance(spark, sf_dir):
    return round_doubles(CMP.lung_compliance(_t(spark, sf_dir, "respiratorycharting")["respiratorycharting"]))


@register("pipe_pf", O.pf_sql())
def pipe_pf(spark, sf_dir):
    return round_doubles(Study(spark, sf_dir).first_pfratio())


@register("pipe_combined", O.combined_sql())
def pipe_combined(spark, sf_dir):
    return round_doubles(Study(spark, sf_dir).combined())


@register("pipe_day12", O.day12_sql())
def pipe_day12(spark, sf_dir):
    return round_doubles(_day12_df(spark, sf_dir))


# --------------------------------------------------------------- report
from carelog.plans import report as R  # noqa: E402


def _report_df(spark, sf_dir):
    return Study(spark, sf_dir).analysis()


def _day12_df(spark, sf_dir):
    return Study(spark, sf_dir).day12()


def _prep_sql() -> str:
    return f"""(select * replace (
        case when bmi < 10 or bmi > 100 then null else bmi end as bmi,
        case when tidal_volume > 1000 then null else tidal_volume end as tidal_volume,
        case when TV_IBW_calculated < 0 or TV_IBW_calculated > 20 then null else TV_IBW_calculated end
          as TV_IBW_calculated,
        case when max_peep > 20 then null else max_peep end as max_peep),
      case when hospitaldischargestatus = 'Alive' then 0 when hospitaldischargestatus = 'Expired' then 1 end
        mortality_num,
      case when unitdischargestatus = 'Alive' then 0 when unitdischargestatus = 'Expired' then 1 end icu_mortality,
      plateau_pressure - peep driving_pressure
    from ({O.combined_sql(False)}) c0 where hospitaldischargestatus in ('Alive', 'Expired'))"""


def _union(parts):
    return " union all ".join(parts)


@register("report_mean_sd", f"""with p as {_prep_sql()}
select * from ({_union(f"select compliance_level, '{v}' variable, round(avg({v}), 6) mean, "
                      f"round(stddev_samp({v}), 6) sd from p group by 1" for v in R.MEAN_SD_VARS)}) x""")
def report_mean_sd(spark, sf_dir):
    """AGG12 on the analysis table: mean and SD of 17 variables per phenotype."""
    return round_doubles(R.mean_sd_table(_report_df(spark, sf_dir)))


@register("report_proportions", f"""with p as {_prep_sql()},
l as ({_union(f"select compliance_level, '{v}' variable, cast({v} as varchar) value from p" for v in R.PROPORTION_VARS)}),
c as (select compliance_level, variable, value, count(*) n from l where value is not null group by 1, 2, 3)
select *, round(n / sum(n) over (partition by compliance_level, variable), 3) prop from c""")
def report_proportions(spark, sf_dir):
    """AGG15 on the analysis table: within-phenotype shares of five categorical variables."""
    return R.proportion_table(_report_df(spark, sf_dir))


@register("report_comorbidity", f"""with p as {_prep_sql()},
l as ({_union(f"select compliance_level, '{v}' flag, cast({v} as boolean) value from p" for v in R.COMORBIDITY_FLAGS)}),
c as (select compliance_level, flag, value, count(*) n from l where value is not null group by 1, 2, 3)
select *, round(n / sum(n) over (partition by compliance_level, flag), 3) prop from c""")
def report_comorbidity(spark, sf_dir):
    """AGG16 on the analysis table: comorbidity prevalence per phenotype."""
    return R.comorbidity_table(_report_df(spark, sf_dir))


@register("report_durations", f"""with p as {_prep_sql()}
select * from ({_union(
    f"select compliance_level, round(min({v}) / {s}, 7) min, round(quantile_cont({v}, 0.25) / {s}, 7) q1, "
    f"round(quantile_cont({v}, 0.5) / {s}, 7) median, round(avg({v}) / {s}, 7) mean, "
    f"round(quantile_cont({v}, 0.75) / {s}, 7) q3, round(max({v}) / {s}, 7) max, "
    f"count(case when {v} is null then 1 end) n_na, '{v}' variable from p group by 1" for v, s in R.DURATIONS)}) x""")
def report_durations(spark, sf_dir):
    """AGG17 on the analysis table: compliance and durations (days) per phenotype."""
    return round_doubles(R.duration_table(_report_df(spark, sf_dir)), 7)


@register("report_mortality_chisq", f"""with p as {_prep_sql()},
t as ({_union(f"select '{o}' outcome, {c} r, compliance_level k from p where {c} is not null and compliance_level is not null"
              for o, c in (("icu", "unitdischargestatus"), ("hospital", "hospitaldischargestatus")))}),
c as (select outcome, r, k, count(*) o from t group by all),
n as (select *, sum(o) over (partition by outcome) total,
             cast(sum(o) over (partition by outcome, r) as double) * sum(o) over (partition by outcome, k)
               / sum(o) over (partition by outcome) e from c),
s as (select outcome, max(total) * (sum(o * o / e / total) - 1) statistic,
             cast((count(distinct r) - 1) * (count(distinct k) - 1) as bigint) df from n group by outcome)
select outcome, round(statistic, 6) statistic, df,
       round(case df when 2 then exp(-statistic / 2) when 4 then exp(-statistic / 2) * (1 + statistic / 2) end, 6) p_value from s""")
def report_mortality_chisq(spark, sf_dir):
    """ST1 on the analysis table: ICU and hospital outcome by phenotype (df 2: p = exp(-x/2))."""
    return round_doubles(R.mortality_tests(_report_df(spark, sf_dir)))


def _models_sql() -> str:
    parts = []
    for outcome in ("mortality_num", "icu_mortality"):
        for adjusted in (False, True):
            more = R.ADJUSTERS if adjusted else []
            cases = " and ".join(f"{c} is not null" for c in [outcome, "compliance_level", *more])
            terms = ["(Intercept)", *[f"compliance_level_{v}" for v in R.LEVELS[1:]], *more]
            xs = ["cast(1 as double)", *[f"cast(compliance_level = '{v}' as double)" for v in R.LEVELS[1:]], *[f"cast({c} as double)" for c in more]]
            rows = f"select {outcome} y, {', '.join(f'{x} x{i}' for i, x in enumerate(xs))} from p where {cases}"
            parts.append(f"select '{outcome}' outcome, {str(adjusted).lower()} adjusted, * from ({O.logit_sql(rows, terms)}) m")
    rounded = ", ".join(f"round({c}, 6) as {c}" for c in O.LOGIT_COLUMNS)
    return f"with p as materialized {_prep_sql()} select * replace ({rounded}) from ({_union(parts)}) u"


@register("report_models", _models_sql())
def report_models(spark, sf_dir):
    """ST4/ST5/ST8: unadjusted and adjusted logistic models, odds ratios, Wald intervals."""
    fits = R.odds_ratio_models(_report_df(spark, sf_dir), profile=False)
    return round_doubles(fits.drop("profile_low", "profile_high", "steps"))


_PROFILE = ["outcome", "term", "estimate", "odds_ratio", "profile_low", "profile_high", "separated"]


def _profile_sql() -> str:
    cells = lambda y: f"select compliance_level as level, count(*) filter ({y} = 1) e, count(*) filter ({y} = 0) n from p where {y} is not null and compliance_level is not null group by 1"
    parts = [f"select '{y}' outcome, * from ({O.profile_sql(cells(y), R.LEVELS[0], 'compliance_level_')}) m" for y in ("mortality_num", "icu_mortality")]
    rounded = ", ".join(f"round({c}, 6) as {c}" for c in _PROFILE[2:6])
    return f"with p as materialized {_prep_sql()} select * replace ({rounded}) from ({_union(parts)}) u"


@register("report_odds_ratios", _profile_sql())
def report_odds_ratios(spark, sf_dir):
    """ST5: unadjusted odds ratios of hospital and ICU death with profile-likelihood intervals."""
    fits = R.odds_ratio_models(_report_df(spark, sf_dir), adjusted=(False,))
    return round_doubles(fits.filter("term <> '(Intercept)'").select(*_PROFILE))


@register("report_odds_ratios_adjusted")
def report_odds_ratios_adjusted(spark, sf_dir):
    """ST5: adjusted odds ratios of all terms with profile-likelihood intervals (tests compare with refits)."""
    return round_doubles(R.odds_ratio_models(_report_df(spark, sf_dir), adjusted=(True,)).select(*_PROFILE))


_PHENO_GRID = ", ".join(f"('{a}', '{b}')" for a in R.PHENO for b in R.PHENO)


@register("report_transitions", f"""with d as ({O.day12_sql(False)}),
g as (select * from (values {_PHENO_GRID}) v(day1_compliance, day2_compliance)),
c as (select day1_compliance, day2_compliance, count(*) n from d group by 1, 2),
f as (select g.*, coalesce(c.n, 0) n from g left join c using (day1_compliance, day2_compliance))
select *, case when sum(n) over (partition by day1_compliance) > 0 then
  round(n / sum(n) over (partition by day1_compliance), 3) end prop from f""")
def report_transitions(spark, sf_dir):
    """ST9: day-1 -> day-2 phenotype transition counts and row shares."""
    return R.transition_tables(_day12_df(spark, sf_dir))[0]


@register("report_transition_mortality", f"""with d as ({O.day12_sql(False)}),
g as (select * from (values {_PHENO_GRID}) v(day1_compliance, day2_compliance)),
c as (select day1_compliance, day2_compliance, count(*) n,
             count(case when hospitaldischargestatus = 'Expired' then 1 end) events, avg(pfratio) mean_value
      from d where hospitaldischargestatus is not null group by 1, 2)
select g.*, coalesce(c.n, 0) n, coalesce(c.events, 0) events, round(c.mean_value, 6) mean_value,
  case when coalesce(c.n, 0) > 0 then round(c.events / c.n, 3) end rate
from g left join c using (day1_compliance, day2_compliance)""")
def report_transition_mortality(spark, sf_dir):
    """ST10: per-transition deaths, patients, mortality and mean P/F."""
    return round_doubles(R.transition_tables(_day12_df(spark, sf_dir))[1])


@register("report_transition_pf_tests", f"""with d as ({O.day12_sql(False)}),
c as (select day1_compliance d1, day2_compliance d2, avg(pfratio) m, var_samp(pfratio) v, count(pfratio) n from d group by all),
g as (select a.p || ' -> ' || b.p group_a, a.p || ' -> {R.PHENO[2]}' group_b, a.p d1, b.p d2
      from (values {", ".join(f"('{p}')" for p in R.PHENO)}) a(p), (values {", ".join(f"('{p}')" for p in R.PHENO[:2])}) b(p)),
w as (select group_a, group_b, x.m mean_a, y.m mean_b, x.v / x.n ea, y.v / y.n eb, x.n na, y.n nb from g
      left join c x on x.d1 = g.d1 and x.d2 = g.d2 left join c y on y.d1 = g.d1 and y.d2 = '{R.PHENO[2]}'),
t as (select *, (mean_a - mean_b) / sqrt(ea + eb) t, power(ea + eb, 2) / (power(ea, 2) / (na - 1) + power(eb, 2) / (nb - 1)) df from w)
select group_a, group_b, round(mean_a, 6) mean_a, round(mean_b, 6) mean_b, round(t, 6) t, round(df, 6) df,
       case when df is not null then round({O.t_tail("t", "df")}, 6) end p_value from t""")
def report_transition_pf_tests(spark, sf_dir):
    """ST3 on the day-1/day-2 pairs: Welch t-tests of P/F between transitions."""
    return round_doubles(R.transition_pf_tests(_day12_df(spark, sf_dir)))


@register("report_transition_chisq", f"""with d as ({O.day12_sql(False)}),
pairs as (select a.p destination, b.p against from (values {", ".join(f"('{p}')" for p in R.PHENO)}) a(p)
          join (values {", ".join(f"('{p}')" for p in R.PHENO)}) b(p) on a.p <> b.p),
f as (select destination, against,
             count(*) filter (where day1_compliance = destination and day2_compliance = destination) a,
             count(*) filter (where day1_compliance = destination and day2_compliance <> destination) b,
             count(*) filter (where day1_compliance = against and day2_compliance = destination) c,
             count(*) filter (where day1_compliance = against and day2_compliance <> destination) d
      from pairs, d group by all),
s as (select *, cast(a + b + c + d as double) * power(a * d - b * c, 2)
                / nullif((a + b) * (c + d) * (a + c) * (b + d), 0) x from f where a + b + c + d > 0)
select destination, against, round(coalesce(x, 0), 6) statistic, cast(case when x is null then 0 else 1 end as bigint) df,
       round({O.chisq1_tail("x")}, 6) p_value from s""")
def report_transition_chisq(spark, sf_dir):
    """ST2: the six pairwise 2x2 tests of day-2 phenotypes, from the pairs' counts."""
    return round_doubles(R.transition_chisq(_day12_df(spark, sf_dir)))


@register("report_gam")
def report_gam(spark, sf_dir):
    """ST6/ST8: the four smooth models' terms (checked in tests against an independent solve)."""
    return round_doubles(R.smooth_summaries(Study(spark, sf_dir).smooth_fits()))


@register("report_gam_curves")
def report_gam_curves(spark, sf_dir):
    """ST7: the four fitted curves with bands, other terms at their medians."""
    return round_doubles(R.smooth_curves(Study(spark, sf_dir).smooth_fits()))


@register("report_gam_points")
def report_gam_points(spark, sf_dir):
    """ST7: points (partial residuals) and rug of the four curves, a row for each complete case and model."""
    return round_doubles(R.smooth_points(_report_df(spark, sf_dir), Study(spark, sf_dir).smooth_fits()))


# driver-table queries register themselves on import
from carelog.plans import generic  # noqa: E402,F401
