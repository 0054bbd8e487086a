"""Statistics against closed forms and small published-style examples."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from carelog.operators import stats as S


def test_tail_probabilities():
    # chi-square df=2: p = exp(-x/2); df=1: p = erfc(sqrt(x/2))
    assert abs(S.chisq_sf(3.0, 2) - math.exp(-1.5)) < 1e-12
    assert abs(S.chisq_sf(2.5, 1) - math.erfc(math.sqrt(1.25))) < 1e-10
    # t with 1 df is Cauchy: two-sided p = 1 - 2 atan(|t|)/pi
    assert abs(S.t_two_sided(2.0, 1) - (1 - 2 * math.atan(2.0) / math.pi)) < 1e-10
    # t with 2 df: two-sided p = 1 - t / sqrt(2 + t^2)
    assert abs(S.t_two_sided(3.0, 2) - (1 - 3 / math.sqrt(11))) < 1e-12
    # any large df is close to the normal, without loss of digits
    for dof in (1e7, 1e14, 1e16):
        assert abs(S.t_two_sided(1.959963984540054, dof) - 0.05) < 1e-7
    assert S.t_two_sided(0.0, 5.5) > 1 - 1e-12 and S.t_two_sided(1e6, 30) < 1e-100
    # chi-square near its mean for a large df (Wilson-Hilferty), and df 3 in closed form
    assert abs(S.chisq_sf(2e6, 2e6) - 0.5) < 1e-3
    x = 4.2
    want = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    assert abs(S.chisq_sf(x, 3) - want) < 1e-13
    assert math.isnan(S.chisq_sf(1.0, 0))


def test_chisq_typed_2x2(spark):
    # the study's hand-typed table cbind(c(10,43), c(32,103))
    counts = spark.createDataFrame([("a", "x", 10), ("b", "x", 43), ("a", "y", 32), ("b", "y", 103)],
                                   "r string, c string, n long")
    out = S.chisq_from_counts(counts, "r", "c").first()
    t = np.array([[10, 32], [43, 103]], float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    want = ((t - e) ** 2 / e).sum()
    assert abs(out.statistic - want) < 1e-9 and out.df == 1
    assert abs(out.p_value - math.erfc(math.sqrt(want / 2))) < 1e-9


def test_chisq_counts_zero_cell(spark):
    counts = spark.createDataFrame([("a", "x", 5), ("b", "x", 3), ("b", "y", 4)], "r string, c string, n long")
    out = S.chisq_from_counts(counts, "r", "c").first()
    t = np.array([[5, 0], [3, 4]], float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert abs(out.statistic - ((t - e) ** 2 / e).sum()) < 1e-9


def test_welch(spark):
    random.seed(3)
    a = [random.gauss(10, 2) for _ in range(40)]
    b = [random.gauss(11, 3) for _ in range(25)]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    r = S.welch_t_test(df, "v", "g", "a", "b").first()
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    assert abs(r.t - t) < 1e-9 and abs(r.df - dof) < 1e-9
    # p from numerical integration of the t density
    xs = np.linspace(abs(t), 60, 200001)
    dens = math.gamma((dof + 1) / 2) / (math.sqrt(dof * math.pi) * math.gamma(dof / 2)) * (1 + xs ** 2 / dof) ** (-(dof + 1) / 2)
    p = 2 * np.trapezoid(dens, xs)
    assert abs(r.p_value - p) < 1e-5


def test_odds_ratio_equals_single_factor_glm(spark):
    random.seed(5)
    data = [(g, int(random.random() < pr)) for g, pr, n in (("L", .3, 300), ("I", .4, 200), ("H", .2, 250))
            for _ in range(n)]
    df = spark.createDataFrame(data, "g string, y int")
    orr = {r.g: r for r in S.odds_ratios(df, "y", "g", ["L", "I", "H"]).collect()}
    glm = {r.term: r for r in S.logistic_regression(df, "y", [], factor="g", levels=["L", "I", "H"]).collect()}
    for lv in ("I", "H"):
        assert abs(orr[lv].odds_ratio - glm[f"g_{lv}"].odds_ratio) < 1e-6
        assert abs(orr[lv].se_log_or - glm[f"g_{lv}"].se) < 1e-6


def test_exact_quantiles_match_numpy(spark):
    random.seed(7)
    data = [(s, round(random.gauss(0, 1), 3)) for s in ("a", "b") for _ in range(3000)] + [("c", 1.0), ("c", 4.0)]
    df = spark.createDataFrame(data, "s string, x double")
    got = {r.s: r for r in S.exact_quantiles(df, "s", "x").collect()}
    for s in ("a", "b", "c"):
        xs = np.array([x for ss, x in data if ss == s])
        for p, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert abs(got[s][c] - np.quantile(xs, p)) < 1e-12


def test_levels_are_complete_and_may_hold_quotes(spark):
    import pytest
    df = spark.createDataFrame([("it's", 1), ("it's", 0), ("b", 1), ("b", 0), ("c", 1)], "g string, y int")
    got = S.odds_ratios(df.filter("g <> 'c'"), "y", "g", ["b", "it's"]).first()
    assert got.g == "it's" and abs(got.odds_ratio - 1) < 1e-12
    with pytest.raises(Exception, match="none of the levels"):
        S.odds_ratios(df, "y", "g", ["b", "it's"]).collect()


def test_quantiles_with_ties_spread_over_ranges(spark):
    """Nine tenths of a stratum tied: counts per value keep every window small."""
    df = spark.range(40000).select(F.lit("a").alias("s"), F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id") / 7).alias("x"))
    got = S.exact_quantiles(df, "s", "x", probs=(0.01, 0.5, 0.99)).first()
    xs = np.array([5.0 if i % 10 else i / 7 for i in range(40000)])
    for p, c in ((0.01, "q1"), (0.5, "q50"), (0.99, "q99")):
        assert abs(got[c] - np.quantile(xs, p)) < 1e-9
    counts = df.groupBy("s", "x").count()
    assert counts.count() <= 4001  # what is sorted: one row for each value, not for each input row
    empty = S.exact_quantiles(df.limit(0), "s", "x", with_summary=True)
    assert empty.count() == 0


def test_six_number_na_not_scaled(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 8.0), ("a", None)], "s string, x double")
    r = S.six_number(df, "s", "x", scale=24).first()
    assert r.n_na == 1 and abs(r.q1 - 1.75 / 24) < 1e-12 and abs(r.median - 3 / 24) < 1e-12 and abs(r.q3 - 5 / 24) < 1e-12


def test_proportions_and_transitions(spark):
    df = spark.createDataFrame([("L", "L", "Alive", 1.0), ("L", "H", "Expired", 2.0), ("L", "H", "Alive", 3.0),
                                ("H", "H", "Alive", None)], "d1 string, d2 string, st string, v double")
    tm = {(r.d1, r.d2): r for r in S.transition_matrix(df, "d1", "d2", ["L", "I", "H"]).collect()}
    assert len(tm) == 9 and tm[("L", "H")].n == 2 and tm[("L", "H")].prop == 0.667 and tm[("I", "L")].prop is None
    to = {(r.d1, r.d2): r for r in S.transition_outcomes(df, "d1", "d2", "st", "Expired", "v", ["L", "I", "H"]).collect()}
    assert to[("L", "H")].rate == 0.5 and to[("L", "H")].mean_value == 2.5 and to[("I", "I")].n == 0
    pr = {(r.d1, r.st): r.prop for r in S.proportions(df, "d1", "st").collect()}
    assert pr[("L", "Alive")] == 0.667


def test_flag_prevalence(spark):
    df = spark.createDataFrame([("a", True, False), ("a", False, None), ("a", True, True)], "s string, f boolean, g boolean")
    got = {(r.flag, r.value): r.prop for r in S.flag_prevalence(df, "s", ["f", "g"]).collect()}
    assert got[("f", True)] == 0.667 and got[("g", True)] == 0.5


def _bspline_matrix(x, lo, width, intervals):
    """Cubic B-splines by the recursion over degrees (independent of the library's closed form)."""
    knots = lo + width * np.arange(-3, intervals + 4)
    b = [((x >= knots[i]) & (x < knots[i + 1])).astype(float) for i in range(len(knots) - 1)]
    for d in (1, 2, 3):
        b = [(x - knots[i]) / (d * width) * b[i] + (knots[i + d + 1] - x) / (d * width) * b[i + 1] for i in range(len(b) - 1)]
    return np.column_stack(b[:intervals + 3])


def test_spline_equals_an_independent_solve(spark):
    from carelog.operators.splines import curve, gam_fit, points, summary_frame
    rng = np.random.default_rng(11)
    x, z = rng.random(800), rng.integers(0, 2, 800).astype(float)
    y = np.sin(2 * np.pi * x) + 0.3 * z + rng.normal(0, 0.2, 800)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z)], "x double, y double, z double")
    fit = gam_fit(df, "y", "x", ["z"])
    lo, width, k = fit["basis"]
    design = np.column_stack([_bspline_matrix(np.minimum(x, lo + width * k - 1e-12), lo, width, k), (z - z.mean()) / z.std()])
    m = k + 3
    d2 = np.diff(np.eye(m), 2, axis=0)
    pen = np.zeros((m + 1, m + 1))
    pen[:m, :m] = d2.T @ d2
    gram = design.T @ design

    def solve(lam):
        a = np.linalg.inv(gram + lam * np.trace(gram) / (m + 1) * pen)
        b = a @ design.T @ y
        edf = np.trace(a @ gram)
        return 800 * ((y - design @ b) ** 2).sum() / (800 - edf) ** 2, edf, b
    score, edf, beta = solve(fit["lambda"])
    assert abs(fit["score"] - score) < 1e-9 and abs(fit["edf"] - edf) < 1e-6
    assert fit["score"] <= min(solve(lam)[0] for lam in np.geomspace(1e-6, 1e6, 200)) + 1e-12
    assert abs(fit["beta"][-1] - beta[-1] / z.std()) < 1e-8 and abs(fit["beta"][-1] - 0.3) < 0.05
    assert fit["deviance"] < fit["null_deviance"] and 3 < fit["edf_smooth"] < 12
    row = summary_frame(spark, fit).first()
    rss = ((y - design @ beta) ** 2).sum()
    assert abs(row.deviance_explained - (1 - rss / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert abs(row.adjusted_r2 - (1 - rss / (800 - edf) / y.var(ddof=1))) < 1e-9 and abs(row.scale - rss / (800 - edf)) < 1e-9
    got = {round(r.x, 12): r for r in points(df, fit).collect()}
    fitted = design @ beta
    for k in range(0, 800, 37):
        r = got[round(x[k], 12)]
        assert abs(r.residual - (y[k] - fitted[k])) < 1e-8 and r.rug == ("above" if y[k] > fitted[k] else "below")
        assert abs(r.curve - (fitted[k] - 0.0) - fit["beta"][-1] * (np.median(z) - z[k])) < 1e-8 and abs(r.partial - r.curve - r.residual) < 1e-12
    err = max(abs(r.fit - (math.sin(2 * math.pi * r.x) + 0.3 * np.median(z))) for r in curve(spark, fit, points=21).collect()[2:-2])
    assert err < 0.15


def test_smooth_of_a_line_is_a_line(spark):
    from carelog.operators.splines import gam_fit
    rng = np.random.default_rng(3)
    x = rng.random(600)
    df = spark.createDataFrame([(float(a), float(2 * a + e)) for a, e in zip(x, rng.normal(0, 0.3, 600))], "x double, y double")
    assert gam_fit(df, "y", "x")["edf_smooth"] < 1.5


def test_binomial_spline_against_newton_steps(spark):
    from carelog.operators.splines import gam_fit, smooth_test, summary_frame
    rng = np.random.default_rng(12)
    x, z = rng.uniform(-2, 2, 900), rng.normal(50, 10, 900)
    y = (rng.random(900) < 1 / (1 + np.exp(-(0.5 + 1.5 * x + 0.05 * (z - 50))))).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z)], "x double, y double, z double")
    fit = gam_fit(df, "y", "x", ["z"], family="binomial")
    assert fit["converged"] and fit["deviance"] <= fit["null_deviance"] and fit["edf_smooth"] < 4
    lo, width, k = fit["basis"]
    design = np.column_stack([_bspline_matrix(np.minimum(x, lo + width * k - 1e-12), lo, width, k), (z - z.mean()) / z.std()])
    m = k + 3
    d2 = np.diff(np.eye(m), 2, axis=0)
    pen = np.zeros((m + 1, m + 1))
    pen[:m, :m] = d2.T @ d2
    mu = np.full(900, y.mean())
    scale = np.trace((design * (mu * (1 - mu))[:, None]).T @ design) / (m + 1)
    b = np.zeros(m + 1)
    for _ in range(60):
        mu = 1 / (1 + np.exp(-design @ b))
        b = b + np.linalg.solve((design * (mu * (1 - mu))[:, None]).T @ design + fit["lambda"] * scale * pen,
                                design.T @ (y - mu) - fit["lambda"] * scale * pen @ b)
    mu = 1 / (1 + np.exp(-design @ b))
    assert abs(fit["deviance"] - -2 * (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum()) < 1e-5
    assert abs(fit["beta"][-1] - b[-1] / z.std()) < 1e-5
    assert smooth_test(fit)[2] < 1e-10
    rows = {r.term: r for r in summary_frame(spark, fit).collect()}
    assert rows["z"].p_value < 1e-3 and rows["s(x)"].estimate is None


def test_points_of_a_binomial_fit(spark):
    """Working residuals on the logit scale; rows with a null in any term have no point."""
    from carelog.operators.splines import gam_fit, points
    rng = np.random.default_rng(21)
    x = rng.uniform(0, 10, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(x - 5) / 2))).astype(float)
    rows = [(k, float(a), float(b), float(k % 7)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(900, None, 1.0, 1.0), (901, 2.0, None, 1.0), (902, 2.0, 1.0, None)], "id int, x double, y double, z double")
    fit = gam_fit(df, "y", "x", ["z"], family="binomial")
    got = {r.id: r for r in points(df, fit, ["id"]).collect()}
    assert sorted(got) == list(range(500))
    lo, width, k = fit["basis"]
    basis = _bspline_matrix(np.minimum(x, lo + width * k - 1e-12), lo, width, k)
    eta = basis @ fit["beta"][:-1] + fit["beta"][-1] * (np.arange(500) % 7)
    mu = 1 / (1 + np.exp(-eta))
    for j in range(0, 500, 29):
        r = got[j]
        assert abs(r.response_residual - (y[j] - mu[j])) < 1e-7 and abs(r.residual - (y[j] - mu[j]) / (mu[j] * (1 - mu[j]))) < 1e-5
        assert (r.rug == "above") == (y[j] == 1)


def test_penalty_search_of_the_working_model(spark):
    """The score of the last working model is no worse than on a grid of 200, and its derivatives are those of the score."""
    from carelog.operators.splines import LOG_RANGE, Penalty
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 9))
    x[:, 8] = x[:, 7]  # two columns alike
    z = x @ rng.normal(0, 1, 9) + rng.normal(0, 2, 300)
    d2 = np.diff(np.eye(9), 2, axis=0)
    for family in ("gaussian", "binomial"):
        s = Penalty(x.T @ x, x.T @ z, z @ z, 300, d2.T @ d2, family)
        assert s.score(s.best())[0] <= min(s.score(r)[0] for r in np.linspace(*LOG_RANGE, 200)) + 1e-12
        for rho in (-3.0, 0.5, 4.0):
            up, down, (v, first, second) = s.score(rho + 1e-4)[0], s.score(rho - 1e-4)[0], s.score(rho)
            assert abs((up - down) / 2e-4 - first) < 1e-6 * max(1, abs(v)) and abs((up - 2 * v + down) / 1e-8 - second) < 1e-3 * max(1, abs(v))


def test_weighted_chi_square_tail_against_simulation():
    from carelog.operators.splines import weighted_chisq_sf
    rng = np.random.default_rng(1)
    n = 400_000
    for whole, f in ((0, 0.5), (2, 0.25), (5, 0.8)):
        half = math.sqrt(1 - f * f)
        w = (1 + f + half) / 2, (1 + f - half) / 2
        q = rng.chisquare(1, n) * w[0] + rng.chisquare(1, n) * w[1] + (rng.chisquare(whole, n) if whole else 0)
        for x in (0.5, 2.0, 6.0, 12.0):
            assert abs(weighted_chisq_sf(x, whole, *w) - (q > x).mean()) < 4 * math.sqrt(0.25 / n)
    assert abs(weighted_chisq_sf(3.0, 3, 1.0, 1.0) - S.chisq_sf(3.0, 5)) < 1e-9
    assert abs(weighted_chisq_sf(3.0, 3, 1.0, 1e-12) - S.chisq_sf(3.0, 4)) < 1e-3


def test_levels_outside_the_list_raise(spark):
    import pytest
    df = spark.createDataFrame([("a", "L"), ("b", "Q")], "r string, c string").withColumns({"st": F.lit("x"), "v": F.lit(1.0)})
    for made in (S.crosstab(df, "r", "c", ["L"]), S.transition_matrix(df, "r", "c", ["a", "b", "L"]), S.transition_outcomes(df, "r", "c", "st", "x", "v", ["a", "b", "L"])):
        with pytest.raises(Exception, match="none of the levels"):
            made.collect()


def test_fits_that_run_off_say_so(spark):
    from carelog.operators.splines import NotConverged, gam_fit
    import pytest
    data = [(float(i), float(i >= 50)) for i in range(100)]
    df = spark.createDataFrame(data, "x double, y double")
    with pytest.raises(NotConverged):
        gam_fit(df, "y", "x", family="binomial", max_iter=12, penalty=0.01)
    with pytest.raises(ValueError):
        gam_fit(df.filter("y = 1"), "y", "x", family="binomial")
    row = S.logistic_regression(df.withColumn("g", F.when(F.col("y") == 1, "a").otherwise("b")), "y", [], factor="g",
                                levels=["b", "a"]).first()
    assert row.separated


def test_pairwise_transition_chisq(spark):
    from carelog.plans import report as R
    low, mid, high = R.PHENO
    cells = {(low, low): 12, (low, mid): 5, (low, high): 3, (mid, low): 4, (mid, mid): 9, (mid, high): 6, (high, low): 2, (high, high): 20}
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)] + [(None, low), (low, None)]
    df = spark.createDataFrame(rows, "day1_compliance string, day2_compliance string")
    got = {(r.destination, r.against): r for r in R.transition_chisq(df).collect()}
    assert len(got) == 6
    for (goal, other), r in got.items():
        n = lambda o, there: sum(c for (a, b), c in cells.items() if a == o and (b == goal) == there)
        t = np.array([[n(goal, True), n(goal, False)], [n(other, True), n(other, False)]], float)
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
        want = ((t - e) ** 2 / e).sum()
        assert abs(r.statistic - want) < 1e-9 and r.df == 1 and abs(r.p_value - math.erfc(math.sqrt(want / 2))) < 1e-9


def test_chisq_transpose_invariant(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz"), st.integers(1, 50)),
                    min_size=2, max_size=9, unique_by=lambda t: (t[0], t[1])))
    def check(cells):
        a = spark.createDataFrame(cells, "r string, c string, n long")
        b = spark.createDataFrame([(c, r, n) for r, c, n in cells], "r string, c string, n long")
        x = S.chisq_from_counts(a, "r", "c").first()
        y = S.chisq_from_counts(b, "r", "c").first()
        assert abs(x.statistic - y.statistic) < 1e-9 and x.df == y.df

    check()
