"""Logistic models and profile intervals against independent refits."""

import math

import numpy as np
import pytest

from carelog.operators.glm import Model, logistic_models

Q = 3.8414588206941236


def refit(x, y, offset):
    """Least deviance over the coefficients of ``x`` beside an offset."""
    def deviance(b):
        eta = x @ b + offset
        return 2 * (np.logaddexp(0, eta) - y * eta).sum()
    b = np.linalg.lstsq(x, -np.broadcast_to(offset, len(y)), rcond=None)[0] if x.shape[1] else np.zeros(0)
    for _ in range(100):
        if not len(b):
            break
        mu = 1 / (1 + np.exp(-np.clip(x @ b + offset, -30, 30)))
        step = np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
        share = 1.0
        while deviance(b + share * step) > deviance(b) + 1e-9 and share > 1e-6:
            share /= 2
        b = b + share * step
        if np.abs(step).max() < 1e-12:
            break
    return deviance(b), b


def bisected(x, y, j, hat, least, side):
    others = np.delete(x, j, axis=1)
    near, far = hat, hat + side * 1e-3
    while refit(others, y, x[:, j] * far)[0] - least < Q:
        far = hat + 2 * (far - hat)
    for _ in range(70):
        mid = (near + far) / 2
        near, far = (mid, far) if refit(others, y, x[:, j] * mid)[0] - least < Q else (near, mid)
    return math.exp((near + far) / 2)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 400
    g = rng.choice(["L", "I", "H"], n)
    x, a = rng.normal(200, 80, n), rng.normal(60, 15, n)
    eta = -1 + 0.7 * (g == "I") - 0.3 * (g == "H") + 0.004 * (x - 200) - 0.02 * (a - 60)
    return g, x, a, (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)


def frame(spark, data):
    g, x, a, y = data
    rows = [(str(g[k]), float(x[k]), float(a[k]), int(y[k]), int(y[k] * (g[k] != "H"))) for k in range(len(y))]
    rows += [(None, 1.0, 1.0, 1, 1), ("L", None, 3.0, None, 0), ("I", float("nan"), 1.0, None, None)]
    return spark.createDataFrame(rows, "g string, x double, a double, y int, z int").repartition(5)


def test_models_and_profiles_equal_refits(spark, data):
    g, x, a, y = data
    models = [Model("one", "y", (), "g", ("L", "I", "H")), Model("all", "y", ("x", "a"), "g", ("L", "I", "H")), Model("plain", "y", ("a",))]
    got = {(r["model"], r["term"]): r for r in logistic_models(frame(spark, data), models).collect()}
    one = np.ones(len(y))
    designs = {"one": [one, g == "I", g == "H"], "all": [one, g == "I", g == "H", x, a], "plain": [one, a]}
    for m in models:
        d, y = np.column_stack(designs[m.name]).astype(float), data[3]
        if m.name == "plain":  # the row without a level is complete for this model
            d, y = np.vstack([d, [1.0, 1.0]]), np.append(y, 1.0)
        least, b = refit(d, y, 0.0)
        mu = 1 / (1 + np.exp(-d @ b))
        cov = np.linalg.inv((d * (mu * (1 - mu))[:, None]).T @ d)
        for j, term in enumerate(m.terms):
            r = got[m.name, term]
            assert abs(r["estimate"] - b[j]) < 1e-7 and abs(r["se"] - math.sqrt(cov[j, j])) < 1e-7
            assert abs(r["deviance"] - least) < 1e-6 and r["n"] == len(y) and r["converged"] and not r["separated"]
            for side, end in ((-1, "profile_low"), (1, "profile_high")):
                want = bisected(d, y, j, b[j], least, side)
                assert abs(r[end] / want - 1) < 1e-6, (m.name, term, end)
            assert abs(r["p_value"] - math.erfc(abs(b[j]) / math.sqrt(2 * cov[j, j]))) < 1e-7


def test_separation_gives_infinite_ends(spark, data):
    g, x, a, y = data
    got = {r["term"]: r for r in logistic_models(frame(spark, data), [Model("m", "z", (), "g", ("L", "I", "H", "none"))]).collect()}
    h = got["g_H"]
    assert h["separated"] and h["estimate"] is None and h["profile_low"] == 0.0
    # the finite end in closed form: the level has n rows without an event beside the reference level
    n, (e0, n0) = (g == "H").sum(), (sum(y[g == "L"]), sum(1 - y[g == "L"]) + 1)  # and the row that lacks only x
    base = -2 * (e0 * math.log(e0 / (e0 + n0)) + n0 * math.log(n0 / (e0 + n0)))

    def excess(v):
        def dev(u):
            p0, p1 = u / (1 + u), math.exp(v) * u / (1 + math.exp(v) * u)
            return -2 * (e0 * math.log(p0) + n0 * math.log(1 - p0) + n * math.log(1 - p1))
        us = np.exp(np.linspace(-8, 4, 200_001))
        return min(map(dev, us[[int(np.argmin([dev(u) for u in us[::500]])) * 500 + d for d in range(-499, 500)]])) - base
    v = math.log(h["profile_high"])
    assert abs(excess(v) - Q) < 1e-3
    assert not got["g_I"]["separated"] and abs(got["g_I"]["profile_low"]) > 0
    assert not got["g_none"]["determined"] and got["g_none"]["estimate"] is None and got["g_none"]["profile_low"] is None


def test_a_level_left_out_raises(spark, data):
    with pytest.raises(Exception, match="none of the levels"):
        logistic_models(frame(spark, data), [Model("m", "y", (), "g", ("L", "I"))])


def test_no_rows_and_one_outcome(spark, data):
    df = frame(spark, data)
    none = logistic_models(df.limit(0), [Model("m", "y", ("x",), "g", ("L", "I", "H"))]).collect()
    assert len(none) == 4 and all(r["estimate"] is None and r["n"] == 0 and not r["converged"] for r in none)
    ones = logistic_models(df.where("y = 1"), [Model("m", "y", ())]).first()
    assert ones["separated"] and ones["estimate"] is None and ones["profile_high"] == math.inf


def test_shared_passes(spark, data, monkeypatch):
    """Four models cost no more passes than the slowest of them."""
    from carelog.operators import glm
    real, count = glm._pass, []
    monkeypatch.setattr(glm, "_pass", lambda *a: (count.append(1), real(*a))[1])
    df = frame(spark, data)
    models = [Model(str(k), "y", t, "g", ("L", "I", "H")) for k, t in enumerate([(), ("x",), ("a",), ("x", "a")])]
    single = []
    for m in models:
        count.clear()
        logistic_models(df, [m])
        single.append(len(count))
    count.clear()
    logistic_models(df, models)
    assert len(count) == max(single) and len(count) < 60
