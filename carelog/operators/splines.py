"""Penalised spline regression (one smooth term plus linear terms).

``y ~ s(x) + z1 + z2 ...`` with cubic B-splines on equally spaced knots and a
penalty on second differences of their coefficients (P-splines).  The penalty
leaves straight lines alone, so a large penalty shrinks the smooth to a line.

Each step is one distributed aggregate: the weighted moments X'WX and X'Wz
(about p squared over 2 sums, p below 20) and the deviance.  Only those sums
reach the driver, where the p x p system is solved.  The penalty is chosen from
the moments alone, with no further pass: in the basis in which X'WX and the penalty
are diagonal, residual sum and degrees of freedom are short sums in the log penalty,
with their derivatives, and Newton steps find the least score (generalised
cross-validation, or for the binomial the expected prediction error of the working
model with scale 1).  Gaussian: one pass in all.  Binomial (logit): penalised
iteratively reweighted least squares, the penalty chosen anew from each step's
moments until it settles (for at most eight steps), then steps to convergence with step halving on the
penalised deviance.  A fit that does not converge raises an error.

Reports hold, besides coefficients, the share of deviance explained, adjusted R
squared, scale, and a test of the smooth whose reference distribution is a weighted
sum of chi-squares (the rank of the test is the smooth's effective degrees of freedom
and need not be whole).  ``points`` scores rows: partial residuals and the side of the
rug, as column expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelog.operators.stats import chisq_sf, t_two_sided

#: Range of the log penalty, relative to the mean diagonal of X'WX.
LOG_RANGE = (-14.0, 16.0)


class NotConverged(RuntimeError):
    """The estimates did not settle, as with separated data."""


def _bspline(s):
    """Cubic B-spline of width 4 at ``s``, as a column or a numpy array."""
    pieces = [s * s * s / 6, (-3 * s * s * s + 12 * s * s - 12 * s + 4) / 6,
              (3 * s * s * s - 24 * s * s + 60 * s - 44) / 6, (4 - s) * (4 - s) * (4 - s) / 6]
    if isinstance(s, Column):
        return (F.when((s < 0) | (s >= 4), 0.0).when(s < 1, pieces[0]).when(s < 2, pieces[1])
                .when(s < 3, pieces[2]).otherwise(pieces[3]))
    return np.select([(s < 0) | (s >= 4), s < 1, s < 2, s < 3], [0.0, *pieces[:3]], pieces[3])


def basis_columns(x, lo: float, width: float, intervals: int) -> list:
    """The ``intervals + 3`` basis functions at ``x``."""
    u = (x - lo) / width
    return [_bspline(u - (j - 3)) for j in range(intervals + 3)]


def _moments(d: DataFrame, p: int, family: str, beta: np.ndarray):
    """X'WX, X'Wz, z'Wz and the deviance at ``beta``, from one pass."""
    x = [F.col(f"_f{i}") for i in range(p)]
    y = F.col("_y")
    if family == "gaussian":
        rows = d.select(*x, F.lit(1.0).alias("_w"), y.alias("_z"), F.lit(0.0).alias("_d"))
    else:
        eta = F.lit(0.0)
        for f, b in zip(x, beta):
            eta = eta + f * F.lit(float(b))
        rows = d.select("*", F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta)).alias("_eta"))
        rows = rows.select("*", (1 / (1 + F.exp(-F.col("_eta")))).alias("_mu"))
        mu = F.col("_mu")
        w = mu * (1 - mu)
        dev = -2 * F.when(y == 1, F.log(mu)).otherwise(F.log1p(-mu))
        rows = rows.select(*x, w.alias("_w"), (F.col("_eta") + (y - mu) / w).alias("_z"), dev.alias("_d"))
    w, z = F.col("_w"), F.col("_z")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = rows.agg(*[F.sum(w * x[i] * x[j]) for i, j in pairs], *[F.sum(w * f * z) for f in x],
                 F.sum(w * z * z), F.sum("_d")).first()
    xtx = np.zeros((p, p))
    for k, (i, j) in enumerate(pairs):
        xtx[i, j] = xtx[j, i] = r[k]
    return xtx, np.array(r[len(pairs):len(pairs) + p], float), float(r[-2]), float(r[-1])


def _binomial_moments(d: DataFrame, p: int, beta: np.ndarray):
    """What ``_moments`` gives for the binomial, as matrix products over Arrow batches (no new code for new coefficients)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(p * p + p + 2)
        for b in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            y, x = rows[:, 0], rows[:, 1:]
            eta = np.clip(x @ beta, -35, 35)
            mu = 1 / (1 + np.exp(-eta))
            w = mu * (1 - mu)
            z = eta + (y - mu) / w
            dev = 2 * (np.logaddexp(0, eta) - y * eta).sum()
            total += np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ (w * z), [(w * z * z).sum(), dev]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = d.select("_y", *[f"_f{i}" for i in range(p)]).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    got = {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    v = np.array([got[k] for k in range(p * p + p + 2)])
    return v[:p * p].reshape(p, p), v[p * p:-2], float(v[-2]), float(v[-1])


def _second_differences(m: int, p: int) -> np.ndarray:
    d = np.diff(np.eye(m), 2, axis=0)
    out = np.zeros((p, p))
    out[:m, :m] = d.T @ d
    return out


def _solve(xtx, xtz, penalty):
    inverse = np.linalg.pinv(xtx + penalty, hermitian=True)
    return inverse @ xtz, inverse


class Penalty:
    """Score of a weighted least-squares fit as a function of the log penalty, from its moments."""

    def __init__(self, xtx, xtz, zwz: float, n: int, roughness, family: str, scale: float | None = None):
        self.scale = scale or np.trace(xtx) / len(xtz)
        self.n, self.zwz, self.family = n, zwz, family
        both = xtx + self.scale * roughness
        size, axes = np.linalg.eigh(both)
        keep = size > 1e-13 * size[-1]
        root = axes[:, keep] / np.sqrt(size[keep])  # both becomes the identity
        a, turn = np.linalg.eigh(root.T @ xtx @ root)
        self.a, self.to = np.clip(a, 0, 1), root @ turn
        self.c = self.to.T @ xtz

    def kept(self, rho: float) -> np.ndarray:
        """What the penalty leaves of each direction, 0 to 1."""
        d = self.a + math.exp(rho) * (1 - self.a)
        return np.where(self.a > 1e-14, self.a / np.where(d > 0, d, 1), 0.0)

    def score(self, rho: float) -> tuple[float, float, float]:
        """Score with first and second derivative."""
        k = self.kept(rho)
        c2 = np.where(self.a > 1e-14, self.c ** 2 / np.where(self.a > 1e-14, self.a, 1), 0.0)
        rss = self.zwz - (c2 * (2 * k - k * k)).sum()
        rss1, rss2 = 2 * (c2 * k * (1 - k) ** 2).sum(), -2 * (c2 * k * (1 - k) ** 2 * (1 - 3 * k)).sum()
        edf, edf1, edf2 = k.sum(), -(k * (1 - k)).sum(), (k * (1 - k) * (1 - 2 * k)).sum()
        n = self.n
        if self.family != "gaussian":
            return rss / n + 2 * edf / n - 1, (rss1 + 2 * edf1) / n, (rss2 + 2 * edf2) / n
        free = n - edf
        if free <= 1e-9:
            return math.inf, 0.0, 0.0
        v = n * max(rss, 0.0) / free ** 2
        v1 = n * (rss1 / free ** 2 + 2 * rss * edf1 / free ** 3)
        v2 = n * (rss2 / free ** 2 + 4 * rss1 * edf1 / free ** 3 + 2 * rss * edf2 / free ** 3 + 6 * rss * edf1 ** 2 / free ** 4)
        return v, v1, v2

    def best(self) -> float:
        """The log penalty of the least score: Newton steps from the best of a coarse grid, kept in its bracket."""
        grid = np.linspace(*LOG_RANGE, 31)
        k = int(np.argmin([self.score(r)[0] for r in grid]))
        low, high, rho = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], grid[k]
        for _ in range(60):
            _, first, second = self.score(rho)
            low, high = (low, rho) if first > 0 else (rho, high)
            step = -first / second if second > 0 else math.inf
            new = rho + step if low < rho + step < high else (low + high) / 2
            if abs(new - rho) < 1e-10:
                break
            rho = new
        return min([rho, grid[k]], key=lambda r: self.score(r)[0])


def gam_fit(df: DataFrame, y: str, smooth: str, linear: list[str] | None = None, family: str = "gaussian",
            intervals: int = 10, penalty: float | None = None, max_iter: int = 60, tol: float = 1e-9) -> dict:
    """Fit on the complete cases; raises ``NotConverged`` instead of returning a
    fit whose penalised deviance still moves after ``max_iter`` steps.

    ``penalty`` fixes the penalty (relative to the mean diagonal of X'WX); by default it
    is chosen.  Returns coefficients, covariance, penalty, effective degrees of freedom,
    deviance, null deviance, scale, score, n, steps and what ``curve`` and ``points`` need.
    """
    if family not in ("gaussian", "binomial"):
        raise ValueError(family)
    linear = list(linear or [])
    d = df.select(F.col(y).cast("double").alias("_y"), F.col(smooth).cast("double").alias("_x"),
                  *[F.col(c).cast("double").alias(c) for c in linear]).dropna()
    st = d.agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.avg("_y").alias("mean"),
               F.var_pop("_y").alias("var"),
               *[f(c).alias(f"{k}_{i}") for i, c in enumerate(linear) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))],
               *[F.percentile_approx(c, 0.5, 100_000).alias(f"median_{i}") for i, c in enumerate(linear)]).first()
    n = int(st["n"])
    if not n:
        raise ValueError("no complete case")
    if family == "binomial" and not 0 < st["mean"] < 1:
        raise ValueError("the outcome has one value only")
    lo = float(st["lo"])
    width = (float(st["hi"]) - lo) / intervals or 1.0
    m = intervals + 3
    p = m + len(linear)
    # linear terms enter standardised, so that the moments are of one scale
    mean = [float(st[f"mean_{i}"]) for i in range(len(linear))]
    sd = [float(st[f"sd_{i}"]) or 1.0 for i in range(len(linear))]
    design = d.select("_y", *[c.alias(f"_f{i}") for i, c in enumerate(basis_columns(F.col("_x"), lo, width, intervals))],
                      *[((F.col(c) - mean[i]) / sd[i]).alias(f"_f{m + i}") for i, c in enumerate(linear)])
    roughness = _second_differences(m, p)
    if family == "gaussian":
        null = float(st["var"]) * n
        best = _gaussian(design, p, n, roughness, penalty)
    else:
        rate = float(st["mean"])
        null = -2 * n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
        start = np.zeros(p)
        start[:m] = math.log(rate / (1 - rate))  # the basis adds up to 1
        design = design.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            best = _binomial(design, p, n, roughness, penalty, start, max_iter, tol)
        finally:
            design.unpersist()
    influence = best.pop("inverse") @ best.pop("xtx")
    back = np.eye(p)  # to the terms' own scales; the smooth takes up their means
    for i in range(len(linear)):
        back[:m, m + i], back[m + i, m + i] = -mean[i] / sd[i], 1 / sd[i]
    best |= {"beta": back @ best["beta"], "cov": back @ best["cov"] @ back.T}
    return best | {
        "names": [f"s({smooth}).{i + 1}" for i in range(m)] + linear, "edf": float(np.trace(influence)),
        "edf_smooth": float(np.trace(influence[:m, :m])) - 1, "null_deviance": null, "n": n, "family": family,
        "response": y, "smooth": smooth, "linear": linear, "basis": (lo, width, intervals),
        "medians": [float(st[f"median_{i}"]) for i in range(len(linear))]}


def _gaussian(design, p, n, roughness, penalty):
    xtx, xty, yty, _ = _moments(design, p, "gaussian", np.zeros(p))
    search = Penalty(xtx, xty, yty, n, roughness, "gaussian")
    rho = search.best() if penalty is None else math.log(penalty)
    beta, inverse = _solve(xtx, xty, math.exp(rho) * search.scale * roughness)
    rss = max(float(yty - 2 * beta @ xty + beta @ xtx @ beta), 0.0)
    free = n - float(np.trace(inverse @ xtx))
    sigma = rss / free if free > 1e-9 else float("nan")
    return {"beta": beta, "inverse": inverse, "xtx": xtx, "cov": inverse @ xtx @ inverse * sigma, "lambda": math.exp(rho), "scale": sigma,
            "deviance": rss, "score": search.score(rho)[0], "steps": 1, "converged": True}


def _binomial(design, p, n, roughness, penalty, start, max_iter, tol):
    beta, here = start, _binomial_moments(design, p, start)
    settled, rho = penalty is not None, math.log(penalty) if penalty is not None else math.inf
    scale = np.trace(here[0]) / p  # that of the first step, so that the penalty means the same in all
    for step in range(1, max_iter + 1):
        search = Penalty(here[0], here[1], here[2], n, roughness, "binomial", scale)
        if not settled:
            new = search.best()
            settled = abs(new - rho) < 0.01 or step >= 8
            rho = new
        cost = math.exp(rho) * scale * roughness
        value = here[3] + beta @ cost @ beta
        goal, _ = _solve(here[0], here[1], cost)
        share = 1.0
        while True:
            tried = beta + share * (goal - beta)
            there = _binomial_moments(design, p, tried)
            new = there[3] + tried @ cost @ tried
            if new <= value + tol * (abs(value) + 0.1) or share < 1e-6:
                break
            share /= 2
        moved = value - new
        if moved > -tol * (abs(value) + 0.1):
            beta, here = tried, there
        if settled and abs(moved) <= tol * (abs(value) + 0.1):
            break
    else:
        raise NotConverged(f"penalised deviance still moves by {moved:.3g} after {max_iter} steps")
    search = Penalty(here[0], here[1], here[2], n, roughness, "binomial", scale)
    _, inverse = _solve(here[0], here[1], math.exp(rho) * scale * roughness)
    return {"beta": beta, "inverse": inverse, "xtx": here[0], "cov": inverse @ here[0] @ inverse, "lambda": math.exp(rho), "scale": 1.0,
            "deviance": here[3], "score": search.score(rho)[0], "steps": step, "converged": True}


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(80)


def weighted_chisq_sf(x: float, whole: int, w1: float, w2: float) -> float:
    """P(C + w1 A + w2 B > x): C chi-square with ``whole`` degrees of freedom (0: none), A and B with one each.

    A and B are the squares of a point in the plane: its angle mixes the weights to
    m, and half its squared radius is exponential.
    """
    if not x > 0:
        return 1.0
    angle = (np.arange(64) + 0.5) * math.pi / 128
    m = np.maximum(w1 * np.cos(angle) ** 2 + w2 * np.sin(angle) ** 2, 1e-300)
    alone = np.exp(-x / (2 * m))
    if not whole:
        return float(alone.mean())
    # beyond x / 2m the two are enough; before that C must exceed the rest
    upto = np.minimum(x / (2 * m), 60.0)
    s = (upto[:, None] / 2) * (_NODES + 1)
    rest = x - 2 * s * m[:, None]
    tail = np.array([chisq_sf(max(r, 0.0), whole) for r in rest.ravel()]).reshape(rest.shape)
    inner = (np.exp(-s) * tail * _WEIGHTS).sum(axis=1) * upto / 2
    return min(1.0, float((alone + inner).mean()))


def _over_scale(x: float, free: float, tail) -> float:
    """The tail of x when the scale is itself estimated with ``free`` degrees of freedom."""
    if not math.isfinite(free) or free > 5000:
        return tail(x)
    spread = math.sqrt(2 / free)
    low, high = max(1e-9, 1 - 9 * spread), 1 + 9 * spread + 20 / free
    v = (low + high) / 2 + (high - low) / 2 * _NODES[::2]
    density = np.exp((free / 2 - 1) * np.log(v) - free * v / 2 - ((free / 2 - 1) * np.log(v) - free * v / 2).max()) * _WEIGHTS[::2]
    return float((density * np.array([tail(x * s) for s in v])).sum() / density.sum())


def smooth_test(fit: dict) -> tuple[float, float, float]:
    """Wald statistic, rank and p-value of the smooth's departure from a constant.

    The rank r is the smooth's effective degrees of freedom.  With k = floor(r) and
    f = r - k, the k - 1 directions of largest variance count fully; the next two enter
    by a 2 x 2 matrix whose trace is 1 + f, so that the reference is a chi-square with
    k - 1 degrees of freedom plus two weighted ones.  A gaussian fit's scale is
    estimated, which the p-value allows for.
    """
    m = len(fit["beta"]) - len(fit["linear"])
    centre = np.eye(m) - np.ones((m, m)) / m
    b, v = centre @ fit["beta"][:m], centre @ np.asarray(fit["cov"])[:m, :m] @ centre
    size, axes = np.linalg.eigh(v)
    order = np.argsort(-size)
    size, axes = size[order], axes[:, order]
    known = int((size > 1e-12 * max(size.max(), 1e-300)).sum())
    rank = float(min(max(1.0, fit["edf_smooth"]), known))
    if not known:
        return float("nan"), rank, float("nan")
    k, f = int(rank), rank - int(rank)
    if f < 1e-8 or k + 1 > known:
        k, f = min(k + (f >= 0.5), known), 0.0
    z = (axes.T @ b)[:known] / np.sqrt(size[:known])
    if not f:
        stat = float((z[:k] ** 2).sum())
        tail = lambda x: chisq_sf(x, k)
    else:
        cross = math.sqrt(f * (1 - f) / 2)
        pair = z[k - 1:k + 1]
        stat = float((z[:k - 1] ** 2).sum() + pair @ np.array([[1, cross], [cross, f]]) @ pair)
        half = math.sqrt(1 - f * f)
        tail = lambda x: weighted_chisq_sf(x, k - 1, (1 + f + half) / 2, (1 + f - half) / 2)
    free = fit["n"] - fit["edf"] if fit["family"] == "gaussian" else math.inf
    return stat, rank, _over_scale(stat, free, tail)


def summary_frame(spark: SparkSession, fit: dict) -> DataFrame:
    """One row for the smooth (Wald statistic in ``z``) and one for each linear term.

    Columns of the whole model: share of the null deviance explained, adjusted R
    squared (of the response, by residual degrees of freedom; gaussian only) and scale.
    """
    stat, rank, p = smooth_test(fit)
    m = len(fit["beta"]) - len(fit["linear"])
    free, n, null = fit["n"] - fit["edf"], fit["n"], fit["null_deviance"]
    explained = 1 - fit["deviance"] / null if null > 0 else None
    adjusted = 1 - (fit["deviance"] / free) / (null / (n - 1)) if fit["family"] == "gaussian" and null > 0 and free > 1e-9 and n > 1 else None
    rest = (fit["lambda"], fit["edf"], fit["deviance"], null, explained, adjusted, float(fit["scale"]), float(fit["score"]), n, fit["converged"])
    rows = [(f"s({fit['smooth']})", None, None, stat, p, fit["edf_smooth"], rank, *rest)]
    for i, name in enumerate(fit["linear"], start=m):
        b, se = float(fit["beta"][i]), math.sqrt(max(float(fit["cov"][i][i]), 0.0))
        z = b / se if se > 0 else float("nan")
        tail = t_two_sided(z, free) if fit["family"] == "gaussian" else math.erfc(abs(z) / math.sqrt(2))
        rows.append((name, b, se, z, tail, 1.0, 1.0, *rest))
    return spark.createDataFrame(rows, "term string, estimate double, se double, z double, p_value double, term_edf double, test_rank double, "
                                       "lambda double, edf double, deviance double, null_deviance double, deviance_explained double, "
                                       "adjusted_r2 double, scale double, score double, n long, converged boolean")


def coefficient_frame(spark: SparkSession, fit: dict) -> DataFrame:
    """Every coefficient, those of the basis included, with its standard error."""
    se = np.sqrt(np.maximum(np.diag(fit["cov"]), 0))
    rows = [(name, float(b), float(s), fit["edf"], fit["deviance"]) for name, b, s in zip(fit["names"], fit["beta"], se)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, edf double, deviance double")


def points(df: DataFrame, fit: dict, keep: list[str] | None = None) -> DataFrame:
    """The points and the rug of the fitted curve: a row for each complete case, with the columns of ``keep``.

    ``curve`` is the smooth at the row's x, other terms at their medians, and ``partial``
    adds the row's residual (binomial: the working residual, on the logit scale, with
    the response residual beside it).  ``rug`` is the side on which its tick is drawn: above for a
    positive residual, below for a negative one.  All of it are column expressions.
    """
    lo, width, intervals = fit["basis"]
    m = intervals + 3
    beta = [float(b) for b in fit["beta"]]
    number = lambda c: F.col(c).cast("double")
    rows = df.where(F.col(fit["response"]).isNotNull() & F.col(fit["smooth"]).isNotNull()
                    & ~sum((F.col(c).isNull().cast("int") for c in fit["linear"]), F.lit(0)).cast("boolean"))
    rows = rows.select(*(keep or []), number(fit["smooth"]).alias("x"), number(fit["response"]).alias("y"),
                       *[number(c).alias(f"_z{i}") for i, c in enumerate(fit["linear"])])
    smooth = sum((b * f for b, f in zip(beta, basis_columns(F.col("x"), lo, width, intervals))), F.lit(0.0))
    medians = sum(b * v for b, v in zip(beta[m:], fit["medians"]))
    away = sum((F.lit(b) * (F.col(f"_z{i}") - v) for i, (b, v) in enumerate(zip(beta[m:], fit["medians"]))), F.lit(0.0))
    out = rows.select(*(keep or []), "x", "y", (smooth + medians).alias("curve"), away.alias("_away"))
    if fit["family"] == "gaussian":
        out = out.withColumn("residual", F.col("y") - F.col("curve") - F.col("_away")).withColumn("response_residual", F.col("residual"))
    else:
        eta = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("curve") + F.col("_away")))
        out = out.withColumn("_mu", 1 / (1 + F.exp(-eta))).withColumn("response_residual", F.col("y") - F.col("_mu"))
        out = out.withColumn("residual", F.col("response_residual") / (F.col("_mu") * (1 - F.col("_mu"))))
    side = F.when(F.col("residual") > 0, "above").otherwise("below")
    return out.select(*(keep or []), "x", "y", "curve", "residual", "response_residual", (F.col("curve") + F.col("residual")).alias("partial"), side.alias("rug"))


def curve(spark: SparkSession, fit: dict, points: int = 100, z: float = 1.959963984540054) -> DataFrame:
    """Fitted curve with a pointwise band on a grid of the smooth's range, the other
    terms at their medians; binomial fits also on the probability scale."""
    lo, width, intervals = fit["basis"]
    x = lo + np.arange(points) / (points - 1) * width * intervals
    rows = np.column_stack([*basis_columns(x, lo, width, intervals), *[np.full(points, v) for v in fit["medians"]]])
    value = rows @ fit["beta"]
    se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", rows, np.asarray(fit["cov"]), rows), 0))
    table = np.column_stack([x, value, se, value - z * se, value + z * se])
    out = spark.createDataFrame([tuple(map(float, r)) for r in table], "x double, fit double, se double, lower double, upper double")
    if fit["family"] == "binomial":
        out = out.withColumns({n: 1 / (1 + F.exp(-F.col(c))) for n, c in (("prob", "fit"), ("prob_lower", "lower"), ("prob_upper", "upper"))})
    return out
