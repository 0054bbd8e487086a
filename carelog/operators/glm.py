"""Logistic regression models fitted together, with profile-likelihood intervals.

Several models (outcome, numeric terms, one factor) over one table are fitted by
Newton steps that share their passes: a pass over the persisted rows gives every
open fit its gradient, information matrix and deviance at its own coefficients, and
only those sums (some tens of numbers a fit) reach the driver, which solves systems
of the size of the model.  Inside a task the sums are matrix products over Arrow
batches, so a batch serves all fits at once.

The profile interval of a term are the values at which the deviance, minimised over
all other terms, exceeds the model's deviance by the chi-square quantile.  Each end
is a search of its own: at a value of the term the constrained minimum is found by
Newton steps along the constraint, then a bracketed root search on the signed root of
the deviance excess proposes the next value.  All terms and both ends of all models
step together through the same passes.

Numeric terms are centred and scaled for the fit and reported on their own scale.

Defined results: rows with a null (or NaN) in any column of a model are left out of
that model; a factor value outside the levels raises; a level without rows, a
constant column and anything else that the data do not determine has a null
estimate (``determined`` is false).  Where the likelihood keeps rising as the
coefficients run off (an outcome determined by the terms), the terms that move are
``separated``: their estimates are null, and the end of the profile interval on that
side is infinite.  An end is also infinite where the excess stays below the
quantile however far the term goes.  A model without complete cases has null results.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

INTERCEPT = "(Intercept)"
#: The normal quantile of 95 % intervals; its square is the chi-square quantile.
Z95 = 1.959963984540054
#: Log-odds beyond which a probability counts as 0 or 1.
CLIP = 35.0
#: A Newton step that still moves a term's log-odds by so much when the deviance has settled marks separation.
RUNS_OFF = 0.05


@dataclass(frozen=True)
class Model:
    """Outcome (0/1) on numeric terms and the levels of a factor against the first one."""

    name: str
    outcome: str
    numeric: tuple[str, ...] = ()
    factor: str | None = None
    levels: tuple = ()

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *[f"{self.factor}_{v}" for v in self.levels[1:]], *self.numeric]


@dataclass
class Point:
    """Coefficients and what a pass found there."""

    beta: np.ndarray
    deviance: float = math.nan
    gradient: np.ndarray | None = None
    information: np.ndarray | None = None


@dataclass
class Fit:
    """A Newton descent of one model's deviance, free or under ``a . beta = value``."""

    model: int
    here: Point
    a: np.ndarray | None = None
    value: float = 0.0
    tried: Point | None = None
    step: np.ndarray | None = None
    share: float = 1.0
    steps: int = 0
    done: bool = False
    converged: bool = False
    moves: np.ndarray | None = None  # the step that was left when the deviance had settled
    info: dict = field(default_factory=dict)

    def propose(self) -> Point:
        """Where the next pass evaluates."""
        self.tried = self.here if self.here.gradient is None else Point(self.here.beta + self.share * self.step)
        return self.tried

    def take(self, tol: float, most: int) -> None:
        """Use what the pass found at ``tried``."""
        new = self.tried
        slack = tol * (abs(new.deviance) + 0.1)
        if new is not self.here and not new.deviance <= self.here.deviance + slack:
            self.share /= 2  # the full step overshot
            if self.share < 1e-8:
                self.settle(False)
            return
        self.here, self.share = new, 1.0
        self.step = newton(new, self.a, self.value)
        self.steps += 1
        left = float(new.gradient @ self.step)  # what the step takes off the deviance
        runs_off = np.abs(self.step).max() > RUNS_OFF
        # a free fit goes on until its information has settled too, unless a coefficient runs off
        if abs(left) <= (slack if self.a is not None or runs_off else 1e-7 * slack):
            self.here = Point(new.beta + self.step, new.deviance - left, new.gradient, new.information)
            self.settle(True)
        elif self.steps >= most:
            self.settle(False)

    def settle(self, converged: bool) -> None:
        self.done, self.moves, self.converged = True, self.step, converged


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverse on the directions that the data determine."""
    size, axes = np.linalg.eigh((m + m.T) / 2)
    keep = size > 1e-13 * max(size[-1], 1e-300)
    return (axes[:, keep] / size[keep]) @ axes[:, keep].T


def newton(at: Point, a: np.ndarray | None, value: float) -> np.ndarray:
    """The Newton step, under ``a . (beta + step) = value`` if there is a constraint."""
    v = _inverse(at.information)
    step = v @ at.gradient
    if a is None:
        return step
    va = v @ a
    reach = float(a @ va)
    if reach <= 1e-300:
        return step
    step = step + va * ((value - a @ at.beta - a @ step) / reach)
    return step + a * ((value - a @ (at.beta + step)) / (a @ a))  # exactly on the constraint


def _design(df: DataFrame, models: list[Model]) -> tuple[DataFrame, list[str]]:
    """Outcomes, numeric columns and one column of level numbers for each factor, as doubles; null is NaN."""
    columns: dict[str, object] = {}
    bad = F.lit(False)
    for m in models:
        for c in (m.outcome, *m.numeric):
            columns[c] = F.col(c).cast("double")
        if m.factor:
            name = f"{m.factor}:{'|'.join(map(str, m.levels))}"
            value = F.col(m.factor)
            number = F.when(value.isNull(), None)
            for k, lv in enumerate(m.levels):
                number = number.when(value == F.lit(lv), F.lit(float(k)))
            columns[name] = number
            bad = bad | (value.isNotNull() & number.isNull())
    message = F.lit("a factor has values that are in none of the levels")
    checked = df.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
    names = list(columns)
    return checked.select(*[F.coalesce(c, F.lit(float("nan"))).alias(f"c{k}") for k, c in enumerate(columns.values())]), names


def _matrices(batch: np.ndarray, names: list[str], models: list[Model], centre: dict, scale: dict):
    """(y, X) of the complete cases of every model in a batch."""
    at = {n: k for k, n in enumerate(names)}
    for m in models:
        y = batch[:, at[m.outcome]]
        parts = [np.ones(len(y))]
        rows = ~np.isnan(y)
        if m.factor:
            f = batch[:, at[f"{m.factor}:{'|'.join(map(str, m.levels))}"]]
            rows &= ~np.isnan(f)
            parts += [(f == k).astype(float) for k in range(1, len(m.levels))]
        for c in m.numeric:
            v = batch[:, at[c]]
            rows &= ~np.isnan(v)
            parts.append((v - centre[c]) / scale[c])
        yield y[rows], np.column_stack(parts)[rows]


def moments(y: np.ndarray, x: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """For each row of ``betas``: deviance, gradient and upper triangle of the information."""
    p = x.shape[1]
    eta = np.clip(x @ betas.T, -CLIP, CLIP)
    mu = 1 / (1 + np.exp(-eta))
    i, j = np.triu_indices(p)
    deviance = 2 * (np.logaddexp(0, eta) - y[:, None] * eta).sum(axis=0)
    return np.vstack([deviance, x.T @ (y[:, None] - mu), (x[:, i] * x[:, j]).T @ (mu * (1 - mu))]).T


def _pass(design: DataFrame, names, models, centre, scale, fits: list[Fit]) -> None:
    """Evaluates what every open fit proposes, in one job over the rows."""
    points = [f.propose() for f in fits]
    of = [[k for k, f in enumerate(fits) if f.model == m] for m in range(len(models))]
    betas = [np.array([points[k].beta for k in ks]) for ks in of]

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            for m, (y, x) in enumerate(_matrices(rows, names, models, centre, scale)):
                if of[m] and len(y):
                    for k, v in zip(of[m], moments(y, x, betas[m])):
                        sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["fit", "sums"])

    parts = design.mapInArrow(run, "fit int, sums array<double>").select("fit", F.posexplode("sums").alias("at", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("fit", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["fit"], {})[r["at"]] = r["v"]
    for k, (f, at) in enumerate(zip(fits, points)):
        p = len(at.beta)
        v = np.array([found[k][i] for i in range(len(found[k]))])
        at.deviance, at.gradient = float(v[0]), v[1:1 + p]
        at.information = np.zeros((p, p))
        i, j = np.triu_indices(p)
        at.information[i, j] = at.information[j, i] = v[1 + p:]


class _End:
    """Search for one end of a profile interval.

    ``excess`` at a value is the signed root of the deviance above the model's; the
    bracket is (near, far) with the excess at near below the goal.
    """

    def __init__(self, fit: Fit, a: np.ndarray, side: int, goal: float):
        self.a, self.side, self.goal, self.model = a, side, goal, fit.model
        self.base = fit.here.deviance
        self.start = float(a @ fit.here.beta)
        se = math.sqrt(max(float(a @ fit.info["inverse"] @ a), 0.0))
        self.unit = float(np.abs(a).sum())
        self.reach = min(goal * se, 4 * self.unit) or self.unit
        self.near, self.far, self.last = (0.0, 0.0), None, None
        self.at, self.result, self.turns = self.reach, None, 0
        self.from_point = fit.here
        self.fit = self._constrained()

    def _constrained(self) -> Fit:
        """The next refit starts where the tangent of the last one meets the constraint."""
        value, at = self.start + self.side * self.at, self.from_point
        along = newton(Point(at.beta, gradient=np.zeros_like(self.a), information=at.information), self.a, value)
        return Fit(self.model, Point(at.beta + along), self.a, value)

    def advance(self, tol: float) -> bool:
        """After the refit has settled: false once the end is known."""
        excess = math.sqrt(max(self.fit.here.deviance - self.base, 0.0))
        here, last = (self.at, excess), self.last
        self.turns, self.last, self.from_point = self.turns + 1, here, self.fit.here
        if abs(excess - self.goal) <= max(1e-9, tol * (self.base + 0.1)) or self.turns > 100:
            self.result = self.start + self.side * self.at
            return False
        if excess < self.goal:
            self.near = here
        else:
            self.far = here
        if self.far is None:
            if self.at > 64 * self.unit:
                self.result = self.side * math.inf
                return False
            self.at *= min(2.0, 1.05 * self.goal / excess) if excess > 0 else 2.0
        else:
            (a, x), (b, y) = self.near, self.far
            if b - a <= 1e-13 * b:
                self.result = self.start + self.side * b
                return False
            p, q = (last, here) if last is not None and abs(here[1] - last[1]) > 1e-12 else ((a, x), (b, y))
            guess = p[0] + (q[0] - p[0]) * (self.goal - p[1]) / (q[1] - p[1])
            # the excess is nearly straight, so the secant is fast; a bisection now and then bounds the search
            self.at = guess if a < guess < b and self.turns % 5 else (a + b) / 2
        self.fit = self._constrained()
        return True


def logistic_models(df: DataFrame, models: list[Model], profile: bool = True, z: float = Z95, tol: float = 1e-11, most: int = 60) -> DataFrame:
    """(model, term, estimate, se, z, p_value, odds ratio with Wald and profile intervals, flags) of every term.

    ``deviance``, ``null_deviance``, ``n`` and ``steps`` are those of the model.
    """
    design, names = _design(df, models)
    design = design.persist(StorageLevel.MEMORY_AND_DISK)  # read by every pass
    try:
        at = {n: f"c{k}" for k, n in enumerate(names)}
        numeric = sorted({c for m in models for c in m.numeric})
        number = lambda c: F.when(~F.isnan(at[c]), F.col(at[c]))
        whole = lambda m: ~sum((F.isnan(at[c]).cast("int") for c in names if c in (m.outcome, *m.numeric) or (m.factor and c.startswith(f"{m.factor}:"))), F.lit(0)).cast("boolean")
        st = design.agg(F.count("*").alias("rows"), *[f(number(c)).alias(f"{k}_{i}") for i, c in enumerate(numeric) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))],
                        *[F.count_if(whole(m)).alias(f"n_{i}") for i, m in enumerate(models)],
                        *[F.avg(F.when(whole(m), F.col(at[m.outcome]))).alias(f"rate_{i}") for i, m in enumerate(models)]).first()
        centre = {c: st[f"mean_{i}"] or 0.0 for i, c in enumerate(numeric)}
        scale = {c: st[f"sd_{i}"] or 1.0 for i, c in enumerate(numeric)}
        fits = []
        for i, m in enumerate(models):
            start = np.zeros(len(m.terms))
            rate = st[f"rate_{i}"]
            if rate is not None and 0 < rate < 1:
                start[0] = math.log(rate / (1 - rate))
            fits.append(Fit(i, Point(start), info={"n": int(st[f"n_{i}"]), "rate": rate}))
            fits[-1].done = not st[f"n_{i}"]
        step = lambda todo: _pass(design, names, models, centre, scale, todo)
        while todo := [f for f in fits if not f.done]:
            step(todo)
            for f in todo:
                f.take(tol, most)
        rows, ends = [], []
        for f, m in zip(fits, models):
            back = _back(m, centre, scale)
            f.info |= _describe(f, m, back)
            if profile and f.info["n"]:
                for k, a in enumerate(back):
                    if f.info["determined"][k]:
                        ends += [(f, k, _End(f, a, side, z)) for side in (-1, 1) if not (f.info["separated"][k] and f.info["side"][k] == side)]
        open_ends = [e for _, _, e in ends]
        while open_ends:
            step([e.fit for e in open_ends])
            for e in open_ends:
                e.fit.take(tol, most)
            open_ends = [e for e in open_ends if not e.fit.done or e.advance(tol)]
        found = {(f.model, k, e.side): e.result for f, k, e in ends}
        for i, (f, m) in enumerate(zip(fits, models)):
            rows += _rows(i, f, m, found, profile, z)
    finally:
        design.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "model string, term string, estimate double, se double, z double, p_value double, odds_ratio double, ci_low double, ci_high double, "
              "profile_low double, profile_high double, determined boolean, separated boolean, converged boolean, "
              "deviance double, null_deviance double, n long, steps int")


def _back(m: Model, centre: dict, scale: dict) -> np.ndarray:
    """Row k takes the fitted coefficients to term k on its own scale."""
    first = len(m.terms) - len(m.numeric)
    back = np.eye(len(m.terms))
    for k, c in enumerate(m.numeric, start=first):
        back[k, k] = 1 / scale[c]
        back[0, k] = -centre[c] / scale[c]
    return back


def _describe(f: Fit, m: Model, back: np.ndarray) -> dict:
    """Estimates, standard errors and which terms run off or are not determined."""
    p = len(m.terms)
    if not f.info["n"]:
        return {"beta": [None] * p, "se": [None] * p, "determined": [False] * p, "separated": [False] * p, "side": [0] * p}
    at = f.here
    size, axes = np.linalg.eigh(at.information)
    lost = axes[:, size <= 1e-13 * max(size[-1], 1e-300)]
    inverse = _inverse(at.information)
    moves = back @ f.moves
    unit = np.abs(back).sum(axis=1)
    runs = np.abs(moves) > RUNS_OFF * unit
    # in a direction without information nothing moves; all probabilities at 0 or 1 is separation, too
    unknown = (np.abs(back @ lost) > 1e-6 * unit[:, None]).any(axis=1) & ~runs
    far = np.abs(back @ at.beta) > CLIP / 2 * unit
    runs |= unknown & far
    unknown &= ~far
    beta, se = back @ at.beta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", back, inverse, back), 0))
    return {"inverse": inverse, "beta": beta, "se": se, "determined": (~unknown).tolist(), "separated": runs.tolist(),
            "side": np.where(np.abs(moves) > 0, np.sign(moves), np.sign(beta)).astype(int).tolist()}


def _rows(i: int, f: Fit, m: Model, found: dict, profile: bool, z: float) -> list[tuple]:
    rate, n = f.info["rate"], f.info["n"]
    null = None if rate is None else -2 * n * sum(v * math.log(v) for v in (rate, 1 - rate) if v > 0)
    out = []
    for k, term in enumerate(m.terms):
        known, runs = f.info["determined"][k], f.info["separated"][k]
        b, se = (float(f.info["beta"][k]), float(f.info["se"][k])) if known and not runs else (None, None)
        wald = (None, None, None, None)
        if b is not None and se > 0:
            wald = (b / se, math.erfc(abs(b / se) / math.sqrt(2)), _exp(b - z * se), _exp(b + z * se))
        ends = [None, None]
        if profile and known:
            ends = [_exp(side * math.inf if runs and f.info["side"][k] == side else found[i, k, side]) for side in (-1, 1)]
        out.append((m.name, term, b, se, wald[0], wald[1], None if b is None else _exp(b), wald[2], wald[3], *ends, bool(known), bool(runs),
                    f.converged, f.here.deviance if n else None, null, n, f.steps))
    return out


def _exp(x: float) -> float:
    return math.exp(x) if x < 709 else math.inf
