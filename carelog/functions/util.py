"""Small helpers shared by the Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def first_match(cases, otherwise=None) -> Column:
    """Searched CASE: ``[(predicate, value), ...]``; the first true predicate wins.

    A NULL predicate counts as false, so three-valued logic falls through to
    later cases exactly as a SQL CASE does.
    """
    expr = None
    for pred, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(pred, value) if expr is None else expr.when(pred, value)
    if otherwise is not None:
        expr = expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return expr


def float_ratio(a, b) -> Column:
    """``a / b`` as floating point has it: an infinity (or NaN for 0 / 0) over zero, where
    Spark's division raises.  Zero counts as positive."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def typed_null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)
