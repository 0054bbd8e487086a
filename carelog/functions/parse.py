"""Safe parsing of values stored as text.

Spark's ``try_cast`` is more lenient than a warehouse SAFE_CAST in a few
places (``'5d'`` and ``'NaN'`` parse as doubles, ``'1.5'`` as decimal text to
an integer type differs between engines), so every parser first checks the
text against a plain number pattern.  All checks stay JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelog.functions.util import col

# Java regex; \z is the true end of input ($ would also accept a trailing newline).
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*\z"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)\s*\z"


def safe_int(c, dtype: str = "bigint") -> Column:
    """Integer text -> integer, anything else -> NULL (``'1.5'``, ``'0x1A'``, ``''``)."""
    c = col(c)
    return F.when(c.rlike(INTEGER_TEXT), F.trim(c).try_cast(dtype))


def safe_double(c) -> Column:
    """Decimal text -> double; ``'5d'``, ``'NaN'``, ``'Infinity'`` -> NULL."""
    c = col(c)
    return F.when(c.rlike(DECIMAL_TEXT), F.trim(c).try_cast("double"))


def safe_decimal(c, precision: int = 18, scale: int = 9) -> Column:
    """Decimal text -> fixed point ``decimal(precision, scale)`` or NULL.

    Fixed point keeps band edges exact: ``0.29 * 100`` is 29, not
    28.999999999999996.
    """
    c = col(c)
    return F.when(c.rlike(DECIMAL_TEXT), F.trim(c).try_cast(f"decimal({precision},{scale})"))


def strict_decimal(c, precision: int = 18, scale: int = 9) -> Column:
    """Hard cast: malformed text fails the query (ANSI), like a plain CAST."""
    return col(c).cast(f"decimal({precision},{scale})")


def to_numeric(c, strict: bool = False, precision: int = 18, scale: int = 9) -> Column:
    return strict_decimal(c, precision, scale) if strict else safe_decimal(c, precision, scale)


def digits_only(c, min_len: int = 0, max_len: int = 5) -> Column:
    """True when the text is only ASCII digits, ``min_len..max_len`` of them."""
    return col(c).rlike(rf"^[0-9]{{{min_len},{max_len}}}\z")


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
