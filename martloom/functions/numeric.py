"""Number handling shared by every operator.

Money is added up in whole cents (64-bit integers), so a total does not depend
on the order in which tasks deliver their partial sums. Rounding happens on the
decimal text of a number, so x.xx5 always rounds away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fixed(value: Column | str, digits: int) -> Column:
    return F.round(as_col(value).cast("decimal(38,12)"), digits).cast("double")


def cents(value: Column | str) -> Column:
    return F.rint(as_col(value).cast("double") * 100).cast("long")


def from_cents(value: Column | str) -> Column:
    return as_col(value) / F.lit(100.0)


def money_sum(value: Column | str) -> Column:
    return from_cents(F.sum(cents(value)))


def weight_sum(value: Column | str) -> Column:
    """Total of weights and volumes as exact decimals: small parts are kept until the end."""
    return F.sum(as_col(value).cast("decimal(20,6)")).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double, NULL where den is 0 or NULL."""
    return as_col(num).cast("double") / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def safe_ratio(
    num: Column | str, den: Column | str, digits: int | None = 4, default: float | None = 0.0
) -> Column:
    """num / den where den is positive, otherwise the default."""
    quotient = ratio(num, den)
    if digits is not None:
        quotient = fixed(quotient, digits)
    fallback = F.lit(default).cast("double")
    return F.when(as_col(den) > 0, quotient).otherwise(fallback)


def floored_ratio(num: Column | str, den: Column | str, digits: int = 4) -> Column:
    """num / max(1, den)."""
    return fixed(
        as_col(num).cast("double") / F.greatest(F.lit(1.0), as_col(den).cast("double")), digits
    )


def finite(value: Column | str) -> Column:
    """NaN and the infinities become NULL."""
    c = as_col(value)
    infinite = F.abs(c) == F.lit(float("inf"))
    return F.when(F.isnan(c) | infinite, F.lit(None)).otherwise(c)


def exact_std(total: Column, squares: Column, count: Column) -> Column:
    """Sample standard deviation in units from sums of whole cents and of their squares.

    Both sums are exact decimals, so the result does not depend on row order; NULL
    below two rows.
    """
    n = count.cast("decimal(10,0)")
    spread = n * squares - total * total
    variance = ratio(spread, (count * (count - 1)).cast("double"))
    return F.when(count > 1, F.sqrt(variance) / F.lit(100.0))


def cents_decimal(value: Column | str) -> Column:
    return cents(value).cast("decimal(14,0)")
