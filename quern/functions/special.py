"""Special functions that Spark SQL lacks, as Columns, and as SQL text for other engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(30)]


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: the power series of erf below 2, else a continued fraction."""

    def of(v: Column) -> Column:
        series = F.aggregate(F.array(*[F.lit(w) for w in reversed(_TERMS)]), F.lit(0.0), lambda s, w: w + v * v * s)
        fraction = F.aggregate(F.sequence(F.lit(22), F.lit(1), F.lit(-1)), v, lambda f, n: v + n / 2 / f)
        return F.when(v < 2, 1 - F.lit(2 / math.sqrt(math.pi)) * v * series).otherwise(F.exp(-v * v) / math.sqrt(math.pi) / fraction)

    # x may be a long expression: it is bound once, not evaluated at each step.
    return F.element_at(F.transform(F.array(x), of), 1)


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z."""
    return erfc(F.abs(z) / math.sqrt(2))


def _num(v: float) -> str:
    text = repr(v)
    return text if "e" in text else text + "e0"


def erfc_sql(x: str) -> str:
    """erfc as SQL text of plain arithmetic, for engines without higher-order functions; x, a column, is repeated."""
    series = _num(_TERMS[-1])
    for w in reversed(_TERMS[:-1]):
        series = f"({_num(w)} + {x} * {x} * {series})"
    fraction = x
    for n in range(22, 0, -1):
        fraction = f"({x} + {n / 2!r}e0 / {fraction})"
    root = _num(math.sqrt(math.pi))
    return f"(CASE WHEN {x} < 2e0 THEN 1e0 - 2e0 / {root} * {x} * {series} ELSE exp(-{x} * {x}) / {root} / {fraction} END)"


def two_sided_sql(z: str) -> str:
    """two_sided for z >= 0 as SQL text."""
    return erfc_sql(f"({z} / {_num(math.sqrt(2))})")


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + F.lit(8.0)
    r = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / y
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + F.lit(float(i)))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(shift)


def lchoose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def hypergeometric_tail(k: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """P(X >= k): so many marked ones or more among those drawn."""
    upto = F.least(marked, drawn)
    term = lambda i: F.exp(lchoose(marked, i) + lchoose(total - marked, drawn - i) - lchoose(total, drawn))
    low = F.greatest(k, drawn - (total - marked), F.lit(0).cast("long"))
    tail = F.aggregate(F.sequence(low, upto), F.lit(0.0), lambda s, i: s + term(i.cast("double")))
    return F.when(low > upto, F.lit(0.0)).otherwise(F.least(F.lit(1.0), tail))


def chi2_tail(x: Column, df: int) -> Column:
    """The upper tail of chi-squared with 1 or 2 degrees of freedom, in closed form."""
    if df == 2:
        return F.exp(-x / 2)
    if df == 1:
        return erfc(F.sqrt(x / 2))
    raise ValueError("closed forms exist for 1 and 2 degrees of freedom")
