"""Column helpers that keep missing values missing.

Spark and pandas disagree on NaN, on division by zero and on ``least``/``greatest`` over NULL; every
helper here states the missing-value rule it follows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what a text must look like to count as a number.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL, so that comparisons treat it as missing."""
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def coerce_double(c: Column) -> Column:
    """Text or number to double; whatever does not read as a number becomes NULL."""
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is zero or either side is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def capacity_factor(generation: Column, capacity: Column, hours_factor: float = 8.76) -> Column:
    """Share of the full-load output: generation / (capacity * hours_factor), within [0, 1.1]."""
    return clip(ratio(generation, capacity * F.lit(float(hours_factor))), 0.0, 1.1)


def log10_positive(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def significance_label(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "significantly different").otherwise("not significantly different")


def direction_label(p: Column, difference: Column, alpha: float = 0.05) -> Column:
    """Better / worse by the sign of the mean difference, once the test is significant."""
    return (
        F.when((p < alpha) & (difference > 0), "significantly better")
        .when((p < alpha) & (difference < 0), "significantly worse")
        .otherwise("not significantly different")
    )


def autocorrelation_label(p: Column, statistic: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(p >= alpha, "no significant spatial autocorrelation")
        .when(statistic > 0, "significant positive spatial autocorrelation")
        .otherwise("significant negative spatial autocorrelation")
    )


def year_of_column(name: Column) -> Column:
    """``cf_2015`` -> 2015."""
    return F.split(name, "_")[1].cast("int")


def half_even(c: Column, digits: int = 3) -> Column:
    """Round ties to the even digit, as the reported tables do. Five more digits are settled first, so that
    the residue of a sum, which depends on the order of its rows, does not decide a tie."""
    return F.bround(F.round(c, digits + 5), digits)
