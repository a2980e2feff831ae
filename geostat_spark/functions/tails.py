"""Tail probabilities and quantiles as Column expressions: nothing leaves the JVM, whatever the number of rows.

Continued fractions and series run as ``aggregate`` over a sequence whose length follows from the parameters; a state
that has converged is carried on unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

TINY, SETTLED = 1e-300, 1e-16

# Wichura's rational approximations of the normal quantile (algorithm AS 241, 16 digits), lowest power
# first: numerators and denominators for the centre, the tails and the far tails.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAILS = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAILS = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _polynomial(coefficients, x: Column) -> Column:
    return reduce(lambda total, c: total * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def log_gamma(a: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series ten places further up."""
    s = a + 10
    below = reduce(lambda total, k: total + F.ln(a + k), range(1, 10), F.ln(a))
    series = 1 / (12 * s) - 1 / (360 * F.pow(s, 3)) + 1 / (1260 * F.pow(s, 5)) - 1 / (1680 * F.pow(s, 7))
    return (s - 0.5) * F.ln(s) - s + 0.5 * math.log(2 * math.pi) + series - below


def _steps(a: Column) -> Column:
    """Enough terms: a number that grows with the root of the parameter."""
    return F.sequence(F.lit(1), (200 + 12 * F.sqrt(F.abs(a))).cast("int"))


def _apart(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(a, x): a series below a + 1, a continued fraction above."""
    lead = F.exp(a * F.ln(x) - x - log_gamma(a))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * x / (a + i)
        done = s["term"] <= s["total"] * SETTLED
        return F.struct(F.when(done, s["term"]).otherwise(term).alias("term"), F.when(done, s["total"]).otherwise(s["total"] + term).alias("total"))

    first = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    series = 1 - lead * F.aggregate(_steps(a), first, add)["total"]

    def divide(s: Column, i: Column) -> Column:
        top = -i * (i - a)
        b = x + 1 - a + 2 * i
        d = 1 / _apart(top * s["d"] + b)
        c = _apart(b + top / s["c"])
        done = F.abs(s["step"] - 1) < SETTLED
        return F.struct(
            F.when(done, s["c"]).otherwise(c).alias("c"), F.when(done, s["d"]).otherwise(d).alias("d"),
            F.when(done, s["total"]).otherwise(s["total"] * c * d).alias("total"), F.when(done, s["step"]).otherwise(c * d).alias("step"),
        )

    d0 = 1 / _apart(x + 1 - a)
    start = F.struct(F.lit(1 / TINY).alias("c"), d0.alias("d"), d0.alias("total"), F.lit(0.0).alias("step"))
    fraction = lead * F.aggregate(_steps(a), start, divide)["total"]
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), series)).otherwise(fraction)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a

    def step(s: Column, m: Column) -> Column:
        out, done = s, F.abs(s["step"] - 1) < SETTLED
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _apart(1 + top * out["d"])
            c = _apart(1 + top / out["c"])
            out = F.struct(c.alias("c"), d.alias("d"), (out["total"] * c * d).alias("total"), (c * d).alias("step"))
        return F.when(done, s).otherwise(out)

    d0 = 1 / _apart(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("total"), F.lit(0.0).alias("step"))
    return front * F.aggregate(_steps(a + b), start, step)["total"]


def beta_lower(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, taken from the nearer end."""
    inner = F.when(x > (a + 1) / (a + b + 2), 1 - _beta_fraction(b, a, 1 - x)).otherwise(_beta_fraction(a, b, x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def chi_square_p(x, df) -> Column:
    """P(X >= x) of a chi-square variable; null without degrees of freedom."""
    x, df = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x, df))
    return F.when(df > 0, gamma_upper(F.when(df > 0, df / 2), x / 2))


def normal_p(z) -> Column:
    """Two-sided tail of the normal distribution: z squared is chi-square with one degree of freedom."""
    z = F.col(z) if isinstance(z, str) else z
    return chi_square_p(z * z, F.lit(1.0))


def student_p(t, df) -> Column:
    """Two-sided tail of Student's t; null without degrees of freedom."""
    t, df = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (t, df))
    return F.when(t.isNull() | df.isNull() | (df <= 0), None).when(F.abs(t) == float("inf"), 0.0).otherwise(_student(t, F.when(df > 0, df)))


def _student(t: Column, df: Column) -> Column:
    return beta_lower(df / 2, F.lit(0.5), df / (df + t * t))


def signed_rank_p(w, n) -> Column:
    """Exact two-sided p of min(W+, W-) for n untied, non-zero differences: the subsets of 1..n are counted by sum."""
    w, n = (F.col(c) if isinstance(c, str) else c for c in (w, n))

    def longer(counts: Column, i: Column) -> Column:
        at = lambda s: F.coalesce(F.get(counts, s), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(counts) + i - 1), lambda s: at(s) + F.when(s >= i, at(s - i)).otherwise(0.0))

    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), longer)
    below = F.aggregate(F.slice(counts, F.lit(1), (F.floor(w) + 1).cast("int")), F.lit(0.0), lambda s, c: s + c)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def normal_quantile(p) -> Column:
    """The z below which a standard normal variable falls with probability p."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    inner = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    ratio = lambda pair, x: _polynomial(pair[0], x) / _polynomial(pair[1], x)
    tail = F.when(r <= 5, ratio(TAILS, r - 1.6)).otherwise(ratio(FAR_TAILS, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, inner)).otherwise(F.signum(q) * tail)
