"""Two-sided p-value of a correlation coefficient, in built-in expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-steps of the continued fraction; the slowest cases (p near 0.07 over a million pairs) take some 110.
STEPS = 400
#: Steps by which a half-integer gamma ratio is moved to where its series holds to the last digits.
SHIFT = 16
#: The series of log gamma(z + 1/2) - log gamma(z) - log(z) / 2 by odd powers of 1 / z.
GAMMA_SERIES = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)


def log_gamma_step(a: Column) -> Column:
    """log gamma(a + 1/2) - log gamma(a), without the difference of two large numbers."""
    z = a + SHIFT
    out = F.log(z) / 2
    for k, c in enumerate(GAMMA_SERIES):
        out = out + F.lit(c) / F.pow(z, F.lit(2 * k + 1))
    for k in range(SHIFT):
        out = out + F.log((a + k) / (a + (k + 0.5)))
    return out


def beta_fraction(a: Column, b: Column, x: Column, steps: int = STEPS) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from the front by a fold over its terms."""
    away = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(F.lit(1e-300))

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    def step(s: Column, k: Column) -> Column:
        t = term(k)
        d, c = F.lit(1.0) / away(1 + t * s["d"]), away(1 + t / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["out"] * d * c).alias("out"))

    first = F.lit(1.0) / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("out"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(steps + 1)), start, step)["out"]


def correlation_p(r: Column, n: Column) -> Column:
    """P-value of correlation ``r`` over ``n`` pairs under Student's t with n - 2 degrees of freedom.

    Null without a correlation or with fewer than two pairs; two pairs give 1, a perfect correlation of more gives 0.
    """
    a, half = (n.cast("double") - 2) / 2, F.lit(0.5)
    square = r * r
    front = F.exp(log_gamma_step(a) - 0.5 * math.log(math.pi) + a * F.log1p(-square) + F.log(square) / 2)
    tail = 1 - square < (a + 1) / (a + 2.5)
    p = F.when(tail, front * beta_fraction(a, half, 1 - square) / a).otherwise(1 - 2 * front * beta_fraction(half, a, square))
    known = r.isNotNull() & ~F.isnan(r) & (n >= 2)
    return F.when(known, F.when(n == 2, 1.0).when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).otherwise(p))
