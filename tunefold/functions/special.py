"""Closed forms for circular statistics on columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .angles import col

# A(0.25) where A = I1/I0: a class cut on kappa becomes a cut on the vector length.
KAPPA_CUT_RESULTANT = 0.124033502


def bessel_ratio(kappa: Column, depth: int = 120) -> Column:
    """I1(k)/I0(k) by backward continued fraction; asymptotic series past k = 60."""
    cf = F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), F.lit(0.0),
                     lambda acc, m: F.lit(1.0) / (F.lit(2.0) * m / kappa + acc))
    k = kappa
    tail = 1.0 - 1.0 / (2.0 * k) - 1.0 / (8.0 * k * k) - 1.0 / (8.0 * k * k * k) - 25.0 / (128.0 * k * k * k * k)
    return F.when(k <= 0, F.lit(0.0)).when(k > 60.0, tail).otherwise(cf)


def kappa_from_resultant(r, steps: int = 12) -> Column:
    """Concentration whose mean resultant is r: Newton steps on A(k) = r. NULL at r >= 1 (unbounded)."""
    r = col(r)
    start = r * (2.0 - r * r) / (1.0 - r * r)

    def newton(k, _):
        a = bessel_ratio(k)
        return k - (a - r) / (1.0 - a / k - a * a)

    value = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton)
    return F.when(r < 2.220446049250313e-16, F.lit(0.0)).when(r < 1.0, value)


def rayleigh_p(n, r, min_n: int = 3) -> Column:
    """Finite-n Rayleigh approximation (Zar), NULL below min_n."""
    n, r = col(n).cast("double"), col(r)
    p = F.exp(F.sqrt(1.0 + 4.0 * n + 4.0 * (n * n - (n * r) * (n * r))) - (1.0 + 2.0 * n))
    return F.when(n >= min_n, p)


def det3(m) -> Column:
    """Determinant of a 3x3 list-of-lists of columns."""
    return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))


def cramer3(m, rhs) -> list[Column]:
    """Solve a 3x3 system by Cramer's rule; NULL when singular."""
    d = det3(m)
    out = []
    for j in range(3):
        mj = [[rhs[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]
        out.append(F.when(F.abs(d) > 1e-12, det3(mj) / d))
    return out
