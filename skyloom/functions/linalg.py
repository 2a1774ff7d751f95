"""Algebra on packed symmetric 3x3 matrices (II, IQ, IU, QQ, QU, UU), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A matrix is singular if its determinant is at most this share of its diagonal's product.
SINGULAR = 1e-12


def determinant(a: list[Column]) -> Column:
    ii, iq, iu, qq, qu, uu = a
    return ii * (qq * uu - qu * qu) - iq * (iq * uu - qu * iu) + iu * (iq * qu - qq * iu)


def regular(a: list[Column]) -> Column:
    diagonal = a[0] * a[3] * a[5]
    return (diagonal > 1e-300) & (determinant(a) > diagonal * SINGULAR)


def inverse(a: list[Column]) -> list[Column]:
    """Packed inverse; null for a singular matrix."""
    ii, iq, iu, qq, qu, uu = a
    det = F.when(regular(a), determinant(a))
    return [
        (qq * uu - qu * qu) / det,
        (iu * qu - iq * uu) / det,
        (iq * qu - iu * qq) / det,
        (ii * uu - iu * iu) / det,
        (iq * iu - ii * qu) / det,
        (ii * qq - iq * iq) / det,
    ]


def multiply(a: list[Column], x: list[Column]) -> list[Column]:
    ii, iq, iu, qq, qu, uu = a
    return [ii * x[0] + iq * x[1] + iu * x[2], iq * x[0] + qq * x[1] + qu * x[2], iu * x[0] + qu * x[1] + uu * x[2]]


def solve(a: list[Column], b: list[Column]) -> list[Column]:
    """a^-1 b; 0 for a singular matrix."""
    return [F.coalesce(v, F.lit(0.0)) for v in multiply(inverse(a), b)]


def rms(a: list[Column]) -> list[Column]:
    """Square roots of the inverse's diagonal; infinite for a singular matrix."""
    inv = inverse(a)
    return [F.coalesce(F.sqrt(inv[i]), F.lit(float("inf"))) for i in (0, 3, 5)]
