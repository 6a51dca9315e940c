"""Dense-vector expressions over ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions.text import col_


def to_double(v) -> Column:
    return col_(v).cast("array<double>")


def dot(a, b) -> Column:
    prod = F.zip_with(to_double(a), to_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b, guarded: bool = True) -> Column:
    """Cosine similarity; the guarded form gives 0 for a zero vector."""
    den = norm(a) * norm(b)
    if guarded:
        return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)
    return dot(a, b) / den


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector stays unchanged. The norm is bound to a name first: inside the
    element's function it would be worked out anew for every element."""
    unit = lambda n: F.when(n == 0, to_double(v)).otherwise(F.transform(to_double(v), lambda x: x / n))
    return F.element_at(F.transform(F.array(norm(v)), unit), 1)


def add_scaled(a, wa: float, b, wb: float) -> Column:
    return F.zip_with(to_double(a), to_double(b), lambda x, y: x * wa + y * wb)
