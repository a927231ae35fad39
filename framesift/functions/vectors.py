"""Vector arithmetic on array<float> columns. All sums are in double; a null operand gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has length 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def usable(v: Column, dim: int) -> Column:
    """Not null, of the right length, without null and NaN, not all zero."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def add(a: Column, b: Column, wa: Column | float = 1.0, wb: Column | float = 1.0) -> Column:
    """wa a + wb b; a null vector counts as absent."""
    wa, wb = (w if isinstance(w, Column) else F.lit(float(w)) for w in (wa, wb))
    both = F.zip_with(as_double(a), as_double(b), lambda x, y: x * wa + y * wb)
    return F.coalesce(both, F.transform(as_double(a), lambda x: x * wa), F.transform(as_double(b), lambda y: y * wb))


def mean_vector(df, vector: str, *by: str):
    """The mean of the vectors of each group, element by element: columns `by` and `mean`. Partial sums are formed before the shuffle."""
    each = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(as_double(F.col(vector))).alias("pos", "x"))
    means = each.groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def fingerprint(v: Column) -> Column:
    """A number that stands for a vector in results: the sum of its elements by place, rounded."""
    return F.round(F.aggregate(F.transform(as_double(v), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)
