"""Vector columns: half-precision rounding, inner product, norm.

Sums are taken in double precision and in order, so they are the same on every
engine that does so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the half-precision format: 2^42 + 1 keeps 11 significant bits; 2^-14 is the
#: smallest normal number; from 65520 on values round to infinity.
SPLIT = 4398046511105.0
LEAST_NORMAL = 6.103515625e-05
OVERFLOW = 65520.0


def f16(x: Column) -> Column:
    """A number rounded to half precision, ties to even; subnormals become 0, too large ones infinite, infinite ones NaN."""
    x = x.cast("double")
    c = x * F.lit(SPLIT)
    rounded = c - (c - x)
    inf = F.lit(float("inf"))
    return (
        F.when(F.isnan(x) | (F.abs(x) == inf), F.lit(float("nan")))
        .when(F.abs(x) < LEAST_NORMAL, F.lit(0.0))
        .when(x >= OVERFLOW, inf)
        .when(x <= -OVERFLOW, -inf)
        .otherwise(rounded)
    )


def vector_f16(v: Column) -> Column:
    return F.transform(v, f16)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def register_sql(spark) -> None:
    """The functions ``dot_f64(a, b)``, ``f16(x)`` and ``tag_match(tags, all_of, none_of)`` for SQL sessions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot_f64(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION f16(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN abs(x) < {LEAST_NORMAL!r}D THEN 0D ELSE x * {SPLIT!r}D - (x * {SPLIT!r}D - x) END".replace("e-05D", "E-5D"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tag_match(tags ARRAY<BIGINT>, all_of ARRAY<BIGINT>, none_of ARRAY<BIGINT>) RETURNS BOOLEAN RETURN size(array_except(all_of, coalesce(tags, array()))) = 0 AND NOT arrays_overlap(coalesce(tags, array()), none_of)")
