"""Expressions over vectors: clamping, quantisation, distances, box bounds. All run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearvote.schema import SCALE, SENTINEL


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """v within [low, high]; NaN stays NaN."""
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def quantize(v: Column) -> Column:
    """[0, 1] to 0..32767, rounded half up; negative numbers are the null marker -32768, NaN is 0."""
    v = v.cast("double")
    return F.when(v < 0, F.lit(SENTINEL)).when(F.isnan(v), F.lit(0)).otherwise(F.round(F.least(v, F.lit(1.0)) * SCALE).cast("int")).cast("smallint")


def bool_to_int8(b: Column) -> Column:
    return b.cast("tinyint")


def is_whole(v: Column, dims: int) -> Column:
    """Whether v has `dims` numbers, none of them null. Searches and indexes leave out rows of other vectors."""
    return F.coalesce((F.size(v) == dims) & ~F.exists(v, F.isnull), F.lit(False))


def dim_differences(q: Column, block: Column, dim: int) -> Column:
    """By vector of a block (an array of vectors), how far it is from q in one dimension."""
    return F.transform(block, lambda v: F.get(q, F.lit(dim)).cast("bigint") - F.get(v, F.lit(dim)).cast("bigint"))


def _sum(terms: list[Column]) -> Column:
    return reduce(add, terms)


def squared_l2(a: Column, b: Column, dims: int, kind: str = "bigint") -> Column:
    """The sum over dims, unrolled for code generation; widened before subtracting, as smallint would overflow."""
    gaps = [F.get(a, F.lit(i)).cast(kind) - F.get(b, F.lit(i)).cast(kind) for i in range(dims)]
    return _sum([g * g for g in gaps])


def box_bound(q: Column, low: Column, high: Column, dims: int, kind: str = "bigint") -> Column:
    """A lower bound of the squared distance of q to any vector within the box."""
    gaps = []
    for i in range(dims):
        x, lo, hi = (F.get(c, F.lit(i)).cast(kind) for c in (q, low, high))
        gaps.append(F.greatest(lo - x, x - hi, F.lit(0).cast(kind)))
    return _sum([g * g for g in gaps])
