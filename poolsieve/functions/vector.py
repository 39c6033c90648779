"""Arrays as vectors and score lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def argmax(scores: Column) -> Column:
    """Position of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def top_k(scores: Column, k: int) -> Column:
    """Positions of the k largest scores, the first of equals first."""
    ranked = F.sort_array(F.transform(scores, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda s: -s["i"])


def mask_from(scores: Column, valid: Column, low: float = -1e9) -> Column:
    """Scores of classes from ``valid`` on are put out of reach."""
    return F.transform(scores, lambda x, i: F.when(i >= valid, F.lit(low)).otherwise(x))


def is_in(values: Column, allowed: Column) -> Column:
    """For each value, whether it is among ``allowed``."""
    return F.transform(values, lambda x: F.array_contains(allowed, x))


def scaled_min_max(a: Column, b: Column) -> tuple[Column, Column]:
    """The smaller and the larger; null if either is null or not a number."""
    bad = a.isNull() | b.isNull() | F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(~bad, F.least(a, b)), F.when(~bad, F.greatest(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
