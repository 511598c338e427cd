"""Distances and normalisations of array columns, in double precision, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to norms before dividing.
GUARD = 1e-8


def dbl(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(dbl(a), dbl(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(dbl(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + GUARD) * (norm(b) + GUARD))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(dbl(a), dbl(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(dbl(a), dbl(b), lambda x, y: F.abs(x - y)))


def angular(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "inner_product": dot, "l2": l2, "l1": l1, "angular": angular}
#: Metrics for which less is nearer.
ASCENDING = frozenset({"l2", "l1", "angular"})


def score(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, not for each element inside f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(v: Column) -> Column:
    return _let(norm(v) + GUARD, lambda n: F.transform(dbl(v), lambda x: x / n))


def mean(v: Column) -> Column:
    return total(dbl(v)) / F.size(v)


def deviation(v: Column) -> Column:
    """Population standard deviation of the elements."""
    return _let(mean(v), lambda m: F.sqrt(total(F.transform(dbl(v), lambda x: (x - m) * (x - m))) / F.size(v)))


def quantile(v: Column, p: float) -> Column:
    """Of the elements, between its two neighbours in proportion; null for an empty vector."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * p
        low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return _let(F.array_sort(dbl(v)), of)


def zscore(v: Column) -> Column:
    moments = F.struct(mean(v).alias("m"), (deviation(v) + GUARD).alias("s"))
    return _let(moments, lambda k: F.transform(dbl(v), lambda x: (x - k["m"]) / k["s"]))


def features(v: Column) -> Column:
    """An extractor's vector as it is compared: to unit length, to z-scores, to unit length again."""
    return unit(zscore(unit(v)))


def normalised_for(metric: str, v: Column) -> Column:
    return unit(v) if metric in ("cosine", "angular", "l2") else dbl(v)


def regions(a: Column, b: Column, parts: int = 4) -> list[Column]:
    """Cosine of equal slices; the last takes the remainder."""
    step = F.floor(F.size(a) / parts).cast("int")
    cut = lambda v, i: F.slice(v, step * i + 1, F.size(v) - step * i if i == parts - 1 else step)
    return [cosine(cut(a, i), cut(b, i)) for i in range(parts)]


def similarity(distance: Column) -> Column:
    return F.exp(-distance)


def inverse_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)
