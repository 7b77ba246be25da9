"""Column functions on ARRAY<FLOAT> embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the L2 score is 100 * (1 - tanh(squared distance / 3000)).
L2_SCALE = 3000.0


def _fold(vector: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(vector, F.lit(0.0), step)


def squared_norm(vector: Column) -> Column:
    return _fold(vector, lambda acc, x: acc + x.cast("double") * x.cast("double"))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return _fold(products, lambda acc, x: acc + x)


def squared_l2(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda x, y: x.cast("double") - y.cast("double"))
    return _fold(gaps, lambda acc, x: acc + x * x)


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine; a zero vector has distance 1 from everything."""
    scale = F.sqrt(squared_norm(left)) * F.sqrt(squared_norm(right))
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(left, right), scale), F.lit(0.0))


def normalize(vector: Column, legacy: bool = False) -> Column:
    """Scale to unit length as ARRAY<DOUBLE>; a zero vector has no direction and becomes NULL.

    ``legacy`` also replaces every zero component by one over the norm.
    """
    total = squared_norm(vector)

    def scaled(norm: Column) -> Column:
        def component(x: Column) -> Column:
            value = x.cast("double")
            if legacy:
                value = F.when(value == 0.0, F.lit(1.0)).otherwise(value)
            return value / norm

        return F.transform(vector, component)

    # The one-element array binds the norm to a lambda variable, so it is computed once per row
    # and not once per component.
    bound = F.transform(F.array(F.sqrt(total)), scaled)[0]
    return F.when(total > 0, bound)


def cosine_score(distance: Column) -> Column:
    return F.lit(100.0) * (F.lit(1.0) - distance)


def l2_score(distance: Column) -> Column:
    return F.lit(100.0) * (F.lit(1.0) - F.tanh(distance / F.lit(L2_SCALE)))


DISTANCES = {"cosine": cosine_distance, "l2": squared_l2}
SCORES = {"cosine": cosine_score, "l2": l2_score}


def check_metric(metric: str) -> str:
    if metric not in SCORES:
        raise ValueError(f"unknown metric {metric!r}; expected one of {sorted(SCORES)}")
    return metric


def distance(metric: str, left: Column, right: Column) -> Column:
    return DISTANCES[check_metric(metric)](left, right)


def score(metric: str, distance_column: Column) -> Column:
    return SCORES[check_metric(metric)](distance_column)
