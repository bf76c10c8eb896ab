"""Vector arithmetic in double precision, for pairs already joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metrics, and whether the larger value is the better one.
METRICS = {"cosine": True, "ip": True, "l2": False}


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def similarity(a: Column, b: Column, metric: str = "cosine", digits: int | None = None) -> Column:
    """The score, rounded if ``digits`` are given. Adding zero turns -0.0 into 0.0."""
    if metric == "ip":
        raw = dot(a, b)
    elif metric == "cosine":
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        raw = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    elif metric == "l2":
        raw = F.sqrt(
            _total(
                F.zip_with(
                    a,
                    b,
                    lambda x, y: (x.cast("double") - y.cast("double"))
                    * (x.cast("double") - y.cast("double")),
                )
            )
        )
    else:
        raise ValueError(f"unknown metric {metric!r}; use one of {sorted(METRICS)}")
    return (raw if digits is None else F.round(raw, digits)) + F.lit(0.0)
