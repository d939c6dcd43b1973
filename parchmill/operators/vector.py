"""Vector collections: exact nearest neighbours, upserts, dimension checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metrics where more is nearer; the others are distances.
METRICS = ("cosine", "dot", "euclid", "manhattan")


class DimensionMismatch(ValueError):
    def __init__(self, expected: int, actual: int) -> None:
        super().__init__(f"expected vector dimension {expected}, got {actual}")
        self.expected, self.actual = expected, actual


def check_dimension(vector: Sequence[float], expected: int) -> None:
    if len(vector) != expected:
        raise DimensionMismatch(expected, len(vector))


def dimension_error(vector: Column, expected: int) -> Column:
    """The message for a row's vector, null if its dimension is right."""
    size = F.coalesce(F.size(vector), F.lit(0))
    return F.when(size != expected, F.concat(F.lit(f"expected vector dimension {expected}, got "), size))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _double(vector: Column) -> Column:
    return F.transform(vector, lambda v: v.cast("double"))


def score(vector: Column, query: Column, metric: str = "cosine") -> Column:
    """Similarity or distance of two arrays, in double precision; null for a zero vector under cosine."""
    a, b = _double(vector), _double(query)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "dot":
        return dot
    if metric == "cosine":
        norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
        return dot / F.nullif(norm, F.lit(0.0))
    if metric == "euclid":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def top_k(points: DataFrame, query: Sequence[float], limit: int, metric: str = "cosine", dimension: int | None = None) -> DataFrame:
    """The ``limit`` nearest points ``(id, vector, ...)`` with their ``score``; ties by id.

    The query is a literal: one pass, no join, and each task keeps only its best (TakeOrderedAndProject).
    """
    if dimension is not None:
        check_dimension(query, dimension)
    got = points.withColumn("score", score(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]), metric)).where("score is not null")
    order = F.desc("score") if metric in ("cosine", "dot") else F.asc("score")
    return got.orderBy(order, "id").limit(limit)


def upsert(points: DataFrame, new: DataFrame, version: Column | None = None) -> DataFrame:
    """``points`` with the rows of ``new`` put in or put over, by id; of several new rows of one id the last counts.

    ``version`` orders the new rows; by default the order of their partitions
    and of the rows in each does. New rows are reduced first, by id; a point of
    the old table is read once and not sorted.
    """
    nth = F.monotonically_increasing_id() if version is None else version
    last = new.withColumn("__pm_v", nth).withColumn("__pm_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("__pm_v")))).where("__pm_n = 1").drop("__pm_v", "__pm_n")
    return points.join(last.select("id"), "id", "left_anti").select(*points.columns).unionByName(last, allowMissingColumns=True)


def upsert_one(points: DataFrame, id_: int, vector: Sequence[float], payload: dict[str, str], dimension: int) -> DataFrame:
    check_dimension(vector, dimension)
    row = points.sparkSession.createDataFrame([(id_, [float(x) for x in vector], payload)], "id bigint, vector array<float>, payload map<string,string>")
    return upsert(points, row)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
