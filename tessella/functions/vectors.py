"""Vector functions over array columns; folds run left to right, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] > 0, s["n"]).otherwise(1.0)))[0]


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; null where either is null."""
    return dot(a, b)


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key the mean of the unit vectors and its size; one partial sum per key, position and task."""
    spread = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(unit(F.col(vector))).alias("pos", "x"))
    means = spread.groupBy(key, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("n")
    )
