"""Averages of checkpoints and running figures of a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.running import numbered
from ..plans.shared import broadcast_if_small


def vector_mean(vectors: DataFrame, name: str, vector: str, integer: bool = False) -> DataFrame:
    """(name, idx, value): element-wise mean of vectors, floor division for integer ones. Elements are averaged apart, so
    no task holds more than partial sums; null vectors don't count."""
    rows = vectors.select(name, F.posexplode(vector).alias("idx", "v"))
    mean = F.floor(F.sum("v") / F.count("v")) if integer else F.avg(F.col("v").cast("double"))
    return rows.groupBy(name, "idx").agg(mean.alias("value"))


def averaged(spark, paths: list[str]) -> DataFrame:
    """(name, idx, value): the mean of saved checkpoints, tables of (name, values). A checkpoint that isn't there is an error,
    and so is one that lacks a name that another has: the mean would be of fewer than was asked for. A name with the same
    storage as another (column `shares`, if there is one) counts once, under the other's name."""
    from pyspark.errors import AnalysisException

    parts = []
    for k, path in enumerate(paths):
        try:
            rows = spark.read.parquet(path)
        except AnalysisException as e:
            raise FileNotFoundError(f"no checkpoint at {path}") from e
        rows = rows.where("shares is null") if "shares" in rows.columns else rows
        parts.append(rows.select(F.lit(k).alias("_k"), "name", "values"))
    if not parts:
        raise ValueError("no checkpoint given")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    lacking = every.groupBy("name").agg(F.count_distinct("_k").alias("n")).where(F.col("n") < len(paths)).limit(5).collect()
    if lacking:
        raise ValueError(f"not in every checkpoint: {', '.join(r['name'] for r in lacking)}")
    return vector_mean(every, "name", "values")


def parameter_count(tensors: DataFrame, values: str = "values") -> DataFrame:
    """(tensors, parameters): how many tensors there are and how many numbers they hold."""
    return tensors.agg(F.count(values).alias("tensors"), F.coalesce(F.sum(F.size(values)), F.lit(0)).cast("long").alias("parameters"))


def checkpoints(batch: int, n: int, step: int = 1000) -> list[int]:
    """Which checkpoints are averaged: n of them up to `batch`, `step` apart."""
    return sorted(batch - i * step for i in range(n))


def ema(rows: DataFrame, key: str, order: list[str], value: Column, alpha: float) -> DataFrame:
    """(key, n, ema): the exponential moving average at each key's last row, e = e * (1 - alpha) + v * alpha from the first value on.

    As a weighted sum with weights from the row's number, it is combined before the shuffle however many rows a key has.
    """
    nums = numbered(rows.where(value.isNotNull()).select(key, *order, value.cast("double").alias("_v")), order, [key], "_i")
    sizes = nums.groupBy(key).agg(F.max("_i").alias("_last")).withColumnRenamed(key, "_k")
    both = nums.join(broadcast_if_small(sizes), nums[key].eqNullSafe(sizes["_k"]))
    weight = F.pow(F.lit(1 - alpha), F.col("_last") - F.col("_i")) * F.when(F.col("_i") == 0, 1.0).otherwise(alpha)
    return both.groupBy(key).agg((F.max("_last") + 1).alias("n"), F.sum(F.col("_v") * weight).alias("ema"))


def best_so_far(means: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """`means` (one row a key and step) with `best`, the smallest value up to the step."""
    w = W.partitionBy(key).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return means.withColumn("best", F.min(value).over(w))
