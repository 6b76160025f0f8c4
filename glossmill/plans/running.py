"""Running sums over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import cut


def running(rows: DataFrame, order: list[str], keys: list[str] | None = None, **values: Column) -> DataFrame:
    """`rows` with, for each named value, its sum over all earlier rows of the same keys in `order` (0 for the first).

    Rows are range-partitioned by (keys, order), so a key that holds a third of all rows lies in many partitions. Each
    partition sums its own rows; what came before it is one small row a partition and key. `order` must tell rows of
    a key apart, or the sums among equal ones are in any order. Null keys form one group.
    """
    keys = keys or []
    names = list(values)
    ranged = rows.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()), "running")
    totals = ranged.groupBy("_part", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names])
    before = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) for n in names})
    on = local["_part"] == offsets["_p"]
    for k in keys:
        on &= local[k].eqNullSafe(offsets[f"_k_{k}"])
    joined = local.join(offsets, on, "left")
    return joined.select(*rows.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names])


def numbered(rows: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "row_no") -> DataFrame:
    """`rows` with their number from 0 in `order` within `keys`."""
    return running(rows, order, keys, **{name: F.lit(1).cast("long")})
