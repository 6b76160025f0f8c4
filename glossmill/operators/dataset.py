"""Reading feature rows for training: shards, epochs and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.running import numbered


def shard_sizes(rows: DataFrame, world: int) -> DataFrame:
    """(rank, rows): how many rows each of `world` readers gets."""
    n = rows.agg(F.count("*").alias("n"))
    ranks = rows.sparkSession.range(world).select(F.col("id").cast("int").alias("rank"))
    both = ranks.join(F.broadcast(n))  # one row
    return both.select("rank", (F.floor(F.col("n") / world) + (F.col("rank") < F.col("n") % world).cast("long")).alias("rows"))


def sharded(rows: DataFrame, order: list[str], world: int, workers: int = 1) -> DataFrame:
    """`rows` with `shard`, their number in `order` modulo all workers of all ranks (rank * workers + worker)."""
    return numbered(rows, order, name="_no").withColumn("shard", (F.col("_no") % (world * workers)).cast("int")).drop("_no")


def epoch_key(key: Column | str, seed: int, epoch: int) -> Column:
    """What to sort a shard by in an epoch: another order for each seed and epoch, the same on any cluster."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-{epoch}-"), c.cast("string")))


def shuffled(rows: DataFrame, key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """`rows` in a random order; the sort is distributed, no buffer bounds how far a row moves."""
    return rows.orderBy(epoch_key(key, seed, epoch))


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """`rows` with `batch_no` and `batch_pos`; the last batch may be smaller."""
    n = numbered(rows, order, name="_no")
    return n.withColumns({"batch_no": F.floor(F.col("_no") / size), "batch_pos": F.col("_no") % size}).drop("_no")


def epoch_batches(rows: DataFrame, order: list[str], world: int, workers: int, size: int, seed: int, epoch: int) -> DataFrame:
    """`rows` as the workers of all ranks read them in an epoch: `shard` (rank * workers + worker), `batch_no` and `batch_pos`
    within it. Rows are dealt out by their number in `order`, so shards stay the same; an epoch only changes their order. All
    sorting is distributed and no row is held in a buffer."""
    keyed = sharded(rows, order, world, workers).withColumn("_key", epoch_key(F.concat_ws("-", *order), seed, epoch))
    n = numbered(keyed, ["_key", *order], ["shard"], "_no")
    return n.withColumns({"batch_no": F.floor(F.col("_no") / size), "batch_pos": F.col("_no") % size}).drop("_no", "_key")


def by_length(rows: DataFrame, order: list[str], size: int, length: Column) -> DataFrame:
    """Batches with `rank` from 0 by descending length, ties in `order`."""
    b = batched(rows, order, size).withColumn("_len", length)
    rank = F.row_number().over(W.partitionBy("batch_no").orderBy(F.desc("_len"), *order)) - 1
    return b.withColumn("rank", rank).drop("_len")


def first_features(docs: DataFrame, key: str, n: int, make) -> DataFrame:
    """The feature rows `make(docs)` of the first documents by `key`, of enough of them that there are n rows (or of all)."""
    most = n
    while True:
        last = docs.where(F.col(key).isNotNull()).select(key).orderBy(key).limit(most).agg(F.max(key), F.count("*")).first()
        rows = make(docs.where(F.col(key) <= last[0])) if last[0] is not None else make(docs)
        if last[1] < most or rows.limit(n).count() == n:
            return rows
        most *= 8


def inspected(features: DataFrame, order: list[str], n: int, head: int = 12) -> DataFrame:
    """The first n feature rows with the heads of their arrays, as text, and the arrays' lengths."""
    arrays = [f.name for f in features.schema if f.dataType.typeName() == "array"]
    shown = [F.array_join(F.slice(c, 1, head).cast("array<string>"), " ").alias(c) for c in arrays]
    return features.orderBy(*order).limit(n).select(*order, *shown, F.size(arrays[0]).alias("length"), "label_len")
