"""Deterministic train/dev/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.running import running


def draw(key: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key and seed only, so any partitioning gives the same split."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}-"), c.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def split_hash(rows: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """`rows` with `part`: dev and test get `share` of the keys each."""
    u = draw(key, seed)
    return rows.withColumn("part", F.when(u < share, "dev").when(u < 2 * share, "test").otherwise("train"))


def split_capped(rows: DataFrame, key: str, cap: int, share: float = 0.05, seed: int = 42, text: str = "text") -> DataFrame:
    """`rows` with `part`, where dev and test take rows in key order until they hold `cap` words (the last one may pass it).

    Rows drawn for a full dev go to test while that has room, and to train after that. Null texts are dropped.
    """
    base = rows.where(F.col(text).isNotNull()).withColumns({"_u": draw(key, seed), "_words": F.size(tokens(text)).cast("long")})
    drawn = base.where(F.col("_u") < 2 * share)
    low = F.col("_u") < share
    dev = running(drawn.select(key, "_u", "_words"), [key], _before=F.when(low, F.col("_words")).otherwise(0))
    marked = dev.withColumn("_dev", low & (F.col("_before") < cap)).drop("_before")
    test = running(marked, [key], _before=F.when(F.col("_dev"), 0).otherwise(F.col("_words")))
    part = F.when(F.col("_dev"), "dev").when(F.col("_before") < cap, "test").otherwise("train")
    picked = test.select(F.col(key).alias("_key"), part.alias("_part"))
    both = base.join(picked, base[key] == picked["_key"], "left")
    return both.withColumn("part", F.coalesce("_part", F.lit("train"))).drop("_key", "_part", "_u", "_words")


def split_counts(rows: DataFrame, part: str, text: str = "text") -> DataFrame:
    """(part, lines, words); null texts aren't counted."""
    n = F.size(tokens(text)).cast("long")
    return rows.where(F.col(text).isNotNull()).groupBy(part).agg(F.count("*").alias("lines"), F.sum(n).alias("words"))
