"""Sizes of texts in tokens of a public tokenizer, and exact ranks without large groups."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..plans.shared import broadcast_if_small, cut

#: Where the vocabulary files lie on every executor, and the one that is used.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Rows that one task ranks at most.
RANK_ROWS = 50_000


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = f"{FOLDER}/{VOCABULARY}") -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    def count(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)


def sized(docs: DataFrame, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, tokens) of every document, written once: sizes are needed for the plan and for its execution."""
    return cut(docs.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens")), "sizes")


def planned(spark: SparkSession, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """A plan made on the driver as a written table: its size is known then, so it is broadcast only if it is small."""
    return broadcast_if_small(cut(spark.createDataFrame(rows, schema).coalesce(1), name))


def ranked(items: DataFrame, keys: list[str], order: list[str], largest: int) -> DataFrame:
    """`items` with `rank`, counting from 0 within `keys`.

    Rows of one key are spread over hash buckets of about RANK_ROWS rows (`largest` is the size of the largest key);
    ranks within a bucket are shifted by the counts of the buckets before it.
    """
    buckets = max(1, -(-largest // RANK_ROWS))
    spread = items.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    if buckets == 1:
        return items.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    counts = spread.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_b", before.alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)).cast("long") - 1
    return spread.withColumn("_own", own).join(offsets, [*keys, "_b"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")
