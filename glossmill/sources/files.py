"""Scans of text shards, text lines and feature files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, squeeze

# Lines of one example in the older text format of features.
FIELDS = ("token_ids", "case_labels", "punct_labels", "valid_ids", "token_masks", "label_masks", "label_len")


def text_rows(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """The non-null texts of a Parquet file or of a folder of them. Only that column is read.

    Raises ValueError for a path without Parquet files and for a missing column.
    """
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"no Parquet files at {path}") from e
    if field not in rows.columns:
        raise ValueError(f"{path} has no column {field}, only {', '.join(rows.columns)}")
    return rows.select(F.col(field).cast("string").alias(field)).where(F.col(field).isNotNull())


def row_count(spark: SparkSession, path: str) -> int:
    """All rows, nulls included. Only file footers are read, as the count is pushed down to the second-version source."""
    push, first = "spark.sql.parquet.aggregatePushdown", "spark.sql.sources.useV1SourceList"
    before = {k: spark.conf.get(k) for k in (push, first)}
    spark.conf.set(push, "true")
    spark.conf.set(first, ",".join(s for s in before[first].split(",") if s != "parquet"))
    try:
        return spark.read.parquet(path).agg(F.count("*")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-empty lines of text files, without white space at their ends."""
    lines = spark.read.text(path).select(squeeze_ends("value").alias("text"))
    return lines.where(F.col("text") != "")


def squeeze_ends(c: str):
    return F.regexp_replace(F.col(c), r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", "")


def exported(rows: DataFrame, field: str = "text", limit: int | None = None, key: str | None = None) -> DataFrame:
    """Texts to write: the non-null ones, at most `limit` of them (those with the smallest keys if a key is given)."""
    kept = rows.where(F.col(field).isNotNull())
    if limit is not None:
        kept = (kept.orderBy(key) if key else kept).limit(limit)
    return kept.select(field)


def legacy_features(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Feature rows of a text file with seven lines an example. Lengths and 0 < label_len <= length are asserted.

    Lines are numbered by their place in the file, so the file must be one that isn't split (`wholetext`).
    """
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\n\s*$", ""), "\n").alias("l"))
    n = F.floor(F.size("l") / len(FIELDS)).cast("int")
    ints = lambda s: F.transform(F.filter(F.split(s, r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    rows = whole.select(F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("l", i * len(FIELDS) + 1, F.lit(len(FIELDS))))).alias("row", "e"))
    out = rows.select("row", *[ints(F.get("e", F.lit(k))).alias(f) for k, f in enumerate(FIELDS)])
    out = out.withColumn("label_len", F.get("label_len", F.lit(0)))
    bad = F.col("label_len").isNull() | (F.col("label_len") <= 0) | (F.col("label_len") > length)
    for f in FIELDS[:-1]:
        bad |= F.size(f) != length
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad feature row "), F.col("row").cast("string")))).otherwise(F.col("label_len"))
    return out.withColumn("label_len", checked.cast("int"))


def blank_free(rows: DataFrame, field: str = "text") -> DataFrame:
    return rows.where(~is_blank(field)).withColumn(field, squeeze(field))
