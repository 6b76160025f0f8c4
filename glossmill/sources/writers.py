"""Writing text shards, features, splits, text files and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAYS = ("token_ids", "case_labels", "punct_labels", "valid_ids", "token_masks", "label_masks")


def rows_in(rows: DataFrame, size: int, field: str = "text", ratio: float = 0.4) -> int:
    """How many rows a file of `size` bytes holds, by the mean length of all texts and the ratio of their compression."""
    mean = rows.agg(F.avg(F.octet_length(field))).first()[0]
    return max(1, int(size / (ratio * mean))) if mean else 1_000_000


def write_shards(rows: DataFrame, path: str, field: str = "text", rows_per_file: int | None = None, append: bool = False, size: int = 512 * 1024 * 1024) -> None:
    """Text shards in Parquet with zstd. A new file begins every `rows_per_file` rows of a task, by default as many as make
    about `size` bytes (`rows_in`); `append` goes on after the shards that are there. Files appear when the job commits, so
    a failed run leaves none behind."""
    rows_per_file = rows_per_file or rows_in(rows, size, field)
    out = rows.select(field).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    out.mode("append" if append else "errorifexists").parquet(path)


def checked_features(features: DataFrame, length: int) -> DataFrame:
    """The feature rows; a row whose arrays aren't all `length` long, or whose label_len isn't within it, fails the job."""
    good = F.col("label_len").between(1, length)
    for a in ARRAYS:
        good &= F.size(a) == length
    return features.withColumn("label_len", F.when(good, F.col("label_len")).otherwise(F.raise_error(F.lit(f"feature row not of length {length}")).cast("int")))


def write_features(features: DataFrame, path: str, length: int, files: int | None = None) -> None:
    rows = checked_features(features, length).select(*ARRAYS, "label_len")
    (rows.coalesce(files) if files else rows).write.option("compression", "zstd").parquet(path)


def write_splits(rows: DataFrame, path: str, part: str = "part", field: str = "text") -> None:
    """One folder of text files for each part, in one pass."""
    rows.select(part, field).write.partitionBy(part).text(path)


def write_text(rows: DataFrame, path: str, field: str = "text") -> None:
    """Text files, each text with one line break after it; line breaks inside stay."""
    rows.select(F.regexp_replace(field, r"\n+$", "").alias(field)).write.text(path)


def vocabulary(model_path: str, spark) -> DataFrame:
    """(piece, id) of a SentencePiece model: its vocabulary, a small fixed table."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return spark.createDataFrame([(sp.id_to_piece(i), i) for i in range(sp.get_piece_size())], "piece string, id int")


def write_vocabulary(table: DataFrame, path: str) -> None:
    """Lines of `piece id`."""
    table.orderBy("id").coalesce(1).select(F.concat_ws(" ", "piece", F.col("id").cast("string"))).write.text(path)
