"""Cleaning a growing folder of text shards, resumable and exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sentences import cleaned


def start_cleaning(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, alphabet: str = "lt", files_per_batch: int = 100) -> StreamingQuery:
    """Clean what is new in `source` since the last run and append it to `target`; then stop.

    The checkpoint folder remembers the files that were read, and the file sink's log which output belongs to them, so
    a run that is killed goes on without losing or repeating rows. `files_per_batch` bounds what is in work at once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = cleaned(rows, "text", alphabet)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd").outputMode("append").trigger(availableNow=True).start()


def clean_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, alphabet: str = "lt") -> DataFrame:
    """All cleaned sentences so far, after reading what is new."""
    start_cleaning(spark, source, target, checkpoint, schema, alphabet).awaitTermination()
    return spark.read.parquet(target)


def progress(states: DataFrame) -> DataFrame:
    """(run_id, saved_at, read_rows, sentences_written, words_written, total_rows): the last saved state of each run.

    Repeated and late checkpoints don't matter: the latest by time counts, and of equal times the furthest.
    """
    s = F.struct("saved_at", "read_rows", "sentences_written", "words_written", "total_rows")
    last = states.groupBy("run_id").agg(F.max(s).alias("s"))
    return last.select("run_id", "s.*")
