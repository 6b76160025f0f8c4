"""Corpus statistics and evaluation of predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_blank, tokens
from ..functions.words import CASE_NAMES, PUNCTUATION_NAMES, WORD_CHARS, case_id, named, punctuation_id, split_word


def corpus_totals(rows: DataFrame, text: str = "text") -> DataFrame:
    """(sentences, words): lines that aren't blank, and their words with a letter or digit first."""
    words = F.size(F.filter(tokens(text), lambda t: t.rlike(f"^[{WORD_CHARS}]"))).cast("long")
    kept = rows.where(~is_blank(text))
    return kept.agg(F.count("*").alias("sentences"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("words"))


def distribution(rows: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(name, n, share) of the casing (`case_id`) or punctuation (`punct_id`) labels of all words. share is of all, in per cent."""
    names = CASE_NAMES if label == "case_id" else PUNCTUATION_NAMES
    # Exploded first: the label is then computed in generated code, and only the one that is asked for.
    words = rows.select(F.explode(tokens(text)).alias("token")).where(F.col("token").rlike(f"^[{WORD_CHARS}]"))
    parts = split_word("token")
    found = case_id(parts["word"]) if label == "case_id" else punctuation_id(parts["punct"])
    counts = words.groupBy(found.alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    both = counts.join(F.broadcast(total))  # one row
    return both.select(named("label", names).alias("name"), "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


def observed(rows: DataFrame, /, **metrics: Column) -> tuple[DataFrame, Observation]:
    """`rows`, and where its metrics stand once they have been read: figures of a run without a second pass."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def write_metrics(frame: DataFrame, path: str, run: str) -> None:
    """Append metrics as JSON lines with their run and time."""
    frame.select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), *frame.columns).write.mode("append").json(path)


def latest(pairs: DataFrame) -> DataFrame:
    """One row for each (sent_id, word_pos, head): the one scored last, so positions scored twice count once."""
    last = pairs.groupBy("sent_id", "word_pos", "head").agg(F.max(F.struct("scored_at", "predicted", "expected")).alias("p"))
    return last.select("sent_id", "word_pos", "head", "p.scored_at", "p.predicted", "p.expected")


def label_counts(pairs: DataFrame) -> DataFrame:
    """(head, label, predicted, expected, correct). A null prediction counts as expected only; labels come from both sides.

    Both sides of a pair are counted in one pass: each pair gives two rows of a label, combined before the shuffle.
    """
    hit = F.when(F.col("predicted") == F.col("expected"), 1).otherwise(0)
    sides = F.array(
        F.struct(F.col("predicted").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("e"), hit.alias("c")),
        F.struct(F.col("expected").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("e"), F.lit(0).alias("c")),
    )
    rows = pairs.select("head", F.inline(sides)).where("label is not null")
    return rows.groupBy("head", "label").agg(F.sum("p").alias("predicted"), F.sum("e").alias("expected"), F.sum("c").alias("correct"))


def scores(counts: DataFrame) -> DataFrame:
    """Per label: precision (null if never predicted), recall (null if never expected), F1 (null if precision is null or 0)."""
    p = F.col("correct") / F.nullif("predicted", F.lit(0))
    r = F.col("correct") / F.nullif("expected", F.lit(0))
    f = F.when(p > 0, F.when(r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return counts.select("head", "label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def overall(counts: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over the labels above 0 that are expected at least once; 0 where nothing is there."""
    kept = counts.groupBy("head").agg(*[F.sum(F.when((F.col("label") > 0) & (F.col("expected") > 0), F.col(c)).otherwise(0)).alias(c) for c in ("predicted", "expected", "correct")])
    p = F.coalesce(F.col("correct") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("correct") / F.nullif("expected", F.lit(0)), F.lit(0.0))
    f = F.when(r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return kept.select("head", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))
