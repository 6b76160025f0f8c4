"""The corpus pipeline: tagger responses or documents to split, labelled and packed features, as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.words import lower_line
from ..operators import packing, scoring, sentences, splits
from .settings import Settings
from .shared import cut


def clean_sentences(docs: DataFrame, settings: Settings, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_no, text): the usable sentences of documents, repaired. One scan, no shuffle."""
    rows = sentences.split_sentences(docs, id_col).withColumnRenamed("sentence", "text")
    return sentences.cleaned(rows, "text", settings.alphabet)


def tagged_sentences(responses: DataFrame, settings: Settings) -> DataFrame:
    """(row_id, chunk_no, sent_no, text): the usable sentences of tagger responses, casing and signs repaired, tags dropped."""
    rows = sentences.repair_case(sentences.group_sentences(responses))
    return sentences.cleaned(rows.select("row_id", "chunk_no", "sent_no", F.col("fixed").alias("text")), "text", settings.alphabet)


def split_corpus(rows: DataFrame, key: str, settings: Settings) -> DataFrame:
    return splits.split_capped(rows, key, settings.max_words, settings.share, settings.seed)


def lowered(rows: DataFrame, text: str = "text") -> DataFrame:
    """Lines for training a subword model; empty ones are dropped."""
    out = rows.where(F.col(text).isNotNull()).withColumn(text, lower_line(text))
    return out.where(F.col(text) != "")


def make_features(rows: DataFrame, group: str, sent: str, settings: Settings, tokenizer, carry: bool = True, flush_tail: bool = False) -> DataFrame:
    """Feature rows of sentences, packed within each group."""
    words = packing.without_long(packing.tokenized(rows, group, sent, "text", tokenizer), group, sent, settings.length)
    return packing.features(packing.packed(words, group, sent, settings.length, carry, flush_tail), group, sent, settings.length)


def punctuated(docs: DataFrame, settings: Settings, tokenizer, scorer, id_col: str = "doc_id", text: str = "text", legacy: bool = False) -> DataFrame:
    """(id, text): free text with the casing and punctuation that a model gives it.

    Words are packed without carry, the last row too, and scored in Arrow batches; labels find their words by row and
    position. Words without tokens are left out, and a text without words has no row.
    """
    sents = docs.where(F.col(text).isNotNull()).select(id_col, F.lit(0).alias("sent"), F.col(text).alias("text"))
    words = packing.tokenized(sents, id_col, "sent", "text", tokenizer)
    rows = cut(packing.packed(words.where(F.size("ids") > 0), id_col, "sent", settings.length, carry=False, flush_tail=True), "inference-words")
    labels = scoring.scored(packing.features(rows, id_col, "sent", settings.length), [id_col, "row"], scorer)
    place = F.row_number().over(W.partitionBy(id_col, "row").orderBy("sent", "pos")) - 1
    known = rows.select(id_col, "row", "pos", "word", place.alias("label_pos")).join(labels, [id_col, "row", "label_pos"])
    return scoring.rendered_sentences(known, [id_col], legacy)


def train_subwords(lines: DataFrame, prefix: str, settings: Settings, sentences_at_most: int = 10_000_000, text: str = "text") -> str:
    """A SentencePiece unigram model over at most `sentences_at_most` lines (those with the smallest digests), trained on the
    driver from a stream of them. Returns the path of the model file."""
    import sentencepiece

    rows = lines.select(text, F.xxhash64(text, F.lit(settings.seed)).alias("_h")).orderBy("_h").limit(sentences_at_most)
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=(r[text] for r in rows.toLocalIterator()),
        model_prefix=prefix,
        vocab_size=settings.vocabulary,
        model_type="unigram",
        character_coverage=1.0,
        user_defined_symbols=[],
        control_symbols=["<blk>", "<s>", "</s>"],
        bos_id=-1,
        eos_id=-1,
        unk_id=3,
        pad_id=-1,
        hard_vocab_limit=False,
    )
    return f"{prefix}.model"
