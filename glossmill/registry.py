"""Queries of the core operators over the tables of one data folder. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import numeric as num
from .functions import words as wd
from .functions.text import tokens
from .operators import averaging, dataset, metrics, packing, scoring, sentences, splits, tagging
from .plans import corpus
from .plans.running import numbered
from .plans.settings import Settings
from .plans.shared import once, scratch, spread
from .sources import files, writers
from .sources.tables import table
from .streaming import resumable

#: Parameters of the queries, and the vocabulary file of a public tokenizer.
LENGTH, CHUNK, CAP, PIECES = 60, packing.FixedChunk(4), 400, "/opt/tokenizers/piece_bpe_32k.model"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"))


def _train(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "train"))


def _split_tables(s: SparkSession, d: str) -> DataFrame:
    out = [table(s, d, n).select("sent_id", "split", "source", "text") for n in ("train", "dev", "test")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of all documents."""
    return _docs(s, d).select(F.explode(tokens("text")).alias("token")).distinct()


def _words(s: SparkSession, d: str) -> DataFrame:
    return _tokens(s, d).select(wd.split_word("token")["word"].alias("word")).distinct()


def _puncts(s: SparkSession, d: str) -> DataFrame:
    return _tokens(s, d).select(wd.split_word("token")["punct"].alias("punct")).distinct()


def _tagged(s: SparkSession, d: str) -> DataFrame:
    """Distinct words of tagger responses with their tags, once with a sign after the tag and once before it."""
    t = table(s, d, "tagger_response").select(F.explode("tokens").alias("t")).where("t.type = 'WORD' and t.mi is not null")
    forms = F.array(F.concat("t.string", F.lit("(="), "t.mi", F.lit("),")), F.concat("t.string", F.lit(".(="), "t.mi", F.lit(")")), F.col("t.string"))
    return t.select(F.explode(forms).alias("token")).distinct()


def _grouped(s: SparkSession, d: str) -> DataFrame:
    return sentences.group_sentences(table(s, d, "tagger_response"))


def _sentences_of(docs: DataFrame) -> DataFrame:
    return sentences.split_sentences(docs).select("doc_id", F.col("sent_no").alias("sent"), F.col("sentence").alias("text"))


def _doc_sentences(s: SparkSession, d: str) -> DataFrame:
    return _sentences_of(_docs(s, d))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of all documents, written to text files and read from them."""
    path = scratch(s, "lines")
    writers.write_text(table(s, d, "documents").where("text is not null"), path)
    return files.text_lines(s, path)


def _places(keyed: DataFrame) -> DataFrame:
    """(sent_id, place) of rows in the order of their partitions and within them, as they would be read."""
    return numbered(keyed.withColumnRenamed("place", "_at"), ["_at"], name="place").select("sent_id", "place")


def _pack(s: SparkSession, d: str, carry: bool, flush: bool, lower: bool, drop: bool) -> DataFrame:
    words = packing.tokenized(_doc_sentences(s, d), "doc_id", "sent", "text", CHUNK, lower)
    if drop:
        words = packing.without_long(words, "doc_id", "sent", LENGTH)
    rows = packing.packed(words, "doc_id", "sent", LENGTH, carry, flush).withColumn("n", F.size("ids"))
    return rows.groupBy("doc_id", "row").agg(
        F.sum("n").cast("long").alias("tokens"), F.count_if(F.col("n") > 0).alias("labels"), F.min("sent").alias("first_sent"), F.max("sent").alias("last_sent")
    )


def _features_of(docs: DataFrame) -> DataFrame:
    return corpus.make_features(_sentences_of(docs), "doc_id", "sent", Settings(length=LENGTH), CHUNK)


def _features(s: SparkSession, d: str) -> DataFrame:
    return _features_of(_docs(s, d))


def _feature_batches(s: SparkSession, d: str) -> DataFrame:
    """Written features as the four workers of two ranks read them in epoch 3."""
    path = scratch(s, "features")
    _features(s, d).write.parquet(path)
    return dataset.epoch_batches(s.read.parquet(path), ["doc_id", "row"], 2, 2, 8, 7, 3).select("doc_id", "row", "shard", "batch_no", "batch_pos")


def _sentence_arrays(s: SparkSession, d: str) -> DataFrame:
    """(sent_id, ids, valid, cases, puncts) of each training sentence, without ends."""
    w = F.filter(F.transform(tokens("text"), lambda t: F.struct(F.lower(wd.split_word(t)["word"]).alias("w"), wd.case_id(wd.split_word(t)["word"]).alias("c"), wd.punctuation_id(wd.split_word(t)["punct"]).alias("p"))), lambda x: x["w"] != "")
    rows = once(_train(s, d).where("text is not null").select("sent_id", "text"), w=w)
    rows = once(rows, i=F.transform("w", lambda x: CHUNK.encode(x["w"])))
    flags = F.flatten(F.transform("i", packing.valid_flags))
    return once(rows.select("sent_id", "w", "i"), ids=F.flatten("i"), valid=flags, cases=F.transform("w", lambda x: x["c"]), puncts=F.transform("w", lambda x: x["p"])).drop("w", "i")


def _text(a) -> F.Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.withColumn("v", F.transform("embedding", lambda x: x.cast("double")))


def _elements(rows: DataFrame, a) -> DataFrame:
    return rows.select("vec_id", F.posexplode(a).alias("idx", "value")).withColumn("value", F.round("value", 6))


def _neighbors(s: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    at = lambda i: F.get(w, F.greatest(F.lit(0), F.least(i, F.size(w) - 1)))
    pairs = F.transform(w, lambda x, i: F.struct(i.alias("pos"), at(i - 1).alias("previous"), x.alias("word"), at(i + 1).alias("next")))
    return _train(s, d).select("sent_id", tokens("text").alias("w")).select("sent_id", F.inline(pairs))


def _losses(s: SparkSession, d: str) -> DataFrame:
    v, y = F.col("v"), F.col("label").cast("int")
    case = num.cross_entropy(F.slice(v, 1, 3), y % 3)
    punct = num.cross_entropy(F.slice(v, 4, 6), y % 6)
    return _vectors(s, d).select("vec_id", F.round(case, 6).alias("case_loss"), F.round(punct, 6).alias("punct_loss"), F.round(case + 0.7 * punct, 6).alias("loss"))


def _schedule(s: SparkSession, d: str) -> DataFrame:
    b = s.range(0, 20000, 100).select(F.col("id").alias("batch"), F.floor(F.col("id") / 2500).alias("epoch"))
    bd, ed = F.col("batch").cast("double"), F.col("epoch").cast("double")
    return b.select("batch", "epoch", F.round(num.eden(0.003, bd, ed, 5000.0, 6.0), 9).alias("eden"), F.round(num.eden2(0.04, bd, 5000.0), 9).alias("eden2"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    base = scratch(s, "stream")
    return resumable.clean_new(s, f"{d}/train*.parquet", f"{base}/out", f"{base}/state", _train(s, d).schema.simpleString()[7:-1].replace(":", " "), "any").select("sent_id", "text")


def _subwords(s: SparkSession, d: str) -> DataFrame:
    w = _words(s, d).where("word <> ''").select(F.lower("word").alias("word")).distinct()
    ids = packing.SentencePiece(PIECES).encode(F.col("word"))
    return w.select("word", F.size(ids).alias("pieces"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return scoring.scored(_features(s, d), ["doc_id", "row"], scoring.HashScorer()).groupBy("case_id", "punct_id").agg(F.count("*").alias("n"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return sentences.judged(_train(s, d).select("sent_id", "text"), "text", "any")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    c = F.col
    tag = lambda s, d: _tagged(s, d).withColumn("p", wd.parse_word("token"))
    counts = lambda s, d: metrics.label_counts(table(s, d, "prediction_pair"))
    return {
        # scans
        "scan_text": lambda s, d: files.text_rows(s, f"{d}/parquet_keeper.parquet"),
        "count_rows": lambda s, d: s.createDataFrame([(files.row_count(s, f"{d}/parquet_keeper.parquet"),)], "n long"),
        "text_lines": _lines,
        "shard_sizes": lambda s, d: dataset.shard_sizes(_train(s, d), 3),
        "inspect_features": lambda s, d: dataset.inspected(dataset.first_features(table(s, d, "documents"), "doc_id", 20, _features_of), ["doc_id", "row"], 20),
        "feature_batches": _feature_batches,
        "limit_read": lambda s, d: numbered(table(s, d, "parquet_keeper").select("row_id", "text"), ["row_id"]).where("row_no < 100"),
        "feature_slice": lambda s, d: numbered(_train(s, d).select("sent_id", "text"), ["sent_id"]).where("row_no between 10 and 29"),
        "limit_rows": lambda s, d: files.exported(_train(s, d), limit=50, key="sent_id"),
        # words
        "tokenize": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.size(tokens("text")).cast("long").alias("n"), F.array_join(tokens("text"), " ").alias("words")),
        "split_word_punct": lambda s, d: _tokens(s, d).select("token", wd.split_word("token").alias("s")).select("token", "s.*"),
        "parse_word_tag": lambda s, d: tag(s, d).select("token", "p.*"),
        "render_word_tag": lambda s, d: tag(s, d).select("token", wd.render_word(c("p.word"), c("p.punct"), c("p.mi")).alias("rendered")),
        "case_label": lambda s, d: _words(s, d).select("word", wd.case_id("word").alias("case_id")),
        "mixed_case": lambda s, d: _words(s, d).select("word", wd.mixed_case("word").alias("mixed")),
        "punct_label": lambda s, d: _puncts(s, d).select("punct", wd.punctuation_id("punct").alias("punct_id")),
        "label_names": lambda s, d: _puncts(s, d).select("punct", wd.named(wd.punctuation_id("punct"), wd.PUNCTUATION_NAMES).alias("name")),
        "label_sentence": lambda s, d: _train(s, d).where("text is not null").select("sent_id", wd.labelled("text").alias("w")).select(
            "sent_id", F.array_join(F.transform("w", lambda x: x["word"]), "|").alias("words"), _text(F.transform("w", lambda x: x["case_id"])).alias("cases"), _text(F.transform("w", lambda x: x["punct_id"])).alias("puncts")
        ),
        "lower_corpus": lambda s, d: corpus.lowered(_train(s, d)).select("sent_id", "text"),
        "drop_symbols": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", wd.drop_symbols("text").alias("text")),
        "fix_punct": lambda s, d: _puncts(s, d).select("punct", wd.fixed_punctuation("punct").alias("fixed")),
        "upper_counts": lambda s, d: _words(s, d).select("word", wd.upper_count("word").cast("long").alias("uppers")),
        "has_num": lambda s, d: _words(s, d).select("word", wd.has_number("word").alias("has_num")),
        "allowed_symbols": lambda s, d: _words(s, d).select("word", wd.allowed_symbols("word").alias("lt"), wd.allowed_symbols("word", "any").alias("any_letters")),
        "allowed_punct": lambda s, d: _tokens(s, d).select(wd.split_word("token").alias("s")).select("s.*").distinct().select("word", "punct", wd.allowed_punctuation("word", "punct").alias("allowed")),
        # tagger responses
        "tag_sentences": lambda s, d: sentences.group_sentences(tagging.tagged(spread(table(s, d, "parquet_keeper")), tagging.LocalTagger()).withColumn("received_at", F.lit(None).cast("timestamp"))).select("row_id", "sentence"),
        "annotate_tokens": lambda s, d: table(s, d, "tagger_response").where("tokens is not null").select("row_id", "chunk_no", F.array_join(F.transform("tokens", sentences.annotated), "").alias("line")),
        "group_sentences": lambda s, d: _grouped(s, d).select("row_id", "chunk_no", "sent_no", "sentence"),
        "fix_case": lambda s, d: sentences.repair_case(_grouped(s, d)).select("row_id", "chunk_no", "sent_no", "fixed"),
        "skip_reason": lambda s, d: _grouped(s, d).select(F.explode(sentences.parsed("sentence")).alias("w")).select("w.*").distinct().withColumn("reason", wd.skip_reason(c("word"), c("punct"), c("mi"))),
        "tagged_corpus": lambda s, d: corpus.tagged_sentences(table(s, d, "tagger_response"), Settings()),
        # sentences
        "sentence_split": lambda s, d: sentences.split_sentences(_docs(s, d)),
        "attach_punct": lambda s, d: _train(s, d).where("text is not null").select("sent_id", sentences.joined(sentences.attach_punctuation(sentences.parsed(wd.drop_symbols("text")))).alias("line")),
        "sentence_ok": lambda s, d: _judged(s, d).select("sent_id", "ok"),
        "clean_corpus": lambda s, d: corpus.clean_sentences(_docs(s, d), Settings()),
        "clean_counts": lambda s, d: _judged(s, d).agg(F.count("*").alias("lines"), F.count_if(F.expr("ok and not short")).alias("kept"), F.count_if(F.expr("ok and short")).alias("short"), F.count_if(F.expr("not ok")).alias("skipped")),
        "stream_clean": _stream,
        # splits, order, batches
        "split_hash": lambda s, d: splits.split_hash(_train(s, d), "sent_id").select("sent_id", "part"),
        "split_capped": lambda s, d: splits.split_capped(_train(s, d), "sent_id", CAP).select("sent_id", "part"),
        "split_counts": lambda s, d: splits.split_counts(_split_tables(s, d), "split"),
        "shard_modulo": lambda s, d: dataset.sharded(_train(s, d).select("sent_id"), ["sent_id"], 3, 2),
        "epoch_shuffle": lambda s, d: dataset.shuffled(_train(s, d).select("sent_id"), "sent_id", 7, 1).select("sent_id", F.monotonically_increasing_id().alias("place")).transform(_places),
        "batching": lambda s, d: dataset.batched(_train(s, d).select("sent_id"), ["sent_id"], 128),
        "sort_by_length": lambda s, d: dataset.by_length(_train(s, d).select("sent_id", "text"), ["sent_id"], 128, F.coalesce(F.size(tokens("text")), F.lit(0))).select("sent_id", "batch_no", "rank"),
        # packing
        "piece_counts": lambda s, d: _words(s, d).where("word <> ''").select("word", F.size(CHUNK.encode(c("word"))).alias("pieces")),
        "subword_counts": _subwords,
        "drop_long_sentences": lambda s, d: packing.without_long(packing.tokenized(_doc_sentences(s, d), "doc_id", "sent", "text", CHUNK), "doc_id", "sent", LENGTH).groupBy("doc_id", "sent").agg(F.sum(F.size("ids")).cast("long").alias("tokens")),
        "pack_sequences": lambda s, d: _pack(s, d, carry=False, flush=False, lower=True, drop=True),
        "pack_with_carry": lambda s, d: _pack(s, d, carry=True, flush=False, lower=True, drop=True),
        "pack_inference": lambda s, d: _pack(s, d, carry=False, flush=True, lower=False, drop=False),
        "features": lambda s, d: _features(s, d).select("doc_id", "row", *[_text(c(a)).alias(a) for a in ("token_ids", "case_labels", "punct_labels", "valid_ids", "token_masks", "label_masks")], "label_len"),
        "pad_features": lambda s, d: _sentence_arrays(s, d).where(F.size("ids") < LENGTH - packing.MARGIN).select("sent_id", *[x if i == 6 else _text(x).alias(n) for i, (x, n) in enumerate(zip(packing.padded(c("ids"), c("valid"), c("cases"), c("puncts"), LENGTH), ("token_ids", "case_labels", "punct_labels", "valid_ids", "token_masks", "label_masks", "label_len")))]),
        "active_mask": lambda s, d: _sentence_arrays(s, d).select("sent_id", _text(packing.active_positions(F.concat(F.array(F.lit(1)), "valid", F.array(F.lit(1))))).alias("active")),
        "nonpad_mask": lambda s, d: _features(s, d).select("doc_id", "row", _text(packing.nonpad_mask(c("token_ids"))).alias("mask")),
        "embedding_lookup": lambda s, d: packing.embedded(_sentence_arrays(s, d).select("sent_id", F.posexplode("ids").alias("pos", "id")).select("sent_id", "pos", (c("id") % 600).alias("token")), table(s, d, "embeddings"), "token", "vec_id", "embedding").select("sent_id", "pos", "token", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first")),
        "compact_valid": lambda s, d: _sentence_arrays(s, d).select("sent_id", _text(packing.compacted(c("ids"), c("valid"))).alias("compacted")),
        "score_features": _scored,
        "punctuate_text": lambda s, d: corpus.punctuated(_docs(s, d), Settings(length=LENGTH), CHUNK, scoring.HashScorer()),
        "render_sentence": lambda s, d: scoring.rendered_sentences(_train(s, d).select("sent_id", F.posexplode(wd.labelled("text")).alias("pos", "w")).select("sent_id", "pos", "w.*"), ["sent_id"]),
        # statistics and evaluation
        "corpus_totals": lambda s, d: metrics.corpus_totals(_docs(s, d)),
        "punct_distribution": lambda s, d: metrics.distribution(_docs(s, d), "punct_id"),
        "case_distribution": lambda s, d: metrics.distribution(_docs(s, d), "case_id"),
        "label_counts": counts,
        "label_counts_dedup": lambda s, d: metrics.label_counts(metrics.latest(table(s, d, "prediction_pair"))),
        "prf_by_label": lambda s, d: metrics.scores(counts(s, d)),
        "prf_overall": lambda s, d: metrics.overall(counts(s, d)),
        "progress_totals": lambda s, d: resumable.progress(table(s, d, "run_state")),
        # training figures and arithmetic
        "vector_mean": lambda s, d: averaging.vector_mean(table(s, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6)),
        "parameter_count": lambda s, d: averaging.parameter_count(table(s, d, "embeddings"), "embedding"),
        "ema": lambda s, d: averaging.ema(table(s, d, "events"), "user_id", ["ts", "event_id"], c("value"), 1 / 20).withColumn("ema", F.round("ema", 6)),
        "best_so_far": lambda s, d: averaging.best_so_far(table(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss")), "event_type", "day", "loss"),
        "argmax": lambda s, d: _vectors(s, d).select("vec_id", num.argmax("v").alias("idx")),
        "softmax": lambda s, d: _elements(_vectors(s, d), num.softmax("v")),
        "layer_norm": lambda s, d: _elements(_vectors(s, d), num.layer_norm("v")),
        "cross_entropy": _losses,
        "masked_loss": lambda s, d: _vectors(s, d).groupBy("label").agg(F.round(num.masked_mean(num.cross_entropy(F.slice("v", 1, 3), c("label").cast("int") % 3), F.when(c("vec_id") % 7 == 0, 0).otherwise(1)), 6).alias("loss")),
        "neighbor_pair": _neighbors,
        "eden_schedule": _schedule,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.sql(LENGTH, CHUNK.size, CHUNK.vocabulary, CAP)


