"""Words as tokens, packed into feature rows of a fixed length."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import tokens
from ..functions.words import case_id, punctuation_id, split_word
from ..plans.shared import broadcast_if_small

# Ids of the special tokens, and by how much a sentence must be shorter than a row.
PAD, BOS, EOS, FIRST_ID, MARGIN = 0, 1, 2, 4, 10


@dataclass(frozen=True)
class FixedChunk:
    """A tokenizer that SQL can follow: pieces of `size` characters, ids from their digest."""

    size: int = 4
    vocabulary: int = 5000

    def encode(self, word: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.char_length(word) / self.size).cast("int") - 1)
        ids = F.transform(starts, lambda i: FIRST_ID + F.conv(F.substring(F.md5(F.substr(word, i * self.size + 1, F.lit(self.size))), 1, 6), 16, 10).cast("int") % self.vocabulary)
        return F.when(word != "", ids).otherwise(F.array().cast("array<int>"))


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass(frozen=True)
class SentencePiece:
    """A SentencePiece model file, loaded once in each Python worker; words are encoded in Arrow batches."""

    path: str

    def encode(self, word: Column) -> Column:
        path = self.path
        return F.pandas_udf(lambda s: pd.Series(_pieces(path).encode([x or "" for x in s], num_threads=1)), T.ArrayType(T.IntegerType()))(word)


def tokenized(sentences: DataFrame, group: str, sent: str, text: str, tokenizer, lower: bool = True) -> DataFrame:
    """(group, sent, pos, word, case_id, punct_id, ids): the words of each sentence with their tokens."""
    rows = sentences.select(group, sent, F.posexplode(tokens(text)).alias("pos", "token"))
    parts = rows.select(group, sent, "pos", split_word("token").alias("s"))
    shown = F.lower("s.word") if lower else F.col("s.word")
    words = parts.select(group, sent, "pos", shown.alias("word"), case_id("s.word").alias("case_id"), punctuation_id("s.punct").alias("punct_id"))
    return words.withColumn("ids", tokenizer.encode(F.col("word")))


def without_long(words: DataFrame, group: str, sent: str, length: int) -> DataFrame:
    """Words of sentences of fewer than length - MARGIN tokens. Rows are laid out by group, as packing needs them next."""
    n = F.sum(F.size("ids")).over(W.partitionBy(group, sent))
    return words.repartition(group).withColumn("_n", n).where(F.col("_n") < length - MARGIN).drop("_n")


def fold(sents: list[int], positions: list[int], sizes: list[int], length: int, carry: bool) -> list[int]:
    """The row in which each word of a group first lands, filling rows of length - 1 tokens greedily and never splitting
    a word. With `carry`, a row that begins inside a sentence repeats that sentence from its start."""
    out, used, row, own, sent = [], 1, 0, 0, None
    for s, p, n in zip(sents, positions, sizes):
        first = s != sent
        if used + n > length - 1:
            row += 1
            used = 1 + (own if carry and not first else 0)
        own = n if first else own + n
        sent = s
        used += n
        out.append(row)
    return out


_PLACE = T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def packed(words: DataFrame, group: str, sent: str, length: int, carry: bool = True, flush_tail: bool = False) -> DataFrame:
    """`words`, repeated as carried over, with the `row` they are in. Without `flush_tail` each group's last row is dropped.

    Groups are packed apart, in the order of (sent, pos); a group should be of a document's size. Words stay in their
    group's array until they are placed, so there is one shuffle and no join.
    """
    rest = [c for c in words.columns if c not in (group, sent, "pos")]
    grouped = words.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(sent, "pos", *rest))).alias("w"))

    def place(sents: pd.Series, positions: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for s, p, n in zip(sents, positions, sizes):
            rows = fold(s, p, n, length, carry)
            last = dict(zip(s, rows))  # rows only grow, so the last one stays
            out.append([(r, last[x] if carry else r) for x, r in zip(s, rows)])
        return pd.Series(out)

    take = lambda f: F.transform("w", f)
    at = F.pandas_udf(place, _PLACE)(take(lambda x: x[sent]), take(lambda x: x["pos"]), take(lambda x: F.size(x["ids"])))
    rows = grouped.select(group, "w", at.alias("at")).withColumn("end", F.element_at("at", -1)["row"])
    flat = rows.select(group, "end", F.explode(F.arrays_zip("w", "at")).alias("z"))
    spread = flat.select(group, "end", "z.w.*", F.explode(F.sequence("z.at.row", "z.at.last")).alias("row"))
    kept = spread if flush_tail else spread.where("row < end")
    return kept.select(*words.columns, "row")


def padded(ids: Column, valid: Column, cases: Column, puncts: Column, length: int) -> list[Column]:
    """The seven columns of a feature row from arrays without the ends and the padding."""
    fill = lambda a: F.concat(a, F.array_repeat(F.lit(PAD), length - F.size(a)))
    ends = lambda a, x, y: F.concat(F.array(F.lit(x)), a, F.array(F.lit(y)))
    ones = lambda a: fill(F.transform(ends(a, 1, 1), lambda _: F.lit(1)))
    return [
        fill(ends(ids, BOS, EOS)).alias("token_ids"),
        fill(ends(cases, 0, 0)).alias("case_labels"),
        fill(ends(puncts, 0, 0)).alias("punct_labels"),
        fill(ends(valid, 1, 1)).alias("valid_ids"),
        ones(ids).alias("token_masks"),
        ones(cases).alias("label_masks"),
        (F.size(cases) + 2).alias("label_len"),
    ]


def valid_flags(ids: Column) -> Column:
    """1 for the first token of a word, 0 for the others."""
    return F.transform(ids, lambda x, i: F.when(i == 0, 1).otherwise(0))


def features(rows: DataFrame, group: str, sent: str, length: int) -> DataFrame:
    """Feature rows (group, row, token_ids, case_labels, punct_labels, valid_ids, token_masks, label_masks, label_len).

    Words without tokens give neither token nor label.
    """
    word = F.struct(sent, "pos", "ids", "case_id", "punct_id")
    grouped = rows.where(F.size("ids") > 0).groupBy(group, "row").agg(F.array_sort(F.collect_list(word)).alias("w"))
    take = lambda name: F.transform("w", lambda x: x[name])
    ids, valid = F.flatten(take("ids")), F.flatten(F.transform("w", lambda x: valid_flags(x["ids"])))
    return grouped.select(group, "row", *padded(ids, valid, take("case_id"), take("punct_id"), length))


def active_positions(valid: Column) -> Column:
    """0-based positions that are valid and neither the first (bos) nor the last (eos) valid one."""
    at = valid_positions(valid)
    return F.slice(at, F.lit(2), F.greatest(F.size(at) - 2, F.lit(0)))


def valid_positions(valid: Column) -> Column:
    """0-based positions of valid tokens, in order: where compaction takes its k-th column from."""
    return F.filter(F.transform(valid, lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())


def nonpad_mask(ids: Column) -> Column:
    """1 where a token stands, 0 where a row is padded."""
    return F.transform(ids, lambda x: F.when(x != PAD, 1).otherwise(0))


def embedded(tokens_: DataFrame, vectors: DataFrame, token: str, key: str, vector: str) -> DataFrame:
    """`tokens_` with the vector of each token id; null where the table has none. A vocabulary is small and is sent to every
    task; a larger table is joined by its key."""
    table = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("embedding"))
    return tokens_.join(broadcast_if_small(table), F.col(token) == F.col("_key"), "left").drop("_key")


def compacted(values: Column, valid: Column) -> Column:
    """The values at valid positions moved to the left; the rest is 0."""
    kept = F.transform(valid_positions(valid), lambda i: F.get(values, i))
    return F.concat(kept, F.array_repeat(F.lit(0), F.size(values) - F.size(kept)))
