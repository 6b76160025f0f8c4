"""From documents and tagger responses to clean sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tokens
from ..functions.words import drop_symbols, fixed_case, fixed_punctuation, parse_word, render_word, usable
from ..plans.shared import once

#: A local stand-in for an external splitter: a run of text that ends in sentence marks.
SENTENCE = r"[^.!?\n]+[.!?]+"
#: Share of a response's tokens that is used when more text follows; a shorter sentence is dropped by cleaning.
USED, LEAST = 0.95, 5


def split_sentences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_no, sentence) by SENTENCE; text after the last mark is dropped, null and empty texts give none."""
    found = F.regexp_extract_all("text", F.lit(SENTENCE), 0)
    return docs.select(id_col, F.posexplode(found).alias("sent_no", "s")).select(id_col, "sent_no", F.trim("s").alias("sentence"))


def annotated(token: Column) -> Column:
    """A tagger token as text: words with a capital, and foreign ones (Dl, De), carry `(=mi)`; line breaks in separators are blanks."""
    s, mi = F.coalesce(token["string"], F.lit("")), F.coalesce(token["mi"], F.lit(""))
    tag = F.concat(F.lit("(="), mi, F.lit(")"))
    word = F.when(s.rlike(r"\p{Lu}"), F.concat(s, tag)).when(mi.isin("Dl", "De"), F.concat(s, tag)).otherwise(s)
    known = F.when(token["type"].isin("SPACE", "NUMBER"), s).otherwise(F.raise_error(F.concat(F.lit("unknown token type "), F.coalesce(token["type"], F.lit("null")))))
    return F.when(token["type"] == "WORD", word).when(token["type"] == "SEPARATOR", F.replace(s, F.lit("\n"), F.lit(" "))).when(token["type"] == "SENTENCE_END", "").otherwise(known)


def group_sentences(responses: DataFrame) -> DataFrame:
    """(row_id, chunk_no, received_at, sent_no, sentence) of tagger responses.

    A sentence is what stands before a SENTENCE_END; what follows the last one is dropped. Of a response that isn't the
    last chunk of its row only the first USED of the tokens count. Failed calls (null tokens) give nothing; repeated
    responses give their sentences again.
    """
    last = F.max("chunk_no").over(W.partitionBy("row_id"))
    n = F.size("tokens")
    used = F.when(F.col("chunk_no") == F.col("last"), n).otherwise(F.least(n, F.floor(n * USED).cast("int") + 2))
    rows = responses.withColumn("last", last).where("tokens is not null").withColumn("tokens", F.slice("tokens", F.lit(1), used))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size("tokens"), F.lit(1))), lambda i: F.element_at(F.col("tokens"), i)["type"] == "SENTENCE_END")
    rows = rows.where(F.size("tokens") > 0).withColumn("ends", ends)
    starts = F.concat(F.array(F.lit(0)), F.col("ends"))
    texts = F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), F.col("ends"), lambda a, b: F.array_join(F.transform(F.slice("tokens", a + 1, b - a - 1), annotated), ""))
    kept = F.transform(F.filter(texts, lambda s: s != ""), lambda s: F.regexp_replace(s, r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", ""))
    return rows.select("row_id", "chunk_no", "received_at", F.posexplode(kept).alias("sent_no", "sentence"))


def parsed(text: Column | str) -> Column:
    """array<struct<word, punct, mi>> of a (possibly annotated) line."""
    return F.transform(tokens(text), parse_word)


def attach_punctuation(words: Column) -> Column:
    """Words with their signs repaired: each has one sign; a stray one goes to the word before it if that has none, else it
    vanishes. A stray sign at the start stays, as an empty word."""

    def one(w: Column) -> Column:
        return F.struct(w["word"].alias("word"), fixed_punctuation(w["punct"]).alias("punct"), w["mi"].alias("mi"))

    def step(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        stray = (w["word"] == "") & (w["punct"] != "") & (F.size(done) > 0)
        takes = (last["word"] != "") & (last["punct"] == "")
        ended = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["word"].alias("word"), w["punct"].alias("punct"), last["mi"].alias("mi"))))
        return F.when(stray & takes, ended).when(stray, done).otherwise(F.concat(done, F.array(w)))

    fixed = F.transform(words, one)
    return F.aggregate(fixed, F.array().cast("array<struct<word:string,punct:string,mi:string>>"), step)


def is_ok(words: Column, alphabet: str = "lt") -> Column:
    """Whether a sentence can be used: no bad word, no small first letter, a sign at the end. True for no words."""
    good = F.forall(words, lambda w: usable(w["word"], w["punct"], w["mi"], alphabet))
    edges = ~F.get(words, F.lit(0))["word"].rlike(r"^\p{Ll}") & (F.element_at(words, -1)["punct"] != "")
    return good & F.when(F.size(words) > 0, edges).otherwise(True)


def joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(w["word"], w["punct"])), " ")


def repair_case(rows: DataFrame, text: str = "sentence") -> DataFrame:
    """`rows` with `fixed`: the annotated line with the casing of its words repaired by their tags."""
    words = F.transform(parsed(text), lambda w, i: render_word(fixed_case(w["word"], w["mi"], i), w["punct"], w["mi"]))
    return rows.withColumn("fixed", F.array_join(words, " "))


def judged(rows: DataFrame, text: str = "text", alphabet: str = "lt") -> DataFrame:
    """`rows` with `clean` (the repaired line), `ok` (usable) and `short` (under LEAST characters). Null texts are dropped."""
    out = once(rows.where(F.col(text).isNotNull()), _w=attach_punctuation(parsed(drop_symbols(text))))
    out = once(out, clean=joined(F.col("_w")), ok=is_ok(F.col("_w"), alphabet)).drop("_w")
    return out.withColumn("short", F.char_length("clean") < LEAST)


def cleaned(rows: DataFrame, text: str = "text", alphabet: str = "lt") -> DataFrame:
    """The usable sentences of `rows`, repaired, in the column `text`."""
    return judged(rows, text, alphabet).where("ok and not short").withColumn(text, F.col("clean")).drop("clean", "ok", "short")
