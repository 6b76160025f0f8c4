"""One consistent form for texts that look the same.

Look-alikes are mapped with built-in string functions, the mapped values are grouped under the accent-sensitive
`UNICODE` collation (which knows composed from combining accents), and each class gets one of its texts as the canonical
member, joined back to every row. Texts that stand alone keep their letters, whatever their script.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import broadcast_if_small, cut

# Letters of other scripts with the shape of a Latin letter (per line: those letters, the Latin ones).
SAME_SHAPE = (
    ("аеорсухіјѕһԁԛԝӏѵ", "aeopcyxijshdqwlv"),  # Cyrillic small
    ("АВЕКМНОРСТУХІЈЅԌԚԜҮӀѴ", "ABEKMHOPCTYXIJSGQWYIV"),  # Cyrillic capital
    ("ЁёЇї", "ËëÏï"),  # Cyrillic with diaeresis
    ("ονραιυγϲϳ", "ovpaiuycj"),  # Greek small
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),  # Greek capital
    ("օոսհցզյ", "onuhgqj"),  # Armenian small
    ("ՕՍՏ", "OUS"),  # Armenian capital
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ⲞⲟⲢⲣⲤⲥⲦⲬⲭ", "OoPpCcTXx"),  # Coptic
    ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),  # numerals of one letter
    ("ɑɡ", "ag"),  # phonetic letters
    ("\u2010\u2011\ufe63\u2043", "----"),  # kinds of hyphen
    ("\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " " * 16),  # kinds of space
)
# Characters that show nothing.
INVISIBLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
#: A joiner between pictures makes one picture of two, so it stays there (as this private character).
JOINER, KEPT = "\u200d", "\ue000"
#: Scripts with letters in the shape of Latin ones; a word of both is no word of either.
_OTHERS = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}\p{IsCoptic}"
#: Where a text of this many rows may lie apart, so that no copy of a frequent text meets all others in one task.
SALTS = 16


def _wide() -> tuple[str, str]:
    """Full-width and half-width forms with their usual characters, from Unicode's own decompositions."""
    pairs = [(chr(c), n) for c in range(0xFF01, 0xFFEF) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _ligatures() -> dict[str, str]:
    ranges = (*range(0xFB00, 0xFB18), *range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4))
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in ranges if unicodedata.normalize("NFKC", chr(c)) != chr(c)}


def _bases() -> tuple[str, str]:
    """Characters with another canonical decomposition and what stays of it without marks and without the vowels and finals
    of Hangul, from Unicode's own decompositions."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        d = unicodedata.normalize("NFD", c)
        if d != c and unicodedata.category(c)[0] != "M":
            pairs.append((c, next(x for x in d if unicodedata.category(x)[0] != "M")))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def skeleton(text: Column) -> Column:
    """The text with look-alikes mapped to one form; accents are left as they are, for the collation."""
    wide, shapes = _wide(), ("".join(a for a, _ in SAME_SHAPE), "".join(b for _, b in SAME_SHAPE))
    t = F.translate(text, wide[0] + shapes[0], wide[1] + shapes[1])
    parts = t
    for a, b in _ligatures().items():
        parts = F.replace(parts, F.lit(a), F.lit(b))
    t = F.when(t.rlike(f"[{''.join(_ligatures())}]"), parts).otherwise(t)
    joined = F.regexp_replace(F.regexp_replace(t, rf"([\x{{2190}}-\x{{2bff}}\x{{fe0f}}\x{{1f000}}-\x{{1faff}}]){JOINER}", f"$1{KEPT}"), f"[{INVISIBLE}{JOINER}]", "")
    return F.when(t.rlike(f"[{INVISIBLE}{JOINER}]"), joined).otherwise(t)


def fingerprint(skel: Column) -> Column:
    """64 bits that are equal for skeletons equal under the collation; it ignores accents, so it only narrows the search.

    What the collation itself ignores (control characters) is left out as well, and so are the vowels and finals of Hangul,
    as a syllable counts by its first consonant.
    """
    a, b = _bases()
    return F.xxhash64(F.regexp_replace(F.translate(skel, a, b), r"[\p{M}\x{1160}-\x{11ff}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]", ""))


def oddness(text: Column) -> Column:
    """How unusually a text is written, so that the canonical member of a class is its plainest one: 4 for a word that mixes
    scripts, 2 for invisible characters, wide forms, ligatures, unusual spaces and hyphens, 1 for combining marks."""
    odd = "".join(_ligatures()) + "".join(a for a, _ in SAME_SHAPE[-2:]) + SAME_SHAPE[9][0] + _wide()[0]
    bit = lambda pattern, n: F.when(text.rlike(pattern), n).otherwise(0)
    mixed = rf"\p{{IsLatin}}\p{{M}}*[{_OTHERS}]|[{_OTHERS}]\p{{M}}*\p{{IsLatin}}"
    return bit(mixed, 4) + bit(f"[{odd}{INVISIBLE}{JOINER}]", 2) + bit(r"\p{M}", 1)


def composed(text: Column) -> Column:
    """The text with composed accents. Only texts with something to compose leave the JVM."""
    some = text.rlike(r"[\p{M}\x{1100}-\x{11ff}\x{2126}\x{212a}\x{212b}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}]")
    nfc = F.pandas_udf(lambda s: pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in s], dtype=object), T.StringType())
    return F.coalesce(nfc(F.when(some, text)), text)


def _visible(docs: DataFrame) -> DataFrame:
    """Rows with something to see, with their skeleton and its fingerprint."""
    rows = docs.select("row_id", "text").where(F.col("text").rlike(r"[^\t-\r\x1c-\x20\x85\p{Z}]"))
    return rows.withColumn("skel", skeleton(F.col("text"))).withColumn("fp", fingerprint(F.col("skel")))


def classes(docs: DataFrame) -> DataFrame:
    """(text, canonical, members): each distinct text of a look-alike class of two or more distinct texts.

    canonical is the plainest text of the class (`oddness`), of equally plain ones the smallest by code points. First the
    64-bit fingerprints under which more than one text stands are found (two numbers a fingerprint, combined before the
    shuffle); only those texts are then grouped under the collation, by sums and minima that combine before the shuffle,
    and joined back to their group.
    """
    prints = cut(_visible(docs).select("row_id", "fp", F.xxhash64("text").alias("h")), "look-alike-prints")
    shared = prints.groupBy("fp").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("fp")
    ids = cut(prints.join(shared, "fp", "left_semi").select("row_id"), "look-alike-candidates")
    # Written, so their size is known: texts are filtered where they are if the ids are few, shuffled by them if not.
    candidates = _visible(docs.select("row_id", "text").join(broadcast_if_small(ids), "row_id", "left_semi"))
    texts = candidates.groupBy("text").agg(F.first("skel").alias("skel"), F.first("fp").alias("fp"))
    texts = cut(texts.withColumn("odd", oddness(F.col("text"))), "look-alikes")  # few rows, read twice
    alike = F.collate("skel", "UNICODE")
    plainest = F.min(F.struct("odd", "text"))["text"]
    grouped = texts.groupBy(F.col("fp").alias("_fp"), alike.alias("_k")).agg(plainest.alias("canonical"), F.count("*").alias("members"))
    joined = texts.join(grouped.where("members > 1"), (F.col("fp") == F.col("_fp")) & (alike == F.col("_k")))
    return joined.select("text", "canonical", "members")


def _with_class(rows: DataFrame, member: DataFrame, how: str) -> DataFrame:
    """Rows with what `member` says of their text's digest `t`. If member is too large to be sent to every task, the copies of
    a text are spread over SALTS tasks."""
    small = broadcast_if_small(member)
    if small is not member:
        return rows.join(small, "t", how)
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    spread = member.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["t", "_s"], how).drop("_s")


def normalized(docs: DataFrame) -> DataFrame:
    """(row_id, text, is_changed): each row as the canonical member of its class, or as itself where it stands alone; either
    way with composed accents.

    Null, empty and blank texts come out as they are. Rows of one class become equal; others stay different.
    """
    member = cut(classes(docs).where("text <> canonical").select(F.unhex(F.md5("text")).alias("t"), "canonical"), "look-alike-members")
    rows = docs.select("row_id", "text", F.coalesce(F.unhex(F.md5("text")), F.unhex(F.md5(F.col("row_id").cast("string")))).alias("t"))
    out = composed(F.coalesce("canonical", "text"))
    return _with_class(rows, member, "left").select("row_id", out.alias("_out"), F.col("text").alias("_in")).select(
        "row_id", F.col("_out").alias("text"), (~F.col("_out").eqNullSafe(F.col("_in"))).alias("is_changed")
    )


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, class): the digests of the texts of classes; (row_id, t, class): the rows that have them."""
    t = cut(classes(docs).select(F.unhex(F.md5("text")).alias("t"), F.unhex(F.md5("canonical")).alias("class")), "look-alike-classes")
    rows = docs.select("row_id", F.unhex(F.md5("text")).alias("t")).where("t is not null and row_id is not null")
    return t, cut(_with_class(rows, t, "inner"), "look-alike-rows")


def linked(docs: DataFrame) -> DataFrame:
    """(row_id, class_id, links): one row for each row that looks like a row of another text; class_id is the smallest row_id
    of its class, links the number of rows it looks like but differs from. Grows with the rows, not with their pairs."""
    _, rows = _members(docs)
    per = rows.groupBy("class", "t").agg(F.count("*").alias("n"), F.min("row_id").alias("least"))
    both = per.groupBy("class").agg(F.sum("n").alias("all"), F.min("least").alias("class_id"))
    text = cut(per.join(both, "class").select("t", "class_id", (F.col("all") - F.col("n")).alias("links")), "look-alike-links")
    return _with_class(rows.select("row_id", "t"), text, "inner").select("row_id", "class_id", "links")


def found(docs: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): all pairs of rows of one class whose texts differ; `linked` says the same without pairs.

    Distinct texts of a class are paired first and rows joined after, so copies of one text never meet each other, and rows
    of a text come in packs of one input partition, so that no text's rows are gathered in one task.
    """
    t, rows = _members(docs)
    variants = t.join(t.select("class", F.col("t").alias("u")), "class").where("t < u").select("t", "u")
    packs = rows.groupBy("t", F.spark_partition_id().alias("part")).agg(F.collect_list("row_id").alias("ids")).drop("part")
    left = variants.join(packs, "t").select("u", F.explode("ids").alias("x"))
    both = left.join(packs.select(F.col("t").alias("u"), F.col("ids").alias("others")), "u").select("x", F.explode("others").alias("y"))
    return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
