"""Splitting oversized texts by content-defined chunking.

Rolling-hash landmarks say roughly where a piece should end; the cut snaps to the nearest natural boundary of the
coarsest sort that the allowed window holds. As both depend only on the nearby characters, an edit alters only the
pieces around it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import broadcast_if_small

BREAK = r"(?>\r\n|[\n\r\u2028\u2029])"
_BLANK_IN = r"[^\S\n\r\u2028\u2029]*"
_LINE = re.compile(BREAK)
_BLANK = re.compile(rf"(?:\A{_BLANK_IN}{BREAK}|{BREAK})(?:{_BLANK_IN}{BREAK})+(?:{_BLANK_IN}\Z)?|\A{_BLANK_IN}{BREAK}|{BREAK}{_BLANK_IN}\Z")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？।։؟][\"'”“»」』)\]]*\s+")
#: Sorts of boundary from coarse to fine, as `cut_at` names them.
LEVELS = (("blank_line", _BLANK), ("line_break", _LINE), ("white_space", _SPACE))
#: Characters in the rolling hash.
WINDOW = 16
PIECE = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("piece_no", T.IntegerType()), ("start_at", T.IntegerType()), ("end_at", T.IntegerType()), ("text", T.StringType()), ("cut_at", T.StringType()))])
)


def coarsest(text: str, limit: int) -> str:
    """The first sort of boundary none of whose stretches is longer than `limit`, else `no_space`."""
    for name, pattern in LEVELS:
        at, fits = 0, True
        for m in pattern.finditer(text):
            if m.start() - at > limit:
                fits = False
                break
            at = m.end()
        if fits and len(text) - at <= limit:
            return name
    return "no_space"


def landmarks(text: str, every: int) -> np.ndarray:
    """Offsets where the hash of the WINDOW characters before falls on one value in `every`."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for j in range(WINDOW):
        factor = np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        h[j:] += codes[: len(codes) - j] * factor
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(max(1, every)) == 0) + 1


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most `limit` characters, each but the first sharing `overlap` with the one before.

    `overlap` is taken as at most `limit - 1`, and a `limit` under 1 as 1.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    marks = landmarks(text, max(1, most // 4))
    found = [np.unique([m.end() for m in p.finditer(text)]) for p in (_BLANK, _LINE, _SENTENCE, _SPACE)]
    out, at = [], 0
    while len(text) - at > (most if out else limit):
        low, high = at + max(1, most // 2), at + (most if out else limit)
        i = np.searchsorted(marks, low)
        aim = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        end = aim
        for least in (low, at + 1):  # a small piece rather than a cut inside a word
            for ends in found:
                lo, hi = np.searchsorted(ends, least), np.searchsorted(ends, high, "right")
                if lo < hi:
                    end = int(ends[lo:hi][np.argmin(np.abs(ends[lo:hi] - aim))])
                    break
            else:
                continue
            break
        out.append((max(0, at - overlap) if out else 0, end))
        at = end
    out.append((max(0, at - overlap) if out else 0, len(text)))
    return out


def _pieces(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    def one(t, n, o):
        if t is None:
            return None
        sort = coarsest(t, int(n))
        return [(k, a, b, t[a:b], sort) for k, (a, b) in enumerate(cuts(t, int(n), int(o)))]

    return pd.Series([one(*x) for x in zip(text, limit, overlap)])


def pieces(text: Column, limit: Column, overlap: Column) -> Column:
    """Pieces of one text. Only texts over the limit leave the JVM; others are their own single piece, with no cut_at."""
    big = F.char_length(text) > limit
    whole = F.array(
        F.struct(
            F.lit(0).alias("piece_no"), F.lit(0).alias("start_at"), F.char_length(text).alias("end_at"), text.alias("text"), F.lit(None).cast("string").alias("cut_at")
        )
    ).cast(PIECE)
    return F.when(text.isNull(), F.lit(None).cast(PIECE)).when(big, F.pandas_udf(_pieces, PIECE)(F.when(big, text), limit, overlap)).otherwise(whole)


def with_limits(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Each row with the max_chars and overlap_chars of its source; `default` for a null or unlisted source.

    `limits` is broadcast if it is small; of `default` there is one row.
    """
    own = broadcast_if_small(limits.select(F.col("source").alias("_source"), F.struct("max_chars", "overlap_chars").alias("_own")))
    default = F.broadcast(limits.where("source = 'default'").select(F.struct("max_chars", "overlap_chars").alias("_default")).limit(1))
    joined = docs.join(own, docs["source"] == own["_source"], "left").join(default, F.lit(True), "left")
    use = F.coalesce("_own", "_default")
    return joined.withColumns({"_max": use["max_chars"], "_overlap": use["overlap_chars"]}).drop("_source", "_own", "_default")


def split_oversized(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(row_id, piece_no, start_at, end_at, text, cut_at): every text as its pieces in order.

    Null texts give no piece, an empty text one empty piece. Whole texts are read; a text within its limit comes out
    unchanged with a null cut_at. Sources without a limit (no `default` row) aren't cut. Extra columns are ignored.
    """
    rows = with_limits(docs.select("row_id", "source", "text"), limits)
    rows = rows.withColumns({"_max": F.coalesce("_max", F.lit(2**31 - 1)), "_overlap": F.coalesce("_overlap", F.lit(0))})
    return rows.select("row_id", F.explode(pieces(F.col("text"), F.col("_max"), F.col("_overlap"))).alias("p")).select("row_id", "p.*")


def checked(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(row_id, pieces_fit, overlaps_hold, is_whole): whether each text's pieces keep the limit, share what they should with the
    piece before, and together are the text. For every text; null texts have no row."""
    rows = with_limits(docs.select("row_id", "source", "text"), limits)
    cut_at = pieces(F.col("text"), F.coalesce("_max", F.lit(2**31 - 1)), F.coalesce("_overlap", F.lit(0)))
    p = rows.where("text is not null").select("row_id", "text", "_max", "_overlap", cut_at.alias("p"))
    fit = F.forall("p", lambda x: F.char_length(x["text"]) <= F.coalesce("_max", F.lit(2**31 - 1)))
    before = lambda i: F.get("p", i - 1)["end_at"]
    shared = F.transform("p", lambda x, i: F.when(i == 0, x["start_at"] == 0).otherwise(x["start_at"] == F.greatest(F.lit(0), before(i) - F.least(F.col("_overlap"), F.col("_max") - 1))))
    fresh = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substr(x["text"], before(i) - x["start_at"] + 1))), "")
    return p.select("row_id", fit.alias("pieces_fit"), F.forall(shared, lambda x: x).alias("overlaps_hold"), (fresh == F.col("text")).alias("is_whole"))


def found(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(row_id, cut_at) of the texts that were cut."""
    return split_oversized(docs, limits).where("piece_no = 0 and cut_at is not null").select("row_id", "cut_at")
