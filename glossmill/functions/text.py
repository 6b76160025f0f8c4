"""White space and punctuation as regular expressions that Spark (Java) and DuckDB (RE2) read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's `str.split()` splits at.
WS = r"\t-\r\x1c-\x20\x85\p{Z}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Words between white space, as `str.split()`: no empty ones. Null stays null."""
    return F.filter(F.split(col(text), f"[{WS}]+"), lambda x: x != "")


def squeeze(text: Column | str) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), f"[{WS}]+", " "))


def is_blank(text: Column | str) -> Column:
    """True for null, empty or white space only."""
    return F.coalesce(~col(text).rlike(f"[^{WS}]"), F.lit(True))
