"""Sentence boundaries in many languages and scripts.

Each character is tagged as the first of a sentence or as inside one, by a linear-chain model with Viterbi decoding. Every
character that can be the first of a word is scored, in every text: the ones after any gap, after any sentence mark, and
each one in scripts that write words without gaps. Characters within a word can't begin a sentence, so their tag is
inside. The weights were learned by `sentences_fit` from marked text and from the same text with all or most of its marks
stripped or its case changed; they are read from `sentences_model.json`.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import broadcast_if_small

MODEL = Path(__file__).with_name("sentences_model.json")
MARKS = ".!?…。！？।։؟"
#: Scripts whose sentences have no marks: there a gap may end a sentence.
GAPPED = r"\u0e00-\u0eff\u1780-\u17ff"
#: Scripts that write words without gaps: every character may begin a word (but for Thai signs that stand on others).
UNSPACED = r"\u0e01-\u0e2f\u0e40-\u0e44\u0e81-\u0eb0\u1000-\u102a\u1780-\u17b3\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
DASHES = "-–—―"
_BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029]")
_CLOSE, _OPEN = "\"'”»」』)]’", "\"'«「『([„‚"
_WORD = re.compile(r"\S{1,40}")
#: A mark that can end a sentence: white space or the text's end follows, and more than one letter or digit comes before.
_FINAL = re.compile(rf"[。！？।։؟]|(?<!\b\w)[.!?…]+[{re.escape(_CLOSE + '“')}]*(?=\s|$)")


@lru_cache(maxsize=2)
def _candidates(low_quotes: bool) -> re.Pattern:
    """A mark with what closes it and its gap, a gap, or a place before a character of a script without gaps."""
    close = re.escape(_CLOSE + ("“" if low_quotes else ""))
    marks = re.escape(MARKS)
    return re.compile(rf"[{marks}](?:[{marks}]|[{close}])*\s*|\s+|(?<=\S)(?=[{UNSPACED}])")


def _spans(text: str, low_quotes: bool) -> list[tuple[int, int]]:
    """Quotations and brackets, outermost only, in order."""
    opens = {"„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]"} | ({} if low_quotes else {"“": "”"})
    out: list[tuple[int, int]] = []
    want, start = "", -1
    for m in re.finditer("[„“”«»「」『』()\\[\\]\"]", text):
        c, i = m[0], m.start()
        if not want:
            if c in opens:
                want, start = opens[c], i
            elif c == '"':
                want, start = '"', i
        elif c in want:
            out.append((start, i))
            want = ""
    return out


def _kind(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        return "lower"
    if c.isalpha():
        return "alpha"
    if c in DASHES:
        return "dash"
    if c in _OPEN or c == "“":
        return "open"
    if c in ",;:)]»”，、；：،；":
        return "goes_on"
    return "other"


def _after(text: str, at: int) -> str:
    """What kind of character comes at `at`, looking through opening marks and dashes."""
    kind, before = _kind(text[at : at + 1]), ""
    while kind in ("open", "dash") and len(before) < 12:
        before += kind + "+"
        at += 1
        while text[at : at + 1].isspace():
            at += 1
        kind = _kind(text[at : at + 1])
    return before + kind


def _far(n: int) -> str:
    return "0" if n < 15 else "1" if n < 40 else "2" if n < 90 else "3" if n < 180 else "4" if n < 400 else "5"


@lru_cache(maxsize=100_000)
def _plain(c: str) -> str:
    return _kind(c)


def _inside(text: str, at: int, spans: list[tuple[int, int]], ends: list[int]) -> str:
    """Whether `at` lies in a quotation or brackets, and what follows them."""
    i = bisect_left(ends, at)
    if i == len(spans) or not spans[i][0] < at <= spans[i][1]:
        return "out"
    j = spans[i][1] + 1
    while j < len(text) and text[j].isspace():
        j += 1
    tight = "tight+" if j == spans[i][1] + 1 else ""
    return "in:" + tight + _after(text, j) + (":mark" if text[spans[i][1] - 1 : spans[i][1]] in MARKS else "")


def places(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(at, head, got, kind, inside) of the offsets that may begin a sentence, the text's first one aside: where what precedes
    them begins, what that is, what comes there, and how it lies in quotations."""
    low_quotes = "„" in text
    spans = _spans(text, low_quotes)
    ends = [e for _, e in spans]
    first = last = len(text) - len(text.lstrip())
    for m in _candidates(low_quotes).finditer(text):
        at = m.end()
        if at >= len(text) or m.start() < first or at == last:
            continue
        last = at
        c = _plain(text[at])
        yield at, m.start(), m[0], _after(text, at) if c in ("open", "dash") else c, _inside(text, at, spans, ends) if spans else "out"


def observed(text: str) -> list[tuple[int, list[str]]]:
    """The offsets that may begin a sentence, with what the model sees there; the text's first one isn't among them."""
    finals = [m.start() for m in _FINAL.finditer(text)]
    edges = [0, *finals, len(text)]
    dense = "none" if not finals else _far(len(text) // len(finals))
    case = "none" if text.lower() == text else "all" if text.upper() == text and any(c.isupper() for c in text) else "mixed"
    out = []
    passed = 0  # a token is looked at back to the place before, so a long one isn't read again and again
    for at, head, got, nxt, inside in places(text):
        marks = got.rstrip()
        k = bisect_right(finals, at - 1)
        back, ahead = _far(at - edges[k]), _far(edges[k + 1] - at)
        # how far an unmarked sentence is to be expected: not a mark in the text, or so many characters between two
        wide = edges[k + 1] - edges[k]
        sure = "N" if not finals else "a" if wide < 90 else "b" if wide < 180 else "c"
        if not got:  # within a script without gaps
            a, b = text[at - 1], text[at]
            a2, b2 = text[max(0, at - 2) : at], text[at : at + 2]
            same = a if _plain(a) != "alpha" else "w"
            out.append((at, [f"c{sure}", f"ca={a}{sure}", f"cb={b}{sure}", f"cA={a2}{sure}", f"cB={b2}{sure}", f"cab={a}{b}{sure}", f"cd={back},{ahead},{dense}", f"cs={same},{dense},{ord(b) >> 7}", f"i={inside},c", f"c3={text[max(0, at - 3) : at]}{sure}", f"cg={back}{sure}"]))
            continue
        gap = got[len(marks) :]
        breaks = len(_BREAK.findall(gap)) if gap != " " else 0
        gap_kind = "blank" if breaks > 1 else "line" if breaks else "space" if gap else "none"
        begin = head
        while begin > passed and not text[begin - 1].isspace():
            begin -= 1
        passed = head
        token = text[begin:head].lstrip("\"'„“«([「").lower()
        last = text[head - 1 : head] if head else ""
        shape = "digit" if token.isdigit() else "one" if len(token) == 1 else "dotted" if "." in token else "short" if len(token) < 4 else "long"
        if shape == "one" and text[begin:head][-1:].isupper():
            shape = "initial"
        word = _WORD.match(text, at)
        word = word[0].strip("\"'„“«(").lower().rstrip(".,:;!?")[:12] if word else ""
        cased = "cased" if last.isupper() or last.islower() or last.isdigit() else _kind(last)
        if not marks:
            after = text[at : at + 80].split(None, 2)[1:2]
            words = len(text[at : min(at + 80, edges[k + 1])].split(None, 3))  # up to the next mark
            caps = "".join("C" if w.lstrip("\"'„“«([「")[:1].isupper() else "c" for w in (text[begin:head], text[at : at + 24], *after))
            out.append(
                (
                    at,
                    [
                        f"g={gap_kind},{case}",
                        f"u={dense},{nxt},{gap_kind},{case},{cased}",
                        f"i={inside},n",
                        f"b={gap_kind == 'blank'},{nxt}",
                        f"d={back},{ahead},{dense},{nxt}",
                        f"s={back},{nxt},{case}",
                        f"x={word},{nxt},{case},{sure}",
                        f"y={token[-5:]},{nxt},{case},{sure}",
                        f"z={shape},{caps},{nxt},{case},{sure}",
                        f"xy={token[-3:]},{word[:5]},{case},{sure}",
                        f"w={ord(last or ' ') >> 7},{ord(text[at]) >> 7},{gap_kind},{sure}",
                        f"xd={word[:8]},{back},{dense}",
                        f"e={last},{nxt},{dense}",
                        f"n={words},{nxt},{case},{sure}",
                        f"nb={words},{back},{nxt},{sure}",
                    ],
                )
            )
            continue
        mark = "ell" if marks[0] == "…" or marks.startswith("..") else marks[0]
        closed = "closed" if marks[-1] not in MARKS else "bare"
        before = text[max(0, begin - 12) : begin].split()
        prior = before[-1].lower() if before else ""
        tight = "t" if not gap else "g"
        out.append(
            (
                at,
                [
                    f"g={gap_kind}",
                    f"m={mark},{closed},{nxt},{tight},{cased},{case}",
                    f"m={mark},{closed},{nxt},{gap_kind}",
                    f"m={mark},{nxt},{shape},{case}",
                    f"m={mark},{shape},{tight},{nxt}",
                    f"i={inside},m",
                    f"i={inside},{nxt},{closed}",
                    f"t={token[:10]},{mark == '.'},{nxt if case == 'mixed' else case}" if len(token) < 9 and mark == "." else f"t=long,{mark},{nxt}",
                    f"p={prior if len(prior) < 4 else 'w'},{token if len(token) < 4 else 'w'},{nxt}" if mark == "." else f"p,{mark}",
                    f"w={word},{shape}" if mark == "." and shape in ("digit", "one", "initial") else f"w,{mark},{shape}",
                    f"b={gap_kind == 'blank'},m,{nxt}",
                ],
            )
        )
    return out


def reach(a: int, b: int) -> str:
    """How far apart two candidates are; close first characters are rare."""
    n = b - a
    return "1" if n < 4 else "2" if n < 10 else "3" if n < 25 else "4"


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    return json.loads(MODEL.read_text())


def decode(seen: list[tuple[int, list[str]]], first: int, w: dict[str, float]) -> list[int]:
    """The best tags by Viterbi: the offsets tagged as first characters, without `first`.

    A state is the last first character so far; all that matters of it is whether it is the previous candidate.
    """
    if not seen:
        return []
    inside = begin = 0.0  # best scores with the previous candidate inside, or a first character
    begin, inside = 0.0, float("-inf")
    back: list[tuple[bool, bool]] = []
    prev = first
    for at, feats in seen:
        score = sum(w.get(f, 0.0) for f in feats)
        near = w.get("near=" + reach(prev, at), 0.0)
        b_from_b, b_from_i = begin + score + near, inside + score
        back.append((b_from_b >= b_from_i, begin >= inside))
        begin, inside = max(b_from_b, b_from_i), max(begin, inside)
        prev = at
    tag = begin > inside
    out = []
    for (at, _), (b, i) in zip(reversed(seen), reversed(back)):
        if tag:
            out.append(at)
            tag = b
        else:
            tag = i
    return out[::-1]


def starts(text: str | None) -> list[int]:
    """Offsets of the first characters of the sentences. Null and blank texts have none. A blank line always ends one."""
    if not text or text.isspace():
        return []
    first = len(text) - len(text.lstrip())
    return [first, *decode(observed(text), first, weights())]


def _udf(items, f):
    return F.pandas_udf(lambda s: pd.Series([f(t) for t in s]), T.ArrayType(items))


def sentence_starts(docs: DataFrame) -> DataFrame:
    """(row_id, sent_start) of every sentence of every text."""
    return docs.select("row_id", F.explode(_udf(T.IntegerType(), starts)("text")).alias("sent_start"))


_SENTENCE = T.StructType([T.StructField("sent_no", T.IntegerType()), T.StructField("sent_start", T.IntegerType()), T.StructField("sentence", T.StringType())])


def _cut(text: str | None) -> list[tuple[int, int, str]]:
    at = starts(text)
    return [(k, a, text[a:b].rstrip()) for k, (a, b) in enumerate(zip(at, [*at[1:], len(text)]))] if at else []


def sentences(docs: DataFrame) -> DataFrame:
    """(row_id, sent_no, sent_start, sentence): every text as its sentences in order; null and blank texts have none."""
    return docs.select("row_id", F.explode(_udf(_SENTENCE, _cut)("text")).alias("s")).select("row_id", "s.*")


def found(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_id, sent_start) for the rows of `wanted`."""
    ids = broadcast_if_small(wanted.select("row_id").distinct())
    return sentence_starts(docs.select("row_id", "text").join(ids, "row_id", "left_semi"))
