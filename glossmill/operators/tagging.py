"""Texts to tagger responses: a pluggable tagger, called in parts of bounded size, with retries and errors kept as data."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import USED

#: What a tagger is: from a text to tokens (type, string, mi), whose strings put together are the text. It may raise.
Tagger = Callable[[str], list[dict]]
#: Characters of a call, tries of a call and the longest wait between two of them in seconds.
MOST_CHARS, TRIES, LONGEST_WAIT = 10_000, 8, 30.0
RESPONSE = "chunk_no int, tokens array<struct<type:string,string:string,mi:string>>, _error string"
_TOKEN = re.compile(r"[^\W\d_]+|\d+| +|[.!?]+|.", re.S)


class LocalTagger:
    """Rules that need no service: runs of letters, digits and blanks, other characters as separators, and a sentence's end
    after each run of `.!?`. It knows no morphology, so every mi is empty."""

    def __call__(self, text: str) -> list[dict]:
        out = []
        for m in _TOKEN.finditer(text):
            s = m[0]
            kind = "WORD" if s[0].isalpha() else "NUMBER" if s[0].isdigit() else "SPACE" if s[0] == " " else "SEPARATOR"
            out.append({"type": kind, "string": s, "mi": ""})
            if s[0] in ".!?":
                out.append({"type": "SENTENCE_END", "string": "", "mi": ""})
        return out


class HttpTagger:
    """A service that takes a text by POST and answers with a list of tokens. Tasks take turns at the addresses."""

    def __init__(self, addresses: list[str], timeout: float = 30.0) -> None:
        self.addresses, self.timeout = addresses, timeout

    def __call__(self, text: str) -> list[dict]:
        from urllib.request import Request, urlopen

        from pyspark import TaskContext

        task = TaskContext.get()
        address = self.addresses[(task.partitionId() if task else 0) % len(self.addresses)]
        with urlopen(Request(address, text.encode("utf-8"), {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
            return json.loads(answer.read())


def insisted(tagger: Tagger, text: str, tries: int = TRIES, wait: float = 1.0) -> list[dict]:
    """The tagger's answer, asked for again after growing waits if it fails; the last failure is raised."""
    for k in count(1):
        try:
            return tagger(text)
        except Exception:
            if k >= tries:
                raise
            time.sleep(min(LONGEST_WAIT, wait * 2 ** (k - 1)))
    raise AssertionError


def used_up(tokens: list[dict]) -> int:
    """How many characters of a call that isn't the text's last one are done with: those up to the last end of a sentence in
    the part of its tokens that counts (see `group_sentences`)."""
    most = min(len(tokens), int(len(tokens) * USED) + 2)
    ends = [i for i, t in enumerate(tokens[:most]) if t["type"] == "SENTENCE_END"]
    return sum(len(t.get("string") or "") for t in tokens[: ends[-1] + 1]) if ends else 0


def responses(text: str, tagger: Tagger, most: int = MOST_CHARS, tries: int = TRIES, wait: float = 1.0) -> Iterator[tuple[int, list[dict] | None, str | None]]:
    """(chunk_no, tokens, error) of the calls for one text. A call that fails, or gets no further, ends the text: nobody knows
    where the next one would begin."""
    for chunk in count():
        try:
            tokens = insisted(tagger, text[:most], tries, wait)
        except Exception as e:
            yield chunk, None, f"{type(e).__name__}: {e}"
            return
        yield chunk, tokens, None
        if len(text) <= most:
            return
        done = used_up(tokens)
        if not done:
            yield chunk + 1, None, "no sentence ends in a call"
            return
        text = text[done:]


def tagged(docs: DataFrame, tagger: Tagger, id_col: str = "row_id", text: str = "text", most: int = MOST_CHARS, tries: int = TRIES, wait: float = 1.0) -> DataFrame:
    """(id, chunk_no, tokens, _error): the responses of `tagger` for every text, as `sentences.group_sentences` takes them.

    Null texts give nothing, an empty one a response without tokens. A failed call is a row with null tokens and its error;
    the sentences of earlier calls are kept. Rows are streamed, one text at a time.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col), F.col(text).alias("_text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [(i, *r) for i, t in zip(part[id_col], part["_text"]) for r in responses(t, tagger, most, tries, wait)]
            yield pd.DataFrame(got, columns=[id_col, "chunk_no", "tokens", "_error"])

    return rows.mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {RESPONSE}")
