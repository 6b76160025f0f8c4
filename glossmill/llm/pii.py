"""Personal data in free text, found by a character-level bidirectional LSTM with CRF transitions.

Every character of every text goes through the network, in overlapping windows of many documents at once: in ONNX Runtime
(`pii_runtime`), or in numpy where that isn't installed. Each window is decoded by Viterbi; a character takes its tag from
the window in whose inner part it lies. Where the tags of two windows don't join at their seam, the document's scores are
put together and decoded as one sequence. Spans are then put on whole words; nothing is dropped or changed by its shape.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_runtime

MODEL = Path(__file__).with_name("pii_model.npz")
KINDS = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; kind k has 1 + 2k for its first character and 2 + 2k for the others.
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and those at each end that only give context.
WINDOW, CONTEXT = 800, 40
INNER = WINDOW - 2 * CONTEXT
#: Characters of text in work at once, and windows that run at once.
CHUNK, BATCH = 4_000_000, 256
#: Characters by kind when they aren't in the vocabulary.
OTHERS = ("pad", "upper", "lower", "digit", "space", "other", "caseless")
_FIRSTS = np.array([0, *range(1, TAGS, 2)])  # tags that any tag may come before


def kind_of(c: str) -> int:
    """The place in OTHERS of a character that has no entry of its own."""
    return 4 if c.isspace() else 3 if c.isdigit() else 1 if c.isupper() or c.istitle() else 2 if c.islower() else 6 if c.isalpha() else 5


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    m = {k: v.astype(np.float32) if v.dtype == np.float16 else v for k, v in np.load(MODEL).items()}
    m["index"] = index_of(m["chars"])
    size = m["wh_f"].shape[0]
    # Gates: sigmoid(v) = (1 + tanh(v / 2)) / 2, so three of four get half of their input; the state is kept doubled.
    scale = np.concatenate([np.full(3 * size, 0.5), np.ones(size)])[:, None]
    half = np.concatenate([np.ones(m["embed"].shape[1] + 1), np.full(size, 0.5)])
    for d in "fb":  # from a character, 1 and the state to the gates
        m[f"gates_{d}"] = np.ascontiguousarray(np.concatenate([m[f"wx_{d}"], m[f"b_{d}"][None], m[f"wh_{d}"]]).T * scale * half, np.float32)
    m["out_f"], m["out_r"] = np.ascontiguousarray(m["out"][:size].T * 0.5), np.ascontiguousarray(m["out"][size:].T * 0.5)
    m["columns"] = np.ascontiguousarray(m["embed"].T)
    return m


@lru_cache(maxsize=1)
def _session():
    return pii_runtime.session(weights())


def index_of(chars: np.ndarray) -> np.ndarray:
    """The vocabulary's number of every code point."""
    index = np.full(0x110000, 5, np.int16)
    for c in range(0x30000):
        if not 0xD800 <= c < 0xE000:
            index[c] = kind_of(chr(c))
    index[chars] = len(OTHERS) + np.arange(len(chars))
    return index


def _add_direction(e: np.ndarray, x: np.ndarray, first: np.ndarray, embed: np.ndarray, gates: np.ndarray, out: np.ndarray, backward: bool) -> None:
    """Add what one direction says to the scores `e` (time, TAGS, batch) of characters `x` (time, batch).

    At time t only the columns from first[t] on are there: they are ordered by length, and none sees what lies beyond its
    own. The state stands below the input, so each step is one product, and all that a step needs stays in the cache.
    """
    n, b = x.shape
    size = len(gates) // 4
    wide = gates.shape[1] - size  # the input and 1
    both = np.zeros((gates.shape[1], b), np.float32)
    both[wide - 1] = 1.0
    z, c, part = np.empty((4 * size, b), np.float32), np.zeros((size, b), np.float32), np.empty((TAGS, b), np.float32)
    for t in range(n - 1, -1, -1) if backward else range(n):
        k = first[t]
        if k:
            both[: wide - 1, k:] = np.take(embed, x[t, k:], 1, mode="clip")
            g, cell, h, y = z[:, k:], c[:, k:], both[wide:, k:], part[:, k:]
            np.matmul(gates, both[:, k:], g)
        else:
            np.take(embed, x[t], 1, both[: wide - 1], "clip")
            g, cell, h, y = z, c, both[wide:], part
            np.matmul(gates, both, g)
        np.tanh(g, g)
        g[: 3 * size] += 1.0
        new = g[:size]
        new *= g[3 * size :]
        cell *= g[size : 2 * size]
        cell += new
        cell *= 0.5
        np.tanh(cell, h)
        h *= g[2 * size : 3 * size]
        np.matmul(out, h, y)
        e[t, :, k:] += y


def _first(n: int, lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(lengths, np.arange(n), "right")


def scores(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tag scores (time, TAGS, batch) of characters (time, batch) in columns of ascending lengths, so that whole rows of the
    batch are together; 0 stands beyond a column's length, where scores mean nothing."""
    if session := _session():
        zeros = np.zeros((x.shape[1], weights()["wh_f"].shape[0]), np.float32)
        return session.run(None, {"x": np.asarray(x, np.int64), "zeros": zeros})[0]
    return _scores(x, lengths)


def _scores(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    m, first = weights(), _first(len(x), lengths)
    e = np.empty((len(x), TAGS, x.shape[1]), np.float32)
    e[:] = m["out_b"][:, None]
    for d, out in (("f", "out_f"), ("b", "out_r")):
        _add_direction(e, x, first, m["columns"], m[f"gates_{d}"], m[out], d == "b")
    return e


def viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags (time, batch) of scores (time, TAGS, batch) in columns of ascending lengths; trans[i, j] is added from tag i
    to tag j. The inner tag of a kind follows its own two tags only. Beyond its length a column repeats its last tag. The
    scores are used up."""
    n, _, b = e.shape
    score = e
    first = _first(n, lengths)
    enter = np.ascontiguousarray(trans[:, _FIRSTS])[:, :, None]
    on, stay = trans[_FIRSTS[1:], _FIRSTS[1:] + 1][:, None], trans[_FIRSTS[1:] + 1, _FIRSTS[1:] + 1][:, None]
    for t in range(1, n):
        k = first[t]
        before, now = score[t - 1, :, k:], score[t, :, k:]
        best = (before[:, None] + enter).max(0)
        now[0] += best[0]
        now[1::2] += best[1:]
        now[2::2] += np.maximum(before[1::2] + on, before[2::2] + stay)
        if k:
            score[t, :, :k] = score[t - 1, :, :k]
    held = np.full_like(trans, -np.inf)
    held[:, _FIRSTS] = trans[:, _FIRSTS]
    for i in _FIRSTS[1:]:
        held[i : i + 2, i + 1] = trans[i : i + 2, i + 1]
    out = np.empty((n, b), np.int8)
    out[-1] = score[-1].argmax(0)
    for t in range(n - 1, 0, -1):
        k = first[t]
        out[t - 1, :k] = out[t, :k]
        out[t - 1, k:] = (score[t - 1, :, k:] + held[:, out[t, k:]]).argmax(0)
    return out


def _windows(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, inner start, inner end, end) of every window of every text, by length."""
    n = -(-sizes // INNER)
    of = np.repeat(np.arange(len(sizes)), n)
    a = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * INNER
    z = np.minimum(a + INNER, sizes[of])
    s, e = np.maximum(0, a - CONTEXT), np.minimum(z + CONTEXT, sizes[of])
    order = np.argsort(e - s, kind="stable")
    return tuple((v + starts[of])[order] for v in (s, a, z, e))


def _tags(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The tag of every character of texts that stand one after another in `codes` (vocabulary numbers)."""
    m = weights()
    out = np.zeros(len(codes), np.int8)
    s, a, z, e = _windows(starts, sizes)
    for i in range(0, len(s), BATCH):
        own = np.arange(i, min(i + BATCH, len(s)))
        lengths = e[own] - s[own]
        x = np.zeros((len(own), int(lengths[-1])), codes.dtype)
        for k, w in enumerate(own):
            x[k, : lengths[k]] = codes[s[w] : e[w]]
        best = viterbi(scores(np.ascontiguousarray(x.T), lengths), m["trans"], lengths)
        for k, w in enumerate(own):
            out[a[w] : z[w]] = best[a[w] - s[w] : z[w] - s[w], k]
    # seams where an inner tag follows another kind: those documents are decoded as one sequence
    inner = np.flatnonzero((out > 0) & (out % 2 == 0))
    left = out[inner - 1]
    broken = inner[~((left == out[inner]) | (left == out[inner] - 1)) | np.isin(inner, starts)]
    for d in np.unique(np.searchsorted(starts, broken, "right") - 1):
        lo, n = starts[d], sizes[d]
        all_ = np.empty((n, TAGS, 1), np.float32)
        for s1, a1, z1, e1 in zip(*_windows(np.zeros(1, np.int64), sizes[d : d + 1])):
            all_[a1:z1] = scores(codes[lo + s1 : lo + e1, None], np.array([e1 - s1]))[a1 - s1 : z1 - s1]
        out[lo : lo + n] = viterbi(all_, m["trans"], np.array([n]))[:, 0]
    return out


_LOCAL, _DOMAIN = re.compile(r"[\w.+%-]"), re.compile(r"(?:[\w-]|\.(?=\w))*")


def _placed(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The span without white space and commas at its ends, with both ends on whole words."""
    while a < b and (text[a].isspace() or text[a] in ".,;:)]}"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:"):
        b -= 1
    while a < b and a > 0 and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and b > a and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    if kind == "email" and b > a:
        while a > 0 and _LOCAL.match(text[a - 1]):
            a -= 1
        b = max(b, _DOMAIN.match(text, b).end() if text[b - 1].isalnum() else b)
    return a, b


def tag(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal data in each text; none for null and empty texts.

    Texts are taken CHUNK characters at a time, so memory doesn't depend on how many come at once.
    """
    out, part, size = [], [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(t or "")
        if size > CHUNK or i + 1 == len(texts):
            out += _tag(part)
            part, size = [], 0
    return out


def _tag(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return found
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    tags = _tags(weights()["index"][np.minimum(codes, 0x10FFFF)].astype(np.intp), starts[sizes > 0], sizes[sizes > 0])
    kind = (tags + 1) // 2
    before = np.concatenate([[0], kind[:-1]])
    before[starts[sizes > 0]] = 0
    begins = np.flatnonzero((kind > 0) & ((tags % 2 == 1) | (kind != before)))
    goes_on = np.concatenate([(kind[1:] == kind[:-1]) & (tags[1:] % 2 == 0), [False]])
    goes_on[(starts + sizes - 1)[sizes > 0]] = False
    stops = np.flatnonzero(~goes_on & (kind > 0))
    stops = stops[np.searchsorted(stops, begins)] + 1
    for a, b, i in zip(begins, stops, np.searchsorted(starts, begins, "right") - 1):
        at = starts[i]
        x, y = _placed(texts[i], int(a - at), int(b - at), KINDS[kind[a] - 1])
        if y > x and (not found[i] or x >= found[i][-1][1]):
            found[i].append((x, y, KINDS[kind[a] - 1]))
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("kind", T.StringType())]))
_BOTH = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def spans(text: Column) -> Column:
    """array<struct<start_at, end_at, kind>> of the personal data in the text; empty for null."""
    return F.pandas_udf(lambda s: pd.Series(tag(list(s))), SPANS)(text)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start_at) of each occurrence."""
    return docs.select("doc_id", F.explode(spans(F.col("text"))).alias("s")).select("doc_id", "s.kind", "s.start_at")


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found): the text with each occurrence replaced by [KIND]; null stays null, all else is unchanged."""

    def both(texts: pd.Series) -> pd.DataFrame:
        got = tag(list(texts))
        return pd.DataFrame({"text": [None if t is None else _masked(t, s) for t, s in zip(texts, got)], "spans": got})

    return docs.select("doc_id", F.pandas_udf(both, _BOTH)("text").alias("p")).select("doc_id", "p.text", F.size("p.spans").alias("found"))
