"""Text quality statistics of each document and a verdict that keeps running text apart from lists, tables and junk.

All statistics are counted over the whole text, many texts at a time. A Gaussian mixture over the standardized statistics gives
the verdict: it was fitted by expectation-maximization (`quality_fit`) without knowing of kinds, its components were then
mapped to kinds by inspected examples, and all of that is read from `quality_model.json`.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


KINDS = ("prose", "list", "table", "junk")
# Frequent function words of the corpus languages.
COMMON = """
ir o kad nes bet tačiau todėl nors jeigu kai kol kurį ar kodėl be po prie iš iki nuo dėl už bei apie buvo yra ne tai per su kaip
the a an of and to in but because while near behind under beside beyond which it was is for with on that did until
der die das den dem und oder aber weil während obwohl neben vor unter hinter ist ein eine mit von zu im
i a w na z do że bo ale oraz obok dla przy koło chociaż gdy jest nie się
и в на с а но у для около возле когда хотя потому или что не как
के की का में है और से
ثم قرب في من على و
և է
he she they we you his her their my this these those be been are were have has had will would can could at by from about into
le la les un une des du et est dans que qui pour pas il elle sur avec el los las una y en es por con no se su il lo gli di che
kur jau dar labai savo jis ji jie mes aš tu jų jo čia ten kas
мы вы он она они это был была было быть если чтобы
""".split()
#: Characters of text that are counted at once.
CHUNK = 4_000_000


MODEL = Path(__file__).with_name("quality_model.json")
#: What the mixture reads, each with the way it is squeezed before it is standardized.
FEATURES = {
    "word_count": np.log1p,
    "mean_word_length": lambda x: np.log(np.clip(x, 1, 40)),
    "symbol_share": np.sqrt,
    "ending_share": None,
    "common_share": np.sqrt,
    "line_count": np.log1p,
    "digit_share": np.sqrt,
    "letter_share": None,
    "code_share": np.sqrt,
    "broken_share": np.sqrt,
    "cluster_share": np.sqrt,
    "latin_share": None,
    "distinct_words": lambda x: np.log(np.clip(x, 1, 12)),
    "long_share": None,
    "bullet_share": None,
    "field_share": None,
    "cell_share": None,
    "part_count": np.log1p,
    "part_words": lambda x: np.log(np.clip(x, 0.5, 12)),
    "short_share": None,
    "comma_words": lambda x: np.log(np.clip(x, 0.5, 12)),
    "tight_share": np.sqrt,
}


WHOLE = ("word_count", "line_count", "distinct_words", "part_count")
STATISTICS = ("word_count", "mean_word_length", "symbol_share", "ending_share", "common_share", *[k for k in FEATURES if k not in ("word_count", "mean_word_length", "symbol_share", "ending_share", "common_share")])


def features(stats: pd.DataFrame) -> np.ndarray:
    return np.stack([f(stats[k].to_numpy(float)) if f else stats[k].to_numpy(float) for k, f in FEATURES.items()], 1)


@lru_cache(maxsize=1)
def model() -> dict:
    m = json.loads(MODEL.read_text())
    d = len(m["features"])
    whiten = np.zeros((len(m["weight"]), d, d))
    for k, rows in enumerate(m["whiten"]):
        for i, row in enumerate(rows):
            whiten[k, i, : i + 1] = row
    base = np.log(np.array(m["weight"]) + 1e-12) + np.log(np.abs(np.diagonal(whiten, axis1=1, axis2=2))).sum(1)
    shift = np.einsum("kij,kj->ki", whiten, np.array(m["mean"]))
    return {k: np.array(m[k]) for k in ("center", "scale", "kinds")} | {"whiten": whiten, "base": base, "shift": shift}


def shares(stats: pd.DataFrame, m: dict | None = None) -> np.ndarray:
    """The share of each component of the mixture at each row."""
    m = m or model()
    z = (features(stats) - m["center"]) / m["scale"]
    log = np.stack([b - 0.5 * ((z @ w.T - s) ** 2).sum(1) for b, s, w in zip(m["base"], m["shift"], m["whiten"])], 1)
    share = np.exp(log - log.max(1, keepdims=True))
    return share / share.sum(1, keepdims=True)


def kinds(stats: pd.DataFrame) -> np.ndarray:
    """The kind that the components at each row speak for, each as far as its inspected examples are of that kind."""
    return np.array(KINDS)[(shares(stats) @ model()["kinds"]).argmax(1)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its classes (one bit each, by CLASSES) and its lower-case form."""
    bits = np.zeros(0x110000, np.uint32)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s, cat = chr(c), unicodedata.category(chr(c))
        if cat == "Cn" or cat == "Co":
            continue
        bits[c] = (s.isspace() << 0) | ((cat[0] in "PS") << 1) | ((cat[0] in "LM") << 2) | ((cat[0] == "N") << 3)
        if len(s.lower()) == 1:
            low[c] = ord(s.lower())
    for k, chars in enumerate(("\n\r\u2028\u2029", ".!?…。！？।։؟", "\"'”“»」』)]", "{}<>=[]_#\\&%@~^$*/|+", "ÃÂÅ¤¼¾\ufffd" + "".join(map(chr, range(0x80, 0xA0))), "\n\r\u2028\u2029;|#•·", "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ", "-*•·▪◦‣+>–—"), 4):
        for c in chars:
            bits[ord(c)] |= 1 << k
    for a, b in ((0x0E00, 0x0F00), (0x3040, 0x3100), (0x3400, 0xA000)):
        bits[a:b] |= 1 << 12
    return bits, low


SPACE, SYMBOL, LETTER, NUMBER, BREAK, MARK, CLOSE, CODE, BROKEN, PART, CONSONANT, BULLET, UNSPACED = (1 << k for k in range(13))


def _powers(n: int) -> np.ndarray:
    """One odd factor for each of n places in a word, so a word's hash is a sum."""
    return np.multiply.accumulate(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def _hash(word: str) -> np.uint64:
    return (np.array([ord(c) for c in word], np.uint64) * _powers(len(word))).sum(dtype=np.uint64)


@lru_cache(maxsize=1)
def _common() -> np.ndarray:
    return np.sort(np.array([_hash(w) for w in set(COMMON)], np.uint64))


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true; no run crosses a document, as each ends with an added line break."""
    d = np.diff(flag.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _count(texts: list[str]) -> dict[str, np.ndarray]:
    bits, lower = _tables()
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    docs, n_docs = ends - np.array([len(t) + 1 for t in texts]), len(texts)
    cls = bits[codes]
    space = (cls & SPACE) != 0
    total = lambda flag: np.add.reduceat(flag, docs, dtype=np.int64)
    of = lambda at: np.searchsorted(ends, at, "right")
    per = lambda at: np.bincount(of(at), minlength=n_docs)
    has = lambda c: total((cls & c) != 0)
    follows = np.concatenate([codes[1:], codes[:1]])
    spaced = np.concatenate([space[1:], space[:1]])

    # words between white space, and runs of letters and digits
    w0, w1 = _runs(~space)
    word_docs = of(w0)
    words = np.bincount(word_docs, minlength=n_docs)
    visible = total(~space)
    ascii_ = np.concatenate([[0], np.cumsum(codes > 126)])
    long = (w1 - w0 >= 30) & (ascii_[w1] == ascii_[w0])
    r0, r1 = _runs((cls & (LETTER | NUMBER)) != 0)
    inside = np.arange(len(codes)) - np.repeat(np.concatenate([[0], r0]), np.diff(np.concatenate([[0], r0, [len(codes)]])))
    keep = (cls & (LETTER | NUMBER)) != 0
    product = np.where(keep, lower[codes].astype(np.uint64) * _powers(int(inside[keep].max(initial=0)) + 1)[np.where(keep, inside, 0)], np.uint64(0))
    hashes = np.add.reduceat(product, r0) if len(r0) else np.zeros(0, np.uint64)
    run_docs = of(r0)
    common = _common()
    is_common = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    pairs = np.unique(np.stack([run_docs.astype(np.uint64), hashes], 1), axis=0) if n_docs == 1 else None
    if pairs is None:
        order = np.lexsort((hashes, run_docs))
        d, h = run_docs[order], hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(d[new], minlength=n_docs)
    else:
        distinct = np.array([len(pairs)])

    def stretches(sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First visible character, end and document of each stretch between separators that shows anything."""
        cut = np.flatnonzero(sep)
        a = np.concatenate([[0], cut[:-1] + 1])
        seen = np.concatenate([[0], np.cumsum(~space & ~sep)])
        full = seen[cut] > seen[a]
        a, b = a[full], cut[full]
        first = w0  # the first visible character at or after a: a itself if visible, else the next start of a word
        nxt = first[np.minimum(np.searchsorted(first, a), len(first) - 1)] if len(first) else a
        return np.where(space[a], nxt, a), b, of(a)

    breaks = (cls & BREAK) != 0
    l0, l1, l_docs = stretches(breaks)
    lines = np.bincount(l_docs, minlength=n_docs)
    slash = (codes == 47) & spaced & np.concatenate([[False], space[:-1]])
    p0, p1, p_docs = stretches(((cls & PART) != 0) | slash)
    parts = np.bincount(p_docs, minlength=n_docs)

    # a line ends in a mark if nothing but closing signs and blanks follows the mark
    solid = np.flatnonzero(((cls & CLOSE) == 0) & (~space | breaks))
    marked = solid[:-1][((cls[solid[:-1]] & MARK) != 0) & breaks[solid[1:]]] if len(solid) > 1 else solid[:0]
    at = lambda i: codes[np.minimum(i, len(codes) - 1)]
    digit = lambda i: (bits[at(i)] & NUMBER) != 0
    dotted = lambda i: (at(i) == 46) | (at(i) == 41)
    blank = lambda i: (bits[at(i)] & SPACE) != 0
    o = l0 + (at(l0) == 40)
    bullet = ((cls[np.minimum(l0, len(cls) - 1)] & BULLET) != 0) & blank(l0 + 1)
    for k in (1, 2, 3):
        numbered = dotted(o + k) & blank(o + k + 1)
        for j in range(k):
            numbered &= digit(o + j)
        bullet |= numbered

    # a part is a named field if a name of at most five words without other signs stands before its first `:` or `=`
    wordcount = np.concatenate([[0], np.cumsum(np.bincount(w0, minlength=len(codes)))])
    signs = np.concatenate([[0], np.cumsum(((cls & (SYMBOL | NUMBER)) != 0) & (codes != 34) & (codes != 39) & (codes != 123) & (codes != 95))])
    quoted = np.flatnonzero((codes == 44) & np.concatenate([[False], codes[:-1] == 34]))  # `",` parts fields of an object
    f0 = np.concatenate([p0, quoted + 1]).astype(np.int64)
    f0.sort()
    colon = np.flatnonzero((codes == 58) | (codes == 61))
    c = colon[np.minimum(np.searchsorted(colon, f0), len(colon) - 1)] if len(colon) else np.full(len(f0), len(codes))
    after = np.concatenate([f0[1:], [len(codes)]])
    named = (c < after) & (wordcount[np.minimum(c, len(codes))] - wordcount[f0] <= 5) & (c > f0) & (signs[np.minimum(c, len(codes))] == signs[f0])
    fields = per(f0[named])

    unspaced = np.concatenate([[0], np.cumsum((cls & UNSPACED) != 0)])
    longs = np.bincount(p_docs[(wordcount[p1] - wordcount[p0] >= 5) | (unspaced[p1] - unspaced[p0] >= 12)], minlength=n_docs)
    g0, g1 = _runs(codes == 32)
    k0, k1 = _runs((cls & CONSONANT) != 0)
    cells = np.max([total(codes == 9), total(codes == 124), total(codes == 59), total((codes == 34) & (follows == 44)), per(g0[g1 - g0 > 1])], 0)
    share = lambda x, y: np.minimum(1.0, x / np.maximum(1, y))
    return {
        "word_count": words,
        "mean_word_length": visible / np.maximum(1, words),
        "symbol_share": share(has(SYMBOL), visible),
        "ending_share": share(per(marked), lines),
        "common_share": share(np.bincount(run_docs, is_common, n_docs), words),
        "line_count": lines,
        "digit_share": share(has(NUMBER), visible),
        "letter_share": share(has(LETTER), visible),
        "code_share": share(has(CODE), visible),
        "broken_share": share(has(BROKEN), visible),
        "cluster_share": share(per(k0[k1 - k0 >= 5]), words),
        "distinct_words": distinct,
        "long_share": share(np.bincount(word_docs, np.where(long, w1 - w0, 0), n_docs), visible),
        "bullet_share": share(np.bincount(l_docs[bullet], minlength=n_docs), lines),
        "field_share": share(fields, np.maximum(parts, per(quoted) + (parts > 0))),
        "cell_share": share(cells, 2 * lines),
        "part_count": parts,
        "part_words": words / np.maximum(1, parts),
        "short_share": np.where(parts > 0, 1 - share(longs, parts), 0.0),
        "comma_words": words / (total(((codes == 44) | (codes == 0x60C) | (codes == 0x3001) | (codes == 0xFF0C)) & spaced) + 1),
        "tight_share": share(total((codes == 44) & ~spaced), 2 * lines),
        "latin_share": share(total((((codes | 32) >= 97) & ((codes | 32) <= 122)) | ((codes >= 0xC0) & (codes < 0x250))), has(LETTER)),
    }


def counted(texts: pd.Series) -> pd.DataFrame:
    """The statistics of each text; zeros for null and blank ones."""
    texts = [t or "" for t in texts]
    out, part, size = [], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size > CHUNK or i + 1 == len(texts):
            out.append(pd.DataFrame(_count(part)))
            part, size = [], 0
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: [] for k in STATISTICS})


def _type(name: str) -> T.DataType:
    return T.StringType() if name == "kind" else T.LongType() if name in WHOLE else T.DoubleType()


def _with_kind(texts: pd.Series) -> pd.DataFrame:
    stats = counted(texts)
    kind = pd.Series(kinds(stats), dtype=object).where(stats["word_count"] > 0, None) if len(stats) else pd.Series([], dtype=object)
    return stats[list(STATISTICS[:5])].assign(kind=kind)


def statistics(docs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row a document: word_count, mean_word_length, symbol_share, ending_share, common_share, and the further
    statistics that the mixture reads. Null and blank texts have zeros. Whole texts are counted, many at a time, in
    numpy: that takes a tenth of the time of one pattern for each statistic in the JVM.
    """
    kind = T.StructType([T.StructField(k, _type(k)) for k in STATISTICS])
    return docs.select(id_col, F.pandas_udf(counted, kind)("text").alias("s")).select(id_col, "s.*")


def judged(docs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The five statistics and `kind` (prose, list, table or junk) of every document; kind is null for null and blank texts."""
    kind = T.StructType([T.StructField(k, _type(k)) for k in (*STATISTICS[:5], "kind")])
    return docs.select(id_col, F.pandas_udf(_with_kind, kind)("text").alias("s")).select(id_col, "s.*")


def found(docs: DataFrame) -> DataFrame:
    """(row_id, kind) of the rows that are not running text."""
    return judged(docs).where("kind <> 'prose'").select("row_id", "kind")
