"""Learns the weights of `sentences` as an averaged structured perceptron and writes `sentences_model.json`.

    python -m glossmill.llm.sentences_fit FOLDER

The texts are WRITTEN texts made of sentences written by hand (`sentences_examples`), whose boundaries are known, and at
most TEXTS rows of parquet_keeper in FOLDER with sentence marks in almost every line. `annotate` marks the latter by the
conventions for clean text; its output was read through by hand and corrected until none of a few hundred texts was
wrong. Each text is learned as it is and in copies that carry its sentences over to harder forms: lower case, capitals,
marks stripped (in scripts without gaps too), other gaps. Stripped copies are what teaches text without marks; most keep
what stands inside web addresses, decimals and abbreviations, and some keep a few of the real marks. The shipped model was
trained on /root/testdata/sf0.1.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import defaultdict

from .sentences import GAPPED, MARKS, MODEL, decode, observed, places
from .sentences_examples import written

TEXTS, WRITTEN, PASSES = 8000, 4000, 8
# Abbreviations that a name or number follows, so that a capital after them begins no sentence.
TITLES = """prof dr p mr mrs ms hr fr st nr no ul ул g pr al pl św ks mgr inż doc hab inž akad gen kun im им проф акад гл рис см стр str žr fig vol ca ok np tzn m.in pvz plg e.g i.e approx bzw z b d.h vgl tel mob el sq art""".split()
# German months, which are capitalised after a day with its point.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()
_AT = re.compile(rf"([{re.escape(MARKS)}]+)([\"'”“»」』)\]]*)(\s*)(?=\S)")


def annotate(text: str) -> set[int]:
    """First characters of the sentences of a clean text by its conventions, without the text's own first one."""
    nocase = text.lower() == text
    out = set()
    for at, start, got, nxt, inside in places(text):
        if not got or got == " " and not re.search(f"[{GAPPED}]", text[start - 1 : start]):
            continue
        head = text[:at]
        if re.search(r"(?>\r\n|[\n\r\u2028\u2029])[^\S\n\r\u2028\u2029]*(?>\r\n|[\n\r\u2028\u2029])\s*$", head):
            out.add(at)
            continue
        m = re.search(rf"([{re.escape(MARKS)}]+)([\"'”“»」』)\]]*)(\s*)$", head)
        goes_on = re.match(r"in:(?:tight\+)?(?:dash\+)*(?:lower|goes_on)|in:tight\+(?:alpha|lower)", inside)
        if not m:
            if re.search(rf"[{GAPPED}]\s+$", head) and not re.search(r"[\n\r]", head[len(head.rstrip()) :]):
                out.add(at)
            continue
        marks, close, gap = m.groups()
        if goes_on:
            continue
        kind = nxt.split("+")[-1]
        before = head[: m.start()]
        token = re.search(r"[^\s\"'„“«(\[「]*$", before)[0]
        if marks[0] in "。！？।։؟" or re.search(r"[\u0530-\u06ff\u0900-\u0dff\u3040-\u9fff]$", before):
            if close and not gap and kind == "alpha":
                continue
            if nxt == "goes_on" or kind == "digit" and not gap:
                continue
            out.add(at)
            continue
        if marks.startswith("..") or marks[0] == "…":
            if kind == "upper":
                out.add(at)
            continue
        if kind == "upper" or (nocase and kind in ("lower", "digit") and gap and not nxt.startswith("dash")):
            if marks == "." and not close:
                if token.lower() in TITLES and not (token.lower() in ("d", "b")):
                    continue
                if len(token) == 1 and token.isupper():
                    continue
                if token.isdigit() and re.match(r"\w+", text[at:]) and re.match(r"\w+", text[at:])[0].lower() in MONTHS:
                    continue
                if nocase and (len(token) < 4 or "." in token or token.isdigit() or token in ("proc", "mln", "usw", "itd", "pan", "etc", "žr", "tūkst")):
                    continue
            if not gap and (marks != "." or len(token) < 3) and kind != "upper":
                continue
            if not gap and re.search(r"[@/]|www\.", token):
                continue
            out.add(at)
        elif kind == "digit" and gap and not (marks == "." and (token.lower() in TITLES or len(token) < 4 or token.isdigit() or token.lower() in ("approx", "proc", "tzn", "m.in"))):
            if re.match(r"(?:18|19|20)\d\d\b", text[at:]) and len(token) > 3:
                out.add(at)
    return out


#: Matter with inner marks that is put into some stripped copies.
INNER = ["www.lrs.lt", "https://example.org/a.html", "info@example.com", "3.5", "12.750", "2.0.1", "e.g.", "m.in.", "10:30", "U.S.A", "index.php?id=4"]


def stripped(text: str, at: set[int], rng: random.Random) -> tuple[str, set[int]]:
    """The text without its marks, or without all but those inside words and after abbreviations, or with a few left."""
    inner, left = rng.random() < 0.5, rng.choice([0.0, 0.0, 0.0, 0.2])
    add = rng.choice([m.end() for m in re.finditer(r"(?<=[^\W\d_]) (?=[^\W\d_])", text) if m.end() not in at] or [-1]) if inner and rng.random() < 0.5 else -1
    out, new, keep = [], set(), False
    for i, c in enumerate(text):
        if i in at:
            new.add(len(out))
        if i == add:
            out.extend(rng.choice(INNER) + " ")
        if c not in MARKS + ",;:\"“”„«»，、；：「」『』":
            out.append(c)
            continue
        if c in MARKS and not (i and text[i - 1] in MARKS):  # a run of marks stays or goes as one
            ends = re.match(rf"[{re.escape(MARKS)}]+[\"'”“»」』)\]]*\s*", text[i:]).end() + i
            token = re.search(r"[^\s\"'„“«(\[「]*$", text[max(0, i - 12) : i])[0].lower()
            real = ends in at or ends >= len(text)
            keep = rng.random() < left if real else inner and (text[i + 1 : i + 2].isalnum() or token in TITLES or len(token) == 1)
        if c in MARKS and keep or c in ",:" and inner and text[i - 1 : i].isalnum() and text[i + 1 : i + 2].isalnum() or c == ":" and inner and text[i + 1 : i + 3] == "//":
            out.append(c)
    return "".join(out), {i for i in new if i < len(out)}


def copies(text: str, at: set[int], rng: random.Random):
    """(text, first characters) as it is and in harder forms."""
    yield text, at
    for change in (str.lower, str.upper):
        if len(change(text)) == len(text) and change(text) != text and rng.random() < 0.3:
            yield change(text), at
    if rng.random() < (0.8 if re.search(r"[A-Za-zА-я]", text) else 0.5):
        less, new = stripped(text, at, rng)
        yield less, new
        if less.lower() != less and len(less.lower()) == len(less) and rng.random() < 0.6:
            yield less.lower(), new
    if rng.random() < 0.3:  # other gaps
        out, new = [], set()
        for i, c in enumerate(text):
            if i in at:
                new.add(len(out))
            out.append(c)
            if c == " ":
                out.extend(rng.choice(["", "", " ", "\n"]) if i + 1 not in at else rng.choice(["", " ", "\n", "\n\n"]))
        yield "".join(out), new


def fit(texts: list[str], seed: int = 0) -> dict[str, float]:
    rng = random.Random(seed)
    rows = []
    for t, known in [(t, annotate(t)) for t in texts] + [written(rng) for _ in range(WRITTEN)]:
        for text, at in copies(t, known, rng):
            seen = observed(text)
            if seen:
                rows.append((seen, len(text) - len(text.lstrip()), {a for a, _ in seen} & at))
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1
    for _ in range(PASSES):
        rng.shuffle(rows)
        wrong = 0
        for seen, first, at in rows:
            got = set(decode(seen, first, w))
            if got != at:
                wrong += 1
                for a, feats in seen:
                    d = (a in at) - (a in got)
                    if d:
                        for f in feats:
                            w[f] += d
                            total[f] += d * step
            step += 1
        print(f"{wrong} of {len(rows)} texts wrong")
    return {f: round(v - total[f] / step, 3) for f, v in sorted(w.items()) if abs(v - total[f] / step) >= 0.05}


def main(folder: str) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    docs = spark.read.parquet(f"{folder}/parquet_keeper.parquet")
    marks = F.regexp_count("text", F.lit(rf"[{re.escape(MARKS)}]")) * 150 >= F.char_length("text")
    gapped = F.col("text").rlike(f"[{GAPPED}]")
    plain = ~F.col("text").rlike(r"[|{}<>=\t]|(?m)^\s*(?:[-*•>]|\d+[.)])\s")
    rows = docs.where((marks | gapped) & plain & (F.char_length("text") < 3000)).orderBy(F.xxhash64("row_id")).limit(TEXTS)
    w = fit([r["text"] for r in rows.select("text").collect()])
    MODEL.write_text(json.dumps(w, ensure_ascii=False, separators=(",", ":"), indent=0) + "\n")


if __name__ == "__main__":
    main(sys.argv[1])
