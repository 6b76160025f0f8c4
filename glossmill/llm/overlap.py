"""Records of evaluation splits that also stand, exactly or nearly, in the training split.

Distinct word sequences stand for all their rows; those on both sides are equal. For the others, the suffixes of both
sides, one at every word, are partitioned and sorted by their first GRAM words and merged: neighbours of different sides
have a common prefix. A training text keeps those of its suffixes that have such a neighbour, and looks up as many disjoint
ones as must be untouched for a near-equal partner, those with the fewest neighbours. The pairs found this way get all
their common runs of GRAM words or more, of any length, which are merged into the coverage of the evaluation record; pairs
that cover too little are rejected, the others compared by an exact word edit distance.

Why no pair is lost: near-equal texts differ by at most k = (words of the longer text) // 8 edits. Of k + 1 disjoint runs
of the training text one is untouched, and moved by at most k words. As the runs may lie anywhere, a beginning that many
texts share is looked up only where a text has no other run. Texts of seven or eight words, which leave no choice,
are found by their forms with one word left out instead. The words that stay in place make at most k + 1 runs, so a
near-equal record of m words is covered by m - 4k words or more (where that is at least GRAM).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import broadcast_if_small, cut
from .format_dups import folded

#: Words a text must have; one word in so many may be edited.
LEAST_WORDS, ONE_IN = 6, 8
#: Words by which suffixes are partitioned and compared first; the least length of a shared span.
GRAM = 4
#: Texts of up to so many words are found by their forms with one word left out.
SHORT = 8


def _rows(train: DataFrame, evals: DataFrame) -> DataFrame:
    """(sent_id, side, folded, part) of rows of enough words. part: the input partition."""
    sided = train.select("sent_id", "text", F.lit(1).alias("side")).unionByName(evals.select("sent_id", "text", F.lit(2).alias("side")))
    f = sided.select("sent_id", "side", folded(F.col("text")).alias("folded"), F.spark_partition_id().alias("part"))
    return cut(f.where(F.size(F.split("folded", " ")) >= LEAST_WORDS), "overlap-rows")


def _rep() -> Column:
    """What stands for a word sequence: the digest of its folded words, computed where needed as it doesn't compress."""
    return F.unhex(F.md5("folded"))


def _records(rows: DataFrame) -> DataFrame:
    """One row for each distinct word sequence: id, folded, n, and the sides it occurs on (1 training, 2 evaluation, 3 both)."""
    reps = rows.groupBy("folded").agg(F.bit_or("side").alias("side"))
    return cut(reps.select(F.monotonically_increasing_id().alias("id"), "folded", F.size(F.split("folded", " ")).alias("n"), "side"), "overlap")


def _windows(records: DataFrame) -> DataFrame:
    """(id, n, at, g): every suffix of GRAM words or more, g being the hash of its first GRAM words."""
    w = records.select("id", "n", F.split("folded", " ").alias("w"))
    s = w.select("id", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - GRAM)).alias("at"))
    return s.select("id", "n", "at", F.xxhash64(*[F.get("w", F.col("at") + i) for i in range(GRAM)]).alias("g"))


def cheapest(n: int, cost: dict[int, int]) -> list[int]:
    """Where to look up a text of n words: of the sets of n // 7 + 1 disjoint windows of GRAM words, the one with the
    fewest neighbours; `cost` has the neighbours of the windows that have any. Windows without any are left out."""
    wanted = n // (ONE_IN - 1) + 1
    last = n - GRAM + 1
    best = np.full((wanted + 1, n + 1), np.iinfo(np.int64).max // 4)  # windows chosen so far, words passed
    best[0] = 0
    take = np.zeros((wanted + 1, n + 1), bool)
    for j in range(1, wanted + 1):
        for end in range(GRAM * j, n + 1):
            one = best[j - 1, end - GRAM] + cost.get(end - GRAM, 0)
            take[j, end] = one < best[j, end - 1]
            best[j, end] = min(one, best[j, end - 1])
    out, end, j = [], n, wanted
    while j:
        if take[j, end]:
            end, j = end - GRAM, j - 1
            if end < last and cost.get(end):
                out.append(end)
        else:
            end -= 1
    return out[::-1]


def _chosen(n: pd.Series, at: pd.Series, cost: pd.Series) -> pd.Series:
    return pd.Series([cheapest(int(k), dict(zip(map(int, a), map(int, c)))) for k, a, c in zip(n, at, cost)])


def _near_windows(records: DataFrame) -> DataFrame:
    """(t, e): pairs of different texts with a common run at about the same place, by the merged suffixes of both sides."""
    e = cut(_windows(records.where(f"side >= 2 and n >= {SHORT}")), "overlap-suffixes")
    counts = e.groupBy("g").agg(F.count("*").alias("cost"))
    t = _windows(records.where(f"side in (1, 3) and n > {SHORT}"))
    # Both sides lie sorted by g; only suffixes with a neighbour of the other side remain. A g that many training texts
    # share meets one row of `counts`, so its partition can be split anywhere.
    met = t.join(counts.hint("merge"), "g").groupBy("id", "n").agg(F.collect_list(F.struct("at", "cost", "g")).alias("m"))
    at = F.pandas_udf(_chosen, T.ArrayType(T.IntegerType()))("n", F.transform("m", lambda x: x["at"]), F.transform("m", lambda x: x["cost"]))
    chosen = met.select("id", "n", "m", at.alias("keep")).where(F.size("keep") > 0)
    chosen = chosen.select(F.col("id").alias("t"), F.col("n").alias("tn"), F.explode(F.filter("m", lambda x: F.array_contains("keep", x["at"]))).alias("m"))
    both = chosen.select("t", "tn", F.col("m.at").alias("ta"), F.col("m.g").alias("g")).join(e, "g")
    k = F.floor(F.greatest("tn", "n") / ONE_IN)
    return both.where((F.abs(F.col("tn") - F.col("n")) <= k) & (F.abs(F.col("ta") - F.col("at")) <= k) & (F.col("t") != F.col("id"))).select("t", F.col("id").alias("e"))


def _near_short(records: DataFrame) -> DataFrame:
    """(t, e): pairs of different texts, the training text of at most SHORT words, that may be one edit apart."""
    w = F.split("folded", " ")
    forms = F.concat(F.array(F.xxhash64(w)), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(F.filter(w, lambda x, j: j != i))))
    of = lambda where, name: records.where(where).select(F.col("id").alias(name), F.explode(F.array_distinct(forms)).alias("h"))
    t, e = of(f"side in (1, 3) and n between {SHORT - 1} and {SHORT}", "t"), of(f"side >= 2 and n between {SHORT - 1} and {SHORT + 1}", "e")
    return t.join(e, "h").where("t <> e").select("t", "e")


def coverage(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """How many words of b stand in runs of GRAM words or more that are also in a, moved by at most k words."""
    covered = np.zeros(len(b), bool)
    for d in range(-k, k + 1):  # b[i] against a[i + d]
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        if hi - lo < GRAM:
            continue
        same = np.concatenate([[False], a[lo + d : hi + d] == b[lo:hi], [False]]).astype(np.int8)
        step = np.diff(same)
        for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if y - x >= GRAM:
                covered[lo + x : lo + y] = True
    return int(covered.sum())


def within(a: list, b: list, k: int) -> bool:
    """Whether at most k words must be changed, added or dropped to get from a to b."""
    if abs(len(a) - len(b)) > k:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b)) <= k
    if k == 0:
        return False
    far = k + 1
    row = [j if j <= k else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - k), min(len(b), i + k)
        new = [far] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > k:
            return False
    return row[len(b)] <= k


def near(x: list[str], y: list[str]) -> bool:
    """Whether a training text x and an evaluation text y are near-equal: coverage first, then the exact distance."""
    k = max(len(x), len(y)) // ONE_IN
    least = len(y) - 4 * k
    if least >= GRAM and k:
        number: dict[str, int] = {}
        a, b = (np.array([number.setdefault(w, len(number)) for w in v]) for v in (x, y))
        if coverage(a, b, k) < least:
            return False
    return within(x, y, k)


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)


def _pairs(records: DataFrame) -> DataFrame:
    """(t, e): the reps of all near-equal (or equal) pairs of distinct training and evaluation word sequences."""
    pairs = cut(_near_windows(records).unionByName(_near_short(records)).distinct(), "overlap-pairs")
    # Only sequences of some pair take part in the comparison; if they are few, the others are left where they are.
    ids = pairs.select(F.explode(F.array("t", "e")).alias("id")).distinct()
    kept = records.join(broadcast_if_small(ids), "id", "left_semi")
    side = lambda c: kept.select(F.col("id").alias(c), _rep().alias(f"{c}_rep"), F.col("folded").alias(f"{c}_text"))
    both = pairs.join(side("t"), "t").join(side("e"), "e")
    close = both.where(F.pandas_udf(_near, T.BooleanType())("t_text", "e_text")).select(F.col("t_rep").alias("t"), F.col("e_rep").alias("e"))
    return close.unionByName(records.where("side = 3").select(_rep().alias("t"), _rep().alias("e")))


def _packs(rows: DataFrame, side: int, rep: str, ids: str) -> DataFrame:
    """The ids of each rep, in one list for each input partition: a rep that holds a third of all rows is many short rows."""
    return rows.where((F.col("side") == side) & F.col("sent_id").isNotNull()).groupBy(_rep().alias(rep), "part").agg(F.collect_list("sent_id").alias(ids)).drop("part")


def found(train: DataFrame, *evals: DataFrame) -> DataFrame:
    """(sent_id_a, sent_id_b): every pair of a training row and an evaluation row of six words or more that are nearly equal.

    Null and short texts and rows without an id give no pair. Columns beside sent_id and text are ignored. `linked` says
    the same without pairs of rows.
    """
    rows = _rows(train, _union(evals))
    e = _pairs(_records(rows)).join(_packs(rows, 2, "e", "es"), "e").select("t", "es")
    both = e.join(_packs(rows, 1, "t", "ts"), "t").select("ts", F.explode("es").alias("y")).select(F.explode("ts").alias("x"), "y")
    return both.select(F.least("x", "y").alias("sent_id_a"), F.greatest("x", "y").alias("sent_id_b"))


def linked(train: DataFrame, *evals: DataFrame) -> DataFrame:
    """(sent_id, class_id, links): each row with a partner on the other side; class_id is the smallest sent_id of the rows of
    its side with the same words, links the number of its partners. Grows with the rows, not with their pairs."""
    rows = _rows(train, _union(evals)).where("sent_id is not null")
    pairs = _pairs(_records(rows))
    per = cut(rows.groupBy("side", _rep().alias("rep")).agg(F.count("*").alias("n"), F.min("sent_id").alias("class_id")), "overlap-classes")
    of = lambda side, name: per.where(F.col("side") == side).select(F.col("rep").alias(name), "n")
    t = pairs.join(of(2, "e"), "e").groupBy(F.lit(1).alias("side"), F.col("t").alias("rep")).agg(F.sum("n").alias("links"))
    e = pairs.join(of(1, "t"), "t").groupBy(F.lit(2).alias("side"), F.col("e").alias("rep")).agg(F.sum("n").alias("links"))
    links = cut(t.unionByName(e).join(per, ["side", "rep"]).select("side", "rep", "class_id", "links"), "overlap-links")
    own = rows.select("sent_id", "side", _rep().alias("rep"))
    return own.join(broadcast_if_small(links), ["side", "rep"]).select("sent_id", "class_id", "links")


def _union(evals: tuple[DataFrame, ...]) -> DataFrame:
    slim = [e.select("sent_id", "split", "source", "text") for e in evals]
    out = slim[0]
    for e in slim[1:]:
        out = out.unionByName(e)
    return out


def report(train: DataFrame, *evals: DataFrame) -> DataFrame:
    """(split, source, rows_all, rows_overlapping, partners): evaluation rows with a partner in training, and how many partners."""
    ev = _union(evals)
    rows = _rows(train, ev)
    pairs = _pairs(_records(rows))
    t = rows.where("side = 1").groupBy(_rep().alias("t")).agg(F.count("*").alias("rows_t"))
    per_e = pairs.join(t, "t").groupBy("e").agg(F.sum("rows_t").alias("partners"))
    # Rows of one rep are counted before the join, so a repeated sentence reaches it once for each split and source.
    keyed = ev.select("split", "source", folded(F.col("text")).alias("folded")).select("split", "source", F.unhex(F.md5("folded")).alias("e"))
    shares = keyed.groupBy("e", "split", "source").agg(F.count("*").alias("rows_e"))
    hit = shares.join(per_e, "e").groupBy("split", "source")
    hit = hit.agg(F.sum("rows_e").alias("rows_overlapping"), F.sum(F.col("rows_e") * F.col("partners")).alias("partners"))
    total = ev.groupBy("split", "source").agg(F.count("*").alias("rows_all"))
    both = total.alias("a").join(hit.alias("h"), F.col("a.split").eqNullSafe(F.col("h.split")) & F.col("a.source").eqNullSafe(F.col("h.source")), "left")
    return both.select("a.split", "a.source", "rows_all", F.coalesce("rows_overlapping", F.lit(0)).alias("rows_overlapping"), F.coalesce("partners", F.lit(0)).alias("partners"))
