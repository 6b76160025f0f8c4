"""Mixing sources to target shares of all tokens.

The budget of each source is filled exactly where its lengths allow: whole passes over the source, then a like share of
each length, then a bounded knapsack over the lengths left for what remains. Documents of a length are chosen by a
seeded hash. Only the counts by source and exact length come to the driver: their number is bounded by the number of
sources and the longest document, not by the number of documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if_small
from .tokens import planned, ranked, sized

#: Tokens that the dynamic program may be wide: 4 bytes each on the driver.
WIDTH = 1 << 25


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length (at most its count) sum to `budget`, or to the largest reachable sum under it.

    Sums that can be reached are bits of one number; of each sum it is noted which items first reached it.
    """
    reach, mask = 1, (1 << (budget + 1)) - 1
    items: list[tuple[int, int]] = []  # (length, how many at once): counts by powers of two
    by = np.full(budget + 1, -1, np.int32)
    for length in sorted(counts, reverse=True):
        n, k = min(counts[length], budget // length if length else 0), 1
        while n > 0 and not reach >> budget & 1:
            k = min(k, n)
            new = (reach << (length * k)) & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                bytes_ = np.flatnonzero(bits)
                at = np.flatnonzero(np.unpackbits(bits[bytes_], bitorder="little"))
                by[bytes_[at >> 3] * 8 + (at & 7)] = len(items)
                reach |= new
            items.append((length, k))
            n, k = n - k, k * 2
    at = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    while at:
        length, k = items[by[at]]
        chosen[length] += k
        at -= length * k
    return dict(chosen)


def _even(counts: dict[int, int], budget: int, total: int) -> dict[int, int]:
    """A like share of every length, rounded so that the error doesn't add up over lengths, and at most `budget` tokens."""
    out, passed = {}, 0
    for s in sorted(counts):
        out[s] = (passed + counts[s]) * budget // total - passed * budget // total
        passed += counts[s]
    over = sum(s * n for s, n in out.items()) - budget
    while over > 0:
        s = min((s for s, n in out.items() if n and s >= over), default=None) or max(s for s, n in out.items() if n)
        out[s] -= 1
        over -= s
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take for `budget` tokens, which is less than the source has.

    Each length gives a like share of its documents (`_even`), and the dynamic program fills what remains. While that leaves a gap,
    documents are handed back, for four times as many tokens every time, until the budget is met or none is left to hand
    back (the result is then the best there is) or the program would be wider than WIDTH.
    """
    total = sum(s * n for s, n in counts.items())
    if not total or budget <= 0:
        return {}
    even = _even(counts, budget, total)
    best: dict[int, int] = {}
    kept, gap, goal = dict(even), budget + 1, 0
    rest = budget - sum(s * n for s, n in kept.items())
    while True:
        while rest < goal and any(kept.values()):  # one document of each length in turn, short ones first
            for s in sorted(s for s, n in kept.items() if n):
                kept[s] -= 1
                rest += s
                if rest >= goal:
                    break
        if rest > WIDTH and best:
            break
        took = knapsack({s: n - kept[s] for s, n in counts.items() if n > kept[s]}, rest)
        left = rest - sum(s * n for s, n in took.items())
        if left < gap:
            gap, best = left, {s: n + took.get(s, 0) for s, n in kept.items()}
        if not gap or not any(kept.values()):
            break
        goal = max(1024, 4 * rest)
    return {s: n for s, n in best.items() if n}


def _plan(sizes: DataFrame, targets: DataFrame):
    """Per source: (target, budget, whole passes, {length: documents used once more}), and the largest count."""
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    hist: dict[str, dict[int, int]] = defaultdict(dict)
    known = sizes.where("tokens > 0").join(broadcast_if_small(targets.select("source")), "source", "left_semi")
    for r in known.groupBy("source", "tokens").count().collect():
        hist[r["source"]][r["tokens"]] = r["count"]
    have = {s: sum(a * n for a, n in h.items()) for s, h in hist.items()}
    total = min((int(have[s] * goals[s][1] / goals[s][0]) for s in have if goals[s][0] > 0), default=0)
    out = {}
    for s in have:
        share, repeats = goals[s]
        budget = min(round(share * total), have[s] * repeats)
        passes, rest = divmod(budget, have[s])
        out[s] = (share, budget, passes, fit(hist[s], rest))
    return out, max((n for h in hist.values() for n in h.values()), default=0)


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture and how often each is used.

    The mixture is the largest that keeps all shares: the source that runs out first (at max_repeats uses of each of its
    documents) sets it. Sources without documents, null sources and texts without tokens contribute nothing.
    """
    spark = docs.sparkSession
    sizes = sized(docs)
    plan, largest = _plan(sizes, targets)
    base = planned(spark, [(s, p) for s, (_, _, p, _) in plan.items()], "source string, passes long", "mix-passes")
    more = planned(spark, [(s, a, n) for s, (*_, e) in plan.items() for a, n in e.items()], "source string, tokens long, extra long", "mix-extra")
    rows = sizes.where("tokens > 0").join(base, "source").withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    ranks = ranked(rows, ["source", "tokens"], ["_h", "doc_id"], largest)
    joined = ranks.join(more, ["source", "tokens"], "left")
    copies = F.col("passes") + (F.col("rank") < F.coalesce("extra", F.lit(0))).cast("long")
    return joined.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def report(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_copies, tokens, actual_share) for every target source."""
    m = mixed(docs, targets, seed)
    per = m.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = targets.join(per, "source", "left").na.fill(0, ["documents", "most_copies", "tokens"])
    total = F.broadcast(per.agg(F.sum("tokens").alias("all")))
    return rows.join(total, F.lit(True), "left").select(
        "source", "target_share", "max_repeats", "documents", "most_copies", "tokens", F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share")
    )


def checked(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(source, share_met, repeats_kept): whether each source has its share of all tokens, to the length of the longest
    document, and no document is used too often. Sources without documents have no share to meet."""
    r = report(docs, targets, seed)
    longest = sized(docs).agg(F.max("tokens").alias("_longest"))
    totals = r.agg(F.sum("tokens").alias("_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("_shares"))
    both = r.join(F.broadcast(totals), F.lit(True), "left").join(F.broadcast(longest), F.lit(True), "left")  # one row each
    off = F.abs(F.col("tokens") - F.col("target_share") / F.col("_shares") * F.col("_tokens"))
    met = (F.col("tokens") == 0) | (off <= 1 + F.col("_longest"))
    return both.select("source", met.alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))
