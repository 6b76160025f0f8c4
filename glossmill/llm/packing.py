"""Filling containers of a fixed number of tokens with documents.

The plan is made from the histogram of sizes alone (its length is bounded by the capacity, whatever the number of
documents): items above a third of the capacity are matched greedily, at most two a container, then smaller items go
to the tightest gap that takes them. Documents find their container by their rank among the documents of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if_small
from .tokens import planned, ranked, sized


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first container, items a container) so that every item has a container.

    Item `rank` of `size` goes to container first + (rank - first rank) // items a container.
    """
    left = {s: n for s, n in sizes.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first container, containers)
    order: list[int] = []  # gaps in use, ascending
    made = 0

    def take(size: int, n: int, first: int, each: int) -> None:
        out.append((size, used[size], used[size] + n, first, each))
        used[size] += n
        left[size] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1  # the largest partner that fits
        if i == len(large) - 1 and left[a] < 2:
            i -= 1
        if i < 0:
            n = left[a]
            take(a, n, made, 1)
            leave(capacity - a, made, n)
        elif large[i] == a:
            n = left[a] // 2
            take(a, 2 * n, made, 2)
            leave(capacity - 2 * a, made, n)
        else:
            n = min(left[a], left[large[i]])
            take(a, n, made, 1)
            take(large[i], n, made, 1)
            leave(capacity - a - large[i], made, n)
        made += n
        if not left[a]:
            large.pop()
        if 0 <= i < len(large) and not left[large[i]]:
            large.pop(i)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):
                each = capacity // s
                n = -(-left[s] // each)
                leave(capacity, made, n)
                made += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(i)
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                take(s, full * each, first, each)
                leave(gap - each * s, first, full)
            first, n = first + full, n - full
            if n and left[s]:  # fewer than `each` are left
                rest = left[s]
                take(s, rest, first, rest)
                leave(gap - rest * s, first, 1)
                first, n = first + 1, n - 1
            leave(gap, first, n)
    return out


def _items(sizes: DataFrame, packs: dict[str, int]) -> DataFrame:
    """Documents as items of each pack: whole, or cut every `capacity` tokens if they are larger."""
    each = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(packs.items())])
    rows = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(each).alias("p")).select("doc_id", "tokens", "p.*")
    parts = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))
    parted = rows.select("pack_name", "capacity", "doc_id", "tokens", F.explode(parts).alias("part_no"))
    start = F.col("part_no") * F.col("capacity")
    return parted.select("pack_name", "doc_id", "part_no", start.alias("start_token"), F.least(F.col("tokens") - start, "capacity").alias("size"))


def assigned(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, container_id, doc_id, part_no, start_token, size): where each document, or part of one, goes.

    Only documents above the capacity have parts. Null and empty texts have no tokens and no container.
    """
    spark = docs.sparkSession
    capacity = {r["pack_name"]: int(r["capacity_tokens"]) for r in packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").collect()}
    if not capacity:
        return spark.createDataFrame([], "pack_name string, container_id long, doc_id long, part_no int, start_token long, size long")
    items = _items(sized(docs), capacity)
    counts = items.groupBy("pack_name", "size").count().collect()  # at most the sum of the capacities
    by: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counts:
        by[r["pack_name"]][r["size"]] = r["count"]
    rows = [(name, *step) for name, sizes in by.items() for step in plan(sizes, capacity[name])]
    steps = planned(spark, rows, "pack_name string, size long, from_rank long, end_rank long, first long, each long", "pack-steps")
    ranks = ranked(items, ["pack_name", "size"], ["doc_id", "part_no"], max((r["count"] for r in counts), default=0))
    joined = ranks.join(steps, ["pack_name", "size"]).where("rank >= from_rank and rank < end_rank")
    container = F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each"))
    return joined.select("pack_name", container.cast("long").alias("container_id"), "doc_id", "part_no", "start_token", "size")


def checked(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, none_over, is_whole, none_split): whether all containers keep the capacity, every document's tokens are
    there once, and only documents above the capacity are split."""
    sizes = sized(docs)
    total = sizes.where("tokens > 0").agg(F.count("*").alias("docs"), F.sum("tokens").alias("all"))
    got = assigned(docs, packs).join(broadcast_if_small(packs.select("pack_name", "capacity_tokens")), "pack_name")
    over = got.groupBy("pack_name", "container_id").agg(F.sum("size").alias("n"), F.first("capacity_tokens").alias("c")).groupBy("pack_name").agg(F.max(F.col("n") - F.col("c")).alias("over"))
    per = got.groupBy("pack_name").agg(F.sum("size").alias("n"), F.count_if(F.col("part_no") == 0).alias("first"), F.count_if((F.col("part_no") > 0) & (F.col("start_token") < F.col("capacity_tokens"))).alias("split"))
    both = per.join(over, "pack_name").join(F.broadcast(total))  # one row
    return both.select("pack_name", (F.col("over") <= 0).alias("none_over"), ((F.col("n") == F.col("all")) & (F.col("first") == F.col("docs"))).alias("is_whole"), (F.col("split") == 0).alias("none_split"))


def report(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, tokens, fill): how full the containers are."""
    per = assigned(docs, packs).groupBy("pack_name", "container_id").agg(F.sum("size").alias("tokens"))
    total = per.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    joined = packs.join(total, "pack_name")
    fill = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return joined.select("pack_name", "capacity_tokens", "containers", "tokens", "fullest", fill.alias("fill"))
