"""Format-insensitive duplicates, cross-split overlaps, packing and mixing."""

import os
import random
from collections import Counter

import pytest

from glossmill.llm import format_dups, mixing, overlap, packing
from glossmill.llm.tokens import ranked

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
needs_tokens = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


def keeper(spark, *texts):
    return spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "row_id long, text string, key string, entry int").repartition(3)


# --- duplicates hidden by formatting


def test_same_but_for_format(spark):
    same = ["Labas, rytas!  Vilniau", "LABAS RYTAS\tvilniau", "„labas“ rytas — Vilniau…", "Labas rytas\n\nVilniau."]
    fields = ['{"Metai": "1999", "Kalba": "lietuvių"}', "kalba: LIETUVIŲ\nmetai: 1999", "METAI = 1999 | KALBA = lietuvių", "Kalba:\tlietuvių;\nMetai:\t1999;"]
    other = ["Labas rytas Vilniaus", "La​bas rytas Vilniau", "Metai: lietuvių; Kalba: 1999", None, "", "?!", " \n", "!?"]
    rows = [*same, *fields, *other]
    want = {(0, i) for i in range(1, 4)} | {(4, i) for i in range(5, 8)}
    assert {tuple(r) for r in format_dups.found(keeper(spark, *rows)).collect()} == want
    assert {tuple(r) for r in format_dups.found(keeper(spark, *rows), bucket_rows=1).collect()} == want
    got = {tuple(r) for r in format_dups.collapsed(keeper(spark, *rows)).collect()}
    assert got == {(0, 4), (4, 4), (8, 1), (9, 1), (10, 1)}
    assert format_dups.found(keeper(spark, *rows).limit(0)).count() == 0


def test_hot_and_long_groups(spark):
    rng = random.Random(2)
    words = ["miškas", "upė", "kelias", "ąžuolas"]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(300)]
    rows = [t if rng.random() < 0.6 else "Karšta eilutė" for t in base] + ["ilgas " * 20_000, "ILGAS, " * 20_000]
    want = {}
    for i, t in enumerate(rows):
        want.setdefault(" ".join(t.lower().replace(",", "").split()), []).append(i)
    want = {(g[0], i) for g in want.values() for i in g[1:]}
    for limit in (10**6, 7):
        assert {tuple(r) for r in format_dups.found(keeper(spark, *rows), bucket_rows=limit).collect()} == want


def test_long_names_and_long_common_beginnings(spark):
    long = "Labai ilgas lauko pavadinimas be jokios ribos ir be galo"
    rows = [f"{long}: taip; Metai: 1999", f"metai = 1999 | {long.upper()} = TAIP"]
    deep = ["x" * 500 + f" {i % 40}" for i in range(120)]
    want = {(0, 1)} | {(2 + i % 40, 2 + i) for i in range(40, 120)}
    assert {tuple(r) for r in format_dups.found(keeper(spark, *rows, *deep), bucket_rows=5).collect()} == want
    entries = keeper(spark, *deep).selectExpr("encode(text, 'utf-8') key", "1L copies", "row_id entry")
    sizes = format_dups.radix_buckets(entries, 5).groupBy("bucket").agg({"key": "count"}).collect()
    assert max(r[1] for r in sizes) <= 5


def test_trie_counts():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(0, 40))) for _ in range(5000)]
    t = format_dups.Trie()
    for i, k in enumerate(keys):
        t.add(k, 1, i, [i])
    got = {k: (n, row) for k, (n, row, _) in t.items()}
    assert got == {k: (n, keys.index(k)) for k, n in Counter(keys).items()}


def test_rows_without_an_id(spark):
    rows = spark.createDataFrame([(None, "Labas rytas"), (1, "labas rytas!"), (2, "LABAS RYTAS")], "row_id long, text string")
    assert [tuple(r) for r in format_dups.found(rows).collect()] == [(1, 2)]
    t, e = sides(spark, [(None, "vienas du trys keturi penki šeši"), (1, "vienas du trys keturi penki šeši")], [(2, "Vienas du trys keturi penki šeši."), (None, "x")])
    assert [tuple(r) for r in overlap.found(t, e).collect()] == [(1, 2)]


# --- overlaps across splits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_within_is_a_bounded_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        for k in range(4):
            assert overlap.within(a, b, k) == (distance(a, b) <= k)


def sides(spark, train, evals):
    df = lambda rows, split: spark.createDataFrame(rows, "sent_id long, text string").selectExpr("sent_id", "text", f"'{split}' split", "cast(null as string) source", "1 rep", "2 side").repartition(3)
    return df(train, "train"), df(evals, "test")


def test_all_near_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"žodis{i}" for i in range(40)]

    def edited(words):
        out = list(words)
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(out) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                out.insert(i, rng.choice(vocabulary))
            elif i < len(out) and kind == 1:
                out.pop(i)
            elif i < len(out):
                out[i] = rng.choice(vocabulary)
        return out

    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 34))] for _ in range(60)]
    base += [["pradžia", "visada", "ta", "pati", *b[:6]] for b in base]  # a hot beginning
    train = [(i, " ".join(edited(rng.choice(base)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "labas"), (1003, "kartą " * 3000)]
    evals = [(5000 + i, " ".join(w.upper() + "," for w in edited(rng.choice(base)))) for i in range(120)] + [(6000, None), (6001, "Kartą, " * 3000)]
    got = [tuple(r) for r in overlap.found(*sides(spark, train, evals)).collect()]
    norm = lambda t: t.lower().replace(",", "").split() if t else []
    t, e = ([(i, norm(x)) for i, x in rows if len(norm(x)) >= 6] for rows in (train, evals))
    want = {(i, j) for i, a in t for j, b in e if len(a) < 1000 and len(b) < 1000 and distance(a, b) <= max(len(a), len(b)) // 8} | {(1003, 6001)}
    assert len(got) == len(set(got)) and set(got) == want
    links = {r["sent_id"]: r for r in overlap.linked(*sides(spark, train, evals)).collect()}
    assert {i: r["links"] for i, r in links.items()} == Counter(x for pair in want for x in pair)
    words = dict(t) | dict(e)
    for i, r in links.items():
        same = [x for x, w in words.items() if (x < 5000) == (i < 5000) and w == words[i]]
        assert r["class_id"] == min(same)
    rows = overlap.report(*sides(spark, train, evals)).collect()
    assert [(r["rows_all"], r["rows_overlapping"], r["partners"]) for r in rows] == [(len(evals), len({b for _, b in want}), len(want))]


def test_short_texts_and_all_edits(spark):
    rng = random.Random(6)
    train = [(i, " ".join(rng.choice("abc") * 2 for _ in range(rng.randrange(6, 11)))) for i in range(250)]
    evals = [(5000 + i, " ".join(rng.choice("abc") * 2 for _ in range(rng.randrange(6, 11)))) for i in range(60)]
    want = {(i, j) for i, a in train for j, b in evals if distance(a.split(), b.split()) <= max(len(a.split()), len(b.split())) // 8}
    assert want and {tuple(r) for r in overlap.found(*sides(spark, train, evals)).collect()} == want


def test_windows_with_the_fewest_neighbours():
    import itertools

    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(9, 33)
        wanted = n // 7 + 1
        cost = {a: rng.randrange(1, 9) for a in rng.sample(range(n - 3), rng.randrange(0, n - 3))}
        best = min(sum(cost.get(a, 0) for a in c) for c in itertools.combinations(range(n - 3), wanted) if all(y - x >= 4 for x, y in zip(c, c[1:]))) if wanted < 4 else None
        got = overlap.cheapest(n, cost)
        assert len(got) <= wanted and all(y - x >= 4 for x, y in zip(got, got[1:])) and all(cost[a] for a in got)
        if best is not None:
            assert sum(cost[a] for a in got) == best


def test_coverage_rejects(spark):
    words = [f"w{i}" for i in range(24)]
    other = words[:4] + [f"x{i}" for i in range(20)]
    assert overlap.near(words, words[:10] + ["y"] + words[11:]) and not overlap.near(words, other)
    import numpy as np

    number = {w: i for i, w in enumerate({*words, *other})}
    ids = lambda v: np.array([number[w] for w in v])
    assert overlap.coverage(ids(words), ids(other), 3) == 4 and overlap.coverage(ids(words), ids(words), 3) == 24


def test_a_beginning_that_all_share_makes_no_candidates(spark):
    """A stock beginning of four words in every text: only texts that share more are compared."""
    stock = ["mes", "pranešame", "jums", "kad"]
    train = [(i, " ".join(stock + [f"t{i}x{k}" for k in range(8)])) for i in range(300)]
    evals = [(5000 + i, " ".join(stock + [f"e{i}x{k}" for k in range(8)])) for i in range(100)] + [(6000, train[7][1] + " dar")]
    t, e = sides(spark, train, evals)
    records = overlap._records(overlap._rows(t, e))
    assert overlap._near_windows(records).distinct().count() <= 3
    assert [tuple(r) for r in overlap.found(t, e).collect()] == [(7, 6000)]


def test_no_rows_no_pairs(spark):
    t, e = sides(spark, [(1, "vienas du trys keturi penki šeši")], [(2, "vienas du trys keturi penki šeši")])
    assert [tuple(r) for r in overlap.found(t, e).collect()] == [(1, 2)]
    assert overlap.found(t.limit(0), e).count() == 0 == overlap.found(t, e.limit(0)).count()


# --- packing


@pytest.mark.parametrize("capacity", [1, 2, 3, 10, 97, 1000])
def test_plan_puts_every_item_once(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        sizes = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 200)))
        seen, bins, large = set(), Counter(), Counter()
        for size, a, b, first, each in packing.plan(dict(sizes), capacity):
            for r in range(a, b):
                assert (size, r) not in seen
                seen.add((size, r))
                bins[first + (r - a) // each] += size
                large[first + (r - a) // each] += 3 * size > capacity
        assert len(seen) == sum(sizes.values()) and all(n <= capacity for n in bins.values()) and all(n <= 2 for n in large.values())
        assert set(bins) == set(range(len(bins)))
        if capacity >= 97 and sum(sizes.values()) > 100:
            assert len(bins) <= 1.25 * sum(s * n for s, n in sizes.items()) / capacity + 2


@needs_tokens
def test_containers(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["miškas", "upė", "the", "river"], k=rng.choice([1, 3, 20, 400])))) for i in range(200)] + [(900, None), (901, ""), (902, "žodis " * 5000)]
    docs = spark.createDataFrame([(i, t, None, 0) for i, t in rows], "doc_id long, text string, source string, size int").repartition(3)
    packs = spark.createDataFrame([("a", 64), ("b", 2048)], "pack_name string, capacity_tokens int")
    got = packing.assigned(docs, packs).collect()
    for name, capacity in (("a", 64), ("b", 2048)):
        own = [r for r in got if r["pack_name"] == name]
        fill = Counter()
        parts = {}
        for r in own:
            fill[r["container_id"]] += r["size"]
            parts.setdefault(r["doc_id"], []).append((r["part_no"], r["start_token"], r["size"]))
        assert max(fill.values()) <= capacity and 900 not in parts and 901 not in parts
        for p in parts.values():
            at = 0
            for k, (no, start, size) in enumerate(sorted(p)):
                assert (no, start) == (k, at) and size > 0
                at += size
            assert len(p) == -(-at // capacity)
    r = {x["pack_name"]: x for x in packing.report(docs, packs).collect()}
    assert r["a"]["tokens"] == r["b"]["tokens"] and r["a"]["fill"] > 0.9
    assert packing.assigned(docs.limit(0), packs).count() == 0 == packing.assigned(docs, packs.limit(0)).count()


def test_ranks(spark):
    rows = [(i % 2, i * 7 % 500) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    for largest in (250, 10**6):
        got = ranked(df, ["k"], ["v"], largest).collect()
        assert sorted((r["k"], r["rank"]) for r in got) == [(k, i) for k in (0, 1) for i in range(250)]


# --- mixing


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        budget = rng.randrange(0, 120)
        reach = {0}
        for s, n in counts.items():
            reach = {a + k * s for a in reach for k in range(n + 1)}
        took = mixing.knapsack(counts, budget)
        assert all(n <= counts[s] for s, n in took.items())
        assert sum(s * n for s, n in took.items()) == max(a for a in reach if a <= budget)


def test_budgets_are_met_where_lengths_allow():
    counts = {70_001: 5, 90_001: 7, 120_007: 3, 200_003: 4}
    took = mixing.fit(counts, 500_000)
    assert 500_000 - sum(s * n for s, n in took.items()) == 9_983
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(rng.randrange(1, 7))}
        total = sum(s * n for s, n in counts.items())
        budget = rng.randrange(0, total)
        reach = {0}
        for s, n in counts.items():
            reach = {a + k * s for a in reach for k in range(n + 1)}
        took = mixing.fit(counts, budget)
        assert all(0 < n <= counts[s] for s, n in took.items()) and sum(s * n for s, n in took.items()) == max(a for a in reach if a <= budget)


@needs_tokens
def test_shares(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["miškas"] * rng.choice([1, 2, 9, 30])), rng.choice(["a", "a", "a", "b", "c", None, "x"])) for i in range(600)]
    docs = spark.createDataFrame([*rows, (900, None, "a"), (901, "", "b")], "doc_id long, text string, source string").repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(docs, targets, seed=1).collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= most[r["source"]] for r in got)
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["tokens"] * r["copies"]
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert tokens[s] / sum(tokens.values()) == pytest.approx(share / 0.95, abs=0.002)
    report = {r["source"]: r for r in mixing.report(docs, targets, seed=1).collect()}
    assert report["none"]["tokens"] == 0 and report["a"]["tokens"] == tokens["a"]
    used = lambda rows: {(r["doc_id"], r["copies"]) for r in rows}
    assert used(mixing.mixed(docs, targets, seed=2).collect()) != used(got) == used(mixing.mixed(docs, targets, seed=1).collect())
    assert mixing.mixed(docs.limit(0), targets).count() == 0
