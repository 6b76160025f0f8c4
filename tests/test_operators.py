"""Tagger responses, splits, packing, metrics, averaging, scoring."""

import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import averaging, dataset, metrics, packing, scoring, sentences, splits
from glossmill.plans.running import numbered, running


def T(kind, string=None, mi=None):
    return (kind, string, mi)


TOKENS = "row_id long, chunk_no int, received_at timestamp, tokens array<struct<type:string,string:string,mi:string>>"


def test_group_sentences(spark):
    end = T("SENTENCE_END")
    one = [T("WORD", "Labas", "Ya"), T("SPACE", " "), T("WORD", "kas", "Dl"), T("SEPARATOR", ".\n"), end, end, T("WORD", "x", "")]
    cut = [T("WORD", "a", "")] * 18 + [end, T("WORD", "b", ""), end, T("WORD", "c", ""), end, *[T("WORD", "d", "")] * 20, end]
    rows = spark.createDataFrame([(1, 0, None, one), (2, 0, None, None), (3, 0, None, cut), (3, 1, None, [end]), (4, 0, None, [T("WORD", "q", None)])], TOKENS)
    got = {(r["row_id"], r["sent_no"]): r["sentence"] for r in sentences.group_sentences(rows).collect()}
    assert got[1, 0] == "Labas(=Ya) kas(=Dl)." and (1, 1) not in got
    assert got[3, 1] == "b" and got[3, 2] == "c" and (3, 3) not in got  # the last end lies beyond 95 %
    assert not [k for k in got if k[0] in (2, 4)]


def test_unknown_token_fails(spark):
    rows = spark.createDataFrame([(1, 0, None, [T("ODD", "x"), T("SENTENCE_END")])], TOKENS)
    with pytest.raises(Exception, match="unknown token type"):
        sentences.group_sentences(rows).collect()


def test_running_is_a_prefix_sum(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(500)]
    rng.shuffle(rows)
    got = {r["i"]: r["s"] for r in running(spark.createDataFrame(rows, "i int, k string, v int"), ["i"], ["k"], s=F.col("v")).collect()}
    seen, want = {}, {}
    for i, k, v in sorted(rows):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + v
    assert got == want
    assert numbered(spark.createDataFrame([], "i int"), ["i"]).count() == 0


@pytest.mark.parametrize("cap", [0, 5, 30, 10**9])
def test_capped_split(spark, cap):
    rows = [(i, " ".join("w" * (i % 4 + 1))) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, text string")
    u = {r["id"]: r["u"] for r in df.select("id", splits.draw("id").alias("u")).collect()}
    got = {r["id"]: r["part"] for r in splits.split_capped(df, "id", cap).collect()}
    dev = test = 0
    for i, t in rows:
        n = len(t.split())
        if u[i] < 0.05 and dev < cap:
            part, dev = "dev", dev + n
        elif u[i] < 0.1 and test < cap:
            part, test = "test", test + n
        else:
            part = "train"
        assert got[i] == part


def plain_pack(sents, length, carry, flush):
    """(row -> list of (sent, pos)) by the rule, word by word."""
    rows, row, own = [], [], []
    used = 1
    for s, sizes in enumerate(sents):
        if sum(sizes) >= length - packing.MARGIN:
            continue
        for i, n in enumerate(sizes):
            if used + n > length - 1:
                rows.append(row)
                row, used = [], 1
                if i > 0 and carry:
                    row = list(own)
                    used += sum(sizes[p] for _, p in own)
            if i == 0:
                own = []
            row.append((s, i))
            own.append((s, i))
            used += n
    if flush and row:
        rows.append(row)
    return rows


@pytest.mark.parametrize("carry", [True, False])
@pytest.mark.parametrize("flush", [True, False])
def test_packing_like_the_rule(spark, carry, flush):
    rng = random.Random(7)
    groups = {g: [[rng.randrange(0, 6) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 12))] for g in range(40)}
    rows = [(g, s, p, [1] * n) for g, sents in groups.items() for s, sizes in enumerate(sents) for p, n in enumerate(sizes)]
    words = spark.createDataFrame(rows, "doc long, sent int, pos int, ids array<int>")
    got = {}
    for r in packing.packed(packing.without_long(words, "doc", "sent", 30), "doc", "sent", 30, carry, flush).collect():
        got.setdefault(r["doc"], {}).setdefault(r["row"], []).append((r["sent"], r["pos"]))
    for g, sents in groups.items():
        assert [sorted(x) for _, x in sorted(got.get(g, {}).items())] == [sorted(x) for x in plain_pack(sents, 30, carry, flush)], g


def test_feature_rows(spark):
    rows = spark.createDataFrame([(1, s, f"Labas, rytas {s}! Kaip – einasi?") for s in range(12)], "doc long, sent int, text string")
    words = packing.tokenized(rows, "doc", "sent", "text", packing.FixedChunk(4))
    f = packing.features(packing.packed(words, "doc", "sent", 30, True, True), "doc", "sent", 30).collect()
    assert len(f) > 2
    for r in f:
        assert all(len(r[c]) == 30 for c in ("token_ids", "case_labels", "punct_labels", "valid_ids", "token_masks", "label_masks"))
        assert r["token_ids"][0] == packing.BOS and sum(r["valid_ids"]) == r["label_len"] == sum(r["label_masks"])
        assert r["token_ids"].index(packing.EOS) + 1 == sum(r["token_masks"])
        assert r["case_labels"][0] == r["punct_labels"][0] == 0 == r["case_labels"][r["label_len"] - 1]


def test_active_and_compact(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 0, 1, 0, 0], [9, 8, 7, 6, 5, 4, 0, 0]), ([1, 1, 0], [1, 2, 0]), ([0, 0], [0, 0])], "v array<int>, x array<int>")
    got = [tuple(r) for r in df.select(packing.active_positions(F.col("v")), packing.compacted(F.col("x"), F.col("v"))).collect()]
    assert got == [([1, 3], [9, 8, 6, 4, 0, 0, 0, 0]), ([], [1, 2, 0]), ([], [0, 0])]


# predicted, expected and correct counts that were published with their scores, to three decimals
GOLDEN = {
    "case": [(0, 9504718, 9448553, 9355604, 0.984, 0.990, 0.987), (1, 47322, 47569, 46245, 0.977, 0.972, 0.975), (2, 1398309, 1454227, 1305083, 0.933, 0.897, 0.915)],
    "punct": [(0, 8950631, 8859389, 8756020, 0.978, 0.988, 0.983), (1, 1069132, 1113937, 942896, 0.882, 0.846, 0.864), (2, 894282, 896179, 792188, 0.886, 0.884, 0.885), (3, 14850, 19564, 9545, 0.643, 0.488, 0.555), (4, 11273, 19605, 7199, 0.639, 0.367, 0.466), (5, 10181, 41675, 8496, 0.834, 0.204, 0.328)],
}
OVERALL = {"case": (0.935, 0.900, 0.917), "punct": (0.880, 0.842, 0.861)}


def test_golden_scores(spark):
    df = spark.createDataFrame([(h, *r[:4]) for h, rows in GOLDEN.items() for r in rows], "head string, label int, predicted long, expected long, correct long")
    got = {(r["head"], r["label"]): (r["precision"], r["recall"], r["f1"]) for r in metrics.scores(df).collect()}
    for h, rows in GOLDEN.items():
        for label, *_, p, r, f in rows:
            assert got[h, label] == pytest.approx((p, r, f), abs=6e-4)
    for r in metrics.overall(df).collect():
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(OVERALL[r["head"]], abs=6e-4)


def test_scores_at_the_edges(spark):
    pairs = [("case", None, 1), ("case", 2, 1), ("case", 0, 0), ("punct", 0, 3)]
    c = metrics.label_counts(spark.createDataFrame(pairs, "head string, predicted int, expected int"))
    got = {(r["head"], r["label"]): tuple(r)[2:] for r in metrics.scores(c).collect()}
    assert got["case", 1] == (None, 0.0, None)  # never predicted
    assert got["case", 2] == (0.0, None, None)  # never expected
    assert {tuple(r) for r in metrics.overall(c).collect()} == {("case", 0.0, 0.0, 0.0), ("punct", 0.0, 0.0, 0.0)}
    assert metrics.overall(c.limit(0)).count() == 0


def test_ema(spark):
    rows = [(k, i, float(v)) for k in (1, None) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])] + [(2, 0, None)]
    got = {r["k"]: r["ema"] for r in averaging.ema(spark.createDataFrame(rows, "k int, i int, v double"), "k", ["i"], F.col("v"), 0.1).collect()}
    e = 3.0
    for v in [1, 4, 1, 5, 9, 2, 6]:
        e = e * 0.9 + v * 0.1
    assert set(got) == {1, None} and all(x == pytest.approx(e) for x in got.values())


def test_vector_mean_and_checkpoints(spark):
    df = spark.createDataFrame([("a", [1, 4]), ("a", [2, 6]), ("b", None)], "name string, v array<int>")
    assert sorted(tuple(r) for r in averaging.vector_mean(df, "name", "v", integer=True).collect()) == [("a", 0, 1), ("a", 1, 5)]
    assert averaging.checkpoints(5000, 3) == [3000, 4000, 5000]


def test_scoring_and_rendering(spark):
    rows = spark.createDataFrame([(1, 0, "labas rytas tau"), (1, 1, "kaip einasi")], "doc long, sent int, text string")
    words = packing.packed(packing.tokenized(rows, "doc", "sent", "text", packing.FixedChunk(4)), "doc", "sent", 30, False, True)
    out = scoring.scored(packing.features(words, "doc", "sent", 30), ["doc", "row"], scoring.HashScorer()).collect()
    first = [r["ids"][0] for r in words.orderBy("sent", "pos").collect()]
    assert [(r["case_id"], r["punct_id"]) for r in sorted(out, key=lambda r: r["label_pos"])] == [(i % 3, i % 6) for i in first]
    w = spark.createDataFrame([(1, 1, "rytas", 0, 2), (1, 0, "labas", 2, 1), (1, 2, "lrv", 1, 5)], "id int, pos int, word string, case_id int, punct_id int")
    assert scoring.rendered_sentences(w, ["id"]).first()["text"] == "Labas, rytas. LRV—"


def test_shards(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [(r["rank"], r["rows"]) for r in dataset.shard_sizes(df, 3).orderBy("rank").collect()] == [(0, 4), (1, 3), (2, 3)]
    assert {r["k"]: r["shard"] for r in dataset.sharded(df, ["k"], 2, 2).collect()} == {i: i % 4 for i in range(10)}
    a, b = ([r["k"] for r in dataset.shuffled(df, "k", 1, e).collect()] for e in (0, 1))
    assert sorted(a) == sorted(b) == list(range(10)) and a != b
