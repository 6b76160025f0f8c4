"""The tagger stage: parts, retries, errors, and its way into sentences."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glossmill.operators import sentences, tagging


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Failing:
    """Fails for texts with a certain word, and the first `times` times for any."""

    def __init__(self, word="zzz", times=0):
        self.word, self.times = word, times

    def __call__(self, text):
        if self.word in text:
            raise RuntimeError("no answer")
        self.times -= 1
        if self.times >= 0:
            raise OSError("busy")
        return tagging.LocalTagger()(text)


def test_tokens_rebuild_the_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["Labas", " ", ".", "!?", "12", "\n", "—", "š", "²", "_"]) for _ in range(30))
        tokens = tagging.LocalTagger()(text)
        assert "".join(t["string"] for t in tokens) == text
        assert {t["type"] for t in tokens} <= {"WORD", "NUMBER", "SPACE", "SEPARATOR", "SENTENCE_END"}


@pytest.mark.parametrize("most", [40, 200, 10_000])
def test_parts_go_on_after_the_last_whole_sentence(most):
    text = " ".join(f"Sakinys numeris {i} baigiasi čia." for i in range(60))
    got = list(tagging.responses(text, tagging.LocalTagger(), most))
    assert [c for c, *_ in got] == list(range(len(got))) and all(e is None for *_, e in got)
    assert (len(got) == 1) == (most >= len(text))
    rebuilt = ""
    for i, (_, tokens, _) in enumerate(got):
        whole = "".join(t["string"] for t in tokens)
        assert len(whole) <= most
        rebuilt += whole if i == len(got) - 1 else whole[: tagging.used_up(tokens)]
    assert rebuilt == text


def test_errors_are_data():
    text = " ".join(f"Sakinys {i} čia." for i in range(20))
    got = list(tagging.responses(text + " zzz. Dar.", Failing(), 100, tries=1))
    assert got[-1][1] is None and "no answer" in got[-1][2] and all(t for _, t, _ in got[:-1])
    stuck = list(tagging.responses("be galo " * 40, tagging.LocalTagger(), 100))
    assert stuck[-1][1:] == (None, "no sentence ends in a call") and len(stuck) == 2
    assert len(tagging.insisted(Failing(times=2), "Labas.", tries=3, wait=0)) == 3
    with pytest.raises(OSError):
        tagging.insisted(Failing(times=3), "Labas.", tries=3, wait=0)


def test_tagged_table(spark):
    rows = [(1, "Labas rytas. Kaip sekasi?", 0), (2, None, 0), (3, "", 0), (4, "zzz", 0), (5, "Be galo", 0)]
    docs = spark.createDataFrame(rows, "row_id long, text string, tokens int")
    out = tagging.tagged(docs, Failing(), tries=1)
    got = {r["row_id"]: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5} and got[4]["tokens"] is None and "no answer" in got[4]["_error"] and got[3]["tokens"] == []
    sents = sentences.group_sentences(out.withColumn("received_at", F.lit(None).cast("timestamp"))).select("row_id", "sentence").collect()
    assert sorted(map(tuple, sents)) == [(1, "Kaip(=) sekasi?"), (1, "Labas(=) rytas.")]
    assert tagging.tagged(docs.limit(0), Failing()).count() == 0
