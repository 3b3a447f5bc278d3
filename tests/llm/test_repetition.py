"""Repetition against counting."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomflow.llm.repetition import _mixed, covered_words, repetition


def counted(codes, n, least):
    grams = [tuple(codes[i : i + n]) for i in range(len(codes) - n + 1)]
    often = Counter(grams)
    inside = [False] * len(codes)
    for i, g in enumerate(grams):
        if often[g] >= least:
            inside[i : i + n] = [True] * n
    return inside


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 7), st.integers(2, 4))
def test_coverage(codes, n, least):
    with np.errstate(over="ignore"):
        got = covered_words(_mixed(np.array(codes, np.int64)), n, least)
    assert got.tolist() == counted(codes, n, least)


def test_table(spark):
    six = "alpha beta gamma delta epsilon zeta "
    rows = [(1, six * 3), (2, six * 2 + "end"), (3, None), (4, ""), (5, "..."), (6, "Same line\nother\nsame line\nSame line"), (1, "x " * 9), (7, "w " * 200_000), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'y' as __text")
    got = repetition(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[(1, len(six) * 3)]["words_6_3"] == 18 and by[(2, len(six) * 2 + 3)]["words_6_3"] == 0
    assert by[(2, len(six) * 2 + 3)]["words_6_3"] == 0 and by[(2, len(six) * 2 + 3)]["words_4_2"] == 12
    assert by[(3, 0)]["n_words"] == by[(4, 0)]["n_words"] == by[(5, 3)]["n_words"] == 0 and by[(5, 3)]["chars_6_3"] == 0
    assert by[(6, 35)]["line_share"] == 18 / 35
    assert by[(7, 400_000)]["words_6_3"] == 200_000 and by[(7, 400_000)]["chars_10_2"] == 1
    assert by[(1, 18)]["words_6_3"] == 9  # occurrences may overlap
    assert repetition(df.limit(0), "doc_id", "text").count() == 0


def test_no_shuffle(spark, plan):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Exchange" not in plan(repetition(df, "doc_id", "text"))
