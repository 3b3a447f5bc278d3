"""Shared passages against brute force."""

import random

import pytest

from loomflow.llm.leakage import anchored_windows, leaked_passages, proximity_matches, window_matches
from loomflow.llm.words import words


def brute(docs, items, passage):
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = words(text), words(item)
            best, prev = 0, [0] * (len(b) + 1)
            for x in a:
                cur = [0] + [prev[j] + 1 if x == y else 0 for j, y in enumerate(b)]
                best, prev = max(best, *cur), cur
            if best >= passage and d is not None and i is not None:
                out[(d, i)] = max(best, out.get((d, i), 0))
    return out


def run(spark, docs, items, passage):
    d, i = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    rows = leaked_passages(d, "doc", "text", i, "item", "text", passage).collect()
    assert len({(r["doc"], r["item"]) for r in rows}) == len(rows)
    by = dict(docs)
    for r in rows:  # the passage is where the row says
        a, b = words(by[r["doc"]]), words(dict(items)[r["item"]])
        assert a[r["doc_word"] : r["doc_word"] + r["n_words"]] == b[r["item_word"] : r["item_word"] + r["n_words"]]
    return {(r["doc"], r["item"]): r["n_words"] for r in rows}


def test_random_corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(3, 25))) for k in range(20)]
    docs = []
    for k in range(60):
        t = text(30).split()
        if k % 4 == 0:
            part = items[k % 20][1].split()
            t[7:7] = part[: rng.randrange(len(part) + 1)]
        docs.append((k, " ".join(t)))
    for passage in (4, 6):
        assert run(spark, docs, items, passage) == brute(docs, items, passage)


def test_edges(spark):
    run12 = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, run12), (2, run12.replace("six", "other")), (3, "one two three"), (4, None), (5, ""), (None, run12), (6, f"{run12} {run12}")]
    docs = [
        (1, f"begin, {run12.upper()}! end"), (2, run12.replace(" ", "_-\n")), (3, run12[:-2]), (4, None), (5, ""), (None, run12),
        (6, "pad " * 5000 + run12), (7, run12.replace("six", "s\u00edx")),
    ]
    assert run(spark, docs, items, 12) == {(1, 1): 12, (2, 1): 12, (6, 1): 12, (1, 6): 12, (2, 6): 12, (6, 6): 12}
    assert run(spark, docs[:1], [(3, "short")], 12) == {}
    empty = spark.createDataFrame([], "doc long, text string")
    assert leaked_passages(empty, "doc", "text", spark.createDataFrame(items, "item long, text string"), "item", "text").count() == 0
    assert leaked_passages(spark.createDataFrame(docs, "doc long, text string"), "doc", "text", spark.createDataFrame([], "item long, text string"), "item", "text").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    import loomflow.llm.leakage as module

    monkeypatch.setattr(module, "BLOCK_WORDS", 10)
    built = []
    monkeypatch.setattr(module, "build_index", lambda *a, f=module.build_index: built.append(1) or f(*a))
    items = [(k, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(5)]
    docs = [(k, f"a b {t} c") for k, t in items]
    assert run(spark, docs, items, 6) == {(k, k): 8 for k in range(5)}
    assert len(built) == 1  # all blocks read one index


@pytest.mark.parametrize("swapped", [False, True])
def test_different_texts_under_one_id(spark, swapped):
    """Both rows have all of the item's words; one of them in its order. No other row may hide it."""
    item = "a b c d e f g h"
    texts = [f"x {item} y", " ".join(reversed(item.split())), "h a"]
    docs = spark.createDataFrame([(1, t) for t in (reversed(texts) if swapped else texts)] + [(2, texts[1])], "doc long, text string").coalesce(1)
    items = spark.createDataFrame([(9, item)], "item long, text string")
    assert [tuple(r) for r in leaked_passages(docs, "doc", "text", items, "item", "text", 6).collect()] == [(1, 9, 8, 1, 0)]
    assert sorted(tuple(r)[:2] for r in proximity_matches(docs, "doc", "text", items, "item", "text").collect()) == [(1, 9), (2, 9)]


def test_a_frequent_anchor_is_spread_over_shards(spark, monkeypatch):
    """A word of every document is the anchor: its postings lie in as many shards as the documents do."""
    import loomflow.llm.leakage as module

    monkeypatch.setattr(module, "SHARD_WORDS", 50)
    monkeypatch.setattr(module, "PAIRS", 7)
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for k in range(200)]
    items = [(1, "a b b a"), (2, "a a a a a")]
    assert run(spark, docs, items, 4) == brute(docs, items, 4)
    index = module.build_index(spark.createDataFrame(docs, "doc long, text string"), "doc", "text")
    held = [r for r in index.collect() if "a" in r["terms"]]
    assert len(held) > 15 and max(sum(r["term_words"]) for r in held) < 70
    assert module.document_frequencies(index, {"a", "zz"}) == {"a": sum("a" in t for _, t in docs)}


def test_windows_with_unknown_words_are_left_out():
    df = {"a": 5, "b": 1, "c": 9}
    assert anchored_windows(["a", "b", "c", "zz", "a", "b", "c"], df, 3, 2) == [(0, 1), (4, 5)]


def test_extra_columns_and_copies(spark):
    t = "a b c d e f"
    docs = spark.createDataFrame([(1, t, 5, "x"), (1, t, 5, "x"), (2, t, 1, "y")], "doc long, text string, item int, start string")
    items = spark.createDataFrame([(9, t, 3)], "item long, text string, doc int")
    rows = leaked_passages(docs, "doc", "text", items, "item", "text", 4).collect()
    assert sorted((r["doc"], r["item"]) for r in rows) == [(1, 9), (2, 9)]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "unseen words only"), (3, None)], "item long, text string")
    docs = spark.createDataFrame([(1, "delta x beta y alpha z gamma"), (2, "alpha beta " + "pad " * 50 + "gamma delta"), (3, None), (4, "alpha beta gamma")], "doc long, text string")
    rows = proximity_matches(docs, "doc", "text", items, "item", "text", rarest=4, least=4, span=10).collect()
    assert [(r["doc"], r["item"], r["n_words"], r["doc_word"]) for r in rows] == [(1, 1, 4, 0)]
    assert proximity_matches(docs.limit(0), "doc", "text", items, "item", "text").count() == 0


def test_windows_find_parts_of_long_items(spark, monkeypatch):
    import loomflow.llm.leakage as module

    monkeypatch.setattr(module, "WINDOW_BLOCK_WORDS", 150)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((10, 24, 60, 100, 200))]
    docs = [(k, [*text(80), *t, *text(80)]) for k, t in items]
    for _ in range(40):
        k, t = rng.choice(items)
        n = rng.randrange(min(24, len(t)), len(t) + 1)
        start = rng.randrange(len(t) - n + 1)
        docs.append((len(docs), [*text(80), *t[start : start + n], *text(80)]))
    edited = items[3][1][40:70]
    edited[12:12], edited[20] = ["new", "words"], "other"
    docs.append((len(docs), [*text(80), *edited, *text(80)]))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item long, text string")
    exact = {(r["doc"], r["item"]) for r in leaked_passages(d, "doc", "text", i, "item", "text", 10).collect() if r["n_words"] >= min(24, len(items[r["item"]][1]))}
    rows = window_matches(d, "doc", "text", i, "item", "text").collect()
    near = {(r["doc"], r["item"]) for r in rows}
    assert len(exact) >= 45 and exact <= near and len(near) == len(rows)
    assert (len(docs) - 1, 3) in near
    of_items = {(r["doc"], r["item"]) for r in proximity_matches(d, "doc", "text", i, "item", "text").collect()}
    assert of_items < near


def test_windows_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c"), (3, None), (None, "a b c d e f g h")], "item long, text string")
    docs = spark.createDataFrame([(1, "z h g f e d c b"), (1, "a b c d e f g h"), (2, "a b c d e f"), (3, None), (None, "a b c d e f g h")], "doc long, text string")
    rows = window_matches(docs, "doc", "text", items, "item", "text").collect()
    assert [(r["doc"], r["item"], r["n_words"], r["doc_word"]) for r in rows] == [(1, 1, 8, 0)]
    assert window_matches(docs.limit(0), "doc", "text", items, "item", "text").count() == 0
