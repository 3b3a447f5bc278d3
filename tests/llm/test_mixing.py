"""Apportionment and mixes."""

import heapq
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomflow.llm.mixing import TOKENIZER_DIR, mix, sainte_lague, token_counts


def one_by_one(shares, seats, caps):
    quotas = [0] * len(shares)
    heap = [(-s, i) for i, s in enumerate(shares) if s > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while heap and sum(quotas) < seats:
        _, i = heapq.heappop(heap)
        quotas[i] += 1
        if quotas[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * quotas[i] + 1), i))
    return quotas


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
def test_highest_quotients(parts, seats):
    shares, caps = [p[0] / 7 for p in parts], [p[1] for p in parts]
    got, want = sainte_lague(shares, seats, caps), one_by_one(shares, seats, caps)
    assert sum(got) == sum(want)
    assert all(g <= c for g, c in zip(got, caps))
    assert sorted(s / (2 * q + 1) for s, q in zip(shares, got)) == pytest.approx(sorted(s / (2 * q + 1) for s, q in zip(shares, want)))


def test_many_seats():
    assert sum(sainte_lague([0.2, 0.5, 0.3], 10**9, [10**9] * 3)) == 10**9


needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER_DIR, "byte_bpe_50k.tiktoken").exists(), reason="no tokenizer files")


@needs_tokenizer
def test_mix(spark):
    rows = [(i, ("big", " BIG ", "small-one", "Small One", "none", None, " ")[i % 7], f"text number {i} with some words " * (1 + i % 9)) for i in range(7000)]
    rows += [(7001, "big", None), (7002, "big", "")]
    docs = spark.createDataFrame(rows, "id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small_one", 0.6, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    report, drawn = mix(docs, "id", "source", "text", targets, block_tokens=512)
    r = {x["source"]: x for x in report.collect()}
    counted = token_counts(docs, ["id"], "text").toPandas().set_index("id")["n_tokens"]
    own = {s: sum(int(counted[i]) for i, x, _ in rows if x in names) for s, names in (("big", ("big", " BIG ")), ("small_one", ("small-one", "Small One")))}
    assert {s: r[s]["available_tokens"] for s in own} == own and r["absent"]["available_tokens"] == 0
    assert {s: x["short"] for s, x in r.items()} == {"big": False, "small_one": False, "absent": True}
    total = sum(own.values()) + sum(int(counted[i]) for i, x, _ in rows if x == "none")
    for s in ("big", "small_one"):
        assert abs(r[s]["drawn_tokens"] - r[s]["target_share"] * total) < 2000
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1)
    got = drawn.toPandas()
    assert got["repeats"].max() <= 3 and not got["id"].duplicated().any()
    assert (got["n_tokens"] * got["repeats"])[got["source"] == "big"].sum() == r["big"]["drawn_tokens"]
    again = mix(docs.repartition(5), "id", "source", "text", targets, block_tokens=512)[1].toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))


@needs_tokenizer
def test_short_source_is_used_up_and_empty(spark):
    docs = spark.createDataFrame([(i, "a" if i < 5 else "b", "word " * 50) for i in range(100)], "id long, source string, text string")
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    report, drawn = mix(docs, "id", "source", "text", targets, block_tokens=100)
    r = {x["source"]: x for x in report.collect()}
    assert r["A"]["short"] and r["A"]["drawn_tokens"] == 2 * r["A"]["available_tokens"] and not r["b"]["short"]
    assert drawn.where("source = 'A' and repeats = 2").count() == 5
    report, drawn = mix(docs, "id", "source", "text", targets, "reachable", block_tokens=51)
    r = {x["source"]: x for x in report.collect()}  # 5 documents twice and 10 of the others
    assert all(abs(x["actual_share"] - 0.5) < 0.06 and not x["short"] for x in r.values())
    assert drawn.selectExpr("max(repeats)").first()[0] == 2
    report, drawn = mix(docs.limit(0), "id", "source", "text", targets)
    assert report.count() == 2 and drawn.count() == 0 and report.where("actual_share is not null").count() == 0
    report, drawn = mix(docs, "id", "source", "text", targets.limit(0))
    assert report.count() == 0 and drawn.count() == 0
    with pytest.raises(ValueError):
        mix(docs, "id", "source", "text", targets.unionByName(spark.createDataFrame([("a", 0.1, 1)], targets.schema)))
