"""Packed fields, case by case."""

import pytest
from pyspark.sql import functions as F

from loomflow.operators import packed

TABLES = [
    ("a.b", ["a.b"]),
    ("  a.b , c.d;e.f | g.h\ti.j\nk.l  ", ["a.b", "c.d", "e.f", "g.h", "i.j", "k.l"]),
    ('["a.b", "c d", \'e;f|g\']', ["a.b", "c d", "e;f|g"]),
    ("{`a b`}", ["a b"]),
    ("[a.b]", ["a.b"]),
    ("[]", []),
    ('"x \\"y\\""', ['x "y"']),
    ('"x ""y"""', ['x "y"']),
    ("a,,b, ,c,", ["a", "b", "c"]),
    ("a.t@day=7,b$stats", ["a.t@day=7", "b$stats"]),
    ("a, a", ["a", "a"]),
    ("it's, fine", ["it's", "fine"]),
    ('open"quote, x', ['open"quote', "x"]),
    ('"never closed, x', ['"never', "closed", "x"]),
    ("None", []), (" ", []), ("", []), (None, []),
]
ARGS = [
    ("a=1, b: 2; c=>3 | d = 4", ["a=1", "b=2", "c=3", "d=4"]),
    ('x="p, q; r", y=[m, n], z', ["x=p, q; r", "y=[m, n]", "z"]),
    ('x="lost \\"w\\", y"', ['x=lost "w", y']),
    ('x="lost ""w"", y"', ['x=lost "w", y']),
    ("n=h.invalid:45454, , m=1,,k=null", ["n=h.invalid:45454", "m=1", "k=null"]),
    ("n: h.invalid:45454", ["n=h.invalid:45454"]),
    ("counters=Counters: 1, File Counters, B=2", ["counters=Counters: 1", "File Counters", "B=2"]),
    ("v=Map 1;w={a; [b, c]}", ["v=Map 1", "w={a; [b, c]}"]),
    ("d='x=1 | y', e=`p; q`", ["d=x=1 | y", "e=p; q"]),
    ("[open, a=1", ["[open, a=1"]),
    ("close], a=1", ["close]", "a=1"]),
    ("None", []), ("\t", []), (None, []),
]


def split(spark, kind, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r[0]: r[1] for r in rows.select("i", kind(F.col("t"))).collect()}


@pytest.mark.parametrize(("kind", "cases"), [(packed.table_list, TABLES), (packed.argument_list, ARGS)])
def test_cases(spark, kind, cases):
    got = split(spark, kind, [t for t, _ in cases])
    for i, (text, want) in enumerate(cases):
        assert (got[i] or []) == want, text


def test_long_field(spark):
    text = ",".join(f'k{i}="v, {i}"' for i in range(3000))
    assert len(split(spark, packed.argument_list, [text])[0]) == 3000
    assert split(spark, packed.argument_list, ["a=" + "x" * 1_000_000])[0] == ["a=" + "x" * 1_000_000]
    assert len(split(spark, packed.argument_list, ['"' * 20_001])[0]) <= 2


def test_unpack_once_per_key(spark):
    df = spark.createDataFrame([("q1", "a,b", "x"), ("q1", "a,b", "y"), (None, "c", "z"), ("q2", None, "z")], "id string, t string, item string")
    got = packed.unpack(df, "id", {"tables": packed.table_list(F.col("t"))}).collect()
    assert sorted(map(tuple, got)) == [("tables", "q1", 1, "a"), ("tables", "q1", 2, "b")]
    assert packed.unpack(df.limit(0), "id", {"tables": packed.table_list(F.col("t"))}).count() == 0
