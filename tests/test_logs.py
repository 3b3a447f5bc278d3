"""Log entries from lines of many layouts."""

import pytest

from loomflow.operators import logs

T0 = 1_704_189_538_757  # 2024-01-02 09:58:58.757 UTC

LAYOUTS = [
    ("2024-01-02 09:58:58,757 [INFO] [main pool - #1] |a.Writer|: hello x", "INFO", "a.Writer", T0),
    ("2024-01-02T11:58:58.757+02:00 warn  b.Reader - hello x", "WARN", "b.Reader", T0),
    ("2024-01-02T04:58:58.757-05:00 ERROR c.Reader - hello x", "ERROR", "c.Reader", T0),
    ("Keeper DEBUG 20240102T095858Z - hello x", "DEBUG", "Keeper", T0 - 757),
    ("1704189538.757|W|d.Slot|hello x", "WARN", "d.Slot", T0),
    ("1704189538.757|fatal|d.Slot|hello x", "FATAL", "d.Slot", T0),
    ("E20240102 09:58:58.757999 1217 e.Cache:707] hello x", "ERROR", "e.Cache", T0),
    ("[02/Jan/2024:09:58:58 +0000] Err (f.Basin) hello x", "ERROR", "f.Basin", T0 - 757),
    ("[02/Jan/2024:15:28:58 +0530] trace (Basin2) hello x", "TRACE", "Basin2", T0 - 757),
    ('{"ts": "2024-01-02T09:58:58.757Z", "level": "warning", "logger": "g.H", "msg": "hello x"}', "WARN", "g.H", T0),
    ('{"msg": "hello x", "ts": 1704189538757, "logger": "g.H", "level": "info"}', "INFO", "g.H", T0),
    ('level=Info ts=1704189538757 comp=i.J msg="hello x"', "INFO", "i.J", T0),
    ('comp=i.J msg="hello x" ts=1704189538757 level=Info', "INFO", "i.J", T0),
]
CONTINUED = [
    "java.x.Failure: at 2024-01-02 09:58:58,757", "\tat a.b(C.java:1)", "", "  2024-01-02 09:58:58,757 INFO quoted - x", "> 2024-01-02 09:58:58,757 [ERROR] [main] |q.Q|: cited",
    "2024-01-02 to 2024-01-03 rollover", "| name | INFO |", "pivot: 823", None, "{", "level FATAL at 2024-01-02 09:58:58,757 ignored", "}",
]


def parse(spark, rows, **options):
    df = spark.createDataFrame(rows, "log_id string, line_no int, line string")
    return sorted(map(tuple, logs.parse_lines(df, **options).collect()))


def many(times=4):
    lines = []
    for _ in range(times):
        for text, *_ in LAYOUTS:
            lines += [text, *CONTINUED]
    return lines


@pytest.mark.parametrize("chunk", [20_000, 5])
def test_layouts_and_continuations(spark, monkeypatch, chunk):
    monkeypatch.setattr(logs, "CHUNK", chunk)
    lines = [*CONTINUED, *many()]
    rows = [("l", i + 1, x) for i, x in enumerate(lines)]
    got = parse(spark, list(reversed(rows)) + rows[::3])
    step, first = len(CONTINUED) + 1, len(CONTINUED) + 1
    want = []
    for k in range(4 * len(LAYOUTS)):
        _, level, component, ms = LAYOUTS[k % len(LAYOUTS)]
        want.append(("l", first + k * step, first + (k + 1) * step - 1, ms, level, component, "hello x"))
    assert got == want


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_objects_over_lines(spark, monkeypatch, chunk):
    monkeypatch.setattr(logs, "CHUNK", chunk)
    one = ["{", '  "time": "2024-01-02T09:58:58.757Z",', '  "severity": "Warning",', '  "component": "k.L",', '  "message": "level INFO, \\"x\\""', "}", "tail"]
    lines = [*one[2:6], *one * 5, "{", "no object", "}", *one]
    got = parse(spark, [("l", i + 1, x) for i, x in enumerate(lines)])
    starts = [5, 12, 19, 26, 33, 43]
    ends = [11, 18, 25, 32, 42, 49]
    assert got == [("l", a, b, T0, "WARN", "k.L", 'level INFO, "x"') for a, b in zip(starts, ends)]


def test_rare_layout_by_fallback_rules(spark):
    rows = [("l", i, LAYOUTS[0][0]) for i in range(1, 40)] + [("l", 40, LAYOUTS[7][0]), ("l", 41, "2024-01-02 09:58:58,757 noted that INFO about Thing - once")]
    got = parse(spark, rows)
    assert got[-1][1:3] == (40, 41) and got[-1][5] == "f.Basin"


def test_rare_keys_among_many_lines(spark):
    rows = [("l", i, LAYOUTS[11][0]) for i in range(1, 9000)]
    rare = ['text=done sev=warn mod=p.Q at=1704189538757', 'at=1704189538757 mod=p.Q sev=warn text="hello x"', '{"when": "2024-01-02T09:58:58.757Z", "sort": "Info", "part": "r.S", "words": "hello x"}']
    rare += ["{", '  "words_": "done",', '  "when_": "2024-01-02T09:58:58.757Z",', '  "sort_": "Warning",', '  "part_": "k.L"', "}", "{", '  "part_": "k.L",', '  "words_": "hello x",', '  "sort_": "Warning",', '  "when_": "2024-01-02T09:58:58.757Z"', "}"]
    got = parse(spark, rows + [("r", i, x) for i, x in enumerate(rare, 1)])
    assert len(got) == 8999 + 5
    assert [r[1:6] for r in got[-5:]] == [(1, 1, T0, "WARN", "p.Q"), (2, 2, T0, "WARN", "p.Q"), (3, 3, T0, "INFO", "r.S"), (4, 9, T0, "WARN", "k.L"), (10, 15, T0, "WARN", "k.L")]
    assert [got[-k][-1] for k in (4, 3, 1)] == ["hello x"] * 3


@pytest.mark.parametrize("other", ["level=3 pool=a", "level=high pool=a", "ts=x1 level=high comp=9"])
def test_keys_that_programs_use_differently(spark, other):
    lines = []
    for text in (LAYOUTS[9][0], LAYOUTS[10][0], LAYOUTS[11][0], LAYOUTS[12][0]) * 5:
        lines += [text, other, other, "bytes=1704189538 state=E node=n", *["bytes=17 state=idle node=n"] * 2]
    got = parse(spark, [("l", i, x) for i, x in enumerate(lines)])
    want = [("l", 6 * k, 6 * k + 5, T0, x[1], x[2], "hello x") for k, x in enumerate(LAYOUTS[9:] * 5)]
    assert got == want


def test_parts_far_into_the_line(spark):
    heads = [
        ("2024-01-02 09:58:58,757 [INFO] [" + "pool thread 7, " * 40 + "x] |a.Writer|: hello x", "a.Writer"),
        ("2024-01-02 09:58:58,757 " + "[1] (2) " * 6 + "[INFO] |a.Writer|: hello x", "a.Writer"),
        ("2024-01-02 09:58:58,757 " + "7 | " * 200 + "INFO b.Reader - hello x", "b.Reader"),
    ]
    lines = []
    for text, _ in heads * 3:
        lines += [text, "at x", "noted " * 100 + "at 2024-01-02 09:58:58,757 INFO about x"]
    got = parse(spark, [("l", i, x) for i, x in enumerate(lines)])
    assert [(r[1], r[2], *r[3:]) for r in got] == [(3 * k, 3 * k + 2, T0, "INFO", c, "hello x") for k, (_, c) in enumerate(heads * 3)]


def test_mining_tells_threads_tags_and_components_apart(spark):
    """Layouts with a second word: which one is the component is known from the pairs' counts only."""
    lines = []
    for k in range(30):
        lines += [f"2024-01-02 09:58:58,757 worker-{k} INFO a.Part{k % 4} - hello {k}", f"svc 2024-01-02 09:58:58,757 INFO b.Part{k % 3} - hello {k}", f"c.Part{k % 5} 2024-01-02 09:58:58,757 [main] WARN main: hello {k}"]
        lines += ["level FATAL at 2024-01-02 09:58:58,757 - cited", f"we saw INFO of Part{k} at 2024-01-02 09:58:58,757 - cited"]
    rows = [("l", i, x) for i, x in enumerate(lines)]
    got = parse(spark, rows)
    want = []
    for k in range(30):
        want += [("l", 5 * k, 5 * k, T0, "INFO", f"a.Part{k % 4}", f"hello {k}"), ("l", 5 * k + 1, 5 * k + 1, T0, "INFO", f"b.Part{k % 3}", f"hello {k}"), ("l", 5 * k + 2, 5 * k + 4, T0, "WARN", f"c.Part{k % 5}", f"hello {k}")]
    assert got == want
    assert parse(spark, rows, support=10**6) == []  # without mining, such layouts are outliers that no rule takes


def test_message_begins_after_the_component(spark):
    got = parse(spark, [("l", 1, "2024-01-02 09:58:58,757 [INFO] [comp.A-worker-1] |comp.A|: hello"), ("l", 2, "2024-01-02 09:58:58,757 comp.B [WARN] hello comp.B")])
    assert [(r[5], r[6]) for r in got] == [("comp.A", "hello"), ("comp.B", "hello comp.B")]


def test_messages_with_later_lines(spark):
    rows = [("l", 1, LAYOUTS[1][0]), ("l", 2, "more"), ("l", 3, None), ("l", 4, "end"), ("m", 7, LAYOUTS[1][0])]
    assert [r[-1] for r in parse(spark, rows, with_text=True)] == ["hello x\nmore\n\nend", "hello x"]


def test_nulls_and_empty(spark):
    rows = [(None, 1, LAYOUTS[1][0]), ("l", None, LAYOUTS[1][0]), ("l", 3, None), ("l", 4, "x" * 200_000)]
    assert parse(spark, rows) == []
    assert parse(spark, []) == []


def test_very_long_and_clashing(spark):
    df = spark.createDataFrame([("l", 1, LAYOUTS[1][0] + "y" * 300_000, 1, "z")], "log_id string, line_no int, line string, log int, kind string")
    row = logs.parse_lines(df).first()
    assert row["message"] == "hello x" + "y" * 300_000


@pytest.mark.parametrize(
    ("text", "ms"),
    [("2024-01-02 09:58:58", T0 - 757), ("2024-02-30 09:58:58", None), ("x", None), ("1704189538", T0 - 757), ("1704189538757", T0), ("1704189538757123", T0), ("1704189538757123456", T0), ("1704189538.7", T0 - 57), ("2024-01-02T09:58:58.7571Z", T0), ("1970-01-01T00:00:00Z", 0)],
)
def test_times(text, ms):
    assert logs.written_time_ms(text) == ms
