"""Log lines of unknown layouts into entries of time, level, component and message.

Layouts are mined, not listed. Heads of lines become tokens, of which times, levels,
bracketed groups and numbers are classes; (position, token) pairs are counted over
all lines. A line's template keeps the tokens of its frequent pairs, the others
become `*`. Templates tell which words of a layout are constants and which of them is the
component. Key-value layouts have no fixed positions; for them the pairs counted are
(key, class of value), which tell which key holds the time, the level and the
component. Outliers go through fallback rules: see ``parse_lines``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomflow.runtime import materialize

#: Lines of one log that are ordered in one task; longer logs are cut in chunks.
CHUNK = 20_000

#: Tokens of a template that are stored one by one; of a longer one the rest is stored as a hash.
HEAD_TOKENS = 12

#: Spellings of levels, in natural order.
LEVELS = {
    "TRACE": "TRACE", "FINER": "TRACE", "FINEST": "TRACE", "T": "TRACE",
    "DEBUG": "DEBUG", "FINE": "DEBUG", "D": "DEBUG",
    "INFO": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO", "I": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "W": "WARN",
    "ERR": "ERROR", "ERROR": "ERROR", "SEVERE": "ERROR", "E": "ERROR",
    "FATAL": "FATAL", "CRIT": "FATAL", "CRITICAL": "FATAL", "F": "FATAL",
}

#: Fixed patterns: written times.
CALENDAR = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?: ?(?:Z|UTC|[+-]\d\d:?\d\d))?"
COMPACT = r"\d{8}[T ]\d\d:?\d\d:?\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
DAY_FIRST = r"\d\d?/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d(?:[.,]\d+)?(?: [+-]\d{4})?"
EPOCH = r"\d{10}[.,]\d+|\d{19}|\d{16}|\d{13}|\d{10}"
_TIME = rf"(?:{CALENDAR}|{COMPACT}|{DAY_FIRST}|(?<![\w.])(?:{EPOCH})(?![\w.]))"
_LONG_LEVELS = "|".join(sorted((x for x in LEVELS if len(x) > 1), key=len, reverse=True))
#: Tokens by class: time, level, a letter that stands where a level does, bracketed group, word, number, mark.
_TOKEN = (
    rf"(?P<T>{_TIME})|(?P<L>(?<![\w.])(?i:{_LONG_LEVELS})(?![\w.]))|(?P<S>^[A-Z](?=\d{{8}} \d\d:)|(?<=\|)[A-Z](?=\|))"
    rf"|(?P<B>\[(?!(?:{_TIME}|(?i:{_LONG_LEVELS})\]))[^\[\]]+\])|(?P<W>[A-Za-z_$][\w.$/-]*)|(?P<N>\d+)|(?P<X>\[\]|\S)"
)
_PAIR = r'"([A-Za-z_][\w.-]*)"\s*:\s*("(?:[^"\\]|\\.)*+"|[^",{}\[\]]+)|(?:^|(?<=\s))([A-Za-z_][\w.-]*)=("(?:[^"\\]|\\.)*+"|[^"\s]\S*)'


_CALENDAR = re.compile(r"(\d{4})-?(\d\d)-?(\d\d)[T ](\d\d):?(\d\d):?(\d\d)(?:[.,](\d+))? ?(?:([+-])(\d\d):?(\d\d)|Z|UTC)?")
_DAY_FIRST = re.compile(r"(\d\d?)/([A-Z][a-z]{2})/(\d{4}):(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?: ([+-])(\d\d)(\d\d))?")
_EPOCH = re.compile(r"(\d{10})[.,](\d+)|(\d{10}|\d{13}|\d{16}|\d{19})")
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


@lru_cache(maxsize=4096)
def _day(year: int, month: int, day: int) -> int | None:
    try:
        return date(year, month, day).toordinal() - 719_163
    except ValueError:
        return None


def written_time_ms(text: str | None) -> int | None:
    """Epoch ms of a written time, finer parts cut off, UTC where no zone is written; None if it is none."""
    if not text:
        return None
    if m := _EPOCH.fullmatch(text):
        if m[1]:
            return int(m[1]) * 1000 + int(m[2][:3].ljust(3, "0"))
        return int(m[3]) * 1000 if len(m[3]) == 10 else int(m[3][:13])
    if m := _CALENDAR.fullmatch(text):
        day = _day(int(m[1]), int(m[2]), int(m[3]))
    elif m := _DAY_FIRST.fullmatch(text):
        day = _day(int(m[3]), _MONTHS.get(m[2], 0), int(m[1]))
    else:
        return None
    if day is None:
        return None
    seconds = ((day * 24 + int(m[4])) * 60 + int(m[5])) * 60 + int(m[6])
    offset = (int(m[9]) * 60 + int(m[10])) * (-60 if m[8] == "-" else 60) if m[8] else 0
    return (seconds - offset) * 1000 + int((m[7] or "")[:3].ljust(3, "0"))


def level_name(text: str | None) -> str | None:
    """TRACE, DEBUG, INFO, WARN, ERROR or FATAL of any known spelling; None for others."""
    return LEVELS.get(text.lstrip("\u0001").upper()) if text else None


#: What a head may begin with and consist of if it is too rare to be mined.
_OPENING = ("<T>", "<L>", "<W>", "[", "(")
_PARTS = ("<T>", "<L>", "<W>", "<B>", "<N>", "[", "]", "(", ")", "|", ":", "-", ",", ";", "/", "#")

#: A word is a constant of a layout if so much of the layout's lines have it there.
CONSTANT = 0.9


def _heads(lines: DataFrame) -> DataFrame:
    """(log, chunk, no, ms, level, words, tokens, regular, message) of lines whose head has a time, a level and one
    or two words, and ends with a mark or the line, wherever that is. Words next to each other are a sentence, not a head.

    ``tokens`` are classes, marks and the words as written, those beyond HEAD_TOKENS as a hash;
    ``regular``: one word, and else only ``_PARTS``. One compiled scan per line; as SQL expressions the token
    classes would be evaluated again for each part."""
    token, is_time, lead = re.compile(_TOKEN), re.compile(_TIME), re.compile(r"^(?::\d+)?[\s|:)\]}-]+")

    def head(line: str) -> tuple | None:
        if not is_time.search(line):
            return None
        kinds: list[str] = []
        words: list[tuple[int, str]] = []
        time = level = None
        end = 0
        for match in token.finditer(line):
            group, text = match.lastgroup, match.group()
            if group == "S":
                group = "W" if level else "L"
            kind = text if group == "X" else f"<{group}>"
            if not kinds and kind not in _OPENING:
                return None
            if time and level and words and group != "W":
                kinds.append(kind)
                if kind not in _PARTS:
                    return None
                break
            if group == "W":
                if len(words) == 2 or (kinds and kinds[-1] == "<W>"):
                    return None
                words.append((len(kinds), text))
                end = match.end()
            elif group == "T" and time is None:
                time, end = text, match.end()
            elif group == "L" and level is None:
                level, end = text, match.end()
            kinds.append(kind)
        if not (time and level and words) or (ms := written_time_ms(time)) is None:
            return None
        regular = len(words) == 1 and all(k in _PARTS for k in kinds)
        rest = kinds[HEAD_TOKENS:]
        tokens = kinds[:HEAD_TOKENS] + ([blake2b("\n".join(rest).encode(), digest_size=16).hexdigest()] if rest else [])
        for at, word in words:
            if at < HEAD_TOKENS:
                tokens[at] = _AS_WORD + word
        names = [w.rstrip(".:/-") or w for _, w in words]
        return ms, level_name(level), names, tokens, regular, lead.sub("", line[end:])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string())
        for batch in batches:
            found = [(i, x) for i, line in enumerate(batch.column(3).to_pylist()) if (x := head(line)) and x[1]]
            rows = batch.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *[pa.array([x[k] for _, x in found], kind) for k, kind in enumerate(kinds)]], names=["log", "chunk", "no", "ms", "level", "words", "tokens", "regular", "message"])

    return lines.select("log", "chunk", "no", "line").mapInArrow(scan, "log string, chunk long, no long, ms long, level string, words array<string>, tokens array<string>, regular boolean, message string")


#: Tells a word of ``tokens`` from a mark or a class.
_AS_WORD = " "


def _template(tokens: list[str], frequent: set[tuple[int, str]]) -> tuple[str, list[str]]:
    """A head's layout, words as `<W>` and infrequent marks as `*`, and its words, infrequent ones as `*`."""
    kept = [t if (at, t) in frequent else _AS_WORD + "*" if t[0] == _AS_WORD else "*" for at, t in enumerate(tokens)]
    return " ".join("<W>" if t[0] == _AS_WORD else t for t in kept), [t[1:] for t in kept if t[0] == _AS_WORD]


def _started(heads: DataFrame, support: int) -> DataFrame:
    """(log, chunk, no, ms, level, component, message) of heads that begin an entry.

    The frequent pairs come to the driver, at most HEAD_TOKENS + 1 times lines / support; so do the layouts
    of the support, at most lines / support. Of a mined layout with two words the later one is the component,
    the earlier one where only that varies; two constants are a sentence that repeats. Heads of other
    layouts count if they are regular.
    """
    pairs = heads.select(F.posexplode("tokens").alias("at", "token")).groupBy("at", "token").count().where(F.col("count") >= support)
    frequent = {(r["at"], r["token"]) for r in pairs.collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                layout, words = _template(tokens, frequent)
                counts[layout, -1, ""] += 1
                counts.update((layout, i, w) for i, w in enumerate(words))
            if len(counts) > 100_000:
                yield batch_of(counts)
                counts.clear()
        yield batch_of(counts)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in counts], kind) for i, kind in enumerate(kinds)], pa.array(list(counts.values()), pa.int64())], names=["layout", "word_no", "word", "n"])

    counted = heads.select("tokens").mapInArrow(count, "layout string, word_no int, word string, n long").groupBy("layout", "word_no", "word").agg(F.sum("n").alias("n"))
    most = lambda i: F.coalesce(F.max(F.when((F.col("word_no") == i) & (F.col("word") != "*"), F.col("n"))), F.lit(0))
    layouts = counted.groupBy("layout").agg(F.max(F.when(F.col("word_no") < 0, F.col("n"))).alias("n"), F.max("word_no").alias("last"), most(0).alias("a"), most(1).alias("b"))
    component: dict[str, int] = {}
    for r in layouts.where(F.col("n") >= support).collect():
        first, second = (r[c] >= CONSTANT * r["n"] for c in ("a", "b"))
        if r["last"] < 1:
            component[r["layout"]] = 0
        elif not (first and second):
            component[r["layout"]] = 0 if second else 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tokens = (batch.column(i).to_pylist() for i in (5, 6))
            rows, names = [], []
            for r in range(batch.num_rows):
                which = component.get(_template(tokens[r], frequent)[0])
                if which is not None:
                    rows.append(r)
                    names.append(words[r][min(which, len(words[r]) - 1)])
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:5], pa.array(names, pa.string()), kept.column(8)], names=["log", "chunk", "no", "ms", "level", "component", "message"])

    # A layout of one word leaves no choice, so regular heads needn't be looked up.
    plain = heads.where("regular").select("log", "chunk", "no", "ms", "level", F.get("words", F.lit(0)).alias("component"), "message")
    return plain.unionByName(heads.where("not regular").mapInArrow(assign, "log string, chunk long, no long, ms long, level string, component string, message string"))


_NAME = r"[A-Za-z_$][\w.$-]*"


def _pairs(line: str) -> list[tuple[str, str]]:
    """`"key": value` and `key=value` of a line, values without quotes and escapes."""
    found = []
    for a, x, b, y in _PAIRS.findall(line):
        value = x if a else y
        found.append((a or b, _ESCAPE.sub(r"\1", value[1:-1]) if value[:1] == '"' and len(value) > 1 else value.strip()))
    return found


_PAIRS, _ESCAPE = re.compile(_PAIR), re.compile(r"\\(.)")


def _layout(starts: bool, pairs: list[tuple[str, str]]) -> str:
    """The set of a line's keys, as a hash; none for lines of an object, which have a key each."""
    return blake2b("\n".join(sorted({k for k, _ in pairs})).encode(), digest_size=16).hexdigest() if starts else ""


def _key_counts(keyed: DataFrame) -> DataFrame:
    """(layout, k, n, times, levels, names, texts): how often each key occurs in lines of a layout, and with values of each class."""
    is_time, is_name, blank = re.compile(_TIME), re.compile(_NAME), re.compile(r"\s")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for starts, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = _pairs(line)
                layout = _layout(starts, pairs)
                for key, value in pairs:
                    own = counts.setdefault((layout, key), [0] * 5)
                    for i, hit in enumerate((True, is_time.fullmatch(value), value.upper() in LEVELS, is_name.fullmatch(value), blank.search(value))):
                        own[i] += bool(hit)
            if len(counts) > 100_000:
                yield batch_of(counts)
                counts = {}
        yield batch_of(counts)

    def batch_of(counts: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in counts], pa.string()) for i in range(2)], *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(5)]], names=names)

    names = ["layout", "k", "n", "times", "levels", "names", "texts"]
    partial = keyed.select("starts", "line").mapInArrow(count, "layout string, k string, n long, times long, levels long, names long, texts long")
    return materialize(partial.groupBy("layout", "k").agg(*[F.sum(c).alias(c) for c in names[2:]]), "log-keys")


def _roles(counts: DataFrame, support: int) -> dict[str, int | None]:
    """Which keys hold times, levels, components and messages (0 to 3), by the class of nearly all their values.

    Only keys of enough support come to the driver, at most lines x keys / support; of
    those without a role the value is None.
    """
    roles: dict[str, int | None] = {}
    of_keys = counts.groupBy("k").agg(*[F.sum(c).alias(c) for c in counts.columns[2:]])
    for r in of_keys.where(F.col("n") >= support).collect():
        roles[r["k"]] = next((i for i, c in enumerate(("times", "levels", "names", "texts")) if r[c] >= 0.9 * r["n"]), None)
    return roles


def _role_values(keyed: DataFrame, counts: DataFrame, roles: dict[str, int | None]) -> DataFrame:
    """(log, chunk, no, starts, ms, level, component, message, ranks) of lines of pairs: the first value of each role.

    A key gives time or level only by values that are such. A role that no key of the support gives
    goes to a pair by its own value: a time, a level, a name, a text, whatever other programs use the key for. Of several such pairs the one whose key holds that class most in lines
    of the same keys wins, by ``counts`` of all layouts, which meet these lines in a join. ``ranks`` is 0 for a role by the key, else above 0.
    """
    is_time, is_name, blank = re.compile(_TIME), re.compile(_NAME), re.compile(r"\s")
    kinds = "log string, chunk long, no long, starts boolean, given array<string>, layout string"
    pair = pa.struct([("at", pa.int32()), ("key", pa.string()), ("value", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given: list[list[str | None]] = []
            rest: list[list[dict] | None] = []
            layouts: list[str] = []
            for starts, line in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                row: list[str | None] = [None] * 4
                pairs = [(at, key, value, own_classes(value), roles.get(key)) for at, (key, value) in enumerate(_pairs(line))]
                layouts.append(_layout(starts, [p[1:3] for p in pairs]))
                others, classes, used = [], set(), set()
                for i in range(4):
                    for at, _, value, own, role in pairs:
                        # A key's role doesn't hold for a value that is a time or level the line still lacks.
                        if role == i and at not in used and (i in own if i < 2 else not own & {j for j in (0, 1) if row[j] is None}):
                            row[i] = value
                            used.add(at)
                            break
                for at, key, value, own, role in pairs:
                    if at not in used and (own := own if role is None else own & {0, 1, role}):
                        others.append({"at": at, "key": key, "value": value})
                        classes |= own
                able = classes | {i for i in range(4) if row[i] is not None}
                wanted = classes & {i for i in range(4) if row[i] is None}
                given.append(row)
                rest.append(others if wanted and (not starts or able >= {0, 1, 2}) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(given, pa.list_(pa.string())), pa.array(layouts, pa.string()), pa.array(rest, pa.list_(pair))], names=["log", "chunk", "no", "starts", "given", "layout", "rest"])

    def own_classes(value: str) -> set[int]:
        return {i for i, hit in enumerate((is_time.fullmatch(value) and written_time_ms(value) is not None, value.upper() in LEVELS, is_name.fullmatch(value), blank.search(value))) if hit}

    def weight(p: dict, i: int) -> float:
        return 2 - p["shares"][i] if p["shares"][i] < 0.9 else 1.0 if p["n"] < 3 else 0.5

    def meant(p: dict, i: int) -> bool:
        """Bare numbers and letters may be anything: for a time or level the key's values in the layout are mostly so. Keys of other roles hold no names or texts."""
        if i < 2:
            return p["shares"][i] >= 0.5 or not (p["value"].isdigit() or len(p["value"]) == 1)
        return roles.get(p["key"]) in (None, i)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ranks = [], []
            for row, pairs in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                rank, taken = [0.0] * 4, set()
                for i in range(4):
                    able = [] if row[i] is not None else [(weight(p, i), p["at"], p["value"]) for p in pairs or () if p["at"] not in taken and i in own_classes(p["value"]) and meant(p, i)]
                    if able:
                        rank[i], at, row[i] = min(able)
                        taken.add(at)
                found.append(row)
                ranks.append(rank)
            values = [pa.array([written_time_ms(r[0]) for r in found], pa.int64()), pa.array([level_name(r[1]) for r in found], pa.string()), *[pa.array([r[i] for r in found], pa.string()) for i in (2, 3)], pa.array(ranks, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *values], names=["log", "chunk", "no", "starts", "ms", "level", "component", "message", "ranks"])

    lines = materialize(keyed.select("log", "chunk", "no", "starts", "line").mapInArrow(extract, f"{kinds}, rest array<struct<at:int,key:string,value:string>>"), "log-pairs")
    shares = counts.select("layout", F.col("k").alias("key"), "n", F.array(*[F.col(c) / F.col("n") for c in ("times", "levels", "names", "texts")]).alias("shares"))
    of_line = ["log", "chunk", "no"]
    weighed = lines.where("rest is not null").select(*of_line, "starts", "given", "layout", F.inline("rest")).join(shares, ["layout", "key"])
    ranked = weighed.groupBy(*of_line).agg(F.first("starts").alias("starts"), F.first("given").alias("given"), F.collect_list(F.struct("at", "key", "value", "n", "shares")).alias("pairs"))
    plain = lines.where("rest is null").select(*of_line, "starts", "given", F.lit(None).cast(ranked.schema["pairs"].dataType).alias("pairs"))
    return plain.unionByName(ranked).mapInArrow(choose, "log string, chunk long, no long, starts boolean, ms long, level string, component string, message string, ranks array<double>")


def parse_lines(lines: DataFrame, support: int | None = None, with_text: bool = False) -> DataFrame:
    """Entries of logs: (log_id, ``first_line``, ``last_line``, ``ts_ms``, ``log_level``, ``component``, ``message``).

    ``lines`` has ``log_id``, ``line_no`` and ``line``, in any order; rows that repeat a line
    count once (of differing ones the greater text), rows without log or line number
    are left out, null lines are empty ones. An entry ends before the next one of its log or
    with the log; lines ahead of a log's first entry belong to none; an empty table gives no rows.
    ``message`` is the rest of the entry's first line, with ``with_text`` the later lines too.

    A line begins an entry if its head has a time, a level and a word, begins with one of them or a bracket, ends with a mark,
    and its layout is frequent (``support``, default 1 in 2000 lines, 3 at least). Of two words of a frequent
    layout, such as a thread and a component, the counts tell which is the component. Fallback rules: a rarer
    layout counts if it holds one word and else nothing but time, level, groups, numbers and
    marks; a line of pairs counts if its keys give time, level and component, or its own values
    do, where the keys are below the support or used in several ways; so does a line `{` whose following lines do. Indented lines, quoted ones (`>`) and all others
    continue the entry before them.
    """
    base = lines.select(F.col("log_id").cast("string").alias("log"), F.col("line_no").cast("long").alias("no"), F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
    base = base.where("log is not null and no is not null").withColumn("chunk", F.expr(f"no div {CHUNK}"))
    # What a line may be is told once, as it is stored: later passes take theirs without looking at others.
    line = F.col("line")
    form = (
        F.when(line.rlike(r'^\{\s*"|^[A-Za-z_][\w.-]*='), "pairs").when(F.rtrim(line) == "{", "open").when(line.rlike(r'^\s+"[A-Za-z_][\w.-]*"\s*:'), "body")
        .when(~line.rlike(r"^[\s>]") & (line != ""), "head").otherwise("more")
    )
    whole = base.repartition("log", "chunk").groupBy("log", "chunk", "no").agg(F.max("line").alias("line"))
    rows = materialize(whole.withColumn("form", form), "log-lines")
    least = support or max(3, rows.count() // 2000)

    keyed = rows.where("form in ('pairs', 'body')").withColumn("starts", F.col("form") == "pairs")
    counts = _key_counts(keyed)
    roles = _roles(counts, least)

    heads = materialize(_heads(rows.where("form = 'head'")), "log-heads")
    started = _started(heads, least).withColumn("kind", F.lit("head"))

    valued = _role_values(keyed, counts, roles)
    filled = "starts and ms is not null and level is not null and component is not null or not starts and (ms is not null or level is not null or component is not null or message is not null)"
    paired = valued.where(filled).select("log", "chunk", "no", F.when(F.col("starts"), "head").otherwise("body").alias("kind"), "ms", "level", "component", "message", "ranks")
    nothing = [F.lit(None).cast(k).alias(n) for n, k in (("ms", "long"), ("level", "string"), ("component", "string"), ("message", "string"))]
    brace = rows.where("form = 'open'").select("log", "chunk", "no", F.lit("open").alias("kind"), *nothing)
    marks = materialize(started.unionByName(brace).unionByName(paired, allowMissingColumns=True), "log-marks")

    # Lines of an object go to the brace before them, across a chunk's border too.
    own = _carry(marks.withColumn("start", F.when(F.col("kind") != "body", F.col("no"))), "start").where("start is not null")
    first = lambda i, c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.get("ranks", F.lit(i)), "no")))
    opened = F.bool_or(F.col("kind") == "open")
    entries = own.groupBy("log", "start").agg(
        opened.alias("opened"),
        *[F.when(opened, first(i, c)).otherwise(F.max(F.when(F.col("kind") == "head", F.col(c)))).alias(c) for i, c in enumerate(("ms", "level", "component", "message"))],
    ).where("ms is not null and level is not null and component is not null")
    entries = materialize(entries.withColumn("chunk", F.expr(f"start div {CHUNK}")), "log-entries")

    ends = rows.groupBy("log").agg(F.max("no").alias("end"))
    closed = _lead(entries).join(ends, "log").withColumn("last", F.coalesce(F.col("next") - 1, F.col("end")))
    text = F.col("message")
    if with_text:
        lead = _carry(rows.join(entries.select("log", F.col("start").alias("no"), F.lit(True).alias("s")), ["log", "no"], "left").withColumn("start", F.when(F.col("s"), F.col("no"))), "start")
        tails = lead.where("start is not null and start <> no").groupBy("log", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("tail"))
        closed = closed.join(tails, ["log", "start"], "left")
        text = F.concat_ws("\n", F.col("message"), F.when(~F.col("opened"), F.col("tail")))
    return closed.select(
        F.col("log").alias("log_id"), F.col("start").cast("int").alias("first_line"), F.col("last").cast("int").alias("last_line"), F.col("ms").alias("ts_ms"), F.col("level").alias("log_level"), "component", text.alias("message")
    )


def _carry(rows: DataFrame, column: str) -> DataFrame:
    """Fills ``column`` from the last filled row before, within a log; by chunks, then over chunks."""
    inside = Window.partitionBy("log", "chunk").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("log").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("log", "chunk").agg(F.max(column).alias("top")).withColumn("before", F.max("top").over(over)).select("log", "chunk", "before")
    filled = rows.withColumn(column, F.last(column, ignorenulls=True).over(inside))
    return filled.join(chunks, ["log", "chunk"]).withColumn(column, F.coalesce(column, "before")).drop("before")


def _lead(entries: DataFrame) -> DataFrame:
    """Adds ``next``, the start of the log's next entry; by chunks, then over chunks."""
    inside = Window.partitionBy("log", "chunk").orderBy("start")
    over = Window.partitionBy("log").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = entries.groupBy("log", "chunk").agg(F.min("start").alias("low")).withColumn("after", F.min("low").over(over)).select("log", "chunk", "after")
    return entries.withColumn("next", F.lead("start").over(inside)).join(chunks, ["log", "chunk"]).withColumn("next", F.coalesce("next", "after")).drop("after")
