"""Several values packed in one field, split into one row per value with its position.

A field is cut at its quoted literals: odd pieces are literals, even pieces are
split on delimiters and brackets, and an array fold puts the pieces together
again, item by item, so that nothing separates inside quotes or brackets. All of
it runs as SQL expressions on the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.operators.skew import heavy_keys
from loomflow.runtime import materialize, ship

#: Fixed pattern: a literal in one of three quotes, with escapes by backslash or doubling.
#: It begins where no letter or digit is right before it, so apostrophes in words don't count.
_LITERAL = "|".join(rf"(?<![\p{{L}}\p{{N}}]){q}(?:[^{q}\\]|\\.|{q}{q})*+{q}" for q in "\"'`")


def pieces(field: Column) -> Column:
    """array<string> of quoted literals and the texts between them, in order."""
    return F.regexp_extract_all(field, F.lit(rf"(?s)(?:{_LITERAL})|[^\"'`]+|[\"'`]"), F.lit(0))


_QUOTES, _BLANKS = ("\"", "'", "`"), " \t\n\x0b\f\r"


def _quoted(text: Column) -> Column:
    """Of a piece: whether it is a literal; of any text: whether it may be one."""
    return F.substring(text, 1, 1).isin(*_QUOTES) & (F.length(text) > 1)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def is_literal(piece: Column) -> Column:
    return piece.rlike(rf"(?s)^(?:{_LITERAL.replace(r'(?<![\p{L}\p{N}])', '')})$")


def unquoted(literal: Column) -> Column:
    """The content of a quoted literal: a backslash quotes the next character, a doubled quote is one."""
    quote = F.substring(literal, 1, 1)
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    inner = F.replace(inner, F.concat(quote, quote), quote)
    return F.regexp_replace(inner, r"(?s)\\(.)", "$1")


def fold_items(field: Column, marks: str, keep_quotes: bool) -> Column:
    """array<string> of the items of one field, blanks around them cut, empty ones left out.

    ``marks`` are the delimiters, a character each. With ``keep_quotes`` literals stay as
    written, else they are put in without quotes and escapes. A closing bracket that
    none opened is an ordinary character; an opening one that none closes reaches to
    the field's end.
    """
    delimiters = "".join(rf"\x{ord(c):02x}" for c in marks)
    plain = F.lit(rf"[{delimiters}]|[\[\](){{}}]|[^{delimiters}\[\](){{}}]+")
    split = F.transform(
        pieces(field),
        lambda p: F.when(_quoted(p), F.array(F.struct(F.lit("q").alias("kind"), (p if keep_quotes else unquoted(p)).alias("text"))))
        .otherwise(
            F.transform(
                F.regexp_extract_all(p, plain, F.lit(0)),
                lambda t: F.struct(
                    F.when(t.isin("[", "(", "{"), F.lit("o")).when(t.isin("]", ")", "}"), F.lit("c")).when(t.isin(*marks), F.lit("d")).otherwise(F.lit("t")).alias("kind"),
                    t.alias("text"),
                ),
            )
        ),
    )
    keep = lambda done, cur: F.when(_trim(cur) == "", done).otherwise(F.concat(done, F.array(_trim(cur))))
    none, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")

    def step(acc: Column, piece: Column) -> Column:
        """``head`` is the text up to a chunk's first delimiter, which goes on the item of the chunk before."""
        kind, text = piece["kind"], piece["text"]
        ends = (kind == "d") & (acc["depth"] == 0)
        depth = F.when(kind == "o", acc["depth"] + 1).when(kind == "c", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(
            F.when(ends & acc["head"].isNull(), acc["cur"]).otherwise(acc["head"]).alias("head"),
            F.when(ends & acc["head"].isNotNull(), keep(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(ends, F.lit("")).otherwise(F.concat(acc["cur"], text)).alias("cur"),
            depth.alias("depth"),
        )

    def fold_chunk(acc: Column, chunk: Column) -> Column:
        fresh = F.struct(no_text.alias("head"), none.alias("done"), F.lit("").alias("cur"), acc["depth"].alias("depth"))
        return F.aggregate(chunk, fresh, step, lambda own: F.struct(
            F.when(own["head"].isNull(), acc["done"]).otherwise(F.concat(keep(acc["done"], F.concat(acc["cur"], own["head"])), own["done"])).alias("done"),
            F.when(own["head"].isNull(), F.concat(acc["cur"], own["cur"])).otherwise(own["cur"]).alias("cur"),
            own["depth"].alias("depth"),
        ))

    # A fold copies its result at every step. Chunks of sqrt(n) pieces, 64 at least, keep that to n x sqrt(n).
    size = lambda p: F.greatest(F.ceil(F.sqrt(F.size(p))).cast("int"), F.lit(64))
    chunks = lambda p: F.transform(F.sequence(F.lit(1), F.size(p), size(p)), lambda at: F.slice(p, at, size(p)))
    start = F.struct(none.alias("done"), F.lit("").alias("cur"), F.lit(0).alias("depth"))
    whole = lambda p: F.aggregate(F.when(F.size(p) > 0, chunks(p)).otherwise(F.array().cast("array<array<struct<kind:string,text:string>>>")), start, fold_chunk, lambda acc: keep(acc["done"], acc["cur"]))
    return F.when(field.isNotNull(), F.element_at(F.transform(F.array(F.flatten(split)), whole), 1))  # the pieces are made once


def _blank(field: Column) -> Column:
    """A field that is null, blank or `None` holds no value."""
    return F.when(field.isNull() | field.rlike(r"^\s*(None)?\s*$"), None).otherwise(field)


def table_list(field: Column) -> Column:
    """Items of a packed list of names: comma, semicolon, bar and white space separate,
    brackets around the whole list are no part of it, quotes and escapes neither.
    A null, blank or `None` field gives null, a list of nothing an empty array; repeated names stay."""
    whole = _trim(_blank(field))
    inner = whole
    for a, b in (("[", "]"), ("{", "}"), ("(", ")")):
        inner = F.when(whole.startswith(a) & whole.endswith(b), F.substring(whole, F.lit(2), F.length(whole) - 2)).otherwise(inner)
    return fold_items(inner, ",;|" + _BLANKS, keep_quotes=False)


def argument_list(field: Column) -> Column:
    """Items `key=value` or bare text: comma, semicolon and bar separate, blanks don't.
    Key and value may be joined by `=`, `=>` or `:`; quotes and escapes around a value go, brackets stay.
    A null, blank or `None` field gives null; fields of any length are folded whole."""
    joiner = r"(?s)^([\p{L}_][\p{L}\p{N}_.\-]*)\s*(?:=>|=|:(?=\s|$)|:(?!//))\s*(.*)$"

    def item(text: Column) -> Column:
        key, value = F.regexp_extract(text, joiner, 1), F.regexp_extract(text, joiner, 2)
        bare = lambda v: F.when(_quoted(v) & is_literal(v), unquoted(v)).otherwise(v)
        return F.when(key != "", F.concat(key, F.lit("="), bare(value))).otherwise(bare(text))

    return F.transform(fold_items(_blank(field), ",;|", keep_quotes=True), item)


def unpack(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(``field_name``, ``row_key`` string, ``pos`` int from 1, ``item``) of each named item array.

    Every value once per key: rows that repeat a key's field give one copy. Rows
    with a null key are left out; null fields and empty ones give no rows.

    Arrays move, not items: a key's arrays meet, and are spread out and made distinct
    where they are. Those of a key that holds much of the table are made distinct before they meet.
    """
    ship(df.sparkSession)
    named = df.where(F.col(key).isNotNull())
    rows = named.select(F.col(key).cast("string").alias("row_key"), *[items.alias(f"__f{i}") for i, items in enumerate(fields.values())])
    heavy = materialize(heavy_keys(named.select(F.col(key).cast("string").alias("row_key")), ["row_key"]).select("row_key"), "packed-heavy")
    light = rows.join(F.broadcast(heavy), "row_key", "left_anti").repartition("row_key")
    hot = rows.join(F.broadcast(heavy), "row_key", "left_semi").distinct()
    listed = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(f"__f{i}").alias("items")) for i, name in enumerate(fields)])

    def spread(part: DataFrame) -> DataFrame:
        part = part.select("row_key", F.inline(listed))
        return part.select("field_name", "row_key", F.posexplode("items").alias("at", "item")).distinct()

    both = spread(rows.repartition("row_key")) if heavy.isEmpty() else spread(light).unionByName(spread(hot))
    return both.select("field_name", "row_key", (F.col("at") + 1).alias("pos"), "item")
