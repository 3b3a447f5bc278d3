"""Queries of the operators for language-model data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.llm import leakage, mixing, quantiles, repetition, topn
from loomflow.operators.skew import hot_join
from loomflow.runtime import materialize
from loomflow.sources.tables import table

#: Section of the sketches: the rank of share q of n values is off by about (n - qn) / 256 at most, of a
#: median 0.2 percent of n, and names of up to 1,536 values are exact.
SECTION = 256
SHARES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def counted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that count: with an id, a vertex_name and a time_taken of 0 or more."""
    return table(spark, sf_dir, "attempts").where("task_attempt_id is not null and vertex_name is not null and time_taken >= 0")


def attempt_values(spark: SparkSession, sf_dir: str, day: bool = False) -> DataFrame:
    """One time_taken per task_attempt_id; with ``day``, of its first start."""
    extra = [F.min(F.when(F.col("start_time") > 0, F.expr("start_time div 86400000"))).alias("day_no")] if day else []
    return counted_attempts(spark, sf_dir).groupBy("vertex_name", "task_attempt_id").agg(F.max("time_taken").alias("time_taken"), *extra)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles.group_percentiles(attempt_values(spark, sf_dir), ["vertex_name"], "time_taken", {"p50": 0.5, "p99": 0.99}, SECTION)
    return found.where("p99 >= 10 * p50").select("vertex_name")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.group_percentiles(attempt_values(spark, sf_dir), ["vertex_name"], "time_taken", SHARES, SECTION)


def p1_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per vertex_name and day, then the percentiles of all days from them."""
    values = attempt_values(spark, sf_dir, day=True)
    days = quantiles.merge_sketches(quantiles.sketch_by(values, ["vertex_name", "day_no"], "time_taken", SECTION), ["vertex_name", "day_no"])
    merged = quantiles.merge_sketches(days, ["vertex_name"]).withColumn("q", quantiles.sketch_quantiles(list(SHARES.values())))
    return merged.select("vertex_name", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(SHARES)])


def p1_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vertex_name its values, and whether every percentile's true rank is within the stated bound: of sketches of all
    values, and of merged sketches of days."""
    values = materialize(attempt_values(spark, sf_dir), "percentile-values")
    out = None
    for name, found in (("within_bound", p1_percentiles(spark, sf_dir)), ("days_within_bound", p1_from_days(spark, sf_dir))):
        ranked = hot_join(values, found, ["vertex_name"], "n")
        ranks = [x for p in SHARES for x in (F.count_if(F.col("time_taken") < F.col(p)).alias(f"{p}_below"), F.count_if(F.col("time_taken") <= F.col(p)).alias(f"{p}_upto"))]
        per = ranked.groupBy("vertex_name").agg(F.count(F.lit(1)).alias("n"), *ranks)
        ok = F.lit(True)
        for p, q in SHARES.items():
            target = F.greatest(F.ceil(F.col("n") * q - 1e-9), F.lit(1))
            error = F.greatest(F.col(f"{p}_below") + 1 - target, target - F.col(f"{p}_upto"), F.lit(0))
            ok = ok & (error <= (F.col("n") - target) / SECTION + 1)
        per = per.select("vertex_name", "n", ok.alias(name))
        out = per if out is None else out.join(per.drop("n"), "vertex_name")
    return out


P1_WITHIN_BOUND_SQL = """
select vertex_name, count(distinct task_attempt_id) as n, true as within_bound, true as days_within_bound from attempts
where task_attempt_id is not null and vertex_name is not null and time_taken >= 0 group by 1
"""

P1_FOUND_SQL = """
with v as (
  select vertex_name, task_attempt_id, max(time_taken) as t from attempts
  where task_attempt_id is not null and vertex_name is not null and time_taken >= 0 group by 1, 2),
r as (select vertex_name, t, row_number() over (partition by vertex_name order by t) as rn, count(*) over (partition by vertex_name) as n from v),
q as (select vertex_name, min(t) filter (where rn * 100 >= 50 * n) as p50, min(t) filter (where rn * 100 >= 99 * n) as p99 from r group by 1)
select vertex_name from q where p99 >= 10 * p50
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted_attempts(spark, sf_dir).where("dag_id is not null")
    top = topn.top_n_per_group(rows, ["dag_id", "vertex_name"], "time_taken", "task_attempt_id", 3)
    return top.select("dag_id", "vertex_name", "rank_no", "task_attempt_id")


P4_FOUND_SQL = """
with v as (
  select dag_id, vertex_name, task_attempt_id, max(time_taken) as t from attempts
  where task_attempt_id is not null and vertex_name is not null and dag_id is not null and time_taken >= 0 group by 1, 2, 3),
r as (select *, row_number() over (partition by dag_id, vertex_name order by t desc, task_attempt_id) as rn from v)
select dag_id, vertex_name, cast(rn as integer) as rank_no, task_attempt_id from r where rn <= 3
"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with the longest shared passage and where it starts."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.leaked_passages(docs, "doc_id", "text", items, "item_id", "text", passage=12)


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents, and the longest passage of each."""
    return p8_passages(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with most of an item's rarest words close together, in any order."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.proximity_matches(docs, "doc_id", "text", items, "item_id", "text")


def p8_near_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with most of the rarest words of any 24 successive words of an item close together, in any order."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.window_matches(docs, "doc_id", "text", items, "item_id", "text")


WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

P8_FOUND_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents where doc_id is not null),
i as (select item_id, {WORDS_SQL} as w from eval_items where item_id is not null),
ig as (select distinct item_id, array_to_string(w[k:k+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
dg as (select doc_id, array_to_string(w[k:k+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d))
select distinct doc_id, item_id from dg join ig using (g)
"""


P8_RUNS_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents where doc_id is not null),
i as (select item_id, {WORDS_SQL} as w from eval_items where item_id is not null),
ig as (select item_id, k as ik, array_to_string(w[k:k+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
dg as (select doc_id, k as dk, array_to_string(w[k:k+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
m as (select distinct doc_id, item_id, dk, ik from dg join ig using (g)),
r as (select *, dk - row_number() over (partition by doc_id, item_id, dk - ik order by dk) as run from m),
p as (select doc_id, item_id, count(*) + 11 as n_words, min(dk) - 1 as doc_word, min(ik) - 1 as item_word from r group by doc_id, item_id, dk - ik, run),
b as (select *, row_number() over (partition by doc_id, item_id order by n_words desc, doc_word, item_word) as rn from p)
"""
P8_PASSAGES_SQL = P8_RUNS_SQL + "select doc_id, item_id, cast(n_words as integer) as n_words, cast(doc_word as integer) as doc_word, cast(item_word as integer) as item_word from b where rn = 1"
P8_ITEMS_SQL = P8_RUNS_SQL + "select item_id, count(*) as n_docs, cast(max(n_words) as integer) as longest from b where rn = 1 group by 1"


P8_NEAR_SQL = f"""
with d as (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as term from (select doc_id, {WORDS_SQL} as w from documents where doc_id is not null)),
f as (select term, count(distinct doc_id) as df from d group by 1),
i as (select distinct item_id, unnest({WORDS_SQL}) as term from eval_items where item_id is not null),
c as (select *, count(*) over (partition by item_id) as n from (select item_id, term, row_number() over (partition by item_id order by df, term) as r from i join f using (term)) where r <= 8),
p as (select doc_id, item_id, k - 1 as p, term from d join c using (term) where n >= 7),
o as (select doc_id, item_id from p group by 1, 2 having count(distinct term) >= 7),
w as (select a.doc_id, a.item_id, a.p, count(distinct b.term) as n, min(b.p) as s from o join p a using (doc_id, item_id) join p b on b.doc_id = a.doc_id and b.item_id = a.item_id and b.p <= a.p and b.p > a.p - 60 group by 1, 2, 3),
x as (select *, row_number() over (partition by doc_id, item_id order by n desc, p) as r from w)
select doc_id, item_id, cast(n as integer) as n_words, cast(s as integer) as doc_word from x where r = 1 and n >= 7
"""


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_report(spark, sf_dir).where("short").select("source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))[0]


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))[1]


def p9_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix in which every source reaches its share."""
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"), total_tokens="reachable")[0]


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, from the drawn documents themselves: ``reported``: the report has their tokens; ``within_repeats``: none
    is drawn more often than it may be; ``whole_if_short``: a short source is drawn whole, as often as it may be;
    ``near_target``: another one is off its target by 5 percent and two blocks at most."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    report, drawn = mixing.mix(docs, "doc_id", "source", "text", targets)
    per = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"), F.max("n_tokens").alias("longest"))
    rows = report.join(per, "source", "left").na.fill(0, ["tokens", "most", "longest"])
    off = F.abs(F.col("tokens") - F.col("asked_tokens"))
    return rows.select(
        "source", (F.col("tokens") == F.col("drawn_tokens")).alias("reported"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"),
        (~F.col("short") | (F.col("tokens") == F.col("max_repeats") * F.col("available_tokens"))).alias("whole_if_short"),
        (F.col("short") | (off <= 0.05 * F.col("asked_tokens") + 2 * (mixing.BLOCK_TOKENS + F.col("longest")))).alias("near_target"),
    )


#: Tokens are counted as the pieces that byte-level tokenizers split first, since usual tokenizers agree on the sources.
P9_FOUND_SQL = r"""
with d as (select regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g') as k, len(regexp_extract_all(coalesce(text, ''), ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) as n from documents where source is not null),
t as (select k, sum(n) as n from d where k <> '' group by 1)
select source from mix_targets left join t on k = regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g') where max_repeats * coalesce(n, 0) < target_share * (select sum(n) from t)
"""

P9_CHECKS_SQL = "select source, true as reported, true as within_repeats, true as whole_if_short, true as near_target from mix_targets"


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = repetition.repetition(table(spark, sf_dir, "documents"), "doc_id", "text", grams=[(6, 3)], lines=False)
    return shares.where("n_words > 0 and words_6_3 * 100 >= 40 * n_words").select("doc_id")


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"), "doc_id", "text")


P10_FOUND_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
g as (select doc_id, len(w) as n, k, array_to_string(w[k:k+5], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 4)) as k from d)),
o as (select doc_id, n, k from (select *, count(*) over (partition by doc_id, g) as c from g) where c >= 3),
p as (select distinct doc_id, n, k + j as at from o, (select unnest(range(0, 6)) as j))
select doc_id from p group by doc_id, n having count(*) * 100 >= 40 * n
"""


_GRAMS = ((2, 2), (4, 2), (6, 3), (10, 2))


def _covered_sql(n: int, least: int) -> str:
    grams = f"select doc_id, k, array_to_string(w[k:k+{n - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as k from d)"
    often = f"select doc_id, k from (select *, count(*) over (partition by doc_id, g) as c from ({grams})) where c >= {least}"
    return f"select doc_id, count(*) as n, sum(len(w[place])) as chars from (select distinct doc_id, k + j as place from ({often}), (select unnest(range(0, {n})) as j)) join d using (doc_id) group by 1"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _repeated_sql(parts: str) -> str:
    return f"select doc_id, sum(len(x) * c) filter (where c > 1) as n from (select doc_id, x, count(*) as c from (select doc_id, trim(unnest({parts}), {_BLANKS}) as x from documents) where x <> '' group by 1, 2) group by 1"


P10_REPETITION_SQL = (
    f"with d as (select doc_id, {WORDS_SQL} as w from documents), "
    + ", ".join(f"g{n} as ({_covered_sql(n, m)})" for n, m in _GRAMS)
    + f", l as ({_repeated_sql('string_split(text, chr(10))')}), p as ({_repeated_sql("regexp_split_to_array(text, '[' || chr(10) || '][ \\t\\n\\r]*[' || chr(10) || ']')")}) "
    + "select t.doc_id, cast(len(w) as bigint) as n_words, cast(length(text) as bigint) as n_chars, "
    + "coalesce(l.n, 0) / greatest(length(text), 1) as line_share, coalesce(p.n, 0) / greatest(length(text), 1) as paragraph_share, "
    + ", ".join(f"coalesce(g{n}.n, 0) as words_{n}_{m}, coalesce(g{n}.chars, 0) / greatest(list_sum(list_transform(w, lambda x: len(x))), 1) as chars_{n}_{m}" for n, m in _GRAMS)
    + " from documents t join d using (doc_id) left join l using (doc_id) left join p using (doc_id) "
    + " ".join(f"left join g{n} using (doc_id)" for n, _ in _GRAMS)
)


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_percentiles": p1_percentiles,
        "p1_from_days": p1_from_days,
        "p1_within_bound": p1_within_bound,
        "p4_found": p4_found,
        "p8_found": p8_found,
        "p8_passages": p8_passages,
        "p8_items": p8_items,
        "p8_near": p8_near,
        "p8_near_windows": p8_near_windows,
        "p9_found": p9_found,
        "p9_report": p9_report,
        "p9_drawn": p9_drawn,
        "p9_reached": p9_reached,
        "p9_checks": p9_checks,
        "p10_found": p10_found,
        "p10_repetition": p10_repetition,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_within_bound": P1_WITHIN_BOUND_SQL, "p9_found": P9_FOUND_SQL, "p9_checks": P9_CHECKS_SQL, "p4_found": P4_FOUND_SQL, "p8_found": P8_FOUND_SQL, "p8_passages": P8_PASSAGES_SQL, "p8_items": P8_ITEMS_SQL, "p8_near": P8_NEAR_SQL, "p10_found": P10_FOUND_SQL, "p10_repetition": P10_REPETITION_SQL}
