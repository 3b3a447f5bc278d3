"""Mixing sources to target shares of tokens by Sainte-Lague apportionment.

Documents are laid out in blocks of about equal tokens per source and shard; the
sources get whole blocks by highest quotients share / (2 s + 1), no source more
than ``max_repeats`` times its own; a source's quota is apportioned over its
shards; and within a shard a seeded order picks the blocks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomflow.runtime import materialize, ship

#: Tokens of a block, documents of a shard.
BLOCK_TOKENS = 4096
SHARD_DOCS = 20_000

#: Folder of the public tokenizers; a parameter of every function that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoder(path: str):  # noqa: ANN202 - an optional library's type
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, columns: Sequence[str], text: str, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``columns`` and ``n_tokens`` long of every row; a null or empty text has 0."""
    ship(df.sparkSession)
    schema = df.select(*columns).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if (t := v.as_py()) else 0 for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64())], names=schema.names)

    return df.select(*columns, F.col(text).cast("string").alias("__text")).mapInArrow(count, schema)


def source_key(source: Column) -> Column:
    """Sources compared without case, outer blanks and what joins their words."""
    return F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")


def sainte_lague(shares: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Whole seats by highest quotients share / (2 s + 1), at most ``caps`` each; ties go to
    the earlier one. All seats are given unless every positive share is at its cap."""
    weights, limits = np.asarray(shares, np.float64), np.asarray(caps, np.int64)
    limits = np.where(weights > 0, limits, 0)
    seats = int(min(seats, limits.sum()))
    if seats <= 0:
        return [0] * len(weights)
    low, high = 0.0, 1.0

    def given(scale: float) -> np.ndarray:
        return np.minimum(np.floor(weights * scale + 0.5), limits).astype(np.int64)

    while given(high).sum() < seats:
        high *= 2
    for _ in range(200):  # the largest scale that gives no more than the seats
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() <= seats else (low, middle)
    quotas = given(low)
    for _ in range(seats - int(quotas.sum())):  # ties at the last quotient
        quotient = np.where(quotas < limits, weights / (2 * quotas + 1), -1)
        quotas[int(np.argmax(quotient))] += 1
    return quotas.tolist()


def mix(
    docs: DataFrame,
    doc_id: str,
    source: str,
    text: str,
    targets: DataFrame,
    total_tokens: int | str | None = None,
    seed: int = 17,
    block_tokens: int = BLOCK_TOKENS,
    tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken",
) -> tuple[DataFrame, DataFrame]:
    """(report, drawn) of a mix of ``total_tokens``: by default those of all documents with a source,
    of which short sources then give less than their share; with ``"reachable"`` the most
    that all sources can fill to their share without repeating beyond ``max_repeats``.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``, one row per source,
    at most 100,000; shares are taken as they are. ``report`` has a row per target: ``source`` as
    in targets, ``target_share``, ``max_repeats``, ``available_tokens``, ``quota_blocks``,
    ``drawn_tokens``, ``actual_share`` (of all drawn tokens), ``asked_tokens`` (its share of the total) and ``short``: its
    quota is all it may give, and what was drawn is still less than asked. ``drawn`` has (doc_id, ``source``,
    ``n_tokens``, ``repeats``), a row per drawn document.

    Documents with a null or blank source aren't part of the mix; sources without a target
    count in the total and draw nothing; null texts have no tokens; repeated ids are
    documents of their own. The order of blocks hangs on the seed and the ids, not on partitions.
    """
    spark = docs.sparkSession
    goals = targets.select("source", "target_share", "max_repeats", source_key(F.col("source")).alias("key")).where("source is not null").limit(100_001).collect()
    if len(goals) > 100_000:
        raise ValueError("more than 100,000 sources")
    if len({g["key"] for g in goals}) < len(goals):
        raise ValueError("two targets name the same source")
    named = docs.select(F.col(doc_id).alias("doc"), source_key(F.col(source)).alias("key"), F.col(text).alias("text")).where("key is not null and key <> ''")
    counted = materialize(token_counts(named, ["doc", "key"], "text", tokenizer), "mix-tokens")

    # As many totals as sources; those of no target are joined in one.
    wanted = [g["key"] for g in goals]
    label = F.when(F.col("key").isin(wanted), F.col("key")) if wanted else F.lit(None).cast("string")
    totals = {r["key"]: r for r in counted.groupBy(label.alias("key")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    tokens = [totals[k]["tokens"] if k in totals else 0 for k in wanted]
    if total_tokens == "reachable":
        most = [max(int(g["max_repeats"] or 0), 0) * t / g["target_share"] for g, t in zip(goals, tokens) if (g["target_share"] or 0) > 0]
        everything = math.floor(min(most, default=0))
    else:
        everything = sum(r["tokens"] for r in totals.values()) if total_tokens is None else int(total_tokens)
    goal_rows = [(g["key"], max(1, math.ceil((totals[g["key"]]["docs"] if g["key"] in totals else 0) / SHARD_DOCS))) for g in goals]
    sharding = spark.createDataFrame(goal_rows, "key string, shards int")

    # Blocks: a shard's documents in seeded order, cut every block_tokens tokens.
    order = F.xxhash64(F.lit(seed), F.col("doc"))
    placed = counted.join(F.broadcast(sharding), "key").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc")), F.col("shards")).cast("int"))
    before = Window.partitionBy("key", "shard").orderBy(order, "doc", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) / block_tokens))
    laid = materialize(laid.select("doc", "key", "shard", "block", "n_tokens"), "mix-blocks")
    blocks = laid.groupBy("key", "shard", "block").agg(F.sum("n_tokens").alias("tokens"))
    shards = blocks.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("blocks"))

    # Quotas of sources, then of shards. A source's blocks hold its mean, so shares are of tokens.
    size = {r["key"]: r["blocks"] for r in shards.groupBy("key").agg(F.sum("blocks").alias("blocks")).collect()}
    repeats = [max(int(g["max_repeats"] or 0), 0) for g in goals]
    caps = [r * size.get(k, 0) for r, k in zip(repeats, wanted)]
    mean = [t / size[k] if size.get(k) else float(block_tokens) for t, k in zip(tokens, wanted)]
    share = [float(g["target_share"] or 0) for g in goals]
    asked = [s * everything / m if m else 0.0 for s, m in zip(share, mean)]
    quotas = sainte_lague(asked, round(sum(asked)), [min(c, math.ceil(a)) for c, a in zip(caps, asked)])
    quota = spark.createDataFrame([(k, q, size.get(k, 0), r) for k, q, r in zip(wanted, quotas, repeats)], "key string, quota long, size long, most int")

    # Of a shard floor(quota x blocks / size) by running sums: integer, and the shards' quotas add up.
    upto = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    split = shards.withColumn("upto", F.sum("blocks").over(upto)).join(F.broadcast(quota), "key")
    share_of = lambda x: F.floor(F.col("quota") * x / F.col("size"))
    split = split.withColumn("own", share_of(F.col("upto")) - share_of(F.col("upto") - F.col("blocks")))
    seeded = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block")
    picked = blocks.withColumn("place", F.row_number().over(seeded)).join(split.select("key", "shard", "blocks", "own", "most"), ["key", "shard"])
    times = F.floor(F.col("own") / F.col("blocks")) + F.when(F.col("place") <= F.col("own") % F.col("blocks"), 1).otherwise(0)
    picked = picked.select("key", "shard", "block", "tokens", F.least(times, F.col("most").cast("long")).cast("int").alias("repeats")).where("repeats > 0")
    picked = materialize(picked, "mix-picked")

    drawn_tokens = {r["key"]: r["t"] for r in picked.groupBy("key").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()}
    drawn_all = sum(drawn_tokens.values())
    rows = [
        (g["source"], share[i], repeats[i], tokens[i], quotas[i], drawn_tokens.get(k, 0), drawn_tokens.get(k, 0) / drawn_all if drawn_all else None, share[i] * everything, quotas[i] >= caps[i] and drawn_tokens.get(k, 0) < share[i] * everything)
        for i, (g, k) in enumerate(zip(goals, wanted))
    ]
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, quota_blocks long, drawn_tokens long, actual_share double, asked_tokens double, short boolean")
    names = spark.createDataFrame([(g["key"], g["source"]) for g in goals], "key string, source string")
    drawn = laid.join(picked.select("key", "shard", "block", "repeats"), ["key", "shard", "block"]).join(F.broadcast(names), "key")
    return report, drawn.select(F.col("doc").alias(doc_id), "source", "n_tokens", "repeats")
