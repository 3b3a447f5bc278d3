"""Generated inputs. All are functions of the row number and a seed, so they can be made again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of generated sentences.
WORDS = ("loom", "weft", "warp", "reed", "heddle", "shuttle", "bobbin", "selvage", "twill", "pick", "treadle", "beam", "lease", "sley", "batten", "temple")


def term(number: Column, seed: int = 0) -> Column:
    return F.concat_ws("_", F.lit("term"), number.cast("string"), F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"))), 1, 12))


def join_data(spark: SparkSession, large: int, small: int, overlap: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(large side, small side, expected intersection) of distinct keys (column ``value``).

    The first ``overlap`` x ``large`` keys of the large side, at most ``small``, are also on the
    small side; the rest of the small side is on neither.
    """
    shared = min(int(large * overlap), small)
    big = spark.range(large).select(term(F.col("id"), seed).alias("value"))
    both = spark.range(shared).select(term(F.col("id"), seed).alias("value"))
    rest = spark.range(small - shared).select(term(F.col("id") + large, seed).alias("value"))
    return big, both.unionByName(rest), both


def random_bytes(spark: SparkSession, rows: int, seed: int = 0, key_bytes: int = 10, value_bytes: int = 90) -> DataFrame:
    """(key, value) binary of fixed lengths, from repeated digests of the row number."""

    def stream(size: int, salt: str) -> Column:
        parts = [F.unhex(F.sha2(F.concat_ws(":", F.lit(f"{seed}{salt}{k}"), F.col("id").cast("string")), 256)) for k in range(-(-size // 32))]
        return F.substring(F.concat(*parts), 1, size)

    return spark.range(rows).select(stream(key_bytes, "k").alias("key"), stream(value_bytes, "v").alias("value"))


def draw(most: int, *parts: Column | int | str) -> Column:
    """A number of 0 to ``most`` - 1 that depends on the parts only, by a digest, so other engines can draw it too."""
    joined = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long"), F.lit(most))


def random_text(spark: SparkSession, rows: int, seed: int = 0, words: Sequence[str] = WORDS, key_words: tuple[int, int] = (5, 10), value_words: tuple[int, int] = (20, 100)) -> DataFrame:
    """(key, value): sentences of random words, lengths between the bounds."""
    listed = F.array(*[F.lit(w) for w in words])

    def sentence(bounds: tuple[int, int], salt: int) -> Column:
        least, most = bounds
        n = least + draw(most - least + 1, seed, salt, F.col("id"))
        return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.get(listed, draw(len(words), seed, salt, F.col("id"), i).cast("int"))), " ")

    return spark.range(rows).select(sentence(key_words, 1).alias("key"), sentence(value_words, 2).alias("value"))
