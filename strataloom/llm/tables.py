"""Reading input tables and staging intermediate ones in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.stage import shared_dir, staged, staged_arrays

__all__ = ["MOST_BITS", "bitmap_bits", "free_name", "partitions", "shared_dir", "sieve", "staged", "staged_arrays", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(frame: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``frame`` has that name in any case."""
    taken = {c.lower() for c in frame.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def text_or_empty(column: str = "text"):
    """The text column, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: The largest bitmap that is broadcast: 2**26 bits, a million words of 64.
MOST_BITS = 26


def bitmap_bits(n: int) -> int | None:
    """Bits (as a power of two) of a bitmap for n keys, some 8 for a key; None where it would be larger than ``MOST_BITS``."""
    bits = max(12, (8 * n).bit_length())
    return bits if bits <= MOST_BITS else None


def sieve(frame: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """``frame`` without most of the rows whose keys are not in ``needed``, unshuffled.

    A bitmap of hashed keys, sized by their count, is broadcast as words of 64
    bits. Rows that it lets through wrongly are left to the join that follows,
    and so are all rows where a bitmap of the largest size would be too small.
    """
    bits = bitmap_bits(needed.count())
    if bits is None:
        return frame
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    bit = lambda: F.expr("shiftleft(1L, cast(_mark % 64 as int))")
    words = needed.withColumn("_mark", mark).select(F.expr("shiftright(_mark, 6)").alias("_word"), bit().alias("_bits"))
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    marked = frame.withColumn("_mark", mark).withColumn("_word", F.expr("shiftright(_mark, 6)"))
    kept = marked.join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit()) != 0)
    return kept.select(*frame.columns)
