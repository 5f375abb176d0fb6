"""Places of rows in an order, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources.stage import staged

#: So many (group, range) pairs at most are broadcast.
MOST_PAIRS = 100_000


def ranked(rows: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), place: str = "place", size: str | None = None) -> DataFrame:
    """``rows`` with the place (from 0) of each in its group, in the order given, and the group's size if named.

    The rows are dealt by sampled ranges of (group, order), as many as the
    session's partitions, and sorted there. A row's place is its number in its
    range, less that of its group's first row there, plus the group's rows in
    the ranges before. So a hot group is spread over many ranges, and only a
    count for each pair of group and range is put in order. Rows that tie take
    any order among themselves: name what tells them apart. A null is a group
    of its own. Sampling reads ``rows`` twice: stage them if they are costly.
    """
    keys = [F.col(g) if isinstance(g, str) else g for g in (*group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = staged(dealt, "ranges")
    counts = dealt.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.withColumn("_shift", before - F.col("_first")).withColumn("_size", F.sum("_rows").over(whole)), "range-counts")
    counts = counts.select(*(F.col(g).alias(f"_group{i}") for i, g in enumerate(group)), F.col("_range").alias("_range2"), "_shift", "_size")
    same = F.col("_range") == F.col("_range2")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_group{i}"))
    few = counts.count() <= MOST_PAIRS
    found = dealt.join(F.broadcast(counts) if few else counts, same)
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), *([F.col("_size").alias(size)] if size else []))
