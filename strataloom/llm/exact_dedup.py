"""Exact dedup by a tree merge of digest runs.

Each row's normalised text becomes a digest. The rows are dealt to leaf runs;
a run holds each of its digests once, with the winning row and the count. Runs
meet in binomial rounds: in each round every run whose lowest digits are not
zero goes to the run that has them zero, and the runs that meet are merged
digest by digest. A merge verifies the digest by the text's length and by a
second, independent hash, and keeps the winner. A hot text costs one row for
each run, never one for each copy.

DataFrame functions only. Cases: a null text counts as empty; equal rows are
told apart by a row number, so that exactly one of them stays; a null doc_id
loses to any other; other columns are kept by ``deduplicated`` and ignored
otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables

KEY = ["text_sha256", "n_bytes", "check"]


def normalised(column: str = "text"):
    """The text with A-Z in lower case, and nothing else changed; null as empty."""
    return F.translate(tables.text_or_empty(column), string.ascii_uppercase, string.ascii_lowercase)


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, row, digest columns) of every row, staged: texts are read once."""
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    each = text.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"))
    return tables.staged(each, "digests")


def merged(rows: DataFrame, keep: str = "largest", leaves: int = 64, fan: int = 4) -> DataFrame:
    """One row for each digest: (digest columns, winner (doc_id, row), n)."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    runs = rows.select(*KEY, F.pmod(F.xxhash64("row"), F.lit(leaves)).cast("int").alias("run"), F.struct("doc_id", "row").alias("winner"), F.lit(1).cast("long").alias("n"))
    runs = runs.groupBy(*KEY, "run").agg(best("winner").alias("winner"), F.sum("n").alias("n"))
    while leaves > 1:
        leaves = -(-leaves // fan)
        runs = runs.withColumn("run", F.expr(f"run div {fan}").cast("int"))
        runs = runs.groupBy(*KEY, "run").agg(best("winner").alias("winner"), F.sum("n").alias("n"))
    return runs.drop("run")


def classes(documents: DataFrame, keep: str = "largest") -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, text_sha256) of every row."""
    rows = digests(documents)
    groups = merged(rows, keep).filter("n > 1")
    found = rows.join(groups, KEY, "left")
    return found.select("doc_id", "row", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("winner.row"), F.lit(True)).alias("kept"), "text_sha256")


def deduplicated(documents: DataFrame, keep: str = "largest") -> DataFrame:
    """``documents`` without the rows that lose, all columns kept."""
    row = tables.free_name(documents, "_row")
    # Rows are told apart by a number that is written once.
    held = tables.staged(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    norm = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), normalised().alias("norm"))
    rows = norm.select("doc_id", "row", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"))
    rows = tables.staged(rows, "digests")
    losers = rows.join(merged(rows, keep).filter("n > 1"), KEY).filter("row <> winner.row").select(F.col("row").alias(row))
    return held.join(losers, row, "left_anti").drop(row)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts; the largest doc_id stays."""
    return classes(tables.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
