"""Mixing sources to target weights by repetition rates.

Sizes are added up for each source; the sources' targets follow from their
weights and caps; a source's rate is its target by its size. A document is
emitted floor(rate) times and once more with a probability equal to the
fraction: its number, hashed with a seed, says whether. Reruns agree, and no
document is seen by any other task.

Targets in closed form: with the sources in the order of cap by weight, those
before some place are at their cap, and the others share what is left by
weight; the place is the first where that share is within the cap, and no later share is
larger.

Cases: a null text has size 0; a null source is a source of its own, after all
others; equal rows get equal copies; a source without words has target 0;
other columns are kept by ``mixed``; an empty table gives no rows. The number
of sources is taken to fit one task's sort (the sources of a corpus, not its
documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm import tables

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(column: str = "text"):
    """Words between ASCII white space; null has none."""
    return F.regexp_count(tables.text_or_empty(column), F.lit(WORD)).cast("long")


def uniform(key, seed: str):
    """A number in [0, 1) from the key's text and the seed: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(everything))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


#: So many sources at most are broadcast.
MOST_SOURCES = 100_000


def beside(rows: DataFrame, found: DataFrame, on) -> DataFrame:
    """``rows`` with their source's columns of ``found``: texts are not dealt by source, whose hottest may hold most rows."""
    few = found.count() <= MOST_SOURCES
    return rows.join(F.broadcast(found) if few else found, on, "left")


def copies(rate, key, seed: str):
    """floor(rate) plus a Bernoulli copy with the fraction's probability."""
    return (F.floor(rate) + (uniform(key, seed) < rate - F.floor(rate)).cast("int")).cast("long")


def rated(documents: DataFrame, share: float, cap: int, weights: tuple[int, ...], seed: str, *more: str) -> DataFrame:
    """Rows of (doc_id, size, source_size, target, taken) and the ``more`` columns."""
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *more)
    sizes = tables.staged(sizes, "sizes")
    found = tables.staged(targets(sizes, share, cap, weights).withColumnRenamed("source", "_source"), "targets")
    joined = beside(sizes, found, sizes["source"].eqNullSafe(found["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.select("doc_id", "size", "source_size", "target", copies(rate, F.col("doc_id"), seed).alias("copies"), *more)


def mixed(documents: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``documents`` as the mix takes them: a row for each copy, all columns kept."""
    size, name, rate, copy = (tables.free_name(documents, n) for n in ("_size", "_source", "_rate", "_copy"))
    held = tables.staged(documents.withColumn(size, word_count()), "sized")
    sizes = held.select(F.col("source").cast("string").alias("source"), F.col(size).alias("size"))
    found = targets(sizes, share, cap, weights).select(F.col("source").alias(name), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    joined = beside(held, tables.staged(found, "targets"), F.col("source").cast("string").eqNullSafe(F.col(name)))
    repeated = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies(F.col(rate), F.col("doc_id").cast("long"), seed).cast("int"))))
    return repeated.select(*documents.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 5, 2, 1 repeating, 150 % of all words, twice at most."""
    rows = rated(tables.table(spark, sf_dir, "documents"), 1.5, 2, WEIGHTS, "mix")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint) / 4503599627370496.0::double as u
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, ([5, 2, 1])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight, 2 * source_size as cap from s),
l as (
  select *, (1.5::double * cast(sum(source_size) over () as double)
             - cast(coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as double))
            / cast(sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as double) as level
  from w),
m as (select max(level) filter (where level * weight <= cap) as level from l),
t as (
  select source, source_size, least(cast(cap as double), coalesce(m.level * weight, cast(cap as double))) as target
  from w, m),
r as (
  select doc_id, size, source_size, target, u, case when source_size > 0 then target / source_size else 0 end as rate
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size as bigint) as taken
from r
"""
