"""Held-out splits, sample pools, balanced draws and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.clean import uniform
from strataloom.operators.numbering import ranked
from strataloom.sources.stage import staged


def leave_one_out(sources: DataFrame, species: int) -> DataFrame:
    """(species, source, pool): the held species' sources are the test pool, all others train and validate; an unknown species is an error."""
    known = sources.agg(F.coalesce(F.max(F.col("species") == species), F.lit(False)).alias("_known"))
    checked = F.when(F.col("_known"), True).otherwise(F.raise_error(F.lit(f"unknown species {species}")).cast("boolean"))
    return sources.join(F.broadcast(known)).filter(checked).select("species", "source", F.when(F.col("species") == species, "test").otherwise("train_val").alias("pool"))


def train_val(slices: DataFrame, n_val: int) -> DataFrame:
    """``slices`` with ``split``: the first ``n_val`` places of each volume and orientation validate."""
    return slices.withColumn("split", F.when(F.col("n") < n_val, "val").otherwise("train"))


def default_holdout(depth: Column) -> Column:
    """Slices held out where no number is given: a fifth, 1 at least, 8 at most."""
    return F.least(F.lit(8), F.greatest(F.lit(1), (depth / 5).cast("int")))


def skip_empty(slices: DataFrame, skipping: Column) -> DataFrame:
    """Slices without foreground go where the source skips them."""
    return slices.filter(~(skipping & (F.col("n_fg") == 0)))


def isotropic_views(volumes: DataFrame, test: bool, all_views: bool = False) -> DataFrame:
    """(.., orientation): xz and yz only for isotropic sources, never for the test pool in 2-D."""
    three = F.array(*map(F.lit, ("xy", "xz", "yz")))
    views = F.when(F.lit(all_views) | (F.col("isotropic") & F.lit(not test)), three).otherwise(F.array(F.lit("xy")))
    return volumes.withColumn("orientation", F.explode(views))


def patch_index(filled: DataFrame, depths: DataFrame, n_slices: int) -> DataFrame:
    """(vol, orientation, z0): slabs inside the volume whose first slice has foreground."""
    starts = depths.filter(F.col("depth") >= n_slices).select("vol", "orientation", F.explode(F.sequence(F.lit(0), F.col("depth") - n_slices)).alias("z0"))
    return starts.join(filled.select("vol", "orientation", F.col("n").alias("z0")), ["vol", "orientation", "z0"])


def slab_join(patches: DataFrame, slices: DataFrame, n_slices: int) -> DataFrame:
    """Each patch with its slices, ``z`` counted from the patch's start: the range as an equi-join."""
    wide = patches.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).withColumn("n", F.col("z0") + F.col("z"))
    return wide.join(slices, ["vol", "orientation", "n"])


def union_pool(rows: DataFrame, wanted: list[int], group: list[str], order: list[str], strict: bool) -> DataFrame:
    """The rows of the sources ``wanted`` with ``position``, numbered by the list's order, then group and order.

    A source without rows is an error if ``strict``, else it is skipped; a pool without rows is an error.
    """
    # Read for its sources, for the sample of its ranges, and to be dealt.
    pool = staged(rows.filter(F.col("source").isin(wanted)), "pool")
    # One row for each source of the list at most.
    found = {r.source for r in pool.select("source").distinct().collect()}
    if strict and len(found) < len(wanted):
        raise ValueError(f"empty sources {[s for s in wanted if s not in found]}")
    if not found:
        raise ValueError("no source has rows")
    placed = pool.withColumn("_ord", F.array_position(F.array(*map(F.lit, wanted)), F.col("source")))
    return ranked(placed, ["_ord", *group, *order], place="position").drop("_ord")


def subset_targets(volumes: DataFrame, chosen: list[int], interleaved: list[str] | None = None) -> DataFrame:
    """Volumes by a list of indexes; ``task`` is the place in the list.

    With ``interleaved``, orientations in the order in which they alternate:
    ``position`` numbers the rows (vol, orientation, n) by task and n, and those
    of one n by that order; other orientations have no rows.
    """
    places = F.explode(F.arrays_zip(F.array(*map(F.lit, chosen)).alias("vol"), F.sequence(F.lit(0), F.lit(len(chosen) - 1)).alias("task")))
    wanted = volumes.sparkSession.range(1).select(places.alias("p")).select(F.col("p.vol").alias("vol"), F.col("p.task").alias("task"))
    # As many rows as the list has.
    found = volumes.join(F.broadcast(wanted), "vol")
    if interleaved is None:
        return found
    turn = F.array_position(F.array(*map(F.lit, interleaved)), F.col("orientation"))
    return ranked(found.withColumn("_turn", turn).filter("_turn > 0"), ["task", "n", "_turn"], place="position").drop("_turn")


def source_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with ``weight`` 1 / (rows of the source)."""
    sizes = rows.groupBy("source").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return rows.join(sizes, "source")


#: So many sources at most are broadcast.
MOST_SOURCES = 100_000


def balanced_draw(rows: DataFrame, order: list[str], draws: int | None, seed: int) -> DataFrame:
    """(draw, source, place, ..): draws with replacement, each source as likely as any other.

    As many as there are rows where ``draws`` is None. Places in a source are
    numbered by sampled ranges, so that no task sorts a whole source.
    """
    # Read for the sample of its ranges, to be dealt, and to be counted.
    rows = staged(rows, "rows")
    placed = ranked(rows, order, ["source"])
    sizes = placed.groupBy("source").agg(F.count("*").alias("_n"))
    sizes = staged(ranked(staged(sizes, "sources"), ["source"], place="_s"), "sources")
    n_sources = sizes.count()
    lots = rows.sparkSession.range(rows.count() if draws is None else draws).withColumnRenamed("id", "draw")
    lots = lots.withColumn("_s", F.floor(uniform(seed, "draw") * n_sources).cast("long"))
    lots = lots.join(F.broadcast(sizes) if n_sources <= MOST_SOURCES else sizes, "_s")
    lots = lots.withColumn("place", F.floor(uniform(seed + 1, "draw") * F.col("_n")).cast("long"))
    return lots.select("draw", "source", "place").join(placed, ["source", "place"])


def shuffle_batches(rows: DataFrame, keys: list[str], seed: int, epoch: int, size: int) -> DataFrame:
    """(batch, slot, ..): a seeded permutation cut into batches, the last partial one dropped. The order is that of a hash."""
    mixed = rows.withColumn("_order", F.xxhash64(F.lit(seed), F.lit(epoch), *keys))
    found = ranked(mixed, ["_order", *keys], place="_place", size="_size")
    found = found.withColumn("batch", F.floor(F.col("_place") / size)).withColumn("slot", F.col("_place") % size)
    return found.filter(F.col("batch") < F.floor(F.col("_size") / size)).drop("_order", "_place", "_size")


def shard(rows: DataFrame, position: str, rank: int, world: int) -> DataFrame:
    """Positions rank, rank + world, .."""
    return rows.filter(F.pmod(position, F.lit(world)) == rank)


#: Attempts that a sample without a prompt is given before it is looked at again: few at first, as most samples need one.
TURNS = (1, 3, 12)


def retry_fallback(samples: DataFrame, prompted: Callable[[DataFrame], DataFrame], keys: list[str], seed: int, tries: int = 48, replacements: int = 32) -> DataFrame:
    """(keys, used_*, attempt): the sample and the attempt that stand for each sample.

    ``prompted`` keeps the rows (keys, attempt) whose attempt gives a prompt. A
    sample takes its first one below ``tries``; only samples without any so far
    are tried again. Without any, replacement r is a random sample at its
    attempt ``tries + r``, and the first that gives a prompt counts; the
    replacements of one sample are looked at together. None is an error.
    """
    left, found, done, turns = samples.select(*keys), None, 0, list(TURNS)
    while done < tries:
        more = min(turns.pop(0) if turns else tries, tries - done)
        attempts = left.withColumn("attempt", F.explode(F.sequence(F.lit(done), F.lit(done + more - 1))))
        own = staged(prompted(attempts).groupBy(*keys).agg(F.min("attempt").alias("attempt")), "attempts")
        found = own if found is None else found.unionByName(own)
        left, done = staged(left.join(own, keys, "left_anti"), "unprompted"), done + more
    own = found.select(*keys, *(F.col(k).alias(f"used_{k}") for k in keys), "attempt")
    if left.isEmpty():
        return own
    placed = ranked(samples.select(*keys), keys, place="_place", size="_n").select("_place", "_n", *(F.col(k).alias(f"used_{k}") for k in keys))
    n = samples.count()
    drawn = left.withColumn("attempt", F.explode(F.sequence(F.lit(tries), F.lit(tries + replacements - 1))))
    drawn = drawn.withColumn("_place", F.floor(uniform(seed, *keys, "attempt") * n).cast("long"))
    tried = staged(drawn.join(placed, "_place").select(*(F.col(k).alias(f"_own_{k}") for k in keys), *(F.col(f"used_{k}").alias(k) for k in keys), "attempt"), "replacements")
    first = prompted(tried).groupBy(*(f"_own_{k}" for k in keys)).agg(F.min(F.struct("attempt", *keys)).alias("_r"))
    first = first.select(*(F.col(f"_own_{k}").alias(k) for k in keys), "_r")
    none = F.raise_error(F.lit("no replacement gives a prompt"))
    other = left.join(first, keys, "left")
    used = [F.coalesce(F.col(f"_r.{k}"), none.cast(samples.schema[k].dataType)).alias(f"used_{k}") for k in keys]
    return own.unionByName(other.select(*keys, *used, F.col("_r.attempt").alias("attempt")))


def collate(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """``rows`` with their arrays as long as the longest of the batch, the last element repeated."""
    most = rows.groupBy("batch").agg(*(F.max(F.size(a)).alias(f"_{a}") for a in arrays))
    found = rows.join(most, "batch")
    for a in arrays:
        found = found.withColumn(a, F.concat(F.col(a), F.array_repeat(F.element_at(a, -1), F.col(f"_{a}") - F.size(a)))).drop(f"_{a}")
    return found


def step_pad(column: Column, steps: int) -> tuple[Column, Column]:
    """(array of ``steps`` with zeros at the end, its validity)."""
    places = F.sequence(F.lit(0), F.lit(steps - 1))
    value = F.transform(places, lambda i: F.coalesce(F.get(column, i), F.lit(0).cast("double")))
    return value, F.transform(places, lambda i: (i < F.size(column)).cast("int"))
