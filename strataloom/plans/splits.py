"""Queries of splits, pools, sampling and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import splits as op
from strataloom.operators.clean import uniform
from strataloom.operators.numbering import ranked
from strataloom.registry import query
from strataloom.sources import fixture as fx
from strataloom.sources.fixture import DUCK
from strataloom.sources.stage import staged

ALL = DUCK + """
, every as (
  select vol, orientation, n, coalesce(n_fg, 0) as n_fg from (
    select distinct vol, 'xy' as orientation, z as n from grid union select distinct vol, 'xz', y from grid union select distinct vol, 'yz', x from grid)
  left join slices using (vol, orientation, n))
"""


def every(spark, sf):
    vols = fx.table(spark, sf, "part").selectExpr("cast(p_partkey div 32 as int) as vol").distinct()
    views = vols.selectExpr("vol", "explode(map('xy', sequence(0, 7), 'xz', sequence(0, 31), 'yz', sequence(0, 31))) as (orientation, ns)")
    places = views.selectExpr("vol", "orientation", "explode(ns) as n")
    return places.join(fx.slices(spark, sf), ["vol", "orientation", "n"], "left").withColumn("n_fg", F.coalesce("n_fg", F.lit(0)))


@query("spl_leave_one_out", "select n_regionkey as species, n_nationkey as source, case when n_regionkey = 2 then 'test' else 'train_val' end as pool from nation")
def spl_leave_one_out(spark, sf):
    return op.leave_one_out(fx.sources(spark, sf), 2)


@query("spl_train_val_slices", ALL + "select vol, orientation, n, n_fg, case when n < 2 then 'val' else 'train' end as split from every")
def spl_train_val_slices(spark, sf):
    return op.train_val(every(spark, sf), 2)


@query("spl_default_holdout", ALL + "select vol, orientation, least(8, greatest(1, cast(count(*) // 5 as int))) as n_val from every group by all")
def spl_default_holdout(spark, sf):
    return every(spark, sf).groupBy("vol", "orientation").agg(op.default_holdout(F.count("*")).cast("int").alias("n_val"))


@query("spl_skip_empty", ALL + "select vol, orientation, n, n_fg from every where n_fg > 0 or vol % 25 % 2 = 0")
def spl_skip_empty(spark, sf):
    return op.skip_empty(every(spark, sf), F.expr("vol % 25 % 2 = 1"))


@query("spl_isotropic_views", DUCK + """
, v as (select distinct vol, vol % 25 as source from seeds)
select vol, source, unnest(case when isotropic then ['xy', 'xz', 'yz'] else ['xy'] end) as orientation from v join sources using (source)""")
def spl_isotropic_views(spark, sf):
    volumes = fx.table(spark, sf, "part").selectExpr("cast(p_partkey div 32 as int) as vol").distinct().selectExpr("vol", "vol % 25 as source").join(fx.sources(spark, sf), "source")
    return op.isotropic_views(volumes, test=False).select("vol", "source", "orientation")


DEPTHS = "stack(3, 'xy', 8, 'xz', 32, 'yz', 32) as (orientation, depth)"


def patches(spark, sf):
    depths = fx.table(spark, sf, "part").selectExpr("cast(p_partkey div 32 as int) as vol").distinct().selectExpr("vol", DEPTHS)
    return op.patch_index(fx.slices(spark, sf), depths, 4)


PATCHES = DUCK + ", patches as (select vol, orientation, n as z0 from slices where n + 4 <= case orientation when 'xy' then 8 else 32 end)"


@query("spl_patch_index", PATCHES + "select vol, orientation, z0 from patches")
def spl_patch_index(spark, sf):
    return patches(spark, sf)


@query("spl_patch_slab_join", PATCHES + "select p.vol, p.orientation, z0, k as z, n_fg from (select *, unnest([0, 1, 2, 3]) as k from patches) p join slices s on s.vol = p.vol and s.orientation = p.orientation and s.n = z0 + k")
def spl_patch_slab_join(spark, sf):
    return op.slab_join(patches(spark, sf), fx.slices(spark, sf), 4).select("vol", "orientation", "z0", "z", "n_fg")


@query("spl_union_pool", DUCK + """
select vol % 25 as source, vol, orientation, n, cast(row_number() over (order by vol % 25, vol, orientation, n) - 1 as bigint) as position from slices where vol % 25 % 3 <> 0""")
def spl_union_pool(spark, sf):
    rows = fx.slices(spark, sf).withColumn("source", F.expr("vol % 25"))
    return op.union_pool(rows, [s for s in range(25) if s % 3], ["vol"], ["orientation", "n"], strict=False).select("source", "vol", "orientation", "n", "position")


@query("spl_subset_targets", DUCK + """
, c as (select unnest([5, 0, 3, 61]) as vol, unnest([0, 1, 2, 3]) as task)
select vol, task, orientation, n from slices join c using (vol)""")
def spl_subset_targets(spark, sf):
    return op.subset_targets(fx.slices(spark, sf), [5, 0, 3, 61]).select("vol", "task", "orientation", "n")


@query("spl_subset_interleaved", DUCK + """
, c as (select unnest([5, 0, 3, 61]) as vol, unnest([0, 1, 2, 3]) as task)
select vol, task, orientation, n, row_number() over (order by task, n, orientation = 'yz') - 1 as position from slices join c using (vol) where orientation <> 'xy'""")
def spl_subset_interleaved(spark, sf):
    return op.subset_targets(fx.slices(spark, sf), [5, 0, 3, 61], ["xz", "yz"]).select("vol", "task", "orientation", "n", "position")


@query("smp_source_weights", DUCK + "select vol % 25 as source, vol, orientation, n, 1.0::double / count(*) over (partition by vol % 25) as weight from slices")
def smp_source_weights(spark, sf):
    return op.source_weights(fx.slices(spark, sf).withColumn("source", F.expr("vol % 25"))).select("source", "vol", "orientation", "n", "weight")


@query("smp_balanced_draw")
def smp_balanced_draw(spark, sf):
    rows = fx.slices(spark, sf).withColumn("source", F.expr("vol % 25"))
    return op.balanced_draw(rows, ["vol", "orientation", "n"], None, 11).select("draw", "source", "vol", "orientation", "n")


@query("smp_shuffle_batches")
def smp_shuffle_batches(spark, sf):
    return op.shuffle_batches(fx.slices(spark, sf), ["vol", "orientation", "n"], 5, 1, 16).select("batch", "slot", "vol", "orientation", "n")


@query("smp_round_robin_shard", DUCK + """
, p as (select vol, orientation, n, row_number() over (order by vol, orientation, n) - 1 as position from slices)
select vol, orientation, n, cast(position as bigint) as position from p where position % 3 = 1""")
def smp_round_robin_shard(spark, sf):
    rows = ranked(fx.slices(spark, sf), ["vol", "orientation", "n"], place="position")
    return op.shard(rows, "position", 1, 3).select("vol", "orientation", "n", "position")


@query("smp_retry_fallback")
def smp_retry_fallback(spark, sf):
    keys = ["vol", "orientation", "n"]
    rows = staged(every(spark, sf), "slices")
    # The fuller a slice, the likelier an attempt is valid; from 64 places on it always is.
    prompted = lambda attempts: attempts.join(rows, keys).filter((F.col("n_fg") > 0) & (uniform(7, *keys, "attempt") < F.col("n_fg") / 64))
    return op.retry_fallback(rows.select(*keys), prompted, keys, 3)


@query("bat_collate", """
with b as (select vec_id, vec_id // 16 as batch, embedding[1:1 + vec_id % 5] as points from embeddings),
m as (select batch, max(len(points)) as most from b group by batch)
select vec_id, batch, list_concat(points, list_transform(range(most - len(points)), lambda i: points[len(points)])) as points from b join m using (batch)""")
def bat_collate(spark, sf):
    rows = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "vec_id div 16 as batch", "slice(embedding, 1, cast(1 + vec_id % 5 as int)) as points")
    return op.collate(rows, ["points"]).select("vec_id", "batch", "points")


@query("bat_step_pad", """
with b as (select vec_id, list_transform(embedding[1:1 + vec_id % 5], lambda v: cast(v as double)) as maps from embeddings)
select vec_id, list_transform(range(1, 6), lambda i: coalesce(maps[i], 0)) as maps, list_transform(range(1, 6), lambda i: case when i <= len(maps) then 1 else 0 end) as valid from b""")
def bat_step_pad(spark, sf):
    rows = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "cast(slice(embedding, 1, cast(1 + vec_id % 5 as int)) as array<double>) as maps")
    value, valid = op.step_pad(F.col("maps"), 5)
    return rows.select("vec_id", value.alias("padded"), valid.alias("valid")).withColumnRenamed("padded", "maps")
