"""Queries of the prompt operators; seeded ones are held by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import episodes, scores, stencil
from strataloom.operators import prompts as op
from strataloom.plans.stencil import EDT
from strataloom.registry import query
from strataloom.sources import fixture as fx
from strataloom.sources.fixture import DUCK
from strataloom.sources.stage import staged_rows as staged

SEED = 1998
MOST = DUCK + EDT + ", most as (select vol, z, label, max(d2) as most from edt group by all)"
BAND = MOST + ", cand as (select vol, z, label, y, x, d2 from edt join most using (vol, z, label) where d2 >= greatest(1, most * (0.2::double * 0.2)))"


@query("rng_stable_seed")
def rng_stable_seed(spark, sf):
    return op.stable_seeds(fx.slices(spark, sf).select("vol", "orientation", "n"), SEED, ["vol", "orientation", "n"])


@query("prm_interior_strict", MOST + "select vol, z, label, y, x, d2 from edt join most using (vol, z, label) where d2 > most * (0.2::double * 0.2)")
def prm_interior_strict(spark, sf):
    return op.interior(stencil.instance_edt(fx.voxels(spark, sf)), 0.2, True)


@query("prm_interior_band", BAND + "select * from cand")
def prm_interior_band(spark, sf):
    return op.interior(stencil.instance_edt(fx.voxels(spark, sf)), 0.2, False)


@query("prm_grid_points", MOST + """
, cand as (select vol, z, label, y, x from edt join most using (vol, z, label) where d2 > most * 0.25::double),
box as (select vol, z, label, min(y) ly, max(y) hy, min(x) lx, max(x) hx from voxels group by all),
c as (select * from cand join box using (vol, z, label)),
g as (select vol, z, label, y, x from c where (y - ly) % 3 = 0 and (x - lx) % 3 = 0),
o as (select c.* from c anti join g using (vol, z, label)
  qualify row_number() over (partition by vol, z, label order by (2*y - ly - hy) * (2*y - ly - hy) + (2*x - lx - hx) * (2*x - lx - hx), y, x) = 1)
select * from g union all select vol, z, label, y, x from o""")
def prm_grid_points(spark, sf):
    rows = fx.voxels(spark, sf)
    return op.grid_points(op.interior(stencil.instance_edt(rows), 0.5, True), rows, 3)


def _center(mean_of: str) -> str:
    return MOST + f"""
, deep as (select vol, z, label, y, x from edt join most using (vol, z, label) where d2 = most),
mean as (select vol, z, label, count(*) n, sum(y) sy, sum(x) sx from {mean_of} group by all),
d as (select *, (n * y - sy) * (n * y - sy) + (n * x - sx) * (n * x - sx) as off from deep join mean using (vol, z, label))
select vol, z, label, y, x from d qualify row_number() over (partition by vol, z, label order by off, y, x) = 1"""


@query("prm_component_center", _center("edt"))
def prm_component_center(spark, sf):
    return op.component_center(stencil.instance_edt(fx.voxels(spark, sf)), export=True)


@query("prm_component_center_train", _center("deep"))
def prm_component_center_train(spark, sf):
    return op.component_center(stencil.instance_edt(fx.voxels(spark, sf)), export=False)


def exported(spark, sf):
    """Points and saved labels of the export; a slice's name is its source and layer."""
    source, layer = F.expr("cast(vol % 25 as string)"), F.expr("lpad(cast(vol * 8 + z as string), 6, '0')")
    return episodes.export_points(fx.merged(spark, sf), SEED, 0.2, 3, (32, 32), source, layer)


@query("prm_export_points")
def prm_export_points(spark, sf):
    return exported(spark, sf)[0]


@query("prm_target_points")
def prm_target_points(spark, sf):
    return episodes.target_points(fx.voxels(spark, sf), SEED)


@query("prm_no_prompt", DUCK + "select vol, z, y, x, 1.0::double as prompt, case when label <> 0 then 1 else 0 end as mask from dense")
def prm_no_prompt(spark, sf):
    return op.no_prompt(fx.dense(spark, sf))


def slabs(spark, sf):
    starts = F.explode(F.sequence(F.greatest(F.col("z") - 3, F.lit(0)), F.least(F.col("z"), F.lit(4))))
    return fx.voxels(spark, sf).withColumn("z0", starts)


@query("prm_random_mix")
def prm_random_mix(spark, sf):
    rows, slices = fx.voxels(spark, sf), fx.grid(spark, sf).select("vol", "z").distinct()
    forms = [op.random_mix(rows, SEED, slices, sam).withColumn("sam", F.lit(sam)) for sam in (False, True)]
    return forms[0].unionByName(forms[1])


@query("prm_random_mix_mask")
def prm_random_mix_mask(spark, sf):
    rows = fx.voxels(spark, sf)
    return op.prompt_mask(rows, op.random_mix(rows, SEED), ["vol", "z"])


@query("prm_mask_3d")
def prm_mask_3d(spark, sf):
    return op.mask_3d(slabs(spark, sf), SEED)


@query("prm_mask_3d_voxels")
def prm_mask_3d_voxels(spark, sf):
    rows = slabs(spark, sf)
    return op.prompt_mask(rows, op.mask_3d(rows, SEED), ["vol", "z0"])


@query("prm_point_map", """
with e as (select user_id % 200 as sample, cast(event_id % 17 as int) as x, cast(event_id % 13 as int) as y, event_id as n, case when user_id % 200 < 50 then 0 else cast(event_id % 3 > 0 as int) end as polarity from events),
p as (select * from e qualify row_number() over (partition by sample, x, y order by n) = 1),
g as (select sample, cast(a.i as int) as y, cast(b.i as int) as x, sum(exp(-(power(b.i - x, 2) + power(a.i - y, 2)) / 60) * (2 * polarity - 1)) as v, max(polarity) as m from p, range(13) a(i), range(17) b(i) group by all),
s as (select distinct o_orderkey % 220 as sample from orders where o_orderkey % 220 not in (select sample from p))
select sample, y, x, round(case when m = 0 then 2 * v + 1 else v end, 5) + 0e0 as prompt from g
union all select sample, cast(a.i as int), cast(b.i as int), case when sample % 2 = 0 then 0e0 else 1e0 end from s, range(13) a(i), range(17) b(i)""")
def prm_point_map(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("user_id % 200 as sample", "cast(event_id % 17 as int) as x", "cast(event_id % 13 as int) as y", "event_id as n", "case when user_id % 200 < 50 then 0 else cast(event_id % 3 > 0 as int) end as polarity")
    samples = fx.table(spark, sf, "orders").selectExpr("o_orderkey % 220 as sample").distinct().selectExpr("sample", "sample % 2 = 0 as prompted")
    found = op.point_map(scores.first_points(rows, ["sample"]), ["sample"], 13, 17, 30.0, samples)
    return found.withColumn("prompt", F.round("prompt", 5) + 0.0)


@query("prm_fps", BAND + """
, c as materialized (select *, row_number() over (partition by vol, z, label order by y, x) as i, 1 + sqrt(cast(d2 as double)) + 0.001::double as far from cand),
p0 as materialized (select vol, z, label, y, x, i, 0 as rank from c where i = 1),
s1 as materialized (select c.*, (c.y - p.y) * (c.y - p.y) + (c.x - p.x) * (c.x - p.x) as gap from c join p0 p using (vol, z, label)),
p1 as materialized (select vol, z, label, y, x, i, 1 as rank from s1 where i <> 1 qualify row_number() over (partition by vol, z, label order by gap / far desc, i) = 1),
s2 as materialized (select s.*, least(s.gap, (s.y - p.y) * (s.y - p.y) + (s.x - p.x) * (s.x - p.x)) as gap2, p.i as i1 from s1 s join p1 p using (vol, z, label)),
p2 as (select vol, z, label, y, x, i, 2 as rank from s2 where i <> 1 and i <> i1 qualify row_number() over (partition by vol, z, label order by gap2 / far desc, i) = 1)
select vol, z, label, rank, y, x from (select * from p0 union all select * from p1 union all select * from p2)""")
def prm_fps(spark, sf):
    return op.farthest(stencil.instance_edt(fx.voxels(spark, sf)), 0.2, 3)


@query("prm_initial")
def prm_initial(spark, sf):
    return episodes.initial(episodes.by_volume(staged(fx.voxels(spark, sf), "voxels"))[0], SEED)


@query("prm_simulate_pred")
def prm_simulate_pred(spark, sf):
    rows = fx.voxels(spark, sf)
    return op.simulated(rows, op.simulated_places(rows, stencil.touching_pairs(rows), SEED))


@query("prm_simulate_pred_mask")
def prm_simulate_pred_mask(spark, sf):
    return episodes.spoiled(staged(fx.voxels(spark, sf), "voxels"), SEED)[2]


@query("prm_correction")
def prm_correction(spark, sf):
    rows, _, pred = episodes.spoiled(staged(fx.voxels(spark, sf), "voxels"), SEED + 100)
    return episodes.corrections(rows, pred, None, SEED)


@query("prm_episode")
def prm_episode(spark, sf):
    return episodes.episode(staged(fx.voxels(spark, sf), "voxels"), SEED)


@query("prm_episode_map")
def prm_episode_map(spark, sf):
    """The prompt map of every instance's replayed rounds, over the places of its slice's foreground."""
    rows = staged(fx.voxels(spark, sf), "voxels")
    points = episodes.replayed(episodes.episode(rows, SEED))
    maps = op.point_map(scores.first_points(points, op.INSTANCE), op.INSTANCE, fx.HEIGHT, fx.WIDTH, 30.0)
    inside = rows.select("vol", "z", "y", "x", "label").withColumn("mask", F.lit(1))
    return maps.join(inside, ["vol", "z", "y", "x", "label"]).withColumn("prompt", F.round("prompt", 6))


@query("prm_one_click", BAND + "select vol, z, label, y, x from cand qualify row_number() over (partition by vol, z, label order by d2 desc, y, x) = 1")
def prm_one_click(spark, sf):
    return op.one_click(stencil.instance_edt(fx.voxels(spark, sf)), 0.2)


@query("prm_one_click_apart", BAND + """
, f as (select vol, z, label, y as fy, x as fx from voxels qualify row_number() over (partition by vol, z, label order by y, x) = 1),
d as (select cand.*, (y - fy) * (y - fy) + (x - fx) * (x - fx) >= 9 as far from cand join f using (vol, z, label))
select vol, z, label, y, x from d where far qualify row_number() over (partition by vol, z, label order by d2 desc, y, x) = 1""")
def prm_one_click_apart(spark, sf):
    rows = fx.voxels(spark, sf)
    taken = rows.groupBy("vol", "z", "label").agg(F.min(F.struct("y", "x")).alias("p")).select("vol", "z", "label", "p.y", "p.x")
    return op.one_click(stencil.instance_edt(rows), 0.2, taken=taken, apart=3.0)


@query("prm_one_click_biased")
def prm_one_click_biased(spark, sf):
    return op.one_click(stencil.instance_edt(fx.voxels(spark, sf)), 0.2, SEED, 0.75)


@query("prm_next_click")
def prm_next_click(spark, sf):
    rows, _, pred = episodes.spoiled(staged(fx.voxels(spark, sf), "voxels"), SEED + 100)
    return episodes.next_click(rows, pred, None, SEED)[0]


@query("prm_episode_plus")
def prm_episode_plus(spark, sf):
    return episodes.episode_plus(staged(fx.voxels(spark, sf), "voxels"), SEED)[0]


@query("prm_episode_plus_state")
def prm_episode_plus_state(spark, sf):
    """What is left of the predictions after the last click: places of every instance."""
    return episodes.episode_plus(staged(fx.voxels(spark, sf), "voxels"), SEED)[1]


def slice_boxes(rows):
    return rows.groupBy("vol", "z", "label").agg(*(F.min(k).alias(f"lo_{k}") for k in "yx"), *((F.max(k) + 1).alias(f"hi_{k}") for k in "yx"))


@query("prm_instance_crop")
def prm_instance_crop(spark, sf):
    rows = fx.voxels(spark, sf)
    boxes = slice_boxes(rows)
    return op.instance_crops(boxes, stencil.touching_pairs(rows), 20, (32, 32), SEED, halo=2, jitter=3)


@query("prm_instance_crop_one")
def prm_instance_crop_one(spark, sf):
    rows = fx.voxels(spark, sf)
    boxes = slice_boxes(rows)
    crops = op.instance_crops(boxes, stencil.touching_pairs(rows), 20, (32, 32), SEED, halo=2, jitter=3, chosen=op.one_instance(boxes, SEED))
    found = op.slice_crops(fx.grid(spark, sf).select("vol", "z").distinct(), crops, 20, (32, 32))
    return op.surviving(found, rows, 20)
