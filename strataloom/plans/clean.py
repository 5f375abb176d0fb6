"""Queries of projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import clean as op
from strataloom.operators import scores
from strataloom.registry import query
from strataloom.sources import fixture as fx
from strataloom.sources.fixture import DUCK

SHAPE = (fx.DEPTH, fx.HEIGHT, fx.WIDTH)


@query("prj_minmax", DUCK + """
, m as (select vol, z, min(raw) lo, max(raw) hi from dense group by all)
select vol, z, y, x, case when hi > lo then cast(raw - lo as double) / (hi - lo) else 0.0::double end as norm from dense join m using (vol, z)""")
def prj_minmax(spark, sf):
    return op.minmax(fx.dense(spark, sf), ["vol", "z"], "raw").select("vol", "z", "y", "x", "norm")


RAW = "case when vol % 9 <> 1 and (z * 7 + y * 5 + x * 3 + vol) % 41 = 0 then {nan} when vol % 9 <> 1 and (y + x) % 97 = 5 then {inf} when vol % 9 = 0 then 3e0 when vol % 9 = 1 then raw else raw * 1.5e0 end"


@query("prj_raw_uint8", DUCK + f"""
, r as (select vol, z, y, x, {RAW.format(nan="'nan'::double", inf="'inf'::double")} as v from dense),
m as (select vol, z, min(v) filter (isfinite(v)) lo, max(v) filter (isfinite(v)) hi from r group by all)
select vol, z, y, x, case when vol % 9 = 1 then cast(v as int) when hi > lo and isfinite(v) then cast(round_even((v - lo) / (hi - lo) * 255, 0) as int) else 0 end as byte from r join m using (vol, z)""")
def prj_raw_uint8(spark, sf):
    rows = fx.dense(spark, sf).withColumn("v", F.expr(RAW.format(nan="double('NaN')", inf="double('Infinity')")))
    return op.raw_uint8(rows, ["vol", "z"], "v", F.expr("vol % 9 = 1")).select("vol", "z", "y", "x", "byte")


RGB = DUCK + ", rgb as (select vol, z, y, x, label*37 % 256 r, label*91 % 256 g, label*151 % 256 b from dense)"


def rgb(spark, sf):
    return fx.dense(spark, sf).selectExpr("vol", "z", "y", "x", "label * 37 % 256 as r", "label * 91 % 256 as g", "label * 151 % 256 as b")


@query("prj_rgb_pack", RGB + "select vol, z, y, x, r * 65536 + g * 256 + b as packed from rgb")
def prj_rgb_pack(spark, sf):
    return rgb(spark, sf).select("vol", "z", "y", "x", op.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("packed"))


@query("prj_color_to_id", RGB + """
, p as (select vol, z, y, x, r * 65536 + g * 256 + b as packed from rgb),
f as (select vol, packed, min(z) mz from p where packed <> 0 group by all),
i as (select vol, packed, cast(row_number() over (partition by vol order by mz, packed) as int) as id from f)
select p.vol, p.z, p.y, p.x, coalesce(id, 0) as id from p left join i using (vol, packed)""")
def prj_color_to_id(spark, sf):
    return op.color_to_id(prj_rgb_pack(spark, sf)).select("vol", "z", "y", "x", "id")


@query("prj_binarize", DUCK + "select vol, z, y, x, case when label <> 0 then 1 else 0 end as fg, case when raw > 128 then 1 else 0 end as membrane from dense")
def prj_binarize(spark, sf):
    return fx.dense(spark, sf).selectExpr("vol", "z", "y", "x", "cast(label <> 0 as int) as fg", "cast(raw > 128 as int) as membrane")


@query("prj_drop_slices", DUCK + """
select vol, case when vol % 3 = 2 then z - (case when z > 2 then 1 else 0 end) - (case when z > 5 then 1 else 0 end) else z end as z, y, x, label
from voxels where not (vol % 3 = 2 and z in (2, 5))""")
def prj_drop_slices(spark, sf):
    return op.drop_slices(fx.voxels(spark, sf), [2, 5], F.col("vol") % 3 == 2)


@query("prj_border_crop", DUCK + "select vol, z - 2 as z, y - 2 as y, x - 2 as x, label from voxels where z between 2 and 5 and y between 2 and 29 and x between 2 and 29")
def prj_border_crop(spark, sf):
    return op.border_crop(fx.voxels(spark, sf), SHAPE, 2)


@query("prj_offset_align", DUCK + "select l.vol, l.z, l.y, l.x, l.label, d.raw from voxels l join dense d on d.vol = l.vol and d.z = l.z + 1 and d.y = l.y + 4 and d.x = l.x + 4")
def prj_offset_align(spark, sf):
    return op.offset_align(fx.voxels(spark, sf), fx.dense(spark, sf), (1, 4, 4))


@query("prj_common_shape", DUCK + """
select vol, z, y, x, label, raw from dense where y < 32 - vol % 3 and z < 8 - vol % 2""")
def prj_common_shape(spark, sf):
    dense = fx.dense(spark, sf)
    return op.common_shape(dense.filter("y < 32 - vol % 3").select(*op.PLACE, "label"), dense.filter("z < 8 - vol % 2").select(*op.PLACE, "raw"))


@query("prj_fg_bbox_crop", DUCK + """
, s as (select vol, z, y, x, case when vol % 5 = 4 or (vol % 5 <> 0 and (z < 3 or y < 10)) then 0 else label end as label from dense),
b as (select vol, min(z) az, max(z) bz, min(y) ay, max(y) by_, min(x) ax, max(x) bx from s where label > 0 group by vol),
c as (select s.*, coalesce(greatest(az - 1, 0), 0) lz, coalesce(least(bz + 1, 7), 7) hz, coalesce(greatest(ay - 1, 0), 0) ly, coalesce(least(by_ + 1, 31), 31) hy,
  coalesce(greatest(ax - 1, 0), 0) lx, coalesce(least(bx + 1, 31), 31) hx from s left join b using (vol))
select vol, z - lz as z, y - ly as y, x - lx as x, label from c where z between lz and hz and y between ly and hy and x between lx and hx""")
def prj_fg_bbox_crop(spark, sf):
    rows = fx.dense(spark, sf).withColumn("label", F.expr("case when vol % 5 = 4 or (vol % 5 <> 0 and (z < 3 or y < 10)) then 0 else label end"))
    return op.foreground_crop(rows.drop("raw"), SHAPE, 1)


@query("prj_label_range_check", DUCK + "select vol, max(label * 2500) as max_label, max(label * 2500) < 65536 as ok, max(label * 2500 % 65536) as max_wrapped from voxels group by vol")
def prj_label_range_check(spark, sf):
    rows = fx.voxels(spark, sf).withColumn("label", F.col("label") * 2500)
    narrow = rows.groupBy("vol").agg(F.max(op.wrapped(F.col("label"))).alias("max_wrapped"))
    return op.label_range(rows).join(narrow, "vol")


@query("prj_orientation_views", DUCK + """
select '2d' as kind, vol, 'xy' as orientation, z as n, y as row, x as col, label from voxels
union all select '2d', vol, 'xz', y, z, x, label from voxels union all select '2d', vol, 'yz', x, z, y, label from voxels
union all select '3d', vol, 'xy', z, y, x, label from voxels union all select '3d', vol, 'xz', y, z, x, label from voxels union all select '3d', vol, 'yz', y, x, z, label from voxels""")
def prj_orientation_views(spark, sf):
    rows = fx.voxels(spark, sf)
    flat = op.slice_views(rows).select(F.lit("2d").alias("kind"), "vol", "orientation", "n", "row", "col", "label")
    return flat.union(op.volume_views(rows).select(F.lit("3d").alias("kind"), "vol", "orientation", "d", "row", "col", "label"))


@query("prj_channel_permute", """
select vec_id, [embedding[2], embedding[3], embedding[1], embedding[5], embedding[6], embedding[4], embedding[9], embedding[7], embedding[8], embedding[10]] as lsd from embeddings""")
def prj_channel_permute(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", op.permute_channels(F.col("embedding"), (1, 2, 0)).alias("lsd"))


@query("prj_pad_multiple", """
select p_partkey, coalesce(cast((case when p_partkey % 7 <> 0 then p_size end + 15) // 16 * 16 as int), 0) as crop, cast((p_size + 1) // 2 * 2 as int) as even from part""")
def prj_pad_multiple(spark, sf):
    part = fx.table(spark, sf, "part")
    return part.select("p_partkey", op.padded_size(F.expr("case when p_partkey % 7 <> 0 then p_size end"), 16).alias("crop"), op.padded_size(F.col("p_size"), 2).alias("even"))


@query("prj_center_crop", DUCK + "select vol, z, y - 6 as y, x - 6 as x, label from voxels where y between 6 and 25 and x between 6 and 25")
def prj_center_crop(spark, sf):
    return op.center_crop(fx.voxels(spark, sf), (32, 32), 20)


PLANES = "(select distinct vol, z from grid) p"


@query("prj_pad_crop", DUCK + f"""
select p.vol, p.z, cast(a.i as int) as y, cast(b.i as int) as x, coalesce(v.label, 0) as label
from {PLANES} cross join range(36) a(i) cross join range(36) b(i) left join voxels v on v.vol = p.vol and v.z = p.z and v.y = a.i and v.x = b.i""")
def prj_pad_crop(spark, sf):
    """A crop that is larger than the plane: rows of zeros at the end."""
    planes = fx.grid(spark, sf).select("vol", "z").distinct()
    cropped = op.center_crop(fx.voxels(spark, sf), (32, 32), 36)
    return op.padded(cropped, planes, ["vol", "z"], {"y": 36, "x": 36}).select("vol", "z", "y", "x", "label")


@query("prj_pad_voxels", DUCK + """
select p.vol, cast(a.i as int) as z, cast(b.i as int) as y, cast(c.i as int) as x, coalesce(v.label, 0) as label
from (select distinct vol from seeds) p cross join range(9) a(i) cross join range(33) b(i) cross join range(33) c(i) left join voxels v on v.vol = p.vol and v.z = a.i and v.y = b.i and v.x = c.i""")
def prj_pad_voxels(spark, sf):
    """Volumes padded at the end to sides that 3 divides."""
    sides = {k: op.padded_size(F.col(f"n{k}"), 3) for k in "zyx"}
    volumes = fx.dealt(fx.volumes(spark, sf), spark, sf)
    return op.padded(fx.voxels(spark, sf), volumes, ["vol"], sides).select("vol", "z", "y", "x", "label")


@query("prj_random_crop")
def prj_random_crop(spark, sf):
    return op.random_crop(fx.voxels(spark, sf), (32, 32), 20, 1998, ["vol", "z"])


PLAN = "(vol + z) % 2 = 0 as flip_rows, (vol + z) % 3 = 0 as flip_cols, cast((vol + z) % 4 as int) as turns, (vol + z) % 5 = 0 as transpose"


@query("prj_dihedral", DUCK + f"""
, p as (select vol, z, label, case when flip_rows then 31 - y else y end as y, case when flip_cols then 31 - x else x end as x, turns, transpose from (select *, {PLAN} from voxels)),
t as (select vol, z, label, case turns when 1 then 31 - x when 2 then 31 - y when 3 then x else y end as y,
  case turns when 1 then y when 2 then 31 - x when 3 then 31 - y else x end as x, transpose from p)
select vol, z, label, case when transpose then x else y end as y, case when transpose then y else x end as x from t""")
def prj_dihedral(spark, sf):
    rows = fx.voxels(spark, sf).selectExpr("*", *(f"({a}) as {b}" for a, b in (p.rsplit(" as ", 1) for p in PLAN.split(", ") if " as int" not in p)), "cast((vol + z) % 4 as int) as turns")
    return op.dihedral(rows, 32).select("vol", "z", "y", "x", "label")


@query("prj_brightness", DUCK + "select vol, z, y, x, least(greatest(cast(raw as double) / 255 * (0.8e0 + vol % 5 * 0.1e0) + (z % 5 - 2) * 0.1e0, 0e0), 1e0) as bright from dense")
def prj_brightness(spark, sf):
    value = op.brightness(F.expr("cast(raw as double) / 255"), F.expr("0.8D + vol % 5 * 0.1D"), F.expr("(z % 5 - 2) * 0.1D"))
    return fx.dense(spark, sf).select("vol", "z", "y", "x", value.alias("bright"))


@query("prj_aug_plan")
def prj_aug_plan(spark, sf):
    samples = fx.slices(spark, sf).select("vol", "orientation", "n")
    return op.augmentation_plan(samples, (32, 32), 20, 7, True, ["vol", "orientation", "n"])


@query("prj_halo_bbox", DUCK + """
select vol, label, greatest(min(z) - 3, 0) as lo_z, greatest(min(y) - 3, 0) as lo_y, greatest(min(x) - 3, 0) as lo_x,
       least(max(z) + 4, 8) as hi_z, least(max(y) + 4, 32) as hi_y, least(max(x) + 4, 32) as hi_x from voxels group by vol, label""")
def prj_halo_bbox(spark, sf):
    return op.halo_box(scores.instance_boxes(fx.voxels(spark, sf)), SHAPE, 3)
