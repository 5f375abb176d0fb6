"""Queries of local shape descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import blocks, clean, descriptors
from strataloom.plans.stencil import tiles
from strataloom.registry import query
from strataloom.sources import fixture as fx
from strataloom.sources.fixture import DUCK

SHAPE = (fx.DEPTH, fx.HEIGHT, fx.WIDTH)


def lsd_sql(rows: str, axes: str, keys: str, step: int) -> str:
    """Direct Gaussian sums over the sampled mask of each instance."""
    sigma = 5 / step
    radius = int(3 * sigma + 0.5)
    k = f"k as (select cast(i as int) - {radius} as d, exp(-0.5 * power((i - {radius}) / {sigma}::double, 2)) as g from range({2 * radius + 1}) t(i)), kn as (select d, g / sum(g) over () as g from k)"
    at = lambda a: f"({a} - o{a}) // {step}"
    weight = " * ".join(f"k{a}.g" for a in axes)
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    sums = ["sum(w) as m"] + [f"sum(w * {a}s * {step}) as s{a}" for a in axes] + [f"sum(w * {a}s * {b}s * {step * step}) as s{a}{b}" for a, b in [(a, a) for a in axes] + pairs]
    var = lambda a: f"greatest(coalesce(s{a}{a}, 0) / mm - u{a} * u{a}, 0.001)"
    clip = lambda e: f"round(least(greatest({e}, 0), 1), 5) + 0e0"
    channels = [clip(f"(u{a} - {a}t * {step}) / 5 * 0.5 + 0.5") for a in axes] + [clip(f"{var(a)} / 25") for a in axes]
    channels += [clip(f"(coalesce(s{a}{b}, 0) / mm - u{a} * u{b}) / sqrt({var(a)} * {var(b)}) * 0.5 + 0.5") for a, b in pairs] + [clip("mm")]
    origin = ", ".join(f"greatest(min({a}) - 15, 0) as o{a}" for a in axes)
    return f""", {k}, base as materialized (select * from {rows}),
org as (select {keys}, {origin} from base group by {keys}),
place as materialized (select base.*, {', '.join(f'{at(a)} as {a}t' for a in axes)}, {' and '.join(f'({a} - o{a}) % {step} = 0' for a in axes)} as on_grid from base join org using ({keys})),
tgt as (select distinct {keys}, {', '.join(f'{a}t' for a in axes)} from place),
src as (select {keys}, {', '.join(f'{a}t as {a}s' for a in axes)} from place where on_grid),
pairs_ as (select {', '.join(f't.{c.strip()}' for c in keys.split(','))}, {', '.join(f't.{a}t, s.{a}s' for a in axes)}, {weight} as w
  from tgt t join src s using ({keys}) {' '.join(f'join kn k{a} on k{a}.d = s.{a}s - t.{a}t' for a in axes)}),
mom as materialized (select {keys}, {', '.join(f'{a}t' for a in axes)}, {', '.join(sums)} from pairs_ group by all),
fin as (select tgt.*, coalesce(nullif(m, 0), 1) as mm, {', '.join(f'coalesce(s{a} / m, 0) as u{a}' for a in axes)}, * exclude ({keys}, m, {', '.join(f'{a}t, s{a}' for a in axes)}) from tgt left join mom using ({keys}, {', '.join(f'{a}t' for a in axes)}))
select vol, z, y, x, label, [{', '.join(channels)}] as lsd from place join fin using ({keys}, {', '.join(f'{a}t' for a in axes)})"""


def rounded(frame):
    return frame.withColumn("lsd", F.transform("lsd", lambda v: F.round(v, 5) + F.lit(0.0)))


@query("lsd_instance_3d", DUCK + lsd_sql("voxels", "yxz", "vol, label", 2))
def lsd_instance_3d(spark, sf):
    return rounded(descriptors.volume_3d(fx.voxels(spark, sf), SHAPE, (8, 16, 16)))


LEADS = """
, n as (select *, lead(label) over wy as dn, lead(label) over wx as rt, lead(label) over wz as bk, lag(label) over wy as up, lag(label) over wx as lf, lag(label) over wz as fr
  from dense window wy as (partition by vol, z, x order by y), wx as (partition by vol, z, y order by x), wz as (partition by vol, y, x order by z)),
eroded as (select vol, z, y, x, label from n where label > 0 and coalesce(dn, label) = label and coalesce(rt, label) = label and coalesce(bk, label) = label
  and coalesce(up, label) = label and coalesce(lf, label) = label and coalesce(fr, label) = label)
"""


@query("lsd_volume_3d", DUCK + LEADS + lsd_sql("eroded", "yxz", "vol, label", 2))
def lsd_volume_3d(spark, sf):
    thin = blocks.erode(tiles(fx.voxels(spark, sf), spark, sf), "zyx", 1)
    eroded = blocks.from_blocks(thin, {"label": ("eroded", "int32", "int")}, keep="label")
    return rounded(descriptors.volume_3d(eroded, SHAPE, (8, 16, 16)))


@query("lsd_slice_2d", DUCK + lsd_sql("voxels", "yx", "vol, z, label", 1))
def lsd_slice_2d(spark, sf):
    return rounded(descriptors.slice_2d(fx.voxels(spark, sf), (32, 32)))


def coded(spark, sf):
    """Voxels with a made cache of ten whole numbers."""
    return fx.voxels(spark, sf).withColumn("lsd", F.expr("transform(sequence(0, 9), k -> cast((label * 7 + z * k + y + x * 3) % 11 as int))"))


CODED = DUCK + ", coded as (select *, list_transform(range(10), lambda k: cast((label * 7 + z * k + y + x * 3) % 11 as int)) as lsd from voxels)"


@query("lsd_slice_from_3d", CODED + """
select vol, 'xy' as orientation, z as n, y as row, x as col, [lsd[1], lsd[2], lsd[4], lsd[5], lsd[7], lsd[10]] as lsd from coded
union all select vol, 'xz', y, z, x, [lsd[3], lsd[2], lsd[6], lsd[5], lsd[9], lsd[10]] from coded
union all select vol, 'yz', x, z, y, [lsd[3], lsd[1], lsd[6], lsd[4], lsd[8], lsd[10]] from coded""")
def lsd_slice_from_3d(spark, sf):
    views = clean.slice_views(coded(spark, sf).drop("label"))
    return views.withColumn("lsd", descriptors.slice_channels(F.col("orientation"), F.col("lsd")))
