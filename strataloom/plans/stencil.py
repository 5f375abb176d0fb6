"""Queries of the neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import blocks
from strataloom.operators import stencil as op
from strataloom.registry import query
from strataloom.sources import fixture as fx
from strataloom.sources.fixture import DUCK
from strataloom.sources.stage import staged

SHAPE = (fx.DEPTH, fx.HEIGHT, fx.WIDTH)
TILE = (8, 16, 16)


def tiles(rows, spark, sf, tile=TILE):
    """The fixture's voxels ``rows`` as blocks with their labels."""
    return blocks.to_blocks(rows, fx.dealt(fx.volumes(spark, sf), spark, sf), tile, {"label": "int32"})


LEADS = DUCK + """
, n as (
  select vol, z, y, x, label, lead(label) over wy as dn, lead(label) over wx as rt, lead(label) over wz as bk, lag(label) over wy as up, lag(label) over wx as lf, lag(label) over wz as fr
  from dense window wy as (partition by vol, z, x order by y), wx as (partition by vol, z, y order by x), wz as (partition by vol, y, x order by z))
"""


@query("nbr_affinity_2d", LEADS + "select vol, z, y, x, case when dn <> label then 1 else 0 end as aff0, case when rt <> label then 1 else 0 end as aff1 from n")
def nbr_affinity_2d(spark, sf):
    found = blocks.affinity(tiles(fx.voxels(spark, sf), spark, sf), "yx")
    return blocks.from_blocks(found, {f"aff{i}": (f"aff[{i}]", "uint8", "int") for i in range(2)})


@query("nbr_affinity_3d", LEADS + """
select vol, z, y, x, case when label = 0 or dn <> label then 1 else 0 end as aff0, case when label = 0 or rt <> label then 1 else 0 end as aff1,
       case when label = 0 or bk <> label then 1 else 0 end as aff2 from n""")
def nbr_affinity_3d(spark, sf):
    found = blocks.affinity(tiles(fx.voxels(spark, sf), spark, sf), "yxz")
    return blocks.from_blocks(found, {f"aff{i}": (f"aff[{i}]", "uint8", "int") for i in range(3)})


@query("nbr_erode_once", LEADS + """
select vol, z, y, x, case when coalesce(dn, label) = label and coalesce(rt, label) = label and coalesce(bk, label) = label and coalesce(up, label) = label
  and coalesce(lf, label) = label and coalesce(fr, label) = label then label else 0 end as eroded,
  case when dn = label and rt = label and up = label and lf = label then label else 0 end as eroded_2d from n""")
def nbr_erode_once(spark, sf):
    found = blocks.erode(tiles(fx.voxels(spark, sf), spark, sf), "zyx", 1)
    found = blocks.erode(found, "yx", 0, "eroded_2d")
    return blocks.from_blocks(found, {c: (c, "int32", "int") for c in ("eroded", "eroded_2d")})


@query("nbr_erode_k", DUCK + """
, b as (select cast(a.i as int) - 2 dz, cast(b.i as int) - 2 dy, cast(c.i as int) - 2 dx from range(5) a(i), range(5) b(i), range(5) c(i)
  where abs(a.i - 2) + abs(b.i - 2) + abs(c.i - 2) between 1 and 2),
w as (select v.*, v.z + dz nz, v.y + dy ny, v.x + dx nx from voxels v, b where v.z + dz between 0 and 7 and v.y + dy between 0 and 31 and v.x + dx between 0 and 31)
select w.vol, w.z, w.y, w.x, w.label from w left join voxels o on o.vol = w.vol and o.z = nz and o.y = ny and o.x = nx and o.label = w.label
group by all having count(*) = count(o.label)""")
def nbr_erode_k(spark, sf):
    return op.erode_k(fx.voxels(spark, sf), 2, "zyx", SHAPE, 1).select("vol", "z", "y", "x", "label")


V3 = DUCK + """
, v as (select *, (z * 32 + y) * 32 + x as lin from merged),
hood as (select cast(a.i as int) - 1 dz, cast(b.i as int) - 1 dy, cast(c.i as int) - 1 dx from range(3) a(i), range(3) b(i), range(3) c(i) where not (a.i = 1 and b.i = 1 and c.i = 1)),
w as (select v.vol, v.lin, v.label, v.z + dz z, v.y + dy y, v.x + dx x from v, hood),
e as (select w.vol, w.lin s, v.lin t from w join v on w.vol = v.vol and w.label = v.label and w.z = v.z and w.y = v.y and w.x = v.x),
r(vol, root, lin) as (select vol, lin, lin from v union select r.vol, r.root, e.t from r join e on e.vol = r.vol and e.s = r.lin),
m as (select vol, lin, min(root) as root from r group by all)
"""


@query("nbr_connected_components", V3 + """
select v.vol, z, y, x, label, cast(dense_rank() over (partition by v.vol order by root) as int) as component from v join m using (vol, lin)""")
def nbr_connected_components(spark, sf):
    found = blocks.components(tiles(fx.merged(spark, sf), spark, sf), SHAPE)
    return blocks.from_blocks(found, {c: (c, "int32", "int") for c in ("label", "component")}, keep="component")


#: 4-connected components of slices; the table's name is to be filled in.
V2 = """
, v as (select vol, z, y, x, label, y * 32 + x as lin from {table}),
cross4 as (select unnest([-1, 1, 0, 0]) dy, unnest([0, 0, -1, 1]) dx),
w as (select v.vol, v.z, v.lin, v.label, v.y + dy y, v.x + dx x from v, cross4),
e as (select w.vol, w.z, w.lin s, v.lin t from w join v on w.vol = v.vol and w.z = v.z and w.label = v.label and w.y = v.y and w.x = v.x),
r(vol, z, root, lin) as (select vol, z, lin, lin from v union select r.vol, r.z, r.root, e.t from r join e on e.vol = r.vol and e.z = r.z and e.s = r.lin),
m as (select vol, z, lin, min(root) as root from r group by all),
cc as (select v.vol, v.z, y, x, label, cast(dense_rank() over (partition by v.vol, v.z order by root) as int) as component from v join m using (vol, z, lin))
"""


@query("nbr_cc_conn1", DUCK + V2.format(table="merged") + "select * from cc")
def nbr_cc_conn1(spark, sf):
    return op.slice_components(fx.merged(spark, sf))


@query("nbr_largest_cc", DUCK + V2.format(table="(select vol, z, y, x, 1 as label from merged where label % 2 = 1)") + """
, n as (select vol, z, component, count(*) n from cc group by all),
b as (select vol, z, component from n qualify row_number() over (partition by vol, z order by n desc, component) = 1)
select vol, z, y, x, component from cc join b using (vol, z, component)""")
def nbr_largest_cc(spark, sf):
    mask = fx.merged(spark, sf).filter("label % 2 = 1").withColumn("label", F.lit(1))
    largest = op.largest_component(staged(op.run_components(mask), "components"), ["vol", "z"], F.expr("x1 - x0 + 1"))
    return op.unfolded(largest, "component")


PAIRS = """
, near2 as (select cast(a.i as int) - 2 dy, cast(b.i as int) - 2 dx from range(5) a(i), range(5) b(i) where abs(a.i - 2) + abs(b.i - 2) between 1 and 2),
touch as (select distinct a.vol, a.z, a.label, b.label as other from (select v.vol, v.z, v.label, v.y + dy y, v.x + dx x from voxels v, near2) a
  join voxels b using (vol, z, y, x) where a.label <> b.label)
"""


@query("nbr_touching_pairs", DUCK + PAIRS + "select * from touch")
def nbr_touching_pairs(spark, sf):
    return op.touching_pairs(fx.voxels(spark, sf))


@query("nbr_binary_erode", DUCK + """
, near2 as (select cast(a.i as int) - 2 dy, cast(b.i as int) - 2 dx from range(5) a(i), range(5) b(i) where abs(a.i - 2) + abs(b.i - 2) between 1 and 2),
p as (select vol, z, y, x from pred where p > 0.15),
w as (select vol, z, y, x, y + dy ny, x + dx nx from p, near2)
select w.vol, w.z, w.y, w.x from w join p o on o.vol = w.vol and o.z = w.z and o.y = ny and o.x = nx group by all having count(*) = 12""")
def nbr_binary_erode(spark, sf):
    mask = fx.predictions(spark, sf).filter("p > 0.15").withColumn("label", F.lit(1))
    return op.erode_k(mask, 2, "yx", SHAPE, 0).select("vol", "z", "y", "x")


#: Squared distances: the least over the complement within the box grown by one.
EDT = """
, bx as (select vol, z, label, min(y) - 1 y0, max(y) + 1 y1, min(x) - 1 x0, max(x) + 1 x1 from voxels group by all),
rows_ as (select *, unnest(range(y0, y1 + 1)) as y from bx), frame as (select vol, z, label, y, unnest(range(x0, x1 + 1)) as x from rows_),
outside as (select * from frame anti join voxels using (vol, z, label, y, x)),
edt as (select v.vol, v.z, v.y, v.x, v.label, cast(min((v.y - o.y) * (v.y - o.y) + (v.x - o.x) * (v.x - o.x)) as bigint) as d2
  from voxels v join outside o using (vol, z, label) group by all)
"""


@query("nbr_edt", DUCK + EDT + "select * from edt")
def nbr_edt(spark, sf):
    return op.instance_edt(fx.voxels(spark, sf))


REACH = "vol, z, y, x, label, case when label > 0 then (label * 7 + x + 2 * y + z) % 11 / 10e0 else 0e0 end as soft, (label * 3 + x * 5 + y * 7 + z) % 21 / 10e0 - 1 as prompt, case when label > 0 then 1e0 else 0e0 end as interior"


#: Rounds of the positive and of the negative spread (the reference's own), and how many are done between two exchanges;
#: so wide a halo asks for wide tiles.
ROUNDS, NEGATIVE_ROUNDS, DEEP, WIDE_TILE = 64, 32, 32, (4, 32, 32)


def _rounds(first: str) -> str:
    """A table ``r`` for each round of both spreads, and those of the positive one alone after them; the first reads ``first``."""
    near = lambda c: f"greatest({c}, coalesce(lag({c}) over wx * lf, 0), coalesce(lead({c}) over wx * rt, 0), coalesce(lag({c}) over wy * up, 0), coalesce(lead({c}) over wy * dn, 0)) as {c}"
    out = ""
    for i in range(ROUNDS):
        both = ["good", "bad"] if i < NEGATIVE_ROUNDS else ["good"]
        out += f", r{i + 1} as (select * replace ({', '.join(map(near, both))}) from {first if not i else f'r{i}'} window wx as (partition by vol, z, y order by x), wy as (partition by vol, z, x order by y))"
    return out


@query("nbr_prompt_reach", DUCK + f"""
, q as (select {REACH} from dense),
s as (select *, case when lead(label) over wx = label then sqrt(soft * lead(soft) over wx) else 0e0 end as rt, case when lead(label) over wy = label then sqrt(soft * lead(soft) over wy) else 0e0 end as dn,
  greatest(least((prompt - 0.7e0) / 0.3e0, 1e0), 0e0) as good, greatest(least((-prompt - 0.2e0) / 0.8e0, 1e0), 0e0) as bad
  from q window wx as (partition by vol, z, y order by x), wy as (partition by vol, z, x order by y)),
w as (select *, lag(rt) over wx as lf, lag(dn) over wy as up from s window wx as (partition by vol, z, y order by x), wy as (partition by vol, z, x order by y))
""" + _rounds("w") + f"""
select vol, z, y, x, round(least(greatest(good - 0.85e0 * bad, 0e0), 1e0) * interior, 6) + 0e0 as prior from r{ROUNDS}""")
def nbr_prompt_reach(spark, sf):
    rows = fx.dense(spark, sf).selectExpr(*_split(REACH.replace("e0", "D").replace("(label * 7 + x + 2 * y + z) % 11 / 10D", "((label * 7 + x + 2 * y + z) % 11) / 10D").replace("(label * 3 + x * 5 + y * 7 + z) % 21 / 10D", "((label * 3 + x * 5 + y * 7 + z) % 21) / 10D")))
    kinds = {"label": "int32", "soft": "float64", "prompt": "float64", "interior": "float64"}
    found = blocks.prompt_reach(blocks.to_blocks(rows, fx.dealt(fx.volumes(spark, sf), spark, sf), WIDE_TILE, kinds), ROUNDS, NEGATIVE_ROUNDS, DEEP)
    return blocks.from_blocks(found, {"prior": ("prior", "float64", "double")}).withColumn("prior", F.round("prior", 6) + 0.0)


def _split(columns: str) -> list[str]:
    return columns.split(", ")
