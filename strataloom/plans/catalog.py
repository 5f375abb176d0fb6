"""Queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import arrays, blocks, chunks
from strataloom.operators import catalog as op
from strataloom.plans.prompts import exported
from strataloom.registry import query
from strataloom.sources import fixture as fx
from strataloom.sources.fixture import DUCK
from strataloom.sources.stage import new_path, staged


def volumes(spark, sf):
    return fx.table(spark, sf, "part").selectExpr("cast(p_partkey div 32 as int) as vol").distinct().selectExpr("vol", "vol % 25 as source")


def listing(spark, sf):
    keys = fx.table(spark, sf, "supplier").select("s_suppkey")
    image = keys.selectExpr("concat('em/im_', s_suppkey, '_pad.h5') as path")
    return image.unionByName(keys.filter("s_suppkey % 7 <> 0").selectExpr("concat('em/seg_', s_suppkey, '_pad.h5') as path"))


@query("src_catalog", DUCK + """
, v as (select distinct vol, vol % 25 as source from seeds),
o as (select *, cast(row_number() over (partition by source order by vol) - 1 as int) as ord from v)
select species, source, vol, ord from o join sources using (source) where source <> 3 or ord in (0, 2)""")
def src_catalog(spark, sf):
    return op.catalog(volumes(spark, sf), fx.sources(spark, sf), 3, [0, 2])


@query("src_ordered_keys", """
with have as (select 'vol_' || s_suppkey as key from supplier where s_suppkey % 2 = 0),
want as (select 24 - n_nationkey as ord, 'vol_' || (n_nationkey * 3) as key from nation)
select ord, key from want where key in (select key from have)""")
def src_ordered_keys(spark, sf):
    paths = fx.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").selectExpr("concat('/data/vol_', s_suppkey, '.zarr') as path")
    want = fx.table(spark, sf, "nation").selectExpr("24 - n_nationkey as ord", "concat('vol_', n_nationkey * 3) as key")
    return op.ordered_keys(paths, want)


@query("src_paired_keys", "select cast(s_suppkey as bigint) as key from supplier where s_suppkey % 7 <> 0")
def src_paired_keys(spark, sf):
    return op.paired_keys(listing(spark, sf))


@query("src_slice_file_match", """
with f as (
  select s_suppkey as n, case when s_suppkey % 3 = 0 then lpad(cast(s_suppkey as varchar), cast(greatest(2, length(cast(s_suppkey as varchar))) as int), '0') else cast(s_suppkey as varchar) end || '.png' as name, 0 as r
  from supplier where s_suppkey % 11 <> 0 and s_suppkey % 3 < 2
  union all select s_suppkey, lpad(cast(s_suppkey as varchar), 8, '0') || '.png', 2 from supplier where s_suppkey % 11 <> 0 and (s_suppkey % 3 = 2 or s_suppkey % 5 = 0)),
b as (select n, min_by(name, r) as name from f group by n)
select s_suppkey as n, name from supplier left join b on n = s_suppkey""")
def src_slice_file_match(spark, sf):
    keys = fx.table(spark, sf, "supplier").selectExpr("s_suppkey as n", "cast(s_suppkey as string) as k").filter("n % 11 <> 0")
    short = keys.filter("n % 3 < 2").selectExpr("concat(case when n % 3 = 0 and length(k) < 2 then lpad(k, 2, '0') else k end, '.png') as name")
    long = keys.filter("n % 3 = 2 or n % 5 = 0").selectExpr("concat(lpad(k, 8, '0'), '.png') as name")
    return op.slice_file_match(fx.table(spark, sf, "supplier").selectExpr("s_suppkey as n"), short.unionByName(long), strict=False)


@query("src_inverted_z_join", DUCK + """
, l as (select vol, z + 1 as number, count(*) as n_fg from voxels group by all)
select g.vol, g.z, g.z + 1 as image_name, 8 - g.z as number, n_fg
from (select distinct vol, z from grid) g left join l on l.vol = g.vol and l.number = 8 - g.z""")
def src_inverted_z_join(spark, sf):
    labels = fx.voxels(spark, sf).groupBy("vol", (F.col("z") + 1).alias("number")).agg(F.count("*").alias("n_fg"))
    return op.inverted_z_join(fx.grid(spark, sf).select("vol", "z").distinct(), labels, 8, 1, strict=False)


@query("src_pick_largest_3d", """
with a as (
  select p_partkey // 8 as container, cast(p_partkey % 8 as int) as place, p_name as key, p_size % 5 as a, p_size as b, p_partkey % 9 as c, p_partkey % 4 as k from part),
o as (select *, cast(a as bigint) * b * c as elements from a where k <> 0 and a > 0 and b > 0 and c > 0)
select container, key, elements from o qualify row_number() over (partition by container order by elements desc, place) = 1""")
def src_pick_largest_3d(spark, sf):
    arrays = fx.table(spark, sf, "part").selectExpr(
        "p_partkey div 8 as container", "cast(p_partkey % 8 as int) as place", "p_name as key",
        "case when p_partkey % 4 = 0 then array(p_size) else array(p_size % 5, p_size, cast(p_partkey % 9 as int)) end as shape",
    )
    return op.largest_3d(arrays)


@query("src_npy_blocks", DUCK + """
select vol, case when vol % 5 <> 4 then 4 else 0 end as dims, case when vol % 5 <> 4 then count(*) else 0 end as elements,
  case when vol % 5 <> 4 then cast(sum(label) as bigint) else 0 end as total, vol % 5 = 4 as failed from dense group by vol""")
def src_npy_blocks(spark, sf):
    files = arrays.files(fx.dense(spark, sf), fx.volumes(spark, sf), F.col("label"))
    # Every fifth file is cut off.
    files = files.withColumn("content", F.expr("if(vol % 5 = 4, substring(content, 1, 1000), content)"))
    found = arrays.blocks(files, "vol").groupBy("vol", "failed").agg(F.max(F.when(~F.col("failed"), F.size("shape"))).alias("dims"), F.sum(F.expr("cardinality(data)")).cast("long").alias("elements"), F.sum(F.expr("aggregate(data, 0D, (a, v) -> a + v)")).cast("long").alias("total"))
    return found.select("vol", "dims", "elements", "total", "failed").fillna(0)


@query("sink_rechunk", DUCK + """
, c as (select *, list_transform(range(10), lambda k: cast((label * 7 + z * k + y + x * 3) % 11 as double)) as lsd from voxels)
select vol, z, y, x, 0 as bc, lsd as "values" from c where list_max(lsd) > 0
union all select vol, z, y, x, 1, [cast(label as double)] from c""")
def sink_rechunk(spark, sf):
    names = [f"c{k}" for k in range(10)]
    rows = fx.voxels(spark, sf).select("*", *(F.expr(f"cast((label * 7 + z * {k} + y + x * 3) % 11 as float)").alias(c) for k, c in enumerate(names)))
    tile = op.capped((3, 12, 12), (8, 32, 32))
    held = blocks.to_blocks(rows, fx.dealt(fx.volumes(spark, sf), spark, sf), tile, dict.fromkeys([*names, "label"], "float32")).withColumn("source", F.expr("vol % 25"))
    path = new_path(spark, "chunks")
    chunks.write(chunks.chunked(held, [*names, "label"], "float32"), path)
    return chunks.voxels(spark.read.parquet(path), "float32")


@query("sink_cache_name", """
with f as (select n_name as source, 'a/' || replace(s_name, '#', '.') || case s_suppkey % 4 when 0 then '.zarr' when 1 then '.h5' when 2 then '.hdf5' else '' end as path, s_suppkey
  from supplier join nation on n_nationkey = s_nationkey)
select s_suppkey, source || '__' || replace(regexp_replace(path, '\\.(zarr|hdf5|h5|hdf|npy|tiff|tif)$', ''), '/', '_') || '__xy.zarr' as name,
       source || '__' || replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '__') as slice_name from f""")
def sink_cache_name(spark, sf):
    files = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    files = files.withColumn("path", F.expr("concat('a/', replace(s_name, '#', '.'), case s_suppkey % 4 when 0 then '.zarr' when 1 then '.h5' when 2 then '.hdf5' else '' end)"))
    return files.select("s_suppkey", op.cache_name(F.col("n_name"), F.col("path"), F.lit("xy")).alias("name"), op.slice_cache_name(F.col("n_name"), F.col("path")).alias("slice_name"))


@query("sink_skip_existing", """
with have as (select l_orderkey as item, count(distinct l_linenumber % 4) as k from lineitem group by 1)
select o_orderkey as item, skip, overwrite, case when coalesce(k, 0) < 4 then 'write' when skip then 'skip' when overwrite then 'write' else 'fail' end as status
from orders cross join (values (true), (false)) s(skip) cross join (values (true), (false)) o(overwrite) left join have on item = o_orderkey""")
def sink_skip_existing(spark, sf):
    modes = "explode(array(true, false)) as"
    items = fx.table(spark, sf, "orders").selectExpr("o_orderkey as item", f"{modes} skip").selectExpr("*", f"{modes} overwrite")
    return op.resume_status(items, fx.table(spark, sf, "lineitem").selectExpr("l_orderkey as item", "l_linenumber % 4 as kind"), 4, F.col("skip"), F.col("overwrite"))


@query("sink_prompt_tables", DUCK + """
, n as (select vol % 25 as source, lpad(cast(vol * 8 + z as varchar), 6, '0') as layer, label as label_id, y, x from voxels),
b as (select source, layer, label_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from n group by all),
p as (select source, layer, label_id, x, y from n qualify row_number() over (partition by source, layer, label_id order by y, x) = 1)
select 'box' as kind, source, layer, label_id, -1 as point_id, x0, y0, x1, y1 from b
union all select 'point', source, layer, label_id, 0, x, y, -1, -1 from p
union all select 'slice', source, layer, cast(count(distinct label_id) as int), -1, -1, -1, 32, 32 from n group by source, layer""")
def sink_prompt_tables(spark, sf):
    # Instances of a volume first: they are names' rows then, not voxels, that are dealt by name.
    ends = {"x0": F.min("x"), "y0": F.min("y"), "x1": F.max("x"), "y1": F.max("y"), "p": F.min(F.struct("y", "x"))}
    own = fx.voxels(spark, sf).groupBy("vol", "z", "label").agg(*(v.alias(k) for k, v in ends.items()))
    named = staged(own.selectExpr("vol % 25 as source", "lpad(cast(vol * 8 + z as string), 6, '0') as layer", "label as label_id", *ends), "instances")
    each = named.groupBy("source", "layer", "label_id")
    tables = {
        "box": each.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")),
        "point": each.agg(F.min("p").alias("p")).selectExpr("source", "layer", "label_id", "0 as point_id", "p.x as x", "p.y as y"),
        "slice": named.groupBy("source", "layer").agg(F.count_distinct("label_id").alias("instance_count")).selectExpr("source", "layer", "32 as width", "32 as height", "instance_count"),
    }
    path = new_path(spark, "prompts")
    op.write_prompts(path, tables)
    back = lambda name, columns: spark.read.schema(f"layer string, {columns}, source int").csv(f"{path}/{name}", header=True).withColumn("kind", F.lit(name))
    boxes = back("box", "label_id int, x0 int, y0 int, x1 int, y1 int")
    points = back("point", "label_id int, point_id int, x0 int, y0 int")
    slices = back("slice", "x1 int, y1 int, label_id int")
    # Columns that a table lacks are -1.
    return boxes.unionByName(points, True).unionByName(slices, True).fillna(-1).select("kind", "source", "layer", "label_id", "point_id", "x0", "y0", "x1", "y1")


@query("sink_prompt_export")
def sink_prompt_export(spark, sf):
    """The whole export written and reread: points, boxes, label slices (as runs of rows) and the list of slices; a row for each."""
    points, saved = exported(spark, sf)
    named = lambda rows: rows.withColumn("source", F.expr("vol % 25")).withColumn("layer", F.expr("lpad(cast(vol * 8 + z as string), 6, '0')")).drop("vol", "z")
    saved = named(saved)
    each = saved.groupBy("source", "layer")
    tables = {
        "point": named(points),
        "box": saved.groupBy("source", "layer", "label_id").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")),
        "label": saved,
        "slice": each.agg(F.count_distinct("label_id").alias("instance_count")),
    }
    kinds = {"point": "label_id int, point_id int, x int, y int", "box": "label_id int, x0 int, y0 int, x1 int, y1 int", "label": "y int, x0 int, x1 int, label_id int", "slice": "instance_count int"}
    path, found = new_path(spark, "prompts"), None
    op.write_prompts(path, {name: rows.select("source", "layer", *(c.split()[0] for c in kinds[name].split(", "))) for name, rows in tables.items()})
    for name, columns in kinds.items():
        own = spark.read.schema(f"layer string, {columns}, source int").csv(f"{path}/{name}", header=True).withColumn("kind", F.lit(name))
        found = own if found is None else found.unionByName(own, True)
    return found.select("kind", "source", "layer", "label_id", "point_id", "x", "y", "x0", "y0", "x1", "y1", "instance_count")


@query("sink_manifest", DUCK + """
, s as (select vol % 25 as source, case when n_fg is null then 'empty' when (vol + z) % 3 = 0 then 'skipped' else 'exported' end as status
  from (select distinct vol, z from grid) left join (select vol, n as z, n_fg from slices where orientation = 'xy') using (vol, z)),
c as (select source, count(*) as t, count(*) filter (status = 'exported') as e, count(*) filter (status = 'skipped') as k from s group by source)
select source, '{"source":' || source || ',"total_layers":' || t || ',"exported_layers":' || e || ',"skipped_layers":' || k || ',"metadata_layers":' || (e + k) || '}' as json from c""")
def sink_manifest(spark, sf):
    filled = fx.slices(spark, sf).filter("orientation = 'xy'").selectExpr("vol", "n as z", "n_fg")
    layers = fx.grid(spark, sf).select("vol", "z").distinct().join(filled, ["vol", "z"], "left")
    return op.manifest(layers.selectExpr("vol % 25 as source", "case when n_fg is null then 'empty' when (vol + z) % 3 = 0 then 'skipped' else 'exported' end as status"))
