"""Voxel volumes derived from the table ``part``, the same in Spark and DuckDB.

32 parts make one volume of 8 x 32 x 32 (z, y, x). Each part paints an
anisotropic ball, the nearest part (then the lowest key) owns a voxel, and its
label is the key mod 32 plus 1; unpainted voxels are background (label 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, HEIGHT, WIDTH = 8, 32, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many parts at most, in the mean, paint the voxels of one task. At 8,192 a stack of stencils held 3.2 GB of its memory.
PARTS = 2048


def dealt(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` by whole volumes, over as many tasks as the number of parts asks for: a task's share does not grow with the input."""
    n = table(spark, sf_dir, "part").count()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // PARTS)), "vol")


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol, z, y, x, code): the places of every part's ball; the least code of a place is its owner's.

    Parts are dealt by volume before they are unfolded, so what follows by
    volume moves no voxel. They meet their offsets by a cross join, as in the
    SQL: Spark then knows that many rows come of it, where it takes an explode
    for one row each and would broadcast what was unfolded.
    """
    seeds = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as pk", "cast(p_partkey div 32 as int) as vol", "cast((p_partkey * 5 + p_size) % 8 as int) as cz",
        "cast((p_partkey * p_partkey + 13 * p_partkey) % 32 as int) as cy", "cast((p_partkey * 11 + p_size * 7) % 32 as int) as cx",
    )
    offsets = spark.range(0, 405, 1, 1).selectExpr("cast(id div 81 - 2 as int) as dz", "cast(id div 9 % 9 - 4 as int) as dy", "cast(id % 9 - 4 as int) as dx").filter("4 * dz * dz + dy * dy + dx * dx <= 16")
    found = dealt(seeds, spark, sf_dir).crossJoin(F.broadcast(offsets))
    found = found.selectExpr("vol", "cz + dz as z", "cy + dy as y", "cx + dx as x", "(4 * dz * dz + dy * dy + dx * dx) * 1000000 + pk as code")
    return found.filter("z between 0 and 7 and y between 0 and 31 and x between 0 and 31")


LABEL = "cast(min(code) % 1000000 % 32 + 1 as int)"


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse foreground: (vol, z, y, x, label)."""
    return near(spark, sf_dir).groupBy("vol", "z", "y", "x").agg(F.expr(LABEL).alias("label"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``voxels``, four parts to a label: several components have one value."""
    return voxels(spark, sf_dir).withColumn("label", F.expr("(label - 1) % 8 + 1"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every volume: (vol, z, y, x)."""
    vols = table(spark, sf_dir, "part").selectExpr("cast(p_partkey div 32 as int) as vol")
    places = spark.range(0, DEPTH * HEIGHT * WIDTH, 1, 1).selectExpr("cast(id div 1024 as int) as z", "cast(id div 32 % 32 as int) as y", "cast(id % 32 as int) as x")
    return dealt(vols, spark, sf_dir).distinct().crossJoin(F.broadcast(places))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place with its label and raw value: (vol, z, y, x, label, raw).

    The grid's places are further candidates without an owner, so one
    aggregation of a volume's candidates gives the whole grid.
    """
    every = near(spark, sf_dir).unionByName(grid(spark, sf_dir).withColumn("code", F.lit(None).cast("long")))
    found = every.groupBy("vol", "z", "y", "x").agg(F.coalesce(F.expr(LABEL), F.lit(0)).alias("label"))
    return found.withColumn("raw", F.expr("(z * 37 + y * 17 + x * 29 + vol * 11 + label * 53) % 256"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol, nz, ny, nx) of every volume."""
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey div 32 as int) as vol", f"{DEPTH} as nz", f"{HEIGHT} as ny", f"{WIDTH} as nx").distinct()


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol, orientation, n, n_fg): foreground of every slice that has some."""
    each = voxels(spark, sf_dir).selectExpr("vol", "stack(3, 'xy', z, 'xz', y, 'yz', x) as (orientation, n)")
    return each.groupBy("vol", "orientation", "n").agg(F.count("*").alias("n_fg"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, source, isotropic): a region is a species, a nation a source."""
    return table(spark, sf_dir, "nation").selectExpr("n_regionkey as species", "n_nationkey as source", "n_nationkey % 3 = 0 as isotropic")


GUESS = "cast((label * 7 + x + 2 * y + z) % 11 as double) / 10"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol, z, y, x, label, p): a made probability for each foreground voxel."""
    return voxels(spark, sf_dir).withColumn("p", F.expr(GUESS))


#: DuckDB common table expressions of the same tables.
DUCK = """with recursive seeds as (
  select p_partkey pk, cast(p_partkey // 32 as int) vol, cast((p_partkey*5 + p_size) % 8 as int) cz,
         cast((p_partkey*p_partkey + 13*p_partkey) % 32 as int) cy, cast((p_partkey*11 + p_size*7) % 32 as int) cx
  from part),
offs as (
  select cast(a.i as int)-2 dz, cast(b.i as int)-4 dy, cast(c.i as int)-4 dx
  from range(5) a(i) cross join range(9) b(i) cross join range(9) c(i)),
near as (
  select vol, cz+dz z, cy+dy y, cx+dx x, 4*dz*dz+dy*dy+dx*dx d2, pk
  from seeds cross join offs
  where 4*dz*dz+dy*dy+dx*dx <= 16 and cz+dz between 0 and 7 and cy+dy between 0 and 31 and cx+dx between 0 and 31),
voxels as (
  select vol, z, y, x, cast(min(d2*1000000 + pk) % 1000000 % 32 + 1 as int) as label from near group by vol, z, y, x),
merged as (select vol, z, y, x, (label - 1) % 8 + 1 as label from voxels),
grid as (
  select vol, cast(a.i as int) z, cast(b.i as int) y, cast(c.i as int) x
  from (select distinct vol from seeds) cross join range(8) a(i) cross join range(32) b(i) cross join range(32) c(i)),
dense0 as (select g.vol, g.z, g.y, g.x, coalesce(v.label, 0) as label from grid g left join voxels v using (vol, z, y, x)),
dense as (select *, (z*37 + y*17 + x*29 + vol*11 + label*53) % 256 as raw from dense0),
slices as (
  select vol, 'xy' as orientation, z as n, count(*) as n_fg from voxels group by all
  union all select vol, 'xz', y, count(*) from voxels group by all
  union all select vol, 'yz', x, count(*) from voxels group by all),
sources as (select n_regionkey as species, n_nationkey as source, n_nationkey % 3 = 0 as isotropic from nation),
pred as (select *, cast((label*7 + x + 2*y + z) % 11 as double) / 10 as p from voxels)
"""
