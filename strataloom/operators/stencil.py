"""Neighbourhood operators on voxel rows: windows, offset joins, runs. Those on dense tiles are in ``blocks``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import kernels
from strataloom.operators import graph
from strataloom.sources.stage import staged_rows as staged

PLACE = ["vol", "z", "y", "x"]


def _line(axis: str):
    return Window.partitionBy(*(k for k in PLACE if k != axis)).orderBy(axis)


def step_differs(axis: str, value: str = "label") -> Column:
    """1 where the next place along the axis has another value; 0 at the edge. Needs the dense grid."""
    return F.coalesce((F.lead(value).over(_line(axis)) != F.col(value)).cast("int"), F.lit(0))


def affinity_2d(dense: DataFrame) -> DataFrame:
    """``dense`` with aff0 (down) and aff1 (right): 1 at a boundary."""
    return dense.withColumn("aff0", step_differs("y")).withColumn("aff1", step_differs("x"))


def affinity_3d(dense: DataFrame) -> DataFrame:
    """``dense`` with aff0, aff1, aff2 (y, x, z); background is a boundary everywhere."""
    for name, axis in (("aff0", "y"), ("aff1", "x"), ("aff2", "z")):
        dense = dense.withColumn(name, F.when(F.col("label") == 0, 1).otherwise(step_differs(axis)))
    return dense


def ball(k: int, axes: str) -> list[dict[str, int]]:
    """Offsets of an L1 distance of k at most, without the place itself."""
    spans = [range(-k, k + 1) if a in axes else [0] for a in "zyx"]
    return [dict(zip("zyx", (z, y, x), strict=True)) for z in spans[0] for y in spans[1] for x in spans[2] if 0 < abs(z) + abs(y) + abs(x) <= k]


def moved(rows: DataFrame, offsets: list[dict[str, int]], *columns: str) -> DataFrame:
    """Each row at every offset from its place: the places it is a neighbour of."""
    shifts = F.array(*(F.struct(*(F.lit(d[k]).alias(k) for k in "zyx")) for d in offsets))
    wide = rows.select("vol", *"zyx", *columns, F.explode(shifts).alias("_d"))
    return wide.select("vol", *((F.col(k) + F.col(f"_d.{k}")).alias(k) for k in "zyx"), *columns)


def erode_k(rows: DataFrame, k: int, axes: str, shape: tuple[int, int, int], border: int) -> DataFrame:
    """Sparse ``rows`` that survive k erosions by the cross, each label by itself.

    A place survives if all places within L1 distance k have its label; places
    beyond the frame count as its own only with border 1. A frame is convex, so
    that is k times the cross, each among the survivors of the one before.
    """
    offsets = ball(1, axes)
    inside = F.lit(len(offsets))
    if border:
        sizes = dict(zip("zyx", shape, strict=True))
        inside = sum((_within(d, sizes).cast("int") for d in offsets), F.lit(0))
    for _ in range(k):
        rows = counted(rows, offsets).filter(F.col("_same") == inside).drop("_same")
    return rows


def counted(rows: DataFrame, offsets: list[dict[str, int]]) -> DataFrame:
    """``rows`` (place, label, ..) with ``_same``: how many of the offsets lead to a place of the same label.

    Places and their neighbours meet in one aggregation, not in a join, so rows
    that are dealt by volume stay where they are.
    """
    others = [c for c in rows.columns if c not in (*PLACE, "label")]
    near = moved(rows, offsets, "label").withColumn("_n", F.lit(1))
    met = rows.withColumn("_own", F.lit(1)).unionByName(near, True).groupBy(*PLACE, "label").agg(F.max("_own").alias("_own"), F.count("_n").alias("_same"), *(F.max(c).alias(c) for c in others))
    return met.filter("_own = 1").select(*rows.columns, "_same")


def _within(offset: dict[str, int], sizes: dict[str, int]) -> Column:
    ok = F.lit(True)
    for k, d in offset.items():
        if d:
            ok = ok & (F.col(k) + d).between(0, sizes[k] - 1)
    return ok


def touching_pairs(rows: DataFrame, reach: int = 2) -> DataFrame:
    """(vol, z, label, other): labels of a slice within L1 distance ``reach``; only boundary places meet, in one aggregation by place."""
    edge = counted(rows.select(*PLACE, "label"), ball(1, "yx")).filter("_same < 4").select(*PLACE, "label")
    none = F.lit(None).cast(edge.schema["label"].dataType)
    near = moved(edge, ball(reach, "yx"), "label").withColumn("other", none).unionByName(edge.select(*PLACE, none.alias("label"), F.col("label").alias("other")))
    met = near.groupBy(*PLACE).agg(F.collect_set("label").alias("_near"), F.collect_set("other").alias("_own")).filter("size(_own) > 0")
    pairs = met.select("vol", "z", F.explode("_near").alias("label"), "_own").select("vol", "z", "label", F.explode("_own").alias("other"))
    return pairs.filter("label <> other").distinct()


def slice_runs(rows: DataFrame) -> DataFrame:
    """(vol, z, y, label, x0, x1): a slice's rows as runs of one label, ends included. Windows of one row's labels."""
    line = Window.partitionBy("vol", "z", "y", "label").orderBy("x")
    return rows.withColumn("_run", F.col("x") - F.row_number().over(line)).groupBy("vol", "z", "y", "label", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


#: Runs of neighbouring rows are joined by cells of so many places: at most half as many runs of a label share one.
CELL = 64
#: Planes and rows of the bands whose runs are labelled by themselves.
BAND = (16, 64)
RUN = ["vol", "z", "y", "label", "x0", "x1"]


def _band_components(band: pa.Table) -> pa.Table:
    """Runs of a band with the row and place (fy, fx) where the first run of their component in the band begins."""
    z, y, label, x0, x1 = (band.column(c).to_numpy() for c in ("z", "y", "label", "x0", "x1"))
    order = np.lexsort((x0, y, label, z))
    z, y, label, x0, x1 = (c[order] for c in (z, y, label, x0, x1))
    new = np.ones(len(y), bool)
    new[1:] = (z[1:] != z[:-1]) | (label[1:] != label[:-1]) | (y[1:] != y[:-1])
    line, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
    # The next line counts if it is the row below in the same slice and label.
    below = np.zeros(len(firsts), bool)
    below[:-1] = (z[firsts[1:]] == z[firsts[:-1]]) & (label[firsts[1:]] == label[firsts[:-1]]) & (y[firsts[1:]] == y[firsts[:-1]] + 1)
    wide = int(x1.max()) + 2
    here = np.flatnonzero(below[line])
    low = np.searchsorted(line * wide + x1, (line[here] + 1) * wide + x0[here], "left")
    high = np.searchsorted(line * wide + x0, (line[here] + 1) * wide + x1[here], "right")
    n = np.maximum(high - low, 0)
    a, b = np.repeat(here, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    root = kernels.roots(len(y), a, b)
    return pa.table([band.column("vol"), *(pa.array(c) for c in (z, y, label, x0, x1, y[root], x0[root]))], names=[*RUN, "fy", "fx"])


def run_components(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(vol, z, y, label, x0, x1, component): 4-connected components of every slice in raster order, as runs.

    Bands of rows are labelled by themselves, so a small slice is whole at
    once. Runs of one label that overlap across the bands' borders are edges
    between the bands' components, found by an equi-join on cells of the row and
    contracted, up to ``most`` of them in one task. A place may have several labels.
    """
    runs = slice_runs(rows).select(*RUN, F.expr(f"z div {BAND[0]}").alias("_bz"), F.expr(f"y div {BAND[1]}").alias("_by"))
    kinds = dict(runs.dtypes)
    schema = ", ".join(f"{c} {kinds[k]}" for c, k in [*((c, c) for c in RUN), ("fy", "y"), ("fx", "x0")])
    found = staged(runs.groupBy("vol", "_bz", "_by").applyInArrow(_band_components, schema), "runs")
    if not found.filter((F.col("y") >= BAND[1]) & (F.col("y") % BAND[1] == 0)).isEmpty():
        found = _across_bands(found, most)
    number = F.dense_rank().over(Window.partitionBy("vol", "z").orderBy("fy", "fx", "label"))
    return found.select(*RUN, number.alias("component"))


def _across_bands(found: DataFrame, most: int) -> DataFrame:
    """``found`` with the first run of each component's bands, where it has several."""
    cells = found.withColumn("cell", F.explode(F.expr(f"sequence(x0 div {CELL}, x1 div {CELL})")))
    above = cells.filter(F.col("y") % BAND[1] == BAND[1] - 1)
    below = cells.filter(F.col("y") % BAND[1] == 0).select("vol", "z", (F.col("y") - 1).alias("y"), "label", "cell", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("fy").alias("_fy"), F.col("fx").alias("_fx"))
    meet = F.expr(f"x0 <= _x1 and _x0 <= x1 and greatest(x0, _x0) div {CELL} = cell")
    pairs = staged(above.join(below, ["vol", "z", "y", "label", "cell"]).filter(meet).select("vol", "z", "label", "fy", "fx", "_fy", "_fx").distinct(), "band-pairs")
    part = ["vol", "z", "label", "fy", "fx"]
    parts = pairs.select(part).union(pairs.select("vol", "z", "label", "_fy", "_fx")).distinct()
    # Numbers that are written once tell the bands' components apart.
    parts = staged(parts.withColumn("node", F.monotonically_increasing_id()), "band-parts")
    edges = pairs.join(parts.withColumnRenamed("node", "a"), part).join(parts.select("vol", "z", "label", F.col("fy").alias("_fy"), F.col("fx").alias("_fx"), F.col("node").alias("b")), ["vol", "z", "label", "_fy", "_fx"])
    joined = parts.join(graph.components(staged(edges.select("a", "b"), "band-edges"), most=most).withColumnRenamed("label", "_whole"), "node")
    firsts = joined.groupBy("_whole").agg(F.min(F.struct("fy", "fx")).alias("_first"))
    named = joined.join(firsts, "_whole").select(*part, "_first")
    return found.join(named, part, "left").select(*RUN, F.coalesce("_first.fy", "fy").alias("fy"), F.coalesce("_first.fx", "fx").alias("fx"))


def slice_components(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(place, label, component): 4-connected components of every slice, in raster order."""
    return unfolded(run_components(rows, most), "label", "component")


def unfolded(runs: DataFrame, *columns: str) -> DataFrame:
    """The places of runs: (vol, z, y, x, ..)."""
    return runs.select("vol", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *columns)


def largest_runs(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(vol, z, y, x, label): the largest component of every label of a slice, the first on ties."""
    runs = staged(run_components(rows, most), "components")
    sizes = runs.groupBy("vol", "z", "label", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    best = sizes.groupBy("vol", "z", "label").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("b"))
    return unfolded(runs.join(best.select("vol", "z", "label", (-F.col("b.c")).alias("component")), ["vol", "z", "label", "component"]), "label")


def largest_component(components: DataFrame, keys: list[str], places: Column | None = None) -> DataFrame:
    """Rows of the largest component of each group, the first on ties; a row is one place, or so many as ``places`` says (runs)."""
    sizes = components.groupBy(*keys, "component").agg(F.sum(F.lit(1) if places is None else places).alias("n"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("b")).select(*keys, (-F.col("b.c")).alias("component"))
    return components.join(best, [*keys, "component"], "left_semi")


def _runs(rows: DataFrame, line: list[str], axis: str) -> DataFrame:
    """``rows`` with ``_run``: the number of their run of neighbouring places on a line along ``axis``."""
    return rows.withColumn("_run", F.col(axis) - F.row_number().over(Window.partitionBy(*line).orderBy(axis)))


def instance_edt(rows: DataFrame) -> DataFrame:
    """(place, label, d2): squared distance to the nearest place outside the slice instance.

    Exact, an axis at a time: along y the distance to the ends of a column's
    run, then along x the least sum of squares over a row's run, where only
    places nearer than the distance along y can matter. No group is larger
    than a line of an instance.
    """
    column = ["vol", "z", "x", "label"]
    tall = _runs(rows.select("vol", "z", "y", "x", "label"), column, "y")
    ends = Window.partitionBy(*column, "_run")
    tall = tall.withColumn("_g", F.least(F.col("y") - F.min("y").over(ends), F.max("y").over(ends) - F.col("y")) + 1).drop("_run")
    lines = _runs(tall, ["vol", "z", "y", "label"], "x").groupBy("vol", "z", "y", "label", "_run").agg(F.array_sort(F.collect_list(F.struct("x", "_g"))).alias("_at"))
    least = """transform(_at, (a, i) -> named_struct('x', a.x, 'd2', cast(least((i + 1) * (i + 1), (size(_at) - i) * (size(_at) - i),
        array_min(transform(slice(_at, greatest(i - a._g + 2, 1), least(i + a._g, size(_at)) - greatest(i - a._g + 2, 1) + 1),
            (b, j) -> b._g * b._g + (b.x - a.x) * (b.x - a.x)))) as bigint)))"""
    return lines.select("vol", "z", "y", "label", F.explode(F.expr(least)).alias("_p")).select("vol", "z", "y", F.col("_p.x").alias("x"), "label", F.col("_p.d2").alias("d2"))
