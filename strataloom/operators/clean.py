"""Cleaning, cropping and re-viewing of voxel rows (vol, z, y, x, label, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["vol", "z", "y", "x"]


def minmax(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``norm``: the value scaled to 0..1 within its group; 0 where the group is constant."""
    # Windows, not a join of rows with their ends: rows that are dealt by volume stay where they are, and are made once.
    own = Window.partitionBy(*keys)
    found = rows.withColumns({"_lo": F.min(value).over(own), "_hi": F.max(value).over(own)})
    return found.withColumn("norm", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def raw_uint8(rows: DataFrame, keys: list[str], value: str, is_byte: Column | None = None) -> DataFrame:
    """``rows`` with ``byte``: finite values scaled to 0..255, half to even; others 0. Rows that hold bytes already (``is_byte``) keep them."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    own = Window.partitionBy(*keys)
    found = rows.withColumns({"_lo": F.min(finite).over(own), "_hi": F.max(finite).over(own)})
    scaled = (finite - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255
    byte = F.when((F.col("_hi") > F.col("_lo")) & finite.isNotNull(), F.least(F.greatest(F.bround(scaled), F.lit(0.0)), F.lit(255.0))).otherwise(F.lit(0.0))
    if is_byte is not None:
        byte = F.when(is_byte, F.col(value)).otherwise(byte)
    return found.withColumn("byte", byte.cast("int")).drop("_lo", "_hi")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """One number of three bytes."""
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def color_to_id(rows: DataFrame, most: int = 65535) -> DataFrame:
    """``rows`` (vol, z, packed, ..) with ``id``: colours numbered from 1 by first slice, then colour; black is 0."""
    first = rows.filter("packed <> 0").groupBy("vol", "packed").agg(F.min("z").alias("_z"))
    ids = first.withColumn("id", F.row_number().over(Window.partitionBy("vol").orderBy("_z", "packed"))).drop("_z")
    ids = ids.withColumn("id", F.when(F.col("id") > most, F.raise_error(F.lit("too many colours"))).otherwise(F.col("id")))
    return rows.join(ids, ["vol", "packed"], "left").withColumn("id", F.coalesce("id", F.lit(0)))


def drop_slices(rows: DataFrame, dropped: list[int], vol: Column) -> DataFrame:
    """Slices ``dropped`` of the volumes where ``vol`` holds go, and the gap closes."""
    below = sum((F.col("z") > d).cast("int") for d in dropped)
    return rows.filter(~(vol & F.col("z").isin(dropped))).withColumn("z", F.when(vol, F.col("z") - below).otherwise(F.col("z")))


def border_crop(rows: DataFrame, shape: tuple[int, int, int], border: int) -> DataFrame:
    """Places ``border`` away from every face, at a new origin."""
    for axis, size in zip("zyx", shape, strict=True):
        rows = rows.filter(F.col(axis).between(border, size - border - 1)).withColumn(axis, F.col(axis) - border)
    return rows


def offset_align(labels: DataFrame, raw: DataFrame, offset: tuple[int, int, int]) -> DataFrame:
    """Labels with the raw value of the place that lies ``offset`` further in a larger volume."""
    moved = raw
    for axis, d in zip("zyx", offset, strict=True):
        moved = moved.withColumn(axis, F.col(axis) - d)
    return met(labels, moved.select(*PLACE, "raw"))


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of places that both have, with the columns of both.

    A place is a row of its own in each, so one aggregation of both joins them; rows that are dealt by volume stay where they are.
    """
    both = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_b", F.lit(1)), True)
    both = both.groupBy(*PLACE).agg(*(F.max(c).alias(c) for c in both.columns if c not in PLACE))
    return both.filter("_a = 1 and _b = 1").drop("_a", "_b")


def common_shape(a: DataFrame, b: DataFrame, trims: Column | None = None) -> DataFrame:
    """Both trimmed to the smaller extent of each axis, joined place by place.

    Extents that differ are an error in volumes where ``trims`` does not hold.
    """
    ends = lambda rows, s: rows.groupBy("vol").agg(*(F.max(k).alias(f"{s}{k}") for k in "zyx"))
    both = ends(a, "a").join(ends(b, "b"), "vol")
    if trims is not None:
        same = F.expr("az = bz and ay = by and ax = bx")
        both = both.filter(F.when(trims | same, True).otherwise(F.raise_error(F.lit("raw and label shapes differ")).cast("boolean")))
    most = both.select("vol", *(F.least(f"a{k}", f"b{k}").alias(f"_{k}") for k in "zyx"))
    kept = met(a, b).join(most, "vol")
    return kept.filter(" and ".join(f"{k} <= _{k}" for k in "zyx")).drop("_z", "_y", "_x")


def foreground_crop(rows: DataFrame, shape: tuple[int, int, int], margin: int) -> DataFrame:
    """Each volume cropped to its foreground and a margin; without foreground it stays whole."""
    box = rows.filter("label > 0").groupBy("vol").agg(*(F.min(k).alias(f"lo_{k}") for k in "zyx"), *(F.max(k).alias(f"hi_{k}") for k in "zyx"))
    found = rows.join(box, "vol", "left")
    for k, size in zip("zyx", shape, strict=True):
        low = F.coalesce(F.greatest(F.col(f"lo_{k}") - margin, F.lit(0)), F.lit(0))
        high = F.coalesce(F.least(F.col(f"hi_{k}") + margin, F.lit(size - 1)), F.lit(size - 1))
        found = found.filter(F.col(k).between(low, high)).withColumn(k, F.col(k) - low).drop(f"lo_{k}", f"hi_{k}")
    return found


def label_range(rows: DataFrame, limit: int = 65536) -> DataFrame:
    """(vol, max_label, ok): volumes whose labels fit the range."""
    return rows.groupBy("vol").agg(F.max("label").alias("max_label")).withColumn("ok", F.col("max_label") < limit)


def wrapped(label: Column, limit: int = 65536) -> Column:
    """The label modulo the range: what a silent narrowing does."""
    return F.pmod(label, F.lit(limit))


def slice_views(rows: DataFrame) -> DataFrame:
    """2-D views: (vol, orientation, n, row, col, ..) for xy, xz and yz."""
    views = "stack(3, 'xy', z, y, x, 'xz', y, z, x, 'yz', x, z, y) as (orientation, n, row, col)"
    others = [c for c in rows.columns if c not in ("vol", "z", "y", "x")]
    return rows.selectExpr("vol", views, *others)


def volume_views(rows: DataFrame) -> DataFrame:
    """3-D views (vol, orientation, d, row, col, ..): xy slides along z; xz and yz both along y, and differ in the plane."""
    views = "stack(3, 'xy', z, y, x, 'xz', y, z, x, 'yz', y, x, z) as (orientation, d, row, col)"
    others = [c for c in rows.columns if c not in ("vol", "z", "y", "x")]
    return rows.selectExpr("vol", views, *others)


def channel_order(axes: tuple[int, int, int]) -> list[int]:
    """Places of the 10 descriptor channels when new axis i is old axis ``axes[i]``."""
    pairs = [(0, 1), (0, 2), (1, 2)]
    crossed = [pairs.index(tuple(sorted((axes[a], axes[b])))) for a, b in pairs]
    return [*axes, *(3 + a for a in axes), *(6 + c for c in crossed), 9]


def permute_channels(column: Column, axes: tuple[int, int, int]) -> Column:
    """The descriptor array in the channel order of a re-oriented view."""
    return F.array(*(F.element_at(column, k + 1) for k in channel_order(axes)))


def padded_size(size: Column, unit: int) -> Column:
    """The size rounded up to a multiple of the unit; null gives 0."""
    return F.coalesce(((size + unit - 1) / unit).cast("int") * unit, F.lit(0))


def center_crop(rows: DataFrame, shape: tuple[int, int], size: int) -> DataFrame:
    """Rows of the window of ``size`` in the middle of the (padded) plane, at a new origin."""
    for axis, n in zip("yx", shape, strict=True):
        start = (max(n, size) - size) // 2
        rows = rows.filter(F.col(axis).between(start, start + size - 1)).withColumn(axis, F.col(axis) - start)
    return rows


def padded(rows: DataFrame, planes: DataFrame, keys: list[str], sides: dict[str, Column | int], value: str = "label") -> DataFrame:
    """(keys, axes of ``sides``, value): every place of each row of ``planes`` up to its sides, 0 where ``rows`` has none.

    What a crop or a network needs that is larger than the plane or volume: zeros at the end.
    """
    grid = planes.select(*keys, *(F.lit(n).alias(f"_n_{a}") if isinstance(n, int) else n.alias(f"_n_{a}") for a, n in sides.items()))
    for axis in sides:
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(f"_n_{axis}") - 1)))
    # The grid's places are rows of their own, so one aggregation of both fills it; rows that are dealt by volume stay where they are.
    both = grid.select(*keys, *sides, F.lit(1).alias("_own")).unionByName(rows.select(*keys, *sides, value), True)
    found = both.groupBy(*keys, *sides).agg(F.max("_own").alias("_own"), F.max(value).alias(value)).filter("_own = 1")
    return found.select(*keys, *sides, F.coalesce(value, F.lit(0)).alias(value))


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) by a hash of the seed and the keys, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def random_crop(rows: DataFrame, shape: tuple[int, int], size: int, seed: int, keys: list[str]) -> DataFrame:
    """As ``center_crop`` with a start that is uniform for each group of keys."""
    for number, (axis, n) in enumerate(zip("yx", shape, strict=True)):
        start = F.floor(uniform(seed + number, *keys) * (max(n, size) - size + 1)).cast("int")
        rows = rows.withColumn("_start", start).filter(F.col(axis).between(F.col("_start"), F.col("_start") + size - 1)).withColumn(axis, F.col(axis) - F.col("_start")).drop("_start")
    return rows


def dihedral(rows: DataFrame, size: int) -> DataFrame:
    """Rows moved by their plan: flip rows, flip columns, quarter turns, transpose, in this order."""
    last = F.lit(size - 1)
    y, x = F.when(F.col("flip_rows"), last - F.col("y")).otherwise(F.col("y")), F.when(F.col("flip_cols"), last - F.col("x")).otherwise(F.col("x"))
    rows = rows.withColumn("_y", y).withColumn("_x", x)
    turns = F.col("turns")
    y = F.when(turns == 1, last - F.col("_x")).when(turns == 2, last - F.col("_y")).when(turns == 3, F.col("_x")).otherwise(F.col("_y"))
    x = F.when(turns == 1, F.col("_y")).when(turns == 2, last - F.col("_x")).when(turns == 3, last - F.col("_y")).otherwise(F.col("_x"))
    rows = rows.withColumn("y", y).withColumn("x", x).drop("_y", "_x")
    swapped = rows.withColumn("_t", F.col("y")).withColumn("y", F.when(F.col("transpose"), F.col("x")).otherwise(F.col("y")))
    return swapped.withColumn("x", F.when(F.col("transpose"), F.col("_t")).otherwise(F.col("x"))).drop("_t")


def brightness(value: Column, alpha: Column, beta: Column) -> Column:
    """Scaled and shifted, within 0..1."""
    return F.least(F.greatest(value * alpha + beta, F.lit(0.0)), F.lit(1.0))


def augmentation_plan(samples: DataFrame, shape: tuple[int, int], size: int, seed: int, augment: bool, keys: list[str], chance: float = 0.3) -> DataFrame:
    """One plan for each sample: window start, flips, turns, transpose and brightness, from hashes of its keys."""
    u = lambda k: uniform(seed + k, *keys)
    space = [max(n, size) - size for n in shape]
    if not augment:
        fixed = {"y0": F.lit(space[0] // 2), "x0": F.lit(space[1] // 2), "flip_rows": F.lit(False), "flip_cols": F.lit(False), "turns": F.lit(0), "transpose": F.lit(False), "alpha": F.lit(1.0), "beta": F.lit(0.0)}
        return samples.select(*keys, *(v.alias(k) for k, v in fixed.items()))
    bright = u(8) < chance
    plan = {
        "y0": F.floor(u(0) * (space[0] + 1)).cast("int"), "x0": F.floor(u(1) * (space[1] + 1)).cast("int"),
        "flip_rows": u(2) < chance, "flip_cols": u(3) < chance,
        "turns": F.when(u(4) < chance, F.floor(u(5) * 3).cast("int") + 1).otherwise(0), "transpose": u(6) < chance,
        "alpha": F.when(bright, 0.8 + 0.4 * u(9)).otherwise(1.0), "beta": F.when(bright, -0.2 + 0.4 * u(10)).otherwise(0.0),
    }
    return samples.select(*keys, *(v.alias(k) for k, v in plan.items()))


def halo_box(rows: DataFrame, shape: tuple[int, int, int], halo: int) -> DataFrame:
    """Half-open boxes (lo_k, hi_k) grown by the halo, within the volume."""
    for k, n in zip("zyx", shape, strict=True):
        rows = rows.withColumn(f"lo_{k}", F.greatest(F.col(f"lo_{k}") - halo, F.lit(0))).withColumn(f"hi_{k}", F.least(F.col(f"hi_{k}") + halo, F.lit(n)))
    return rows
