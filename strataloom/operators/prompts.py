"""Prompts of slice instances: candidate places, random mixes, bad predictions, clicks and crops. Episodes are in ``episodes``."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import kernels
from strataloom.operators.clean import uniform
from strataloom.sources.stage import staged

INSTANCE = ["vol", "z", "label"]


def stable_seeds(rows: DataFrame, base: int, parts: list[str]) -> DataFrame:
    """``rows`` with ``seed``: a stable hash of the base and the parts."""

    @F.pandas_udf("long")
    def seed(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([kernels.stable_seed(base, *row) for row in frame.itertuples(index=False)], dtype="int64")

    return rows.withColumn("seed", seed(F.struct(*parts)))


def interior(edt: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Places of the squared distance ``d2`` that are interior: strictly above a share of the largest depth (export), or 1 and at least that (training)."""
    edt = edt.withColumn("most", F.max("d2").over(Window.partitionBy(*INSTANCE)))
    bar = F.col("most") * F.lit(threshold * threshold)
    keep = F.col("d2") > bar if strict else F.col("d2") >= F.greatest(F.lit(1.0), bar)
    return edt.filter(keep).drop("most")


def _first(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    best = rows.groupBy(*INSTANCE).agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *columns)).alias("b"))
    return best.select(*INSTANCE, *(F.col(f"b.{c}").alias(c) for c in columns))


def grid_points(candidates: DataFrame, rows: DataFrame, stride: int) -> DataFrame:
    """(instance, y, x): candidates on a grid from the instance's corner; without any, the one nearest the box's centre."""
    box = rows.groupBy(*INSTANCE).agg(*(f(k).alias(f"{n}{k}") for k in "yx" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    found = candidates.join(box, INSTANCE)
    on = found.filter(((F.col("y") - F.col("loy")) % stride == 0) & ((F.col("x") - F.col("lox")) % stride == 0)).select(*INSTANCE, "y", "x")
    twice = [2 * F.col(k) - F.col(f"lo{k}") - F.col(f"hi{k}") for k in "yx"]
    rest = found.join(on.select(*INSTANCE).distinct(), INSTANCE, "left_anti")
    return on.unionByName(_first(rest, [twice[0] * twice[0] + twice[1] * twice[1], F.col("y"), F.col("x")], ["y", "x"]))


def component_center(edt: DataFrame, export: bool) -> DataFrame:
    """(instance, y, x): of the deepest places the one nearest the centroid of the instance (export) or of those places."""
    own = Window.partitionBy(*INSTANCE)
    mean = {"n": F.count(F.lit(1)).over(own), "sy": F.sum("y").over(own), "sx": F.sum("x").over(own)}
    most = edt.withColumns({"most": F.max("d2").over(own)} | (mean if export else {}))
    deepest = most.filter("d2 = most")
    deepest = deepest if export else deepest.withColumns(mean)
    # Distances times the count: whole numbers, so that ties are exact.
    off = [F.col("n") * F.col(k) - F.col(f"s{k}") for k in "yx"]
    return _first(deepest, [off[0] * off[0] + off[1] * off[1], F.col("y"), F.col("x")], ["y", "x"])


def no_prompt(dense: DataFrame) -> DataFrame:
    """(place, prompt, mask): a prompt of ones, all foreground as the mask."""
    return dense.select("vol", "z", "y", "x", F.lit(1.0).alias("prompt"), (F.col("label") != 0).cast("int").alias("mask"))


def point_map(points: DataFrame, keys: list[str], height: int, width: int, theta: float, samples: DataFrame | None = None, empty: float = 0.0) -> DataFrame:
    """(keys, y, x, prompt): signed bumps of points, each scaled by its peak on the grid; all negative gives 2 v + 1.

    ``samples`` (keys, prompted) adds maps of samples without points: ``empty``
    where they are prompted, ones where not. A bump is the product of one along
    y and one along x, so points of one column are summed before x unfolds.
    """
    along = lambda at, k, size: F.exp(-(F.pow(at - F.col(k), 2) - F.pow(F.least(F.greatest(F.col(k), F.lit(0)), F.lit(size - 1)) - F.col(k), 2)) * F.lit(0.5 / theta))
    tall = points.withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    column = tall.groupBy(*keys, "gy", "x").agg(F.sum(along(F.col("gy"), "y", height) * (2 * F.col("polarity") - 1)).alias("v"), F.max("polarity").alias("p"))
    wide = column.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    total = wide.groupBy(*keys, F.col("gy").alias("y"), F.col("gx").alias("x")).agg(F.sum(F.col("v") * along(F.col("gx"), "x", width)).alias("v"), F.max("p").alias("p"))
    found = total.select(*keys, "y", "x", F.when(F.col("p") == 0, 2 * F.col("v") + 1).otherwise(F.col("v")).alias("prompt"))
    if samples is None:
        return found
    bare = samples.join(points, keys, "left_anti").select(*keys, F.when(F.col("prompted"), empty).otherwise(1.0).alias("prompt"))
    bare = bare.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return found.unionByName(bare)


def mixed_instances(instances: DataFrame, keys: list[str], seed: int, whole: bool) -> DataFrame:
    """``instances`` (keys, label, ..) with ``whole``, ``style`` (+, - or +-), ``included`` and ``n_included`` of their group.

    Half of the groups take all instances if ``whole``; the others take each with
    the group's share (0.1 to 0.9): the first of ten rounds that takes any, else one at random.
    """
    share = (F.floor(uniform(seed, *keys) * 9) + 1) / 10
    rounds = sum((F.when(uniform(seed + 10 + r, *keys, "label") < share, 1 << r).otherwise(0) for r in range(10)), F.lit(0))
    rows = instances.withColumn("_rounds", rounds)
    group = rows.groupBy(*keys).agg(F.bit_or("_rounds").alias("_any"), F.min(F.struct(F.xxhash64(F.lit(seed), *keys, "label").alias("lot"), "label")).alias("_one"))
    group = group.withColumn("whole", F.lit(whole) & (uniform(seed + 1, *keys) < 0.5))
    group = group.withColumn("style", F.element_at(F.array(*map(F.lit, ("+", "-", "+-"))), (F.floor(uniform(seed + 2, *keys) * 3) + 1).cast("int")))
    # The lowest bit of ``_any`` is the first round that takes an instance.
    first = F.col("_any").bitwiseAND(-F.col("_any"))
    taken = F.when(F.col("_any") > 0, F.col("_rounds").bitwiseAND(first) > 0).otherwise(F.col("label") == F.col("_one.label"))
    found = rows.join(group, keys).withColumn("included", F.col("whole") | taken).drop("_rounds", "_any", "_one")
    sizes = found.groupBy(*keys).agg(F.count_if("included").alias("n_included"))
    return found.join(sizes, keys)


def _one_place(seed: int, *keys: str) -> Column:
    """Aggregate: a random place (y, x) of each group."""
    return F.min(F.struct(F.xxhash64(F.lit(seed), *keys, "y", "x").alias("lot"), "y", "x"))


def random_mix(rows: DataFrame, seed: int, slices: DataFrame | None = None, sam: bool = False) -> DataFrame:
    """(vol, z, label, whole, included, polarity, x, y, x0, y0, x1, y1): the prompt of every slice, a row for each instance.

    A ``whole`` slice has no points and boxes, its mask is all foreground; no slice
    is whole if ``sam``. Else included instances have a box and, in a style with +
    or as the only one, a positive point; excluded ones a negative point in a style
    with -. ``slices`` (vol, z) without foreground have a row of nulls, or of label 0 and zeros if ``sam``.
    """
    ends = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    found = mixed_instances(rows.groupBy(*INSTANCE).agg(_one_place(seed + 3, *INSTANCE).alias("p"), *ends), ["vol", "z"], seed, not sam)
    positive = F.col("included") & (F.col("style").contains("+") | (F.col("n_included") == 1))
    negative = ~F.col("included") & F.col("style").contains("-")
    pointed, boxed = ~F.col("whole") & (positive | negative), ~F.col("whole") & F.col("included")
    columns = [F.when(pointed, F.col("included").cast("int")).alias("polarity"), *(F.when(pointed, F.col(f"p.{k}")).alias(k) for k in "xy"), *(F.when(boxed, F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1"))]
    found = found.select(*INSTANCE, "whole", "included", *columns)
    if slices is None:
        return found
    zero = F.lit(0 if sam else None).cast("int")
    bare = slices.select("vol", "z").join(rows, ["vol", "z"], "left_anti")
    return found.unionByName(bare.select("vol", "z", zero.alias("label"), F.lit(False).alias("whole"), F.lit(False).alias("included"), *(zero.alias(k) for k in ("polarity", "x", "y", "x0", "y0", "x1", "y1"))))


def mask_3d(slab: DataFrame, seed: int) -> DataFrame:
    """(vol, z0, label, whole, included, polarity, x, y): the prompt of every slab, a row for each instance of its first slice.

    A ``whole`` slab has no points; else included instances have a positive point
    of the first slice in a style with +, excluded ones a negative one in a style with -.
    """
    keys = ["vol", "z0"]
    first = slab.filter("z = z0").groupBy(*keys, "label").agg(_one_place(seed + 3, *keys, "label").alias("p"))
    found = mixed_instances(first, keys, seed, True)
    pointed = ~F.col("whole") & F.when(F.col("included"), F.col("style").contains("+")).otherwise(F.col("style").contains("-"))
    return found.select(*keys, "label", "whole", "included", F.when(pointed, F.col("included").cast("int")).alias("polarity"), *(F.when(pointed, F.col(f"p.{k}")).alias(k) for k in "xy"))


def prompt_mask(rows: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Places of the instances that a prompt includes."""
    return rows.join(prompts.filter("included").select(*keys, "label"), [*keys, "label"], "left_semi")


def one_instance(boxes: DataFrame, seed: int) -> DataFrame:
    """(instance): a random instance of every slice."""
    lot = F.xxhash64(F.lit(seed), *INSTANCE)
    return boxes.groupBy("vol", "z").agg(F.min(F.struct(lot.alias("lot"), "label")).alias("b")).select("vol", "z", "b.label")


def slice_crops(slices: DataFrame, crops: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """(vol, z, label, y0, x0): the window of every slice; in the middle and without a label where there is no crop."""
    middle = [F.lit(max(n - size, 0) // 2) for n in shape]
    return slices.select("vol", "z").join(crops, ["vol", "z"], "left").select("vol", "z", "label", F.coalesce("y0", middle[0]).alias("y0"), F.coalesce("x0", middle[1]).alias("x0"))


def surviving(crops: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """``crops`` (vol, z, label, y0, x0) whose label is null where erosion inside the window leaves nothing of it.

    A place goes where a neighbour in its window has another label or none;
    beyond the window nothing erodes.
    """
    window = crops.filter("label is not null").select(*INSTANCE, "y0", "x0")
    inside = F.col("y").between(F.col("y0"), F.col("y0") + size - 1) & F.col("x").between(F.col("x0"), F.col("x0") + size - 1)
    own = rows.select("vol", "z", "y", "x", "label").join(window, INSTANCE).filter(inside)
    place = ["vol", "z", "y", "x", "label"]
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))))
    met = own.select("*", steps.alias("s")).select("vol", "z", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"), "label")
    met = met.groupBy(*place).agg(F.count("*").alias("_n"))
    edges = sum((e.cast("int") for e in (F.col("y") == F.col("y0"), F.col("x") == F.col("x0"), F.col("y") == F.col("y0") + size - 1, F.col("x") == F.col("x0") + size - 1)), F.lit(0))
    left = own.join(met, place).filter(F.col("_n") + edges == 4).select(*INSTANCE).distinct().withColumn("_left", F.lit(True))
    return crops.join(left, INSTANCE, "left").withColumn("label", F.when(F.col("_left"), F.col("label"))).drop("_left")


def spread_points(places: DataFrame, most: int, wanted: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """(instance, rank, y, x): up to ``most`` points spread over the places (instance, y, x, d2) of each instance.

    The first is the first in raster order, or a random one by a seed; ``wanted``
    (instance, wanted) gives each instance its own number. A round for each
    point: of every place the squared distance to the nearest point so far, by
    1.001 and its depth; the place of the largest is the next point, the first
    in raster order on ties. All rounds are windows over the same instances, so
    the places are dealt and sorted once, whatever the number of points.
    """
    own = Window.partitionBy(*INSTANCE)
    lot = F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), *INSTANCE, "y", "x")
    found = places.select(*INSTANCE, "y", "x", "d2", F.min(F.struct(lot.alias("lot"), "y", "x")).over(own).alias("_first"))
    found = found.withColumn("_p0", F.struct("_first.y", "_first.x")).drop("_first")
    square = lambda p: (F.col("y") - F.col(f"{p}.y")) * (F.col("y") - F.col(f"{p}.y")) + (F.col("x") - F.col(f"{p}.x")) * (F.col("x") - F.col(f"{p}.x"))
    found = found.withColumn("_gap", square("_p0"))
    for rank in range(1, most):
        score = F.struct((-(F.col("_gap") / (F.lit(1.0) + F.sqrt("d2") + F.lit(1e-3)))).alias("s"), "y", "x")
        best = F.min(F.when(F.col("_gap") > 0, score)).over(own)
        found = found.withColumn("_best", best).withColumn(f"_p{rank}", F.when(F.col("_best").isNotNull(), F.struct("_best.y", "_best.x"))).drop("_best")
        found = found.withColumn("_gap", F.least("_gap", square(f"_p{rank}")))
    picks = found.groupBy(*INSTANCE).agg(*(F.max(f"_p{r}").alias(f"_p{r}") for r in range(most)))
    points = picks.select(*INSTANCE, F.posexplode(F.array(*(f"_p{r}" for r in range(most)))).alias("rank", "_p")).filter("_p is not null")
    points = points.select(*INSTANCE, "rank", "_p.y", "_p.x")
    if wanted is None:
        return points
    return points.join(wanted.select(*INSTANCE, "wanted"), INSTANCE, "left").filter("rank = 0 or rank < wanted").drop("wanted")


def farthest(edt: DataFrame, threshold: float, k: int) -> DataFrame:
    """(instance, rank, y, x): points spread over each instance's interior, the first candidate first."""
    return spread_points(interior(edt, threshold, False), k)


@dataclass(frozen=True)
class Spoiling:
    """Fixed values of bad predictions."""

    merge_odds: float = 0.55
    merge_share: float = 0.45
    most_erosion: int = 4


SPOILING = Spoiling()


def simulated_places(rows: DataFrame, pairs: DataFrame, seed: int, rules: Spoiling = SPOILING, tasks: int | None = None) -> DataFrame:
    """(vol, z, y, x, label, mine): the bad prediction of every instance; ``mine`` marks its own places.

    A share of a random one of the touching ``pairs`` is merged in, or the mask is
    eroded; instances that touch none are eroded. With ``tasks`` places are dealt
    to so many by volume before they meet those around them: few bytes, much work.
    """
    lot = F.struct(F.xxhash64(F.lit(seed), *INSTANCE, "other").alias("lot"), "other")
    near = pairs.groupBy(*INSTANCE).agg(F.min(lot).alias("n")).select(*INSTANCE, F.col("n.other").alias("other")).hint("merge")
    plan = rows.select(*INSTANCE).distinct().join(near, INSTANCE, "left")
    merges = F.col("other").isNotNull() & (uniform(seed + 1, *INSTANCE) < rules.merge_odds)
    erodes = F.col("other").isNull() | (uniform(seed + 2, *INSTANCE) < 1 - rules.merge_odds)
    times = F.when(erodes, F.floor(uniform(seed + 3, *INSTANCE) * rules.most_erosion) + 1).otherwise(0).cast("int")
    plan = plan.select(*INSTANCE, F.when(merges, F.col("other")).alias("other"), times.alias("times")).hint("merge")
    place = ["vol", "z", "y", "x"]
    own = rows.select(*place, "label").join(plan.drop("other"), INSTANCE).withColumn("mine", F.lit(True))
    other = rows.select(*place, F.col("label").alias("other")).join(plan.filter("other is not null"), ["vol", "z", "other"])
    other = other.filter(uniform(seed + 4, *INSTANCE, "y", "x") < rules.merge_share).select(*own.columns[:-1], F.lit(False).alias("mine"))
    whole = own.unionByName(other)
    whole = whole.repartition(tasks, "vol") if tasks else whole
    # A place survives k erosions if all 2 k (k + 1) places around it within L1 distance k are there.
    ball = [(abs(dy) + abs(dx), dy, dx) for dy, dx in product(range(-rules.most_erosion, rules.most_erosion + 1), repeat=2) if 0 < abs(dy) + abs(dx) <= rules.most_erosion]
    around = F.explode(F.filter(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for d, dy, dx in ball)), lambda b: b.d <= F.col("times")))
    seen = whole.filter("times > 0").select("*", around.alias("b")).select("vol", "z", (F.col("y") + F.col("b.dy")).alias("y"), (F.col("x") + F.col("b.dx")).alias("x"), "label", F.lit(1).alias("n"))
    counted = whole.unionByName(seen, True).groupBy(*place, "label").agg(F.sum("n").alias("n"), F.max("mine").alias("mine"), F.max("times").alias("times"))
    return counted.filter("mine is not null and (times = 0 or n = 2 * times * (times + 1))").select(*place, "label", "mine")


def simulated(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(instance, area, fp, fn): errors of the predictions ``places``."""
    found = places.groupBy(*INSTANCE).agg(F.count_if(~F.col("mine")).alias("fp"), F.count_if("mine").alias("tp"))
    area = rows.groupBy(*INSTANCE).agg(F.count("*").alias("area")).join(found, INSTANCE, "left")
    return area.select(*INSTANCE, "area", F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("area") - F.coalesce("tp", F.lit(0))).alias("fn"))


def one_click(edt: DataFrame, threshold: float, seed: int = 0, bias: float = 1.0, taken: DataFrame | None = None, apart: float = 0.0) -> DataFrame:
    """(instance, y, x): an interior place of every instance: the deepest (the first on ties) with probability ``bias``, else a random one.

    Where it is nearer than ``apart`` to a point of ``taken`` (instance, y, x), the
    deepest place that is not; an instance without one has no row.
    """
    places = interior(edt, threshold, False)
    depth = [-F.col("d2"), F.col("y"), F.col("x")]
    if bias >= 1 and taken is None:
        return _first(places, depth, ["y", "x"])
    deep = uniform(seed, *INSTANCE) < bias
    lot = F.when(deep, 0).otherwise(F.xxhash64(F.lit(seed), *INSTANCE, "y", "x"))
    allowed = F.lit(True)
    if taken is not None:
        marks = taken.groupBy(*INSTANCE).agg(F.collect_set(F.struct("y", "x")).alias("_marks"))
        places = places.join(marks, INSTANCE, "left")
        far = lambda p: (F.col("y") - p.y) * (F.col("y") - p.y) + (F.col("x") - p.x) * (F.col("x") - p.x) >= apart * apart
        allowed = F.coalesce(F.forall("_marks", far), F.lit(True))
    ranked = places.select(*INSTANCE, F.struct(lot.alias("lot"), *(c.alias(f"o{i}") for i, c in enumerate(depth)), "y", "x", allowed.alias("ok")).alias("first"), F.when(allowed, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(depth)), "y", "x")).alias("other"))
    best = ranked.groupBy(*INSTANCE).agg(F.min("first").alias("f"), F.min("other").alias("o"))
    pick = F.when(F.col("f.ok"), F.struct("f.y", "f.x")).otherwise(F.struct("o.y", "o.x"))
    return best.filter("o is not null").select(*INSTANCE, pick.alias("p")).select(*INSTANCE, "p.y", "p.x")


def instance_crops(boxes: DataFrame, pairs: DataFrame, size: int, shape: tuple[int, int], seed: int, draws: int = 48, halo: int = 28, jitter: int = 10, chosen: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(instance, y0, x0, overlap): the window of ``size`` around each instance (of ``chosen``) that covers most of it and its neighbours.

    Of ``draws`` jittered windows that cover the instance's box the one with the
    largest overlap with the joint box, grown by the halo. Of more than ``most``
    touching neighbours random ones are in the joint box.
    """
    targets = boxes
    if chosen is not None:
        targets, pairs = (rows.join(chosen, INSTANCE, "left_semi") for rows in (boxes, pairs))
    turn = F.row_number().over(Window.partitionBy(*INSTANCE).orderBy(F.xxhash64(F.lit(seed), *INSTANCE, "other"), "other"))
    pairs = pairs.withColumn("_turn", turn).filter(F.col("_turn") <= most).drop("_turn")
    near = pairs.join(boxes.select("vol", "z", F.col("label").alias("other"), *(F.col(c).alias(f"n_{c}") for c in ("lo_y", "lo_x", "hi_y", "hi_x"))), ["vol", "z", "other"])
    joint = near.groupBy(*INSTANCE).agg(*(F.min(f"n_lo_{k}").alias(f"m_lo_{k}") for k in "yx"), *(F.max(f"n_hi_{k}").alias(f"m_hi_{k}") for k in "yx"))
    rows = targets.join(joint, INSTANCE, "left")
    u = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), *INSTANCE, "draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    overlap = F.lit(1)
    for k, n in zip("yx", shape, strict=True):
        low, high = F.col(f"lo_{k}"), F.col(f"hi_{k}")
        wide_low = F.greatest(F.least(low, F.coalesce(f"m_lo_{k}", low)) - halo, F.lit(0))
        wide_high = F.least(F.greatest(high, F.coalesce(f"m_hi_{k}", high)) + halo, F.lit(n))
        first, last = F.greatest(high - size, F.lit(0)), F.least(low, F.lit(n - size))
        middle = F.floor((low + high - size) / 2) + F.floor((u(f"j{k}") * 2 - 1) * jitter)
        start = F.least(F.greatest(F.when(first <= last, first + F.floor(u(f"s{k}") * (last - first + 1))).otherwise(middle), F.lit(0)), F.lit(max(n - size, 0))).cast("int")
        rows = rows.withColumn(f"s{k}", start)
        overlap = overlap * F.greatest(F.least(F.col(f"s{k}") + size, wide_high) - F.greatest(F.col(f"s{k}"), wide_low), F.lit(0))
    best = rows.withColumn("overlap", overlap.cast("int")).groupBy(*INSTANCE).agg(F.max(F.struct("overlap", (-F.col("draw")).alias("d"), "sy", "sx")).alias("b"))
    return best.select(*INSTANCE, F.col("b.sy").alias("y0"), F.col("b.sx").alias("x0"), "b.overlap")
