"""Aggregations over instances and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import stencil


def instance_boxes(rows: DataFrame) -> DataFrame:
    """Half-open boxes (vol, label, lo_k, hi_k) of the instances."""
    ends = [F.min(k).alias(f"lo_{k}") for k in "zyx"] + [(F.max(k) + 1).alias(f"hi_{k}") for k in "zyx"]
    return rows.groupBy("vol", "label").agg(*ends)


def region_props(runs: DataFrame, keys: list[str], shape: tuple[int, int], least_area: int = 10, least_side: int = 5, most: float = 0.95) -> DataFrame:
    """Area, box and centroid of every component of runs (keys, y, x0, x1); small and nearly frame-filling ones are dropped."""
    n = F.expr("cast(x1 - x0 + 1 as long)")
    found = runs.groupBy(*keys).agg(F.sum(n).alias("area"), F.min("y").alias("y0"), F.min("x0").alias("_x0"), (F.max("y") + 1).alias("y1"), (F.max("x1") + 1).alias("_x1"), F.sum(F.col("y") * n).alias("_cy"), F.sum(F.expr("(x0 + x1) * cast(x1 - x0 + 1 as long) div 2")).alias("_cx"))
    found = found.select(*keys, "area", "y0", F.col("_x0").alias("x0"), "y1", F.col("_x1").alias("x1"), (F.col("_cy") / F.col("area")).alias("cy"), (F.col("_cx") / F.col("area")).alias("cx"))
    h, w, side = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.lit(most * max(shape))
    return found.filter((F.col("area") >= least_area) & (h >= least_side) & (w >= least_side) & (h <= side) & (w <= side))


def box_prompts(props: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(.., label_id, x0, y0, x1, y1) with inclusive ends; survivors numbered from 1 by ``number``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return props.select(*keys, F.col(number), place.alias("label_id"), "x0", "y0", (F.col("x1") - 1).alias("x1"), (F.col("y1") - 1).alias("y1"))


def renumbered(runs: DataFrame, keys: list[str], number: str, shape: tuple[int, int], least_area: int = 10, least_side: int = 5, most: float = 0.95) -> DataFrame:
    """``runs`` (keys, number, y, x0, x1) with ``label_id``: the components that ``region_props`` keeps, numbered from 1 by ``number``; 0 for the others.

    Windows over a slice's runs, so that they are dealt once and meet in no join.
    """
    runs = runs.repartition(*keys)
    own = Window.partitionBy(*keys, number)
    h, w, side = F.max("y").over(own) + 1 - F.min("y").over(own), F.max("x1").over(own) + 1 - F.min("x0").over(own), F.lit(most * max(shape))
    found = runs.withColumns({"_n": F.sum(F.expr("cast(x1 - x0 + 1 as long)")).over(own), "_h": h, "_w": w})
    kept = (F.col("_n") >= least_area) & (F.col("_h") >= least_side) & (F.col("_w") >= least_side) & (F.col("_h") <= side) & (F.col("_w") <= side)
    # Dropped components come last, so they take no number from the others.
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("_kept").desc(), number))
    return found.withColumn("_kept", kept).withColumn("label_id", F.when(F.col("_kept"), place).otherwise(0)).drop("_n", "_h", "_w", "_kept")


def foreground_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(.., ids, n): sorted distinct labels."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("ids"), F.count_distinct("label").alias("n"))


def fp_fn(rows: DataFrame, keys: list[str], pred: Column, truth: Column) -> DataFrame:
    """(.., fp, fn) counts of places."""
    return rows.groupBy(*keys).agg(F.count_if(pred & ~truth).alias("fp"), F.count_if(truth & ~pred).alias("fn"))


def best_overlap(component: DataFrame, labels: DataFrame, target: Column) -> DataFrame:
    """(keys, label, n): the label, other than the target, with most places inside each component; the lowest on ties."""
    counts = component.join(labels, ["vol", "z", "y", "x"]).filter(F.col("label") != target).groupBy("vol", "component", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("vol", "component").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"))
    return best.select("vol", "component", (-F.col("b.l")).alias("label"), "b.n")


def iou(pred: Column, truth: Column) -> Column:
    """Intersection over union of thresholded maps; 1 where both are empty."""
    p, t = pred > 0.5, truth >= 0.5
    union = F.count_if(p | t)
    return F.when(union == 0, 1.0).otherwise(F.count_if(p & t) / union)


def soft_dice(pred: Column, truth: Column, eps: float = 1.0) -> Column:
    """1 - (2 sum(pt) + 1) / (sum(p) + sum(t) + 1)."""
    return 1 - (2 * F.sum(pred * truth) + eps) / (F.sum(pred) + F.sum(truth) + eps)


def bce(logit: Column, truth: Column) -> Column:
    """Binary cross entropy with logits of one place."""
    return F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))


def weighted_mean(loss: Column, weight: Column) -> Column:
    """sum(l w) / max(sum(w), 1)."""
    return F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def smooth_l1(difference: Column) -> Column:
    """0.5 d**2 below 1, d - 0.5 above."""
    d = F.abs(difference)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def boundary_loss(dense: DataFrame, axes: str) -> DataFrame:
    """``dense`` (place, label, p) with ``boundary``: mean over the axes of the smooth L1 of |step of p| against the affinity.

    Two axes take the affinity of slices, three that of volumes.
    """
    rows = (stencil.affinity_3d if len(axes) == 3 else stencil.affinity_2d)(dense)
    steps = [F.coalesce(F.abs(F.lead("p").over(stencil._line(k)) - F.col("p")), F.lit(0.0)) for k in axes]
    for i, step in enumerate(steps):
        rows = rows.withColumn(f"_b{i}", smooth_l1(step - F.col(f"aff{i}")))
    names = [f"_b{i}" for i in range(len(axes))]
    return rows.withColumn("boundary", sum(map(F.col, names), F.lit(0.0)) / len(axes)).drop(*names)


def summed_mse(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean squared errors of pairs of arrays, a mean for each pair over all its elements, summed."""
    total = F.lit(0.0)
    for pred, target in pairs:
        errors = F.aggregate(F.zip_with(pred, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
        total = total + F.sum(errors) / F.sum(F.size(pred))
    return total


def total_loss(logit: Column, truth: Column, boundary: Column, weights: tuple[float, float, float] = (1.0, 1.0, 0.3)) -> Column:
    """Weighted sum of mean BCE with logits, soft Dice of the probabilities, and mean boundary loss of a group of places."""
    prob = 1 / (1 + F.exp(-logit))
    return weights[0] * F.avg(bce(logit, truth)) + weights[1] * soft_dice(prob, truth) + weights[2] * F.avg(boundary)


def epoch_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(.., batch_mean, sample_mean): mean of the batches, and weighted by their samples; NaN where empty."""
    nan = F.lit(float("nan"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg("loss"), nan).alias("batch_mean"), F.coalesce(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), nan).alias("sample_mean"))


def multistep_loss(rows: DataFrame, decay: float, boost: float, weights: tuple[float, float, float] = (1.0, 1.0, 0.3), strict: bool = True) -> DataFrame:
    """(run, loss, last_step, final_loss) of rows (run, sample, step, bce, dice, boundary, valid).

    Steps count up to the first without valid samples, weighted by decay**step;
    the Dice part of step 0 is boosted. ``final_loss`` takes each sample's last
    valid step (its first without any). A run without a step is an error, or has no row if not ``strict``.
    """
    mean = lambda part: F.sum(F.col(part) * F.col("valid")) / F.greatest(F.sum("valid"), F.lit(1))
    steps = rows.groupBy("run", "step").agg(F.sum("valid").alias("n"), *(mean(p).alias(p) for p in ("bce", "dice", "boundary")))
    gap = steps.groupBy("run").agg(F.min(F.when(F.col("n") == 0, F.col("step"))).alias("gap"), F.min("step").alias("_first"))
    if strict:
        gap = gap.filter(F.when(F.expr("gap is null or gap > _first"), True).otherwise(F.raise_error(F.lit("no valid step")).cast("boolean")))
    inside = F.expr("gap is null or step < gap")
    kept = steps.join(gap, "run").filter(inside)
    boosted = weights[1] * F.when(F.col("step") == 0, boost).otherwise(1.0)
    loss, weight = weights[0] * F.col("bce") + boosted * F.col("dice") + weights[2] * F.col("boundary"), F.pow(F.lit(decay), F.col("step"))
    total = kept.groupBy("run").agg((F.sum(weight * loss) / F.sum(weight)).alias("loss"), F.max("step").alias("last_step"))
    parts = F.struct("bce", "dice", "boundary")
    own = rows.join(gap, "run").filter(inside).groupBy("run", "sample").agg(F.max_by(parts, F.when(F.col("valid") > 0, F.col("step"))).alias("_last"), F.min_by(parts, "step").alias("_any"))
    last = own.select("run", F.coalesce("_last", "_any").alias("l"))
    final = last.groupBy("run").agg((weights[0] * F.avg("l.bce") + weights[1] * F.avg("l.dice") + weights[2] * F.avg("l.boundary")).alias("final_loss"))
    return total.join(final, "run")


def best_so_far(epochs: DataFrame, patience: int) -> DataFrame:
    """(run, epoch, loss, improves, waited): until ``waited`` reaches the patience; later epochs are dropped."""
    past = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = F.min("loss").over(past)
    rows = epochs.withColumn("improves", best.isNull() | (F.col("loss") < best))
    rows = rows.withColumn("_group", F.sum(F.col("improves").cast("int")).over(here))
    since = Window.partitionBy("run", "_group").orderBy("epoch")
    rows = rows.withColumn("waited", F.row_number().over(since) - 1)
    stop = F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    return rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop"))).drop("_group", "_stop")


def top_checkpoints(epochs: DataFrame, k: int, patience: int) -> DataFrame:
    """(run, epoch, loss, rank): the k lowest losses among the epochs that improve."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy("loss", "epoch"))
    return best_so_far(epochs, patience).filter("improves").withColumn("rank", rank).filter(F.col("rank") <= k).select("run", "epoch", "loss", "rank")


def first_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of points at one place the first by ``n``, whatever its polarity."""
    best = points.groupBy(*keys, "x", "y").agg(F.min(F.struct("n", "polarity")).alias("b"))
    return best.select(*keys, "x", "y", "b.n", "b.polarity")
