"""Every query with an oracle against DuckDB at the smallest scale; the others by invariants."""

from __future__ import annotations

import dataclasses
import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom import registry
from strataloom.functions import kernels
from strataloom.operators import blocks, descriptors, prompts, splits, stencil
from strataloom.sources import fixture as fx
from tests import plain as plain_forms

DATA = "/root/testdata/sf0.001"
PLACE = ["vol", "z", "y", "x"]


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def run(spark, name):
    return registry.queries()[name](spark, DATA)


#: Queries of many steps: ``test_episodes`` holds what they are made of, and runs it twice.
LONG = {"prm_correction", "prm_episode", "prm_episode_map", "prm_episode_plus", "prm_episode_plus_state", "prm_export_points", "prm_initial", "prm_next_click", "sink_prompt_export"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - LONG))
def test_seeded_queries_agree_on_reruns(spark, name):
    first, again = (Counter(map(str, run(spark, name).collect())) for _ in range(2))
    assert first and first == again


@pytest.mark.parametrize("name", ["prm_correction", "prm_episode_map", "prm_episode_plus_state", "prm_next_click"])
def test_long_queries_have_rows(spark, name):
    assert not run(spark, name).isEmpty()


def test_points_lie_in_their_instances(spark):
    voxels = fx.voxels(spark, DATA)
    for name in ("prm_target_points", "prm_initial"):
        points = run(spark, name)
        points = points.filter("polarity = 1") if "polarity" in points.columns else points
        assert points.join(voxels, [*PLACE, "label"], "left_anti").count() == 0


def test_draws_are_balanced(spark):
    counts = [r["count"] for r in run(spark, "smp_balanced_draw").groupBy("source").count().collect()]
    n = fx.slices(spark, DATA).count()
    assert sum(counts) == n
    assert all(abs(c - n / len(counts)) < 5 * (n / len(counts)) ** 0.5 for c in counts)


def test_an_epoch_draws_as_often_as_the_pool_has_rows(spark):
    assert run(spark, "smp_balanced_draw").count() == fx.slices(spark, DATA).count()


def test_draws_reach_every_place_of_a_source(spark):
    rows = spark.range(300).selectExpr("id % 3 * (id % 2) as source", "id as n")
    found = splits.balanced_draw(rows, ["n"], 20_000, 11)
    counts = [r["count"] for r in found.groupBy("source").count().collect()]
    assert sum(counts) == 20_000 and max(counts) < 1.1 * min(counts)
    assert found.select("source", "n").distinct().count() == 300
    assert found.select("source", "place", "n").distinct().count() == 300
    sizes = {r.source: (r.low, r.high, r.n) for r in found.groupBy("source").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("place").alias("n")).collect()}
    assert all(low == 0 and high == n - 1 for low, high, n in sizes.values())


def test_point_maps_take_all_events(spark):
    events = fx.table(spark, DATA, "events").selectExpr("user_id % 200 as sample", "event_id % 17 as x", "event_id % 13 as y", "event_id as n", "case when user_id % 200 < 50 then 0 else cast(event_id % 3 > 0 as int) end as polarity").collect()
    points, maps = {}, {}
    for e in sorted(events, key=lambda e: e.n):
        points.setdefault((e.sample, e.x, e.y), e.polarity)
    for (sample, x, y), polarity in points.items():
        grid = [(2 * polarity - 1) * math.exp(-((b - x) ** 2 + (a - y) ** 2) / 60) for a in range(13) for b in range(17)]
        total, most = maps.get(sample, ([0.0] * 221, 0))
        maps[sample] = [s + g for s, g in zip(total, grid, strict=True)], max(most, polarity)
    found = {(r.sample, r.y, r.x): r.prompt for r in run(spark, "prm_point_map").collect()}
    bare = {r.k for r in fx.table(spark, DATA, "orders").selectExpr("o_orderkey % 220 as k").distinct().collect()} - set(maps)
    assert bare and len(found) == 221 * (len(maps) + len(bare))
    assert all(v == s % 2 for (s, *_), v in found.items() if s in bare)
    for sample, (total, most) in maps.items():
        for i, v in enumerate(total):
            assert abs(found[sample, i // 17, i % 17] - (v if most else 2 * v + 1)) < 2e-5


def test_batches_are_full_permutations(spark):
    found = run(spark, "smp_shuffle_batches")
    sizes = {r["count"] for r in found.groupBy("batch").count().collect()}
    assert sizes == {16} and found.distinct().count() == found.count()


def test_tiles_equal_whole_instances(spark):
    rows = fx.voxels(spark, DATA).filter("vol < 2")
    shape = (fx.DEPTH, fx.HEIGHT, fx.WIDTH)
    whole = descriptors.volume_3d(rows, shape, shape)
    for tile in ((4, 8, 8), (8, 32, 10)):
        tiled = descriptors.volume_3d(rows, shape, tile).withColumnRenamed("lsd", "other")
        pairs = whole.join(tiled, [*PLACE, "label"])
        worst = pairs.select(F.max(F.expr("aggregate(zip_with(lsd, other, (a, b) -> abs(a - b)), 0D, (m, v) -> greatest(m, v))"))).first()[0]
        assert pairs.count() == whole.count() and worst < 1e-9


def test_empty_tables(spark):
    empty = fx.voxels(spark, DATA).filter("vol < 0")
    assert stencil.touching_pairs(empty).count() == 0
    assert stencil.instance_edt(empty).count() == 0


def by_slice(spark):
    found = {}
    for r in fx.voxels(spark, DATA).collect():
        found.setdefault((r.vol, r.z), {}).setdefault(r.label, set()).add((r.y, r.x))
    return found


def test_random_mixes_follow_their_rules(spark):
    labels, mixes = by_slice(spark), {}
    for r in run(spark, "prm_random_mix").collect():
        mixes.setdefault(r.sam, {}).setdefault((r.vol, r.z), []).append(r)
    every = {tuple(r) for r in fx.grid(spark, DATA).select("vol", "z").distinct().collect()}
    for sam, slices in mixes.items():
        assert set(slices) == every
        wholes, styles = 0, set()
        for key, rows in slices.items():
            if key not in labels:
                assert [tuple(r)[5:12] for r in rows] == [(0,) * 7 if sam else (None,) * 7]
                continue
            assert sorted(r.label for r in rows) == sorted(labels[key])
            assert len({r.whole for r in rows}) == 1
            whole, inside = rows[0].whole, [r for r in rows if r.included]
            wholes += whole
            assert inside and not (sam and whole)
            if whole:
                assert len(inside) == len(rows) and all(r.polarity is None and r.x0 is None for r in rows)
                continue
            for r in rows:
                places = labels[key][r.label]
                assert r.polarity is None or ((r.y, r.x) in places and r.polarity == r.included)
                box = (min(x for _, x in places), min(y for y, _ in places), max(x for _, x in places), max(y for y, _ in places))
                assert (r.x0, r.y0, r.x1, r.y1) == (box if r.included else (None,) * 4)
            # All or none of the included (excluded) instances have a point; a single included one always.
            assert len({r.polarity is None for r in inside}) == 1 and len({r.polarity is None for r in rows if not r.included}) <= 1
            assert len(inside) > 1 or inside[0].polarity == 1
            styles.add((inside[0].polarity, next((r.polarity for r in rows if not r.included), None)))
        assert {(1, 0), (1, None), (None, 0)} <= styles
        assert wholes == 0 if sam else 0.25 * len(labels) < wholes < 0.75 * len(labels)


def test_masks_hold_the_included_instances(spark):
    for name, mask, keys in (("prm_random_mix", "prm_random_mix_mask", ["vol", "z"]), ("prm_mask_3d", "prm_mask_3d_voxels", ["vol", "z0"])):
        prompts = run(spark, name)
        prompts = prompts.filter("not sam") if "sam" in prompts.columns else prompts
        inside = {tuple(r) for r in prompts.filter("included").select(*keys, "label").collect()}
        rows = fx.voxels(spark, DATA)
        if "z0" in keys:
            rows = rows.withColumn("z0", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("z between z0 and z0 + 3")
        want = Counter(tuple(r) for r in rows.select(*keys, *(c for c in PLACE if c not in keys), "label").collect() if (r[keys[0]], r[keys[1]], r.label) in inside)
        found = run(spark, mask)
        assert Counter(tuple(r) for r in found.select(*keys, *(c for c in PLACE if c not in keys), "label").collect()) == want


def test_slab_points_lie_in_the_first_slice(spark):
    labels = by_slice(spark)
    rows = run(spark, "prm_mask_3d").collect()
    assert {(r.vol, r.z0, r.label) for r in rows} == {(*k, label) for k, found in labels.items() if k[1] <= 4 for label in found}
    assert all(r.polarity is None if r.whole else r.polarity is None or (r.polarity == r.included and (r.y, r.x) in labels[r.vol, r.z0][r.label]) for r in rows)
    assert {r.whole for r in rows} == {True, False}


def test_one_window_for_every_slice(spark):
    labels = by_slice(spark)
    rows = run(spark, "prm_instance_crop_one").collect()
    assert len(rows) == len({(r.vol, r.z) for r in rows}) == fx.grid(spark, DATA).select("vol", "z").distinct().count()
    every = {tuple(r) for r in run(spark, "prm_instance_crop").select("vol", "z", "label", "y0", "x0").collect()}
    for r in rows:
        if (r.vol, r.z) in labels:
            # Erosion inside the window may leave nothing of the instance: then its id goes, its window stays.
            if r.label is None:
                assert (r.vol, r.z, r.y0, r.x0) in {(e[0], e[1], e[3], e[4]) for e in every}
                continue
            assert tuple(r) in every
            assert all(0 <= y - r.y0 < 20 and 0 <= x - r.x0 < 20 for y, x in labels[r.vol, r.z][r.label]) or max(max(c) - min(c) for c in zip(*labels[r.vol, r.z][r.label], strict=True)) >= 20
        else:
            assert (r.label, r.y0, r.x0) == (None, 6, 6)


def test_random_crops_are_windows_of_the_slices(spark):
    labels, found = by_slice(spark), {}
    for r in run(spark, "prj_random_crop").collect():
        found.setdefault((r.vol, r.z), set()).add((r.y, r.x, r.label))
    starts = set()
    for key, rows in found.items():
        every = {(y, x, label) for label, places in labels[key].items() for y, x in places}
        fits = [(a, b) for a in range(13) for b in range(13) if {(y - a, x - b, v) for y, x, v in every if 0 <= y - a < 20 and 0 <= x - b < 20} == rows]
        assert fits
        starts.add(fits[0])
    assert len(starts) > len(found) / 3


def test_plans_stay_in_their_ranges(spark):
    rows = run(spark, "prj_aug_plan").collect()
    assert all(r.turns in range(4) and 0.8 <= r.alpha <= 1.2 and -0.2 <= r.beta <= 0.2 and r.y0 >= 0 and r.x0 >= 0 for r in rows)
    for share in (sum(r.flip_rows for r in rows), sum(r.flip_cols for r in rows), sum(r.turns > 0 for r in rows), sum(r.transpose for r in rows), sum(r.alpha != 1 for r in rows)):
        assert abs(share - 0.3 * len(rows)) < 5 * (0.21 * len(rows)) ** 0.5


@pytest.mark.parametrize("odds", [0.0, 0.55, 1.0])
def test_bad_predictions_follow_their_rules(spark, odds):
    labels, near = by_slice(spark), {}
    rows = fx.voxels(spark, DATA)
    pairs = stencil.touching_pairs(rows).cache()
    for r in pairs.collect():
        near.setdefault((r.vol, r.z, r.label), set()).add(r.other)
    places = prompts.simulated_places(rows, pairs, 5, dataclasses.replace(prompts.SPOILING, merge_odds=odds)).cache()
    pred = {}
    for r in places.collect():
        pred.setdefault((r.vol, r.z, r.label), {})[r.y, r.x] = r.mine
    shares, kinds = [], Counter()
    for (vol, z), found in labels.items():
        for label, own in found.items():
            mask, got = np.zeros((32, 32), bool), pred.get((vol, z, label), {})
            mask[tuple(np.array(sorted(own)).T)] = True
            assert all(mine == (at in own) for at, mine in got.items())
            others = {next(k for k, v in found.items() if at in v) for at, mine in got.items() if not mine}
            assert len(others) <= 1 and others <= near.get((vol, z, label), set())
            eroded = [{tuple(map(int, at)) for at in np.argwhere(plain_forms.erode(mask, k, False))} for k in range(5)]
            if odds == 0 or (vol, z, label) not in near:
                assert set(got) in eroded[1:]
                kinds["eroded"] += 1
            elif odds == 1:
                assert {at for at, mine in got.items() if mine} == own
                kinds["merged"] += len(others)
                shares += [(sum(not m for m in got.values()), len(found[o])) for o in others]
    if odds == 1:
        merged, of = map(sum, zip(*shares, strict=True))
        assert kinds["merged"] > 20 and abs(merged / of - 0.45) < 0.05
    errors = {(r.vol, r.z, r.label): (r.area, r.fp, r.fn) for r in prompts.simulated(rows, places).collect()}
    for (vol, z), found in labels.items():
        for label, own in found.items():
            got = pred.get((vol, z, label), {})
            assert errors[vol, z, label] == (len(own), sum(not m for m in got.values()), len(own) - sum(got.values()))


def test_merged_predictions_erode_as_a_whole(spark):
    # Two 9 x 9 squares side by side; merging everything and eroding k times leaves the joint rectangle's inside.
    rows = spark.createDataFrame([(v, 0, y, x, 1 + x // 9) for v in range(40) for y in range(9) for x in range(18)], "vol int, z int, y int, x int, label int")
    rules = dataclasses.replace(prompts.SPOILING, merge_odds=0.5, merge_share=1.0)
    found = {}
    for r in prompts.simulated_places(rows, stencil.touching_pairs(rows), 5, rules).collect():
        found.setdefault((r.vol, r.label), set()).add((r.y, r.x))
    shapes = Counter()
    for (_, label), got in found.items():
        joint = any(x // 9 + 1 != label for _, x in got)
        low, high = (0, 18) if joint else (9 * (label - 1), 9 * label)
        fits = [k for k in range(5) if got == {(y, x) for y in range(k, 9 - k) for x in range(low + k, high - k)}]
        assert len(fits) == 1
        shapes[joint, fits[0] > 0] += 1
    assert len(found) == 80 and len(shapes) == 4


def test_the_export_is_written_whole(spark):
    found = run(spark, "sink_prompt_export").cache()
    n = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    points = {(r.layer, r.label_id, r.point_id, r.x, r.y) for r in found.filter("kind = 'point'").collect()}
    assert points == {(f"{r.vol * 8 + r.z:06d}", r.label_id, r.point_id, r.x, r.y) for r in run(spark, "prm_export_points").collect()}
    boxes = {(r.layer, r.label_id): (r.x0, r.y0, r.x1, r.y1) for r in found.filter("kind = 'box'").collect()}
    assert boxes == {(f"{r.vol * 8 + r.z:06d}", r.label_id): (r.x0, r.y0, r.x1, r.y1) for r in run(spark, "agg_box_prompts").collect()}
    saved = {(r.layer, r.y, x): r.label_id for r in found.filter("kind = 'label'").collect() for x in range(r.x0, r.x1 + 1)}
    assert saved == {(f"{r.vol * 8 + r.z:06d}", r.y, r.x): r.label_id for r in run(spark, "agg_renumber").filter("label_id > 0").collect()}
    assert n["point"] == 5 * n["box"] and found.filter("kind = 'slice'").agg(F.sum("instance_count")).first()[0] == n["box"]


def test_crops_lose_an_instance_that_erosion_removes(spark):
    # A bar of two rows goes, a square of three stays, and at the window's edge nothing erodes.
    rows = [(1, 0, y, x, 1) for y in (5, 6) for x in range(3, 9)] + [(1, 1, y, x, 2) for y in range(4, 7) for x in range(4, 7)] + [(1, 2, y, x, 3) for y in range(4, 6) for x in range(0, 8)]
    rows = spark.createDataFrame(rows, "vol int, z int, y int, x int, label int")
    crops = spark.createDataFrame([(1, 0, 1, 0, 0), (1, 1, 2, 2, 2), (1, 2, 3, 4, 2), (1, 3, None, 2, 2)], "vol int, z int, label int, y0 int, x0 int")
    assert {r.z: r.label for r in prompts.surviving(crops, rows, 10).collect()} == {0: None, 1: 2, 2: 3, 3: None}


def test_random_neighbours_of_a_crop(spark):
    boxes = spark.createDataFrame([(1, 0, k, 10 * k, 0, 10 * k + 5, 5) for k in range(12)], "vol int, z int, label int, lo_y int, lo_x int, hi_y int, hi_x int")
    pairs = spark.createDataFrame([(1, 0, 5, k) for k in range(12) if k != 5], "vol int, z int, label int, other int")
    own = boxes.filter("label = 5").select("vol", "z", "label")
    wide, narrow = (prompts.instance_crops(boxes, pairs, 130, (130, 130), 3, halo=0, chosen=own, most=n).first().overlap for n in (11, 1))
    assert wide == 115 * 5 and narrow < wide


def test_prompts_reach_as_far_as_the_references_rounds(spark):
    """64 rounds of the positive spread and 32 of the negative, over whole planes."""
    shape = (fx.DEPTH, fx.HEIGHT, fx.WIDTH)
    label = np.zeros((40, *shape), int)
    for r in fx.dense(spark, DATA).filter("label > 0").collect():
        label[r.vol, r.z, r.y, r.x] = r.label
    z, y, x = np.indices(shape)
    soft = np.where(label > 0, (label * 7 + x + 2 * y + z) % 11 / 10, 0)
    prompt = (label * 3 + x * 5 + y * 7 + z) % 21 / 10 - 1
    weights = blocks.reach_weights(label, soft)
    good = kernels.spread(np.clip((prompt - 0.7) / 0.3, 0, 1), *weights, 64)
    bad = kernels.spread(np.clip((-prompt - 0.2) / 0.8, 0, 1), *weights, 32)
    want = np.clip(good - 0.85 * bad, 0, 1) * (label > 0)
    found = run(spark, "nbr_prompt_reach").collect()
    got = np.array([r.prior for r in found])
    assert np.abs(got - want[tuple(np.array([(r.vol, r.z, r.y, r.x) for r in found]).T)]).max() < 1e-5
