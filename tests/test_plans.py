"""Plans of queries over volumes: what is dealt, what is broadcast, and over how many tasks."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from strataloom import registry
from strataloom.operators import blocks, catalog, prompts, samples, stencil
from strataloom.plans import samples as plans_samples
from strataloom.plans.stencil import tiles
from strataloom.sources import fixture as fx
from strataloom.sources import stage

DATA = "/root/testdata/sf0.01"


def plan(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", [
    "agg_best_overlap", "agg_boundary_loss", "agg_total_loss", "lsd_instance_3d", "lsd_slice_2d", "nbr_erode_once", "nbr_erode_k", "nbr_prompt_reach", "nbr_touching_pairs", "prj_binarize", "prj_brightness",
    "prj_color_to_id", "prj_common_shape", "prj_fg_bbox_crop", "prj_minmax", "prj_offset_align", "prj_pad_voxels", "prj_raw_uint8",
])
def test_no_voxels_are_broadcast(spark, name):
    """Rows that were unfolded are many more than Spark takes them for; none of their joins may be planned as a broadcast."""
    found = plan(registry.queries()[name](spark, DATA))
    assert "BroadcastHashJoin" not in found
    # The cross joins of the fixture broadcast a range of places or offsets.
    assert all("Cross" in line for line in found.splitlines() if "BroadcastNestedLoopJoin" in line)


def test_tasks_follow_the_parts(spark, monkeypatch):
    monkeypatch.setattr(fx, "PARTS", 50)
    for rows in (fx.voxels(spark, DATA), fx.dense(spark, DATA)):
        assert rows.rdd.getNumPartitions() == 40


@pytest.mark.parametrize("name", ["agg_boundary_loss", "agg_instance_bbox", "nbr_binary_erode", "nbr_edt", "nbr_erode_k", "prj_border_crop", "prm_component_center", "prm_fps", "prm_interior_strict", "prm_one_click"])
def test_volumes_stay_where_they_are(spark, name):
    """Only parts are dealt, by volume; whatever follows inside volumes moves no row."""
    found = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", found)
    assert dealt and all(kind == "REPARTITION_BY_NUM" for _, kind in dealt)


def test_labels_of_one_place_are_eroded_by_themselves(spark):
    rows = [(0, 0, y, x, 1) for y in range(3) for x in range(3)] + [(0, 0, 1, 1, 2)]
    frame = spark.createDataFrame(rows, "vol int, z int, y int, x int, label int")
    left = stencil.erode_k(frame, 1, "yx", (1, 3, 3), 0)
    assert [tuple(r) for r in left.collect()] == [(0, 0, 1, 1, 1)]
    assert {(r.label, r.other) for r in stencil.touching_pairs(frame).collect()} == {(1, 2), (2, 1)}


def test_spread_points_stop_when_places_run_out(spark):
    rows = [(0, 0, 1, 0, x, 1) for x in range(2)] + [(0, 0, 2, 0, x, 1) for x in range(5)]
    places = spark.createDataFrame(rows, "vol int, z int, label int, y int, x int, d2 long")
    points = lambda wanted: sorted((r.label, r["rank"], r.x) for r in prompts.spread_points(places, 3, wanted).collect())
    assert points(None) == [(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 4), (2, 2, 2)]
    wanted = spark.createDataFrame([(0, 0, 2, 2)], "vol int, z int, label int, wanted int")
    assert points(wanted) == [(1, 0, 0), (2, 0, 0), (2, 1, 4)]


def test_a_source_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(2000).selectExpr("0 as source", "lpad(cast(id as string), 6, '0') as layer", "1 as instance_count")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.write_prompts(str(tmp_path), {"slice": rows})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("slice/source=0/*.csv"))) > 1
    back = spark.read.csv(str(tmp_path / "slice"), header=True)
    assert back.select(F.count_distinct("layer")).first()[0] == 2000


@pytest.mark.parametrize("name", ["lsd_instance_3d", "lsd_slice_2d"])
def test_descriptors_are_made_where_their_volume_is(spark, name):
    found = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", found)
    assert dealt and all(kind == "REPARTITION_BY_NUM" for _, kind in dealt)


@pytest.mark.parametrize("name", ["prj_minmax", "prj_raw_uint8", "prj_offset_align", "prj_pad_crop"])
def test_rows_of_volumes_meet_without_a_join(spark, name):
    """Ranges, shifted places and padding are found where the volume is, by windows or one aggregation."""
    found = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", found)
    assert "Join" not in found.replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert dealt and all(kind == "REPARTITION_BY_NUM" for _, kind in dealt)


def test_padding_keeps_to_volumes(spark):
    """Rows of volumes are dealt once made distinct; the padded places are not."""
    found = registry.queries()["prj_pad_voxels"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in found
    assert not re.findall(r"Exchange hashpartitioning\([^)]*, [zyx]#[^)]*\)", found)


def test_blocks_are_packed_once_where_their_volume_is(spark, monkeypatch):
    """Cells of volumes that are dealt alike are neither joined nor sent, and an erosion that reads blocks twice packs them once."""
    executed = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    eroded = executed(registry.queries()["nbr_erode_once"](spark, DATA))
    assert "collect_list(_cell#" not in eroded
    kept = []
    monkeypatch.setattr(blocks, "staged", lambda frame, name: kept.append(frame) or frame)
    held = tiles(fx.voxels(spark, DATA), spark, DATA)
    found = executed(kept[0] if kept else held)
    assert "SortMergeJoin" not in found
    assert not re.findall(r"Exchange hashpartitioning\([^)]*, b[zyx]#[^)]*\)", found)


def test_missed_samples_are_described_by_many_tasks(spark, monkeypatch):
    """Their tasks follow the number of samples, whatever their bytes."""
    monkeypatch.setattr(samples, "MISSED", 1, raising=False)
    found = registry.queries()["lsd_cache_miss"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\), (\w+)", found.partition("FlatMapGroupsInArrow")[2])
    keys, tasks, kind = below[0]
    assert re.fullmatch(r"vol#\d+L?", keys) and kind == "REPARTITION_BY_NUM" and int(tasks) > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["prm_correction", "prm_episode", "prm_episode_map", "prm_episode_plus", "prm_episode_plus_state", "prm_initial", "prm_next_click", "prm_simulate_pred_mask"])
def test_episodes_broadcast_no_rows(spark, monkeypatch, name):
    """Places and instances that are staged are few bytes and many rows: no step of an episode may broadcast any."""
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **kwargs: plans.append(self._df._jdf.queryExecution().sparkPlan().toString()) or write(self, *args, **kwargs))
    plans.append(plan(registry.queries()[name](spark, "/root/testdata/sf0.001")))
    lines = [line for p in plans for line in p.splitlines()]
    assert [line.strip() for line in lines if "BroadcastHashJoin" in line or ("BroadcastNestedLoopJoin" in line and "Cross" not in line)] == []


def test_few_rows_of_arrays_are_unpacked_together(spark, tmp_path):
    """Arrays that pack to nothing still lie in row groups of few rows, and Python gets few at once; the session's limits stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    count = F.arrow_udf(lambda a: pa.array([len(a)] * len(a)), "int")
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(repeat('a', 4000) as binary) as held").withColumn("n", count("id"))
    found = stage.staged_arrays(rows, "held")
    assert found.agg(F.max("n")).first()[0] <= stage.FEW and spark.conf.get(key) == before
    held = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in found.inputFiles()]
    assert max(m.row_group(i).num_rows for m in held for i in range(m.num_row_groups)) <= stage.FEW


def test_cached_blocks_are_staged_a_few_at_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(plans_samples, "staged_arrays", lambda frame, name: kept.append(name) or frame)
    plans_samples.cache(spark, "/root/testdata/sf0.001")
    assert kept == ["cache"]
