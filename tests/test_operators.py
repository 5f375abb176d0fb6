"""Errors, modes and edge cases of operators, on small made rows."""

from __future__ import annotations

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import arrays, blocks, catalog, chunks, clean, prompts, scores, splits


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_a_missing_slice_is_an_error(spark):
    slices, files = spark.createDataFrame([(1,), (2,)], "n long"), spark.createDataFrame([("01.png",), ("1.png",), ("x.png",)], "name string")
    assert rows_of(catalog.slice_file_match(slices.filter("n = 1"), files)) == [(1, "01.png")]
    assert {r.name for r in catalog.slice_file_match(slices, files, strict=False).collect()} == {"01.png", None}
    with pytest.raises(Exception, match="no mask file"):
        catalog.slice_file_match(slices, files).collect()


def test_a_missing_label_slice_is_an_error(spark):
    images, labels = spark.createDataFrame([(0, 1), (0, 2)], "vol int, z int"), spark.createDataFrame([(0, 7, 5)], "vol int, number int, n_fg int")
    assert rows_of(catalog.inverted_z_join(images.filter("z = 1"), labels, 8, 0)) == [(0, 1, 1, 7, 5)]
    with pytest.raises(Exception, match="no label slice"):
        catalog.inverted_z_join(images, labels, 8, 0).collect()


@pytest.mark.parametrize(("skip", "overwrite", "whole"), [(True, True, "skip"), (True, False, "skip"), (False, True, "write"), (False, False, "fail")])
def test_resume_modes(spark, skip, overwrite, whole):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item int")
    made = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "item int, kind string")
    assert rows_of(catalog.resume_status(items, made, 2, F.lit(skip), F.lit(overwrite))) == [(1, whole), (2, "write"), (3, "write")]


def test_chunks_are_no_longer_than_the_volume():
    assert catalog.capped((10, 512, 512, 32), (6, 600, 40, 32)) == (6, 512, 40, 32)


def test_chunks_are_written_whole_and_in_order(spark, tmp_path):
    rng, shape, n = np.random.default_rng(1), (5, 7, 6), 13
    array = rng.integers(0, 5, (n, *shape)).astype(np.float32)
    names = [f"c{k}" for k in range(n)]
    rows = spark.createDataFrame([(v, z, y, x, *array[:, z, y, x].tolist()) for v in (3, 4) for z, y, x in np.ndindex(shape)], "vol int, z int, y int, x int, " + ", ".join(f"{c} float" for c in names))
    volumes = spark.createDataFrame([(v, *shape) for v in (3, 4)], "vol int, nz int, ny int, nx int")
    tile = catalog.capped((2, 16, 4), shape)
    held = blocks.to_blocks(rows, volumes, tile, dict.fromkeys(names, "float32")).withColumn("source", F.lit(8))
    chunks.write(chunks.chunked(held, names, "float32"), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert {r.dc for r in back.filter("bc = 0").collect()} == {10} and {r.dc for r in back.filter("bc = 1").collect()} == {3}
    assert back.count() == 2 * 2 * 3 * 1 * 2
    for r in back.collect():
        part = array[10 * r.bc : 10 * r.bc + r.dc, r.z0 : r.z0 + r.dz, r.y0 : r.y0 + r.dy, r.x0 : r.x0 + r.dx]
        assert (np.frombuffer(r.data, np.float32).reshape(r.dc, r.dy, r.dx, r.dz) == part.transpose(0, 2, 3, 1)).all()
    for file in {r.f for r in back.select(F.input_file_name().alias("f")).distinct().collect()}:
        keys = [tuple(r[c] for c in chunks.ORDER) for r in spark.read.parquet(file).coalesce(1).collect()]
        assert keys == sorted(keys)
    found = {(r.vol, r.z, r.y, r.x, r.bc): r["values"] for r in chunks.voxels(back, "float32").collect()}
    for v, (z, y, x), bc in ((v, at, bc) for v in (3, 4) for at in np.ndindex(shape) for bc in (0, 1)):
        own = array[10 * bc : 10 * bc + 10, z, y, x].tolist()
        assert found.get((v, z, y, x, bc)) == (own if any(own) else None)


def test_array_files(spark):
    def content(data, version=None):
        file = io.BytesIO()
        np.lib.format.write_array(file, data, version)
        return file.getvalue()

    rng, whole = np.random.default_rng(3), {}
    for i, kind in enumerate(arrays.SIZES):
        whole[i] = rng.integers(0, 200, (2, 3, 4, 5)).astype(kind)
    whole[10] = rng.random((1, 2, 7, 1))
    bad = [content(whole[0])[:-3], content(whole[0]) + b"x", content(np.zeros((2, 2))), b"", b"\x93NUMPY", content(np.asfortranarray(whole[0])), content(np.zeros((1, 0, 2, 2))), content(np.zeros((1, 1, 1, 1), complex)), None, b"no array file at all"]
    files = [(k, bytearray(content(a, (2, 0) if k == 10 else None))) for k, a in whole.items()] + [(100 + i, None if b is None else bytearray(b)) for i, b in enumerate(bad)]
    found = arrays.blocks(spark.createDataFrame(files, "name int, content binary"), "name").collect()
    assert sorted(r.name for r in found if r.failed) == [100 + i for i in range(len(bad))] and all(r.data is None and r.block is None for r in found if r.failed)
    good = {(r.name, r.block): r.data for r in found if not r.failed}
    assert good == {(k, i): a[:, i].astype(float).ravel().tolist() for k, a in whole.items() for i in range(a.shape[1])}


def test_written_array_files_are_numpy_files(spark):
    array = np.random.default_rng(2).integers(0, 9, (3, 12, 11))
    rows = spark.createDataFrame([(7, *map(int, at), int(array[at])) for at in np.ndindex(array.shape)], "vol int, z int, y int, x int, label int").repartition(4)
    (file,) = arrays.files(rows, spark.createDataFrame([(7, *array.shape)], "vol int, nz int, ny int, nx int"), F.col("label")).collect()
    assert (np.load(io.BytesIO(file.content)) == array.transpose(1, 2, 0)[None]).all()


def test_shapes_that_differ_are_an_error_unless_trimmed(spark):
    place = "vol int, z int, y int, x int"
    a = spark.createDataFrame([(v, 0, y, 0, y) for v in (0, 1) for y in range(3)], f"{place}, label int")
    b = spark.createDataFrame([(v, 0, y, 0, y) for v in (0, 1) for y in range(3 - v)], f"{place}, raw int")
    assert clean.common_shape(a, b).count() == 5
    assert clean.common_shape(a, b, F.col("vol") == 1).count() == 5
    with pytest.raises(Exception, match="shapes differ"):
        clean.common_shape(a, b, F.col("vol") == 0).collect()


def test_an_unknown_species_is_an_error(spark):
    sources = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "species int, source int")
    assert rows_of(splits.leave_one_out(sources, 1)) == [(0, 1, "train_val"), (0, 2, "train_val"), (1, 3, "test")]
    with pytest.raises(Exception, match="unknown species 5"):
        splits.leave_one_out(sources, 5).collect()


def test_union_pool_keeps_the_order_of_the_list(spark):
    rows = spark.createDataFrame([(1, 9), (2, 8), (2, 7), (4, 1)], "source int, n int")
    found = splits.union_pool(rows, [2, 3, 1], [], ["n"], strict=False)
    assert [(r.source, r.n) for r in found.orderBy("position").collect()] == [(2, 7), (2, 8), (1, 9)]
    with pytest.raises(ValueError, match=r"empty sources \[3\]"):
        splits.union_pool(rows, [2, 3, 1], [], ["n"], strict=True)
    with pytest.raises(ValueError, match="no source"):
        splits.union_pool(rows, [3], [], ["n"], strict=False)


def test_retries_then_replacements(spark):
    samples = spark.range(40).selectExpr("id as k")
    tries, more = 3, 60
    # Even samples have a first valid attempt k % 3; a few odd ones only give replacements.
    valid = samples.filter("k % 2 = 0").withColumn("attempt", F.explode(F.sequence((F.col("k") % 3).cast("int"), F.lit(2))))
    valid = valid.unionByName(samples.filter("k in (4, 7)").withColumn("attempt", F.explode(F.sequence(F.lit(tries), F.lit(tries + more * 10 - 1)))))
    asked = []

    def among(rows):
        def prompted(attempts):
            asked.append(attempts.count())
            return attempts.join(rows, ["k", "attempt"], "left_semi")

        return prompted

    found = {r.k: r for r in splits.retry_fallback(samples, among(valid), ["k"], 3, tries, more * 10).collect()}
    # Samples with a prompt are not tried again.
    assert asked[:2] == [40, 2 * (40 - 7)]
    assert len(found) == 40
    for k, r in found.items():
        assert (r.used_k, r.attempt) == (k, k % 3) if k % 2 == 0 else (r.used_k in (4, 7) and r.attempt >= tries)
    with pytest.raises(Exception, match="no replacement"):
        splits.retry_fallback(samples, among(valid.filter("attempt < 3")), ["k"], 3, tries, more).collect()


def test_multistep_loss_by_hand(spark):
    rows = spark.createDataFrame(
        [(0, "a", 0, 1.0, 2.0, 0.0, 1), (0, "b", 0, 3.0, 4.0, 10.0, 0), (0, "a", 1, 5.0, 6.0, 0.0, 1), (0, "b", 1, 7.0, 8.0, 0.0, 1), (0, "a", 2, 9.0, 9.0, 9.0, 0), (0, "a", 3, 1.0, 1.0, 1.0, 1), (0, "c", 1, 2.0, 2.0, 0.0, 0), (1, "d", 0, 1.0, 1.0, 1.0, 0)],
        "run int, sample string, step int, bce double, dice double, boundary double, valid int",
    )
    run, loss, last, final = rows_of(scores.multistep_loss(rows, 0.5, 2.0, strict=False))[0]
    first, second = 1 + 2 * 2, 6 + 7
    assert (run, last) == (0, 1) and math.isclose(loss, (first + 0.5 * second) / 1.5)
    assert math.isclose(final, (11 + 15 + 4) / 3)
    with pytest.raises(Exception, match="no valid step"):
        scores.multistep_loss(rows, 0.5, 2.0).collect()


def test_point_maps_by_hand(spark):
    points = [(1, 2, 3, 0, 1), (1, 5, 1, 1, 0), (2, -2, 6, 0, 0), (2, 3, 3, 1, 0)]
    frame = spark.createDataFrame(points, "sample int, x int, y int, n int, polarity int")
    samples = spark.createDataFrame([(1, True), (3, True), (4, False)], "sample int, prompted boolean")
    found = {(r.sample, r.y, r.x): r.prompt for r in prompts.point_map(frame, ["sample"], 5, 7, 10.0, samples, empty=0.25).collect()}
    assert len(found) == 4 * 35
    for sample in (1, 2):
        total = np.zeros((5, 7))
        for s, px, py, _, polarity in points:
            if s == sample:
                bump = np.array([[math.exp(-((x - px) ** 2 + (y - py) ** 2) / 20) for x in range(7)] for y in range(5)])
                total += bump / bump.max() * (2 * polarity - 1)
        want = total if sample == 1 else 2 * total + 1
        assert all(math.isclose(found[sample, y, x], want[y, x], abs_tol=1e-12) for y in range(5) for x in range(7))
    assert {v for (s, *_), v in found.items() if s == 3} == {0.25} and {v for (s, *_), v in found.items() if s == 4} == {1.0}


def test_one_click_keeps_its_distance(spark):
    edt = spark.createDataFrame([(0, 0, 1, 0, x, d) for x, d in enumerate((1, 4, 9, 4, 4, 1))] + [(0, 0, 2, 0, 9, 1)], "vol int, z int, label int, y int, x int, d2 int")
    assert rows_of(prompts.one_click(edt, 0.2)) == [(0, 0, 1, 0, 2), (0, 0, 2, 0, 9)]
    taken = spark.createDataFrame([(0, 0, 1, 0, 2), (0, 0, 2, 0, 9)], "vol int, z int, label int, y int, x int")
    assert rows_of(prompts.one_click(edt, 0.2, taken=taken, apart=2.0)) == [(0, 0, 1, 0, 4)]
    assert rows_of(prompts.one_click(edt, 0.2, taken=taken.filter("label = 2"), apart=1.0)) == [(0, 0, 1, 0, 2)]
    picks = {rows_of(prompts.one_click(edt.filter("label = 1"), 0.2, seed, 0.0))[0][-1] for seed in range(12)}
    assert len(picks) > 1 and picks <= set(range(6))
