"""Dense blocks against whole arrays, whatever the tile."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import kernels
from strataloom.operators import blocks, graph, stencil
from strataloom.operators.numbering import ranked

SHAPES = {0: (5, 11, 13), 3: (8, 16, 16), 4: (1, 1, 1), 9: (3, 40, 7)}
TILES = [(3, 4, 5), (8, 16, 16), (64, 64, 64), (2, 5, 64)]


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(5)
    out = {}
    for vol, shape in SHAPES.items():
        labels = rng.integers(0, 4, [-(-n // 2) for n in shape])
        for axis, n in enumerate(shape):
            labels = np.repeat(labels, 2, axis)
            labels = labels[tuple(slice(0, n) if i == axis else slice(None) for i in range(3))]
        out[vol] = np.where(rng.random(shape) < 0.1, 0, labels).astype(np.int32)
    return out


@pytest.fixture(scope="module")
def rows(spark, arrays):
    found = [(vol, *map(int, at), int(a[tuple(at)])) for vol, a in arrays.items() for at in np.argwhere(a)]
    return spark.createDataFrame(found, "vol int, z int, y int, x int, label int").cache()


@pytest.fixture(scope="module")
def volumes(spark):
    return spark.createDataFrame([(v, *s) for v, s in SHAPES.items()], "vol int, nz int, ny int, nx int")


def tiled(rows, volumes, tile, values=None):
    return blocks.to_blocks(rows, volumes, tile, values or {"label": "int32"})


def gathered(frame, name, arrays, kind=np.int32):
    """The column of voxel rows as arrays; every place once."""
    out = {vol: np.full(a.shape, -7, kind) for vol, a in arrays.items()}
    for r in frame.collect():
        assert out[r.vol][r.z, r.y, r.x] == -7
        out[r.vol][r.z, r.y, r.x] = r[name]
    return out


def near(a, axis, step, fill):
    """The neighbour's value at every place."""
    wide = np.pad(a, 1, constant_values=fill)
    return wide[tuple(slice(1 + step * (i == axis), a.shape[i] + 1 + step * (i == axis)) for i in range(3))]


@pytest.mark.parametrize("tile", TILES)
def test_round_trip(rows, volumes, arrays, tile):
    found = tiled(rows, volumes, tile)
    assert found.count() == sum(np.prod([-(-n // t) for n, t in zip(s, tile, strict=True)]) for s in SHAPES.values())
    back = gathered(blocks.from_blocks(found, {"label": ("label", "int32", "int")}), "label", arrays)
    assert all((back[v] == a).all() for v, a in arrays.items())
    sparse = blocks.from_blocks(found, {"label": ("label", "int32", "int")}, keep="label")
    assert sparse.exceptAll(rows).count() == 0 and sparse.count() == rows.count()


@pytest.mark.parametrize("tile", TILES)
def test_stencils_equal_whole_arrays(rows, volumes, arrays, tile):
    held = tiled(rows, volumes, tile)
    for axes in ("yx", "yxz"):
        found = blocks.from_blocks(blocks.affinity(held, axes), {f"a{i}": (f"aff[{i}]", "uint8", "int") for i in range(len(axes))}).cache()
        for i, k in enumerate(axes):
            got = gathered(found, f"a{i}", arrays)
            for v, a in arrays.items():
                ahead = near(a, "zyx".index(k), 1, -1)
                assert (got[v] == (((ahead != a) & (ahead >= 0)) | ((a == 0) & (len(axes) == 3)))).all()
    for axes, border in (("zyx", 1), ("yx", 0), ("yx", 1)):
        got = gathered(blocks.from_blocks(blocks.erode(held, axes, border), {"e": ("eroded", "int32", "int")}), "e", arrays)
        for v, a in arrays.items():
            sides = [near(a, "zyx".index(k), s, -1) for k in axes for s in (-1, 1)]
            keep = np.all([(s == a) | ((s < 0) & bool(border)) for s in sides], axis=0)
            assert (got[v] == np.where(keep, a, 0)).all()


@pytest.mark.parametrize(("tile", "most"), [(TILES[0], 0), *((t, 1 << 20) for t in TILES[:3])])
def test_components_equal_whole_arrays(rows, volumes, arrays, tile, most):
    found = blocks.components(tiled(rows, volumes, tile), (8, 40, 16), most)
    got = gathered(blocks.from_blocks(found, {"c": ("component", "int32", "int")}), "c", arrays)
    assert all((got[v] == kernels.components(a, full=True)).all() for v, a in arrays.items())


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components_of_runs_equal_whole_slices(rows, arrays, most):
    got = {v: np.zeros(a.shape, int) for v, a in arrays.items()}
    for r in stencil.slice_components(rows, most).collect():
        got[r.vol][r.z, r.y, r.x] = r.component
    for v, a in arrays.items():
        assert all((got[v][z] == kernels.components(a[z], full=False)).all() for z in range(len(a)))


def test_long_runs_meet_once(spark):
    line = [(1, 0, y, x, 2) for y in (0, 1, 2) for x in range(300) if y != 1 or x in (70, 200)]
    rows = spark.createDataFrame(line, "vol int, z int, y int, x int, label int")
    runs = stencil.run_components(rows)
    assert runs.count() == 4 and {r.component for r in runs.collect()} == {1}


@pytest.mark.parametrize("tile", TILES)
def test_contacts_equal_whole_slices(rows, volumes, arrays, tile):
    if min(tile[1:]) < 2:
        return
    got = {(r.vol, r.z, r.label): (r.places, r.near, r.others) for r in blocks.contacts(tiled(rows, volumes, tile)).collect()}
    want = {}
    for v, a in arrays.items():
        for z, frame in enumerate(a):
            for label in set(frame.ravel().tolist()) - {0}:
                mask = frame == label
                hit = np.pad(frame, 2, constant_values=-1)
                close, others = np.zeros(mask.shape, bool), set()
                for dy, dx in ((y, x) for y in range(-2, 3) for x in range(-2, 3) if 0 < abs(y) + abs(x) <= 2):
                    there = hit[2 + dy : 2 + dy + frame.shape[0], 2 + dx : 2 + dx + frame.shape[1]]
                    close |= there != label
                    others |= set(there[mask].tolist())
                want[v, z, label] = (mask.sum(), (close & mask).sum(), sorted(others - {0, -1, label}))
    assert got == want


@pytest.mark.parametrize(("tile", "deep"), [((2, 8, 8), 8), ((1, 8, 16), 5), ((8, 64, 64), 64), ((3, 16, 8), 3)])
def test_prompt_reach_equals_whole_slices(spark, tile, deep):
    rng = np.random.default_rng(2)
    shape, rounds, negative = (2, 19, 23), 64, 32
    label, soft, prompt = rng.integers(0, 2, shape), rng.random(shape) * 0.2 + 0.8, rng.random(shape) * 2 - 1
    prompt = np.where(rng.random(shape) < 0.9, 0, prompt)
    interior = (label > 0).astype(float)
    data = [(1, z, y, x, int(label[z, y, x]), float(soft[z, y, x]), float(prompt[z, y, x]), float(interior[z, y, x])) for z, y, x in np.ndindex(shape)]
    rows = spark.createDataFrame(data, "vol int, z int, y int, x int, label int, soft double, prompt double, interior double")
    volumes = spark.createDataFrame([(1, *shape)], "vol int, nz int, ny int, nx int")
    held = blocks.to_blocks(rows, volumes, tile, {"label": "int32", "soft": "float64", "prompt": "float64", "interior": "float64"})
    found = blocks.from_blocks(blocks.prompt_reach(held, rounds, negative, deep), {"p": ("prior", "float64", "double")})
    got = gathered(found, "p", {1: label}, float)[1]
    weights = blocks.reach_weights(label, soft)
    good = kernels.spread(np.clip((prompt - 0.7) / 0.3, 0, 1), *weights, rounds)
    bad = kernels.spread(np.clip((-prompt - 0.2) / 0.8, 0, 1), *weights, negative)
    assert np.allclose(got, np.clip(good - 0.85 * bad, 0, 1) * interior)


def test_empty_blocks(spark, rows, volumes):
    empty, none = rows.filter("false"), volumes.filter("false")
    assert tiled(empty, none, (2, 2, 2)).count() == 0
    held = tiled(empty, volumes, (4, 8, 8))
    assert blocks.from_blocks(blocks.components(held, (8, 40, 16)), {"c": ("component", "int32", "int")}, keep="c").count() == 0
    assert blocks.from_blocks(blocks.erode(held, "yx", 1), {"e": ("eroded", "int32", "int")}).agg(F.sum("e")).first()[0] == 0
    assert stencil.slice_components(empty).count() == 0


def test_contraction_in_one_task_and_in_stars(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2)) if a != b] + [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    one, other = ({(r.node, r.label) for r in graph.components(edges, most).collect()} for most in (0, 1000))
    assert one == other


@pytest.mark.parametrize("parts", [1, 7])
def test_ranked(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rng = np.random.default_rng(4)
    data = [(None if g == 2 else int(g), int(k), i) for i, (g, k) in enumerate(zip(rng.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]), rng.permutation(500), strict=True))]
    frame = spark.createDataFrame(data, "g int, k int, other int")
    found = ranked(frame, [F.col("k").desc()], ["g"], "at", "n").collect()
    for g in (0, 1, None, 3):
        own = sorted((r for r in found if r.g == g), key=lambda r: -r.k)
        assert [r["at"] for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
    assert [r.k for r in sorted(ranked(frame, ["k"], place="at").collect(), key=lambda r: r["at"])] == sorted(r[1] for r in data)
    assert ranked(frame.filter("false"), ["k"]).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("band", [(1, 1), (3, 7)])
def test_components_of_runs_across_bands(rows, arrays, monkeypatch, band, most):
    monkeypatch.setattr(stencil, "BAND", band)
    test_components_of_runs_equal_whole_slices(rows, arrays, most)


def test_small_slices_need_no_contraction(spark, rows, monkeypatch):
    """Slices inside one band are labelled where they are: no edge of theirs is staged, however many they are."""
    monkeypatch.setattr(stencil.graph, "components", lambda *args, **kwargs: pytest.fail("edges were contracted"))
    assert stencil.run_components(rows).count() > 0
