"""Catalogues of volumes and pairing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog(volumes: DataFrame, sources: DataFrame, limited: int | None = None, indexes: list[int] | None = None) -> DataFrame:
    """(species, source, vol, ord): volumes by source; of source ``limited`` only the places in ``indexes``."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("vol")) - 1
    found = volumes.withColumn("ord", place).join(sources, "source")
    if limited is not None and indexes is not None:
        found = found.filter((F.col("source") != limited) | F.col("ord").isin(indexes))
    return found.select("species", "source", "vol", "ord")


def stem(path: Column, extension: str) -> Column:
    """The last part of a path without the extension; empty where it does not fit."""
    return F.regexp_extract(path, rf"([^/]+)\.{extension}$", 1)


def ordered_keys(paths: DataFrame, preferred: DataFrame) -> DataFrame:
    """(ord, key) of the preferred keys that a listing has."""
    have = paths.select(stem(F.col("path"), "zarr").alias("key")).filter("key <> ''")
    return preferred.join(have, "key", "left_semi").select("ord", "key")


def paired_keys(paths: DataFrame) -> DataFrame:
    """Keys that have an image and a label file."""
    keys = lambda kind: paths.select(F.regexp_extract("path", rf"{kind}_(\d+)_pad\.h5$", 1).alias("key")).filter("key <> ''").distinct()
    return keys("im").join(keys("seg"), "key").selectExpr("cast(key as bigint) as key")


def required(value: Column, strict: bool, message: str) -> Column:
    """The value; where it is null an error if ``strict``."""
    return F.coalesce(value, F.raise_error(F.lit(message))) if strict else value


def slice_file_match(slices: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """(n, name): a slice's mask file by its number; two digits first, then plain, then eight digits, then any.

    A slice without a file is an error, or has a null name if not ``strict``.
    """
    named = files.withColumn("stem", stem(F.col("name"), "png")).filter("stem rlike '^[0-9]+$'").withColumn("n", F.expr("cast(stem as bigint)"))
    plain = F.col("n").cast("string")
    rank = F.when(F.col("stem") == F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain), 0).when(F.col("stem") == plain, 1).when(F.col("stem") == F.lpad(plain, 8, "0"), 2).otherwise(3)
    best = named.withColumn("rank", rank).groupBy("n").agg(F.min(F.struct("rank", "name")).alias("best"))
    return slices.join(best, "n", "left").select("n", required(F.col("best.name"), strict, "a slice has no mask file").alias("name"))


def inverted_z_join(images: DataFrame, labels: DataFrame, depth: int, first_name: int, strict: bool = True) -> DataFrame:
    """Image slice z with label slice ``depth - z``; image names begin at ``first_name``.

    An image slice without a label slice is an error, or has a null ``n_fg`` if not ``strict``.
    """
    numbered = images.withColumn("number", F.lit(depth) - F.col("z"))
    n_fg = required(F.col("n_fg"), strict, "an image slice has no label slice").alias("n_fg")
    return numbered.join(labels, ["vol", "number"], "left").select("vol", "z", (F.col("z") + first_name).alias("image_name"), "number", n_fg)


def largest_3d(arrays: DataFrame) -> DataFrame:
    """Of each container the array of three positive dimensions with most elements, the first on ties."""
    ok = arrays.filter(F.expr("size(shape) = 3 and forall(shape, s -> s > 0)"))
    ok = ok.withColumn("elements", F.expr("aggregate(shape, 1L, (a, s) -> a * s)"))
    best = ok.groupBy("container").agg(F.max(F.struct("elements", (-F.col("place")).alias("back"), "key")).alias("b"))
    return best.select("container", "b.key", "b.elements")


def cache_name(source: Column, path: Column, orientation: Column, extension: str = "zarr") -> Column:
    """``source__stem__orientation.ext``: a known extension goes, separators become ``_``."""
    bare = F.regexp_replace(path, r"\.(zarr|hdf5|h5|hdf|npy|tiff|tif)$", "")
    return F.concat(F.concat_ws("__", source, F.regexp_replace(bare, r"[/\\]", "_"), orientation), F.lit(f".{extension}"))


def slice_cache_name(source: Column, path: Column) -> Column:
    """The slice reader's own rule: the last extension goes, ``/`` becomes ``__``."""
    return F.concat_ws("__", source, F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), "/", "__"))


def resume_status(items: DataFrame, artefacts: DataFrame, kinds: int, skip: Column, overwrite: Column) -> DataFrame:
    """``items`` with ``status``: complete ones are skipped, overwritten or failed; others are to be done. Skip wins."""
    whole = artefacts.groupBy("item").agg(F.count_distinct("kind").alias("have")).filter(F.col("have") >= kinds).select("item", F.lit(True).alias("whole"))
    done = F.coalesce("whole", F.lit(False))
    status = F.when(~done, "write").when(skip, "skip").when(overwrite, "write").otherwise("fail")
    return items.join(whole, "item", "left").withColumn("status", status).drop("whole")


def manifest(layers: DataFrame) -> DataFrame:
    """A JSON line for each source: layers in all, exported, skipped, and with metadata."""
    n = lambda status: F.count_if(F.col("status") == status)
    found = layers.groupBy("source").agg(F.count("*").alias("total_layers"), n("exported").alias("exported_layers"), n("skipped").alias("skipped_layers"), F.count_if(F.col("status").isin("exported", "skipped")).alias("metadata_layers"))
    return found.select("source", F.to_json(F.struct("source", "total_layers", "exported_layers", "skipped_layers", "metadata_layers")).alias("json"))


def capped(chunk: tuple[int, ...], shape: tuple[int, ...]) -> tuple[int, ...]:
    """The chunk's sides, none longer than the volume's."""
    return tuple(map(min, chunk, shape))


#: Files of one source's table at most.
PARTS = 32


def write_prompts(path: str, tables: dict[str, DataFrame]) -> None:
    """Tables with ``source`` and ``layer`` as CSV with a header, by name and source; a source's layers are dealt to some tasks, its files."""
    for name, rows in tables.items():
        rows.repartition("source", F.pmod(F.xxhash64("layer"), F.lit(PARTS))).write.partitionBy("source").csv(f"{path}/{name}", header=True)
