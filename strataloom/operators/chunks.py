"""Chunked arrays with a channel axis, as Parquet rows: one row for a chunk.

A chunk is (source, vol, bc, by, bx, bz, dc, dy, dx, dz, data): ``dc`` channels
of a tile as one binary array in the order (channel, row, column, plane), the
order of the descriptor cache. Rows lie by source and in the order of their
key, so a reader of some chunks skips the other row groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ["vol", "bc", "by", "bx", "bz"]


def chunked(blocks: DataFrame, channels: list[str], kind: str, most: int = 10) -> DataFrame:
    """Chunks of blocks that have a binary column (planes, rows, columns) for each channel; ``most`` channels to a chunk."""

    def pack(dz: pa.Array, dy: pa.Array, dx: pa.Array, *values: pa.Array) -> pa.Array:
        out = []
        for *shape, in zip(*(c.to_pylist() for c in (dz, dy, dx, *values)), strict=True):
            whole = np.stack([np.frombuffer(v, kind).reshape(shape[:3]) for v in shape[3:]]).transpose(0, 2, 3, 1)
            out.append([{"bc": i // most, "dc": len(part := whole[i : i + most]), "data": np.ascontiguousarray(part).tobytes()} for i in range(0, len(whole), most)])
        return pa.array(out, pa.list_(pa.struct([("bc", pa.int32()), ("dc", pa.int32()), ("data", pa.binary())])))

    found = blocks.withColumn("_c", F.explode(F.arrow_udf(pack, "array<struct<bc int, dc int, data binary>>")("dz", "dy", "dx", *channels)))
    return found.select("source", "vol", "_c.bc", "by", "bx", "bz", "z0", "y0", "x0", "_c.dc", "dy", "dx", "dz", "_c.data")


def write(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet by source, in the order of their keys."""
    laid = chunks.repartitionByRange("source", *ORDER).sortWithinPartitions("source", *ORDER)
    laid.write.option("compression", "zstd").partitionBy("source").parquet(path)


def voxels(chunks: DataFrame, kind: str) -> DataFrame:
    """(vol, z, y, x, bc, values) of the places where a chunk has a value other than 0; values: an array of its channels."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                array = np.frombuffer(r["data"], kind).reshape(r["dc"], r["dy"], r["dx"], r["dz"])
                y, x, z = np.nonzero(array.any(axis=0))
                values = array[:, y, x, z].T.astype(float)
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * r["dc"])
                places = [np.full(len(z), r["vol"], np.int32), *((c + r[f"{k}0"]).astype(np.int32) for k, c in (("z", z), ("y", y), ("x", x))), np.full(len(z), r["bc"], np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, places), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["vol", "z", "y", "x", "bc", "values"])

    columns = ["vol", "bc", "z0", "y0", "x0", "dc", "dy", "dx", "dz", "data"]
    return chunks.select(columns).mapInArrow(unfold, "vol int, z int, y int, x int, bc int, values array<double>")
