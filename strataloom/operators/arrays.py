"""Array files (magic, header, values in C order) read and written by SQL over their bytes.

The header is parsed and the blocks are cut by SQL; only a block's values are
decoded by numpy. A file is one row of bytes, as Spark's ``binaryFile`` source
gives it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = "934E554D5059"  # \x93NUMPY
#: Bytes of a value by the kind in the header; other kinds are failed files.
SIZES = {"<f4": 4, "<f8": 8, "<i4": 4, "<u2": 2, "|u1": 1}


def with_header(files: DataFrame) -> DataFrame:
    """``files`` (.., content) with ``shape``, ``kind``, ``start`` (bytes before the values) and ``failed``.

    A file fails whose magic, order, kind or length is not that of a whole
    array of four axes, all longer than 0.
    """
    little = lambda at, n: " + ".join(f"shiftleft(cast(conv(hex(substring(content, {at + i}, 1)), 16, 10) as bigint), {8 * i})" for i in range(n))
    size = f"coalesce(try_element_at(map({', '.join(f'{k!r}, {v}' for k, v in SIZES.items())}), kind), 0)"
    rows = files.withColumn("_v", F.expr("hex(substring(content, 7, 1))"))
    rows = rows.withColumn("_n", F.expr(f"if(_v = '01', {little(9, 2)}, {little(9, 4)})")).withColumn("start", F.expr("if(_v = '01', 10, 12) + _n"))
    rows = rows.withColumn("_ok", F.expr(f"coalesce(octet_length(content) >= 12 and hex(substring(content, 1, 6)) = '{MAGIC}' and octet_length(content) >= start, false)"))
    rows = rows.withColumn("_h", F.expr("if(_ok, decode(substring(content, cast(if(_v = '01', 11, 13) as int), cast(_n as int)), 'ISO-8859-1'), '')"))
    rows = rows.withColumn("shape", F.expr("transform(filter(split(regexp_extract(_h, \"'shape': [(]([^)]*)[)]\", 1), ','), s -> trim(s) <> ''), s -> cast(s as bigint))"))
    rows = rows.withColumn("kind", F.expr("regexp_extract(_h, \"'descr': '([^']*)'\", 1)"))
    whole = f"octet_length(content) = start + {size} * aggregate(shape, 1L, (a, s) -> a * s)"
    good = f"_ok and _h rlike \"'fortran_order': False\" and size(shape) = 4 and forall(shape, s -> s > 0) and {size} > 0 and {whole}"
    return rows.withColumn("failed", F.expr(f"not coalesce({good}, false)")).drop("_v", "_n", "_ok", "_h")


def blocks(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, shape, data, failed) of files (keys, content): a block for each row of the second axis, over all channels.

    ``data``: its values in the order (channel, third axis, fourth axis). A
    failed file has one row, without a block.
    """
    rows = with_header(files)
    cut = rows.select(*keys, "content", "shape", "kind", "start", "failed", F.expr("explode_outer(if(failed, null, sequence(0L, shape[1] - 1)))").alias("block"))
    size = f"element_at(map({', '.join(f'{k!r}, {v}' for k, v in SIZES.items())}), kind)"
    part = f"substring(content, cast(1 + start + (c * shape[1] + block) * shape[2] * shape[3] * {size} as int), cast(shape[2] * shape[3] * {size} as int))"
    cut = cut.withColumn("_b", F.expr(f"if(failed, null, aggregate(sequence(0L, shape[0] - 1), X'', (a, c) -> concat(a, {part})))"))

    def decode(data: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b, k).astype(float) for b, k in zip(data.to_pylist(), kind.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return cut.select(*keys, "block", "shape", F.arrow_udf(decode, "array<double>")("_b", "kind").alias("data"), "failed")


def files(rows: DataFrame, volumes: DataFrame, value: Column) -> DataFrame:
    """(vol, content): one file of float values (1, y, x, z) for each volume (vol, nz, ny, nx), from its dense voxel rows.

    Values are encoded a row of the second axis at a time, and the rows' bytes
    are joined by SQL.
    """

    def encode(values: pa.Array) -> pa.Array:
        flat, bounds = values.values.field(1).to_numpy().astype("<f4"), values.offsets.to_numpy()
        return pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())

    lines = rows.groupBy("vol", "y").agg(F.array_sort(F.collect_list(F.struct((F.col("x").cast("long") * (1 << 32) + F.col("z")).alias("at"), value.cast("double").alias("v")))).alias("_l"))
    lines = lines.select("vol", "y", F.arrow_udf(encode, "binary")("_l").alias("b"))
    whole = lines.groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("y", "b"))).alias("_l")).join(volumes, "vol")
    header = F.format_string("{'descr': '<f4', 'fortran_order': False, 'shape': (1, %d, %d, %d), }", "ny", "nx", "nz")
    # Padded with spaces and a line feed, so that the values begin at a multiple of 64.
    header = F.concat(F.rpad(header, 117, " "), F.lit("\n"))
    values = F.aggregate("_l", F.expr("X''"), lambda a, l: F.concat(a, l.b))  # noqa: E741
    return whole.select("vol", F.concat(F.unhex(F.lit(f"{MAGIC}01007600")), F.encode(header, "ISO-8859-1"), values).alias("content"))
