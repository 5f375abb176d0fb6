"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local master, an error for any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's staged tables; frames that read them are of no use after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table that is written, below ``staged_dir``."""
    return f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def staged_rows(frame: DataFrame, name: str) -> DataFrame:
    """``staged`` rows of places or instances, to be joined by merging: they pack so well that Spark, which goes by the files' bytes, would have the driver broadcast millions of them."""
    return staged(frame, name).hint("merge")


#: Rows and bytes of an Arrow batch, and bytes of a Parquet row group, where a row holds arrays.
FEW, BYTES, GROUP = 128, 1 << 24, 1 << 24


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made inside give Python ``rows`` rows at most and ``BYTES`` at once. Spark's own 10,000 wait in the JVM as a whole, with all their columns, at each step of a chain."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}
    before = {key: spark.conf.get(key) for key in keys}
    for key, most in keys.items():
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def staged_arrays(frame: DataFrame, name: str, rows: int = FEW) -> DataFrame:
    """``staged`` rows that hold arrays, so that no task holds many of them at once: few go to Python together, and row groups are small.

    A reader unpacks up to 4,096 rows of a row group together. Bytes alone do
    not bound that, since arrays that pack well are counted packed.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    with small_batches(spark, rows):
        frame.write.option("compression", "zstd").option("parquet.block.size", str(GROUP)).option("parquet.block.row.count.limit", str(rows)).option("parquet.page.size.row.check.min", "2").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
