"""Token ids in a binary file format: frequency ranks in byte-aligned codes.

Ids are renumbered by their frequency over the whole corpus (most frequent
first, then the lower id), so that most take one byte. A rank takes 1 to 4
bytes; two bits for each rank say how many, and these control bits lie apart
from the data bytes. Four ranks share a control byte, and a table of 256 rows
gives numpy the sizes of all four at once.

The format: Parquet rows in ascending document order, one for each block of
documents: ``part`` (its range of documents), ``before`` (ids of the part before
the block), ``size``, the documents' ids and lengths, ``control`` and ``data``; beside it the table ``ranks`` (rank, id, n). Both are
written by Spark's committer to any store that Spark reaches.

Cases: a null or empty text is its end id alone; rows with the same doc_id
stay apart, in the order of their ids' bytes; a null doc_id comes first; an
empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import encoding, tables

END_ID = 0
#: Bytes of each of the four ranks of a control byte, lowest bits first.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
BLOCK_IDS = 1 << 18
BLOCK_NAMES = ["part", "before", "size", "doc_ids", "lengths", "control", "data"]
BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of the ranks."""
    ranks = np.asarray(ranks, np.uint32)
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) <= code[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of (control, data), by table lookup."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").reshape(-1)


def token_ids(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids): unsigned 16-bit ids of each text with the end id."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.append(x, END_ID).astype("<u2").tobytes() for _, x in encoding.encoded(batch.column(1), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_or_empty().alias("text")).mapInArrow(tokenise, "doc_id long, ids binary")


def frequencies(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task adds its own counts up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << 16, np.int64), [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= 1 << 20:
                    total += np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=1 << 16)
                    held, size = [], 0
        total += np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(documents: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the documents' ids below ``path``."""
    spark = documents.sparkSession
    ids = tables.staged(token_ids(documents, tokenizer), "ids")
    found = frequencies(ids).orderBy(F.desc("n"), "id").collect()  # a row for each id of the vocabulary: 65,536 at most
    spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(found)], "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(1 << 16, np.uint32)
    rank[[r["id"] for r in found]] = np.arange(len(found))
    shared = spark.sparkContext.broadcast(rank)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, before = [], 0, 0

        def block() -> pa.RecordBatch:
            control, data = encode_ranks(shared.value[np.concatenate([x for _, x in held])])
            columns = [[part], [before], [size], [[d for d, _ in held]], [[len(x) for _, x in held]], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, np.frombuffer(x, "<u2")))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield block()
                    held, size, before = [], 0, before + size
        if held:
            yield block()

    ordered = ids.repartitionByRange(tables.partitions(spark), "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    coded = ordered.mapInArrow(encode, "part int, before long, size long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    coded.write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of the files below ``path``."""
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row for each task that wrote; its number is that of its range of documents.
    sizes = blocks.groupBy("part").agg(F.sum("size").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        starts[row["part"]], total = total, total + row["n"]
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    table = spark.sparkContext.broadcast(np.array([r["id"] for r in ids], np.uint32))
    first = spark.sparkContext.broadcast(starts)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, lengths, control, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids = table.value[decode_ranks(control, data, sum(lengths))].astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                each = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first.value[part] + before + bounds[:-1]), pa.array(lengths, pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "before", "doc_ids", "lengths", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in the file format and read back."""
    path = f"{tables.shared_dir(spark)}/binary-ids-{uuid.uuid4().hex}"
    write(tables.table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
