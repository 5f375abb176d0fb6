"""Best-fit packing: pieces of tokenised documents into sequences of fixed length.

Bounded-space online best-fit. A fixed number of bins is open at a time; they
are found by a bitset keyed by free space, so that the fittest bin is the
lowest set bit at or above a piece's length. Where no more bins may be opened,
the fullest closes first. Every task packs its own share of the pieces, dealt
by a hash of the piece, so the work grows with the tasks and no key is hot.

Cases: a null or empty text packs as its end id alone; equal rows are packed
once each; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

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
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open bins by free space; ``add`` gives a piece's (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.made = 0

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.opened >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.opened += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.opened -= 1
        return number


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents' ids, each with the end id after the last."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, numbers, starts, lengths, sums = batch.column(0).to_pylist(), [], [], [], []
            docs = []
            for row, ids in encoding.encoded(batch.column(1), path):
                whole = np.append(ids, END_ID).astype("<u4")
                for number, (start, length) in enumerate(cut(len(whole), capacity)):
                    docs.append(ids_of[row])
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(whole[start : start + length]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_or_empty().alias("text")).mapInArrow(tokenise, PIECES)


def tasks_for(documents: DataFrame) -> int:
    """Packing tasks: one for 4,096 documents, as every task leaves its last bins unfilled; of more than fit the session's partitions, one for 500,000."""
    n = documents.count()
    return max(1, min(n // 4096, max(tables.partitions(documents.sparkSession), n // 500_000)))


def pack(parts: DataFrame, capacity: int = 2048, open_bins: int = 8192, block: int = 16384, tasks: int | None = None) -> DataFrame:
    """``parts`` (columns of PIECES) with ``sequence_id`` and ``offset``.

    A task takes its pieces in an order fixed by their hash, in blocks whose
    long pieces come first; ``open_bins`` bounds what it holds open.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            whole = whole.take(pa.array(np.argsort(-whole["length"].to_numpy(), kind="stable")))
            found = [fit.add(length) for length in whole["length"].to_pylist()]
            numbers, offsets = (np.array(x, np.int64) for x in zip(*found, strict=True))
            whole = whole.append_column("sequence_id", pa.array(first + numbers)).append_column("offset", pa.array(offsets))
            yield from whole.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from packed()
                held.clear()
        if held:
            yield from packed()

    dealt = parts.select(*names).repartition(tasks or tables.partitions(parts.sparkSession), *names)
    ordered = dealt.sortWithinPartitions(F.xxhash64(*names), *names)
    return ordered.mapInArrow(assign, f"{PIECES}, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    documents = tables.table(spark, sf_dir, "documents")
    return pack(pieces(documents), tasks=tasks_for(documents))
