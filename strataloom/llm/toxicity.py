"""Toxicity by nearest labelled examples under TF-IDF cosine.

Terms are words: runs of letters, A-Z in lower case. A sample of the labelled
rows, of ``examples`` in the mean, gives the examples, and every word of them
is a term; words that no example has are no dimension of the space, as is
usual. Inverse document frequencies come from all documents. A term's weight
is (1 + log tf) * idf times a factor of 1 and more by how much more often
examples with the label have the word (its relevance frequency, by how sure
it is, see ``relevance``). All terms keep a weight; without the factor a text's
neighbours are those that share its rarest words, whatever these mean.

The examples' weights lie in an inverted index. Terms of few examples are
added up over their postings. Terms of many lie in blocks of 64 examples with
the largest weight of each: what the rare terms give is a lower bound of the
k-th similarity, and a block is opened only for texts whose bound reaches it,
so the neighbours are exact. They vote with their similarity, and the label's
base rate with a small weight, so that weak votes stay moderate; the nearest
example is the evidence. A text without any known word has the base rate.

Cases: a null or empty text has no terms; labels other than 0 and 1, and null
ones, are not used; of a document with several labels each counts; equal rows
get equal scores; without labels the score is 0; other columns are ignored;
an empty table gives no rows; long texts are read in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables, textkit
from strataloom.llm.textkit import U64

EXAMPLES, EXAMPLE_BYTES, NEIGHBOURS, BLOCK, PRIOR, LIMIT = 8_000, 1 << 26, 15, 64, 0.05, 0.7
#: Texts that are scored together.
TOGETHER = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of a chunk."""
    inside = np.concatenate([[False], _letters()[data], [False]])
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[1:-1][edges]
    stops[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.searchsorted(offsets, starts, "right") - 1, textkit.span_hash(textkit.prefix_hash(data, textkit.LOWER), starts, ends)


def term_counts(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, text, term, count) of a column's distinct words, by text.

    Terms are hashes or, with the sorted hashes ``known``, their places there; unknown words go.
    """

    def found(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, term = words(data, offsets)
        if known is None:
            return text, term
        if not len(known):
            return text[:0], np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(known, term), len(known) - 1)
        hit = known[place] == term
        return text[hit], place[hit]

    held = []
    for first, last, data, offsets, ended in textkit.parts(column):
        held.append(found(data, offsets))
        if not ended:
            continue
        text, term = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        order = np.lexsort((term, text))
        text, term = text[order], term[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
        place = np.flatnonzero(new)
        yield first, last, text[new], term[new], np.diff(np.append(place, len(text)))


def held_out():
    """Rows whose crc32 of the doc_id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(documents: DataFrame, labels: DataFrame, examples: int, example_bytes: int) -> DataFrame:
    """(doc_id, label, text): a hashed sample of the labelled rows that may be learned from.

    ``examples`` rows in the mean, and fewer where their texts would have more than ``example_bytes`` in the mean.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1 << 20))
    share = min(1.0, examples / max(n, 1))
    # The sample is bounded by ``examples``, so it may be broadcast.
    sample = known.withColumn("place", place).filter(F.col("place") < F.lit(int(share * (1 << 20))))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_or_empty().alias("text"))
    held = tables.staged(texts.join(F.broadcast(sample), "doc_id"), "examples")
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return held.filter(F.col("place") < F.lit(int(share * min(1.0, example_bytes / max(size, 1)) * (1 << 20)))).select("doc_id", "label", "text")


class Examples:
    """The labelled rows as (example, term, count), bounded by the sample; collected once."""

    def __init__(self, rows: DataFrame):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, text, term, n in term_counts(batch.column(2)):
                    edges = np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (term.view(np.int64), n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], *lists], names=["doc_id", "label", "terms", "counts"])

        found = rows.select("doc_id", "label", "text").mapInArrow(count, "doc_id long, label int, terms array<long>, counts array<int>").toArrow()
        found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
        self.docs, self.labels = (found.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "label"))
        lists = pa.concat_arrays(found.column("terms").chunks) if found.num_rows else pa.array([], pa.list_(pa.int64()))
        counts = pa.concat_arrays(found.column("counts").chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
        self.counts = counts.flatten().to_numpy().astype(np.float64)
        self.known, self.term = np.unique(lists.flatten().to_numpy().view(U64), return_inverse=True)
        self.row = np.repeat(np.arange(len(self.docs)), np.diff(lists.offsets.to_numpy()))


def document_frequencies(texts: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that have each known term, all documents); each task adds its own counts up first."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, _, term, _ in term_counts(batch.column(0), shared.value):
                total += np.bincount(term, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["term", "n"])

    found = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    term, n = (found.column(k).to_numpy() for k in ("term", "n"))
    out = np.zeros(len(known), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def relevance(examples: Examples) -> np.ndarray:
    """A factor of 1 and more for each term, by how it goes with the label.

    The relevance frequency, log2(2 + the term's share of rows with the label by its share of those without), times
    1 + z: by how many standard deviations (one added to their square) its rows with the label exceed their expected number.
    """
    n_terms, n = len(examples.known), max(len(examples.docs), 1)
    rows = np.bincount(examples.term, minlength=n_terms)
    hits = np.bincount(examples.term, weights=examples.labels[examples.row], minlength=n_terms)
    base = examples.labels.sum() / n
    with_, without = max(examples.labels.sum(), 1), max((1 - examples.labels).sum(), 1)
    z = (hits - rows * base) / np.sqrt(rows * base * (1 - base) + 1)
    return np.log2(2 + (hits / with_) / (np.maximum(rows - hits, 1) / without)) * (1 + np.maximum(z, 0))


class BlockMaxIndex:
    """Inverted index of unit vectors with a bound for each block of examples."""

    def __init__(self, examples: Examples, weight: np.ndarray):
        self.known, self.weight = examples.known, weight
        n, n_terms = len(examples.docs), len(weight)
        self.base = float(examples.labels.mean()) if n else 0.0
        value = (1 + np.log(examples.counts)) * weight[examples.term]
        norm = np.sqrt(np.bincount(examples.row, weights=value * value, minlength=n))
        value = value / np.maximum(norm, 1e-300)[examples.row]
        used = np.bincount(examples.term, minlength=n_terms)
        frequent = used >= max(BLOCK, n // 16)
        self.dense = np.full(n_terms, -1)
        self.dense[frequent] = np.arange(frequent.sum())
        # Examples whose heaviest frequent term is the same lie together, so that blocks differ.
        often = frequent[examples.term]
        heavy = np.full(n, -1)
        order = np.lexsort((value[often], examples.row[often]))
        heavy[examples.row[often][order]] = self.dense[examples.term[often][order]]
        rank = np.lexsort((np.arange(n), heavy))
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        self.size = self.blocks * BLOCK
        self.docs, self.labels = examples.docs[rank], np.zeros(self.size)
        self.labels[:n] = examples.labels[rank]
        row, term = place[examples.row], examples.term
        table = np.zeros((int(frequent.sum()), self.size))
        table[self.dense[term[often]], row[often]] = value[often]
        self.most = table.reshape(len(table), self.blocks, BLOCK).max(axis=2)
        self.table = np.ascontiguousarray(table.reshape(len(table), self.blocks, BLOCK).transpose(1, 0, 2))
        order = np.lexsort((row[~often], term[~often]))
        self.places, self.values = row[~often][order].astype(np.int32), value[~often][order]
        self.edges = np.searchsorted(term[~often][order], np.arange(n_terms + 1))

    def scores(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n_texts: int) -> tuple[np.ndarray, ...]:
        """(score, place of the nearest example or -1, its similarity, voting rows) of texts given by their distinct terms."""
        if not self.size:
            return np.full(n_texts, self.base), np.full(n_texts, -1), np.zeros(n_texts), np.zeros(n_texts, np.int64)
        value = (1 + np.log(count)) * self.weight[term]
        value = value / np.maximum(np.sqrt(np.bincount(text, weights=value * value, minlength=n_texts)), 1e-300)[text]
        often = self.dense[term] >= 0
        begin, n = self.edges[term[~often]], np.diff(self.edges)[term[~often]]
        at = textkit.ragged(begin, n)
        rare = np.bincount(np.repeat(text[~often], n) * self.size + self.places[at], weights=np.repeat(value[~often], n) * self.values[at], minlength=n_texts * self.size)
        similar = rare.astype(np.float64, copy=False).reshape(n_texts, self.size)
        query = np.zeros((n_texts, len(self.most)))
        query[text[often], self.dense[term[often]]] = value[often]
        k = min(NEIGHBOURS, self.size)
        # All weights are positive: what the rare terms give can only grow.
        least = np.partition(similar, -k, axis=1)[:, -k]
        blocks = similar.reshape(n_texts, self.blocks, BLOCK)
        reach = query @ self.most + blocks.max(axis=2) >= least[:, None] - 1e-12
        for b in range(self.blocks):
            own = np.flatnonzero(reach[:, b])
            if len(own):
                blocks[own, b] += query[own] @ self.table[b]
        blocks[~reach] = 0
        least = np.partition(similar, -k, axis=1)[:, -k]
        votes = np.where((similar >= least[:, None] - 1e-12) & (similar > 0), similar, 0)
        total = votes.sum(axis=1)
        score = (votes @ self.labels + PRIOR * self.base) / (total + PRIOR)
        best = np.where(total > 0, similar.argmax(axis=1), -1)
        return np.clip(score, 0, 1), best, similar.max(axis=1), (votes > 0).sum(axis=1)


def scored(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest_doc_id, similarity, votes) of every row.

    ``examples`` and ``example_bytes`` bound the labelled rows that are learned from (see ``training``);
    everything else covers all rows and whole texts.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_or_empty().alias("text"))
    learned = Examples(training(documents, labels, examples, example_bytes))
    frequency, n = document_frequencies(texts, learned.known)
    weight = (1 + np.log((1 + n) / (1 + frequency))) * relevance(learned)
    index = documents.sparkSession.sparkContext.broadcast(BlockMaxIndex(learned, weight))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for first, last, text, term, count in term_counts(batch.column(1), own.known):
                for at in range(0, last - first, TOGETHER):
                    n_texts = min(TOGETHER, last - first - at)
                    a, b = np.searchsorted(text, [at, at + n_texts])
                    score, best, similar, votes = own.scores(text[a:b] - at, term[a:b], count[a:b], n_texts)
                    near = pa.array(own.docs[best] if len(own.docs) else np.zeros(n_texts, np.int64), mask=best < 0)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first + at : first + at + n_texts], pa.array(score), near, pa.array(similar), pa.array(votes)], names=["doc_id", "score", "nearest_doc_id", "similarity", "votes"])

    votes = texts.mapInArrow(vote, "doc_id long, score double, nearest_doc_id long, similarity double, votes long")
    return votes.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "nearest_doc_id", "similarity", "votes")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by examples outside the held-out third."""
    return scored(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))
