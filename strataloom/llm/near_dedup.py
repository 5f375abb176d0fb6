"""Near-duplicate classes by DartMinHash signatures, bands and verification.

A text is the set of its 5-word shingles (or a weighted set, where a shingle
weighs as often as it occurs). Darts are thrown at the plane of weight and
rank of each element by a hash of the element alone, so that equal elements
get equal darts in every text; a dart counts where its weight coordinate lies
under the element's weight. Only darts of a rank under t / (total weight) are
thrown, t expected in all whatever the text's length, each with a hashed
coordinate of the signature; the earliest dart of a coordinate is its value. Two
texts agree in a coordinate with the probability of their weighted Jaccard
similarity. A text with an empty coordinate throws on, with t doubled.

Signatures of ``bands * rows`` coordinates are joined by bands. Texts with
equal shingle sets are one node. In each bucket the node that meets most
others leads, and all others are compared with it; then those that are still
in different components of a bucket are compared with one another, block by
block. A pair is linked where the exact similarity of the sets reaches the threshold.

With 20 bands of 5, a pair at similarity 0.8 shares a bucket with probability
0.9996, one at 0.9 with 0.99999.

Cases: words lie between ASCII white space, A-Z in lower case; a text of fewer
than 5 words is one shingle of all of them; null, empty and blank texts are
equal to one another; equal rows belong to one class and one of them is kept;
a null doc_id sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables, textkit
from strataloom.operators import graph
from strataloom.llm.textkit import U64, mix

WORDS = 5
_STEPS = mix(np.arange(11, 11 + 64, dtype=U64)) | U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of a chunk, by text and hash."""
    starts, ends, first = textkit.word_spans(data, offsets)
    hashes = textkit.span_hash(textkit.prefix_hash(data, textkit.LOWER), starts, ends)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = len(hashes) - words + 1
    if n > 0:
        whole = text[:n] == text[words - 1 :]
        at = np.flatnonzero(whole)
        value = np.zeros(len(at), U64)
        for k in range(words):
            value += hashes[at + k] * _STEPS[k]
        doc, value = text[at], mix(value)
    else:
        doc, value = np.zeros(0, np.int64), np.zeros(0, U64)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        more = [int((hashes[first[i] : first[i + 1]] * _STEPS[: sizes[i]]).sum(dtype=U64)) ^ int(sizes[i]) for i in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(np.array(more, U64))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    place = np.flatnonzero(new)
    return doc[new], value[new], np.diff(np.append(place, len(doc)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """(n_docs, size) signatures of weighted sets; rows of empty sets are 0."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    out = np.zeros((n_docs, size), U64)
    budget = size * (np.log(size) + 2)
    open_docs = total > 0
    while open_docs.any():
        pick = open_docs[doc]
        found, full = _throw(doc[pick], element[pick], weight[pick], np.where(open_docs, budget / np.maximum(total, 1e-300), 0), n_docs, size)
        done = open_docs & full
        out[done] = found[done]
        open_docs &= ~full
        budget *= 2
    return out


def _throw(doc, element, weight, limit, n_docs, size):
    """Earliest darts of each coordinate among those of a rank under the text's limit."""
    places, ranks, darts = [], [], []
    low, height = 0.0, 1.0
    strip = 0
    while len(doc):
        d, e, w, rank, throw = doc, element, weight, np.zeros(len(doc)), 0
        while len(d):
            throw += 1
            dart = mix(e ^ mix(np.array([(strip << 32) + throw], U64)))
            rank = rank - np.log(((dart >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)) / height
            alive = rank < limit[d]
            d, e, w, rank, dart = d[alive], e[alive], w[alive], rank[alive], dart[alive]
            spot = mix(dart ^ U64(0x5851F42D4C957F2D))
            hit = low + height * ((spot >> U64(32)).astype(np.float64) / (1 << 32)) < w
            places.append((d * size + (spot & U64(0xFFFFFFFF)).astype(np.int64) % size)[hit])
            ranks.append(rank[hit])
            darts.append(dart[hit])
        low, height = (1.0, 1.0) if strip == 0 else (low * 2, height * 2)
        strip += 1
        higher = weight > low
        doc, element, weight = doc[higher], element[higher], weight[higher]
    place, rank, dart = np.concatenate(places), np.concatenate(ranks), np.concatenate(darts)
    order = np.argsort(-rank, kind="stable")
    found, hit = np.zeros(n_docs * size, U64), np.zeros(n_docs * size, bool)
    found[place[order]] = dart[order]  # of equal places the last, the earliest dart, stays
    hit[place] = True
    return found.reshape(n_docs, size), hit.reshape(n_docs, size).all(axis=1)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signed_texts(documents: DataFrame, bands: int = 20, rows: int = 5, weighted: bool = False, row: str | None = None) -> DataFrame:
    """(doc_id, row, d1, d2, n, bands) of every row, staged; d1, d2, n identify the shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.chunks(batch.column(2)):
                n_docs = last - first
                doc, value, count = shingles(data, offsets)
                weight = count.astype(np.float64) if weighted else np.ones(len(doc))
                signature = dart_signatures(doc, value, weight, n_docs, bands * rows)
                band = np.zeros((n_docs, bands), U64)
                for k in range(rows):
                    band += signature[:, k::rows][:, :bands] * _STEPS[k]
                band = mix(band ^ np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
                edges, d1, d2 = _digests(doc, value ^ count.astype(U64) if weighted else value, n_docs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1) * bands, pa.int32()), pa.array(_signed(band).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(d1), pa.array(d2), pa.array(np.diff(edges)), lists], names=["doc_id", "row", "d1", "d2", "n", "bands"])

    rows_of = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), tables.text_or_empty().alias("text"))
    return tables.staged(rows_of.mapInArrow(sign, "doc_id long, row long, d1 long, d2 long, n long, bands array<long>"), "signed")


def _digests(doc: np.ndarray, shape: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, d1, d2): where each text's shingles lie, and two sums that tell their set."""
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(shape ^ U64(k)), dtype=U64)]) for k in (1, 2)]
    d1, d2 = (_signed(s[edges[1:]] - s[edges[:-1]]) for s in sums)
    return edges, d1, d2


def _sets(documents: DataFrame, needed: DataFrame, weighted: bool = False) -> DataFrame:
    """(row, set) of the ``needed`` (row, d1, d2, n): the sorted hashes as bytes.

    A bitmap, sized by their number, keeps out most sets that are not needed
    before they are shuffled; one that it lets through wrongly only costs its
    way. Where the largest bitmap would be too small there is none. A task
    gives each set once.
    """
    spark = documents.sparkSession
    bits = tables.bitmap_bits(needed.count())
    bitmap = None
    if bits is not None:
        mark = f"pmod(d1, {1 << bits}L)"
        words = needed.selectExpr(f"shiftright({mark}, 6) as w", f"shiftleft(1L, cast({mark} % 64 as int)) as v")
        found = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # a million words at most
        bitmap = np.zeros(1 << (bits - 6), np.int64)
        bitmap[found.column("w").to_numpy()] = found.column("v").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for first, last, data, offsets in textkit.chunks(batch.column(0)):
                doc, value, count = shingles(data, offsets)
                edges, d1, d2 = _digests(doc, value ^ count.astype(U64) if weighted else value, last - first)
                if bits is None:
                    wanted = range(last - first)
                else:
                    spot = d1 % (1 << bits)
                    wanted = np.flatnonzero((shared.value[spot >> 6] >> (spot & 63)) & 1)
                keep = []
                for i in wanted:
                    if (key := (int(d1[i]), int(d2[i]))) not in given:
                        given.add(key)
                        keep.append(i)
                each = [value[edges[i] : edges[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(d1[keep]), pa.array(d2[keep]), pa.array(np.diff(edges)[keep]), pa.array(each, pa.binary())], names=["d1", "d2", "n", "set"])

    found = documents.select(tables.text_or_empty().alias("text")).mapInArrow(sets, "d1 long, d2 long, n long, set binary")
    return found.join(needed, ["d1", "d2", "n"]).select("row", "set").dropDuplicates(["row"])


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of the threshold at least."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("row").alias("a"), F.col("set").alias("x")), sets.select(F.col("row").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def block_links(rows: list[list[int]], labels: list[list[int]], sets: list[list[bytes]], threshold: float) -> list[tuple[int, int]]:
    """Links between members of two blocks (or within one) that join different labels; of each such tie one link.

    Intersections come from products of incidence matrices, some thousands of
    shared elements at a time.
    """
    row, label = sum(rows, []), sum(labels, [])
    each = [np.frombuffer(x, U64) for x in sum(sets, [])]
    size = np.array([len(x) for x in each], np.int64)
    owner = np.repeat(np.arange(len(each)), size)
    value, place, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    keep = (count > 1)[place]
    owner, place, n_common = owner[keep], common[place[keep]], int((count > 1).sum())
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    first = len(rows[0])
    left, right = slice(0, first), slice(0, first) if len(rows) == 1 else slice(first, None)
    both = np.zeros((first, len(each) - right.start), np.float32)
    for begin in range(0, n_common, 8192):
        a, b = np.searchsorted(place, [begin, begin + 8192])
        part = np.zeros((len(each), min(8192, n_common - begin)), np.float32)
        part[owner[a:b], place[a:b] - begin] = 1
        both += part[left] @ part[right].T
    union = size[left, None] + size[None, right] - both
    x, y = np.nonzero(both >= threshold * union - 1e-9)
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            v = up
        return v

    found = []
    for u, v in zip(x.tolist(), (y + right.start).tolist(), strict=True):
        if (p := root(label[u])) != (q := root(label[v])):
            parent[max(p, q)] = min(p, q)
            found.append((row[u], row[v]))
    return found


def linked_blocks(members: DataFrame, key: list[str], sets: DataFrame, threshold: float, block: int = 96) -> DataFrame:
    """Links (a, b) between members of a bucket that have different labels, compared block by block.

    A bucket's members are dealt to blocks of about ``block``; every two blocks
    of a bucket meet in one row, so that neither a bucket nor its pairs are
    ever gathered, and only the links leave the task.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = [[[m[k] for m in side] for side in ([x] if y is None else [x, y])] for k in ("row", "label", "set")]
                found += block_links(*blocks, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    blocks = F.ceil(F.col("met") / block).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    held = dealt.join(sets, "row").groupBy(*key, "blocks", "own").agg(F.collect_list(F.struct("row", "label", "set")).alias("x"))
    held = tables.staged(held, "blocks")
    alone = held.select("x", F.lit(None).cast(held.schema["x"].dataType).alias("y"))
    wide = held.filter("own + 1 < blocks").select(*key, "x", F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)).alias("own"))
    met = wide.join(held.filter("own > 0").select(*key, "own", F.col("x").alias("y")), [*key, "own"]).select("x", "y")
    pairs = alone.unionByName(met).repartition(tables.partitions(members.sparkSession))
    return pairs.mapInArrow(compare, "a long, b long").distinct()


def classes(documents: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 5, weighted: bool = False, row: str | None = None) -> DataFrame:
    """(doc_id, row, class_id, class_size, kept) of every row; class_id is the least doc_id."""
    signed = signed_texts(documents, bands, rows, weighted, row)
    one = ["d1", "d2", "n"]
    nodes = tables.staged(signed.groupBy(*one).agg(F.min(F.struct("row", "bands")).alias("m"), F.count("*").alias("copies")).select(*one, "m.row", "m.bands", "copies"), "nodes")
    spots = nodes.filter("n > 0").select("row", F.posexplode("bands").alias("band", "hash"))
    key = ["band", "hash"]
    # Staged, so that the join deals both of its sides anew and Spark can split a hot bucket.
    meets = tables.staged(spots.groupBy(*key).agg(F.count("*").alias("met")).filter("met > 1"), "meets")
    shared = tables.staged(spots.join(meets, key), "buckets")
    fame = shared.groupBy("row").agg(F.sum("met").alias("fame"))
    leaders = shared.join(fame, "row").groupBy(*key).agg(F.max(F.struct("fame", "row")).alias("lead"))
    leaders = tables.staged(leaders, "leaders")
    star = shared.join(leaders, key).select(F.least("row", "lead.row").alias("a"), F.greatest("row", "lead.row").alias("b")).filter("a <> b").distinct()
    star = tables.staged(star, "pairs")
    needed = nodes.join(shared.select("row").distinct(), "row").select("row", *one)
    sets = tables.staged(_sets(documents, needed, weighted), "sets")
    links = tables.staged(linked(star, sets, threshold), "links")
    label = graph.components(links)
    # Members of one bucket that no link has brought together yet are compared with one another.
    named = shared.join(label.withColumnRenamed("node", "row"), "row", "left").select(*key, "row", F.coalesce("label", "row").alias("label"))
    named = tables.staged(named, "named")
    split = named.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("met")).filter("lo < hi")
    split = tables.staged(split, "split")
    more = tables.staged(linked_blocks(named.join(split.select(*key, "met"), key), key, sets, threshold), "links")
    label = graph.components(links.unionByName(more))
    grouped = nodes.join(label.withColumnRenamed("node", "row"), "row", "left").select(*one, "row", "copies", F.coalesce("label", "row").alias("label"))
    members = signed.join(grouped.select(*one, "label"), one).select("doc_id", "row", "label")
    best = members.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("class_size")).filter("class_size > 1")
    best = tables.staged(best, "best")  # the join then deals both of its sides anew, and Spark can split a hot class
    found = members.join(best, "label", "left")
    alone = F.col("class_size").isNull()
    return found.select("doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("row") == F.col("best.row"))).alias("kept"))


def deduplicated(documents: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 5) -> DataFrame:
    """One row of each class, the least doc_id's, all columns kept."""
    row = tables.free_name(documents, "_row")
    held = tables.staged(documents.withColumn(row, F.monotonically_increasing_id()), "documents")
    losers = classes(held, threshold, bands, rows, row=row).filter("not kept").select(F.col("row").alias(row))
    return held.join(losers, row, "left_anti").drop(row)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 5 words, similarity 0.8."""
    return classes(tables.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
