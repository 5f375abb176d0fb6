"""Phrase collocations by relational mining of occurrences, one length after the other.

The occurrence relation of length 1 is written once, in blocks: a block holds
one language's words in the order of (piece, position), each as a number of
the block's own list of words. For each next length the relation is joined
with itself: an occurrence meets the one that starts a place later in its
piece, and as both sides lie in that order, the join is one merge along the
block. Before it, occurrences of groups that are not frequent are left out
(the semi-join), and the groups that it gives are counted over all blocks.

The semi-join uses a bitmap of the frequent groups' hashes, of at most 2**26
bits at any size: what it lets through wrongly is rare as a whole, so it is
dropped by its own count. Counts are of words, not of hashes, so they are exact.

Cases: a null text has no words, a null language is ``und``; a text of any
length is taken in parts of some 2 MB, each with the words before it that a
phrase may begin with; a piece of any length may be cut so, a word is never
cut; repeated rows count again; ties go by the phrase's bytes; columns besides
text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm import tables, textkit

BLOCK_BYTES = 1 << 21
GAP, BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
AFTER_A_WORD = re.compile(rb"[ \t.,;:!?\n-\r]")
LOWER = bytes(textkit.LOWER)
RELATION = "lang string, words array<string>, steps binary, ids binary, context long"


def streams(langs: pa.Array, texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[str, bytes, bool]]:
    """(language, bytes, whether they go on) of runs of texts, a line feed between two; long texts come in several runs."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for at in range(len(texts)):
        lang, data = langs[at].as_py(), (texts[at].as_py() or "").encode().translate(LOWER)
        lang = "und" if lang is None else lang
        if len(data) > limit:
            begin = 0
            while begin < len(data):
                found = AFTER_A_WORD.search(data, begin + limit)
                end = found.start() if found else len(data)
                yield lang, data[begin:end], end < len(data)
                begin = end
            continue
        held.setdefault(lang, []).append(data)
        sizes[lang] = sizes.get(lang, 0) + len(data) + 1
        if sizes[lang] > limit:
            yield lang, b"\n".join(held.pop(lang)), False
            sizes[lang] = 0
    for lang, parts in held.items():
        yield lang, b"\n".join(parts), False


def occurrences(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A run's list of words; for each occurrence, in order, its word's number, its step from the one before (1: next in its piece, 2: not) and where it starts."""
    values = np.frombuffer(data, np.uint8)
    kind = KIND[values]
    inside = np.zeros(len(values) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values[inside[1:-1]].tobytes())])
    coded = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
    steps = np.where(np.diff(piece, prepend=-1) == 0, 1, 2).astype(np.uint8)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int32), steps, starts


def relation(documents: DataFrame, longest: int, limit: int = BLOCK_BYTES) -> DataFrame:
    """The staged occurrence relation of length 1: rows of RELATION.

    ``context`` occurrences at a block's start belong to the block before it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = b""
            for lang, data, more in streams(batch.column(0), batch.column(1), limit):
                words, ids, steps, starts = occurrences(before + data)
                context = int(np.searchsorted(starts, len(before)))
                if len(ids) > context:
                    yield row(lang, words, steps, ids, context)
                before = (before + data)[starts[-longest + 1 :][0] :] if more and longest > 1 and len(starts) else b""
            pa.default_memory_pool().release_unused()

    return tables.staged_arrays(documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(read, RELATION), "occurrences", 10_000)


def row(lang: str, words: pa.Array, steps: np.ndarray, ids: np.ndarray, context: int) -> pa.RecordBatch:
    """One block as a batch of RELATION."""
    held = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), held, pa.array([steps.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([context], pa.int64())], names=["lang", "words", "steps", "ids", "context"])


def unfolded(batch: pa.RecordBatch, length: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, int]]:
    """(lang, words, steps, ids as rows of ``length``, context) of a batch of RELATION."""
    for i in range(batch.num_rows):
        ids = np.frombuffer(batch.column(3)[i].as_py(), np.int32).reshape(-1, length)
        yield batch.column(0)[i].as_py(), batch.column(1)[i].values, np.frombuffer(batch.column(2)[i].as_py(), np.uint8), ids, batch.column(4)[i].as_py()


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    words = words.cast(pa.large_string())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(words) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0] if len(words) else bounds
    return textkit.span_hash(textkit.prefix_hash(data), bounds[:-1], bounds[1:]) if len(words) else np.zeros(0, np.uint64)


def marks(lang: str, rows: np.ndarray, bits: int) -> np.ndarray:
    """The places in a bitmap of 2**bits of phrases of a language, given their words' hashes row by row."""
    out = np.full(len(rows), hashes(pa.array([lang], pa.large_string()))[0], np.uint64)
    for column in rows.T:
        out = textkit.mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def counted(occurring: DataFrame, length: int) -> DataFrame:
    """(lang, phrase, f) of all groups of a relation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, _, ids, context in unfolded(batch, length):
                first, n = groups(ids[context:], len(words))
                parts = [words.take(pa.array(c)) for c in ids[context:][first].T]
                phrases = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
                found = pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32))), phrases.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "f"])
                yield from (found.slice(at, 1 << 16) for at in range(0, len(n), 1 << 16))
                del found, phrases, parts
                pa.default_memory_pool().release_unused()

    return occurring.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def groups(ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """An occurrence and the count of each distinct row of ids."""
    key, bound = ids[:, 0].astype(np.int64), n_words
    for column in ids.T[1:]:
        if bound * n_words >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            bound = len(distinct)
        key, bound = key * n_words + column, bound * n_words
    order = np.argsort(key)
    new = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
    return order[new], np.diff(new, append=len(key)).astype(np.int64)


def bitmap(frequent: DataFrame, n: int, length: int) -> tuple[int, np.ndarray]:
    """Its size as a power of two, and the bitmap of frequent groups as words of 64 bits; at most ``tables.MOST_BITS``."""
    bits = tables.bitmap_bits(n) or tables.MOST_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for lang in dict.fromkeys(langs):
                own = pc.list_flatten(pc.split_pattern(phrases.filter(pa.array(langs == lang)), " "))
                at = marks(lang, hashes(own).reshape(-1, length), bits)
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    places = frequent.select("lang", "phrase").mapInArrow(mark, "at long")
    found = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits, out.view(np.uint64)


def extended(occurring: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """The staged relation of length + 1: occurrences of frequent groups, each joined with the one a place later."""
    spark, n = occurring.sparkSession, frequent.count()
    bits, held = bitmap(frequent, n, length)
    shared = spark.sparkContext.broadcast(held)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lang, words, steps, ids, context in unfolded(batch, length):
                at = marks(lang, hashes(words)[ids], bits)
                alive = known[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1
                left = np.flatnonzero(alive[:-1] & alive[1:] & (steps[1:] == 1))
                fresh = int(np.searchsorted(left, context - 1))
                if fresh < len(left):
                    joined = np.column_stack([ids[left], ids[left + 1, -1]])
                    used, numbers = np.unique(joined, return_inverse=True)
                    ahead = np.where(np.diff(left, prepend=-9) == 1, 1, 2).astype(np.uint8)
                    yield row(lang, words.take(pa.array(used)), ahead, numbers.reshape(joined.shape).astype(np.int32), fresh)

    return tables.staged_arrays(occurring.mapInArrow(extend, RELATION), "occurrences", 10_000)


def mined(documents: DataFrame, longest: int = 3, least: int = 10, limit: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and the staged frequent groups of all lengths: (lang, phrase, length, f)."""
    occurring, found = relation(documents, longest, limit), None
    sizes = occurring.groupBy("lang").agg(F.sum(F.expr("octet_length(ids) div 4 - context")).alias("n"))
    for length in range(1, longest + 1):
        frequent = tables.staged_arrays(counted(occurring, length).filter(F.col("f") >= least), "frequent", 10_000)
        some = frequent.withColumn("length", F.lit(length))
        found = some if found is None else found.unionByName(some)
        if length < longest:
            occurring = extended(occurring, frequent, length)
    return sizes, found


def scored(frequent: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(lang, phrase, length, a, l, r, score) of groups of two words or more, by their lowest cut.

    Every cut of a candidate asks for the counts of its two parts; parts are as
    frequent as the candidate at least, so they are all in ``frequent``.
    """
    words = F.split("phrase", " ")
    cut = lambda first, n: F.concat_ws(" ", F.slice(words, first, n))
    cuts = frequent.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.withColumn("left", cut(F.lit(1), F.col("k"))).withColumn("right", cut(F.col("k") + 1, F.col("length")))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(n)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("_up", (wide("a") * wide("a") * F.lit(scale)).cast("decimal(38,0)")).withColumn("_down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("_up div _down").cast("long"))
    best = cuts.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "length", "a", "best.l", "best.r", "best.score")


def maximal(candidates: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates without those whose words lie in a longer one that is ``percent`` as frequent at least."""
    longer = candidates.filter("length > 2").select("lang", F.col("a").alias("_longer"), F.split("phrase", " ").alias("_words"), "length")
    inner = longer.select("lang", "_longer", "_words", "length", F.explode(F.expr("sequence(2, length - 1)")).alias("_n"))
    inner = inner.select("lang", "_longer", F.expr("explode(transform(sequence(1, length - _n + 1), i -> concat_ws(' ', slice(_words, i, _n))))").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").filter(f"_longer is null or 100 * _longer < {percent} * a").drop("_longer")


def first(candidates: DataFrame, most: int = 2000) -> DataFrame:
    """The first rows of each language by score, count and phrase; a language is cut down in parts first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    fewer = candidates.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    return fewer.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, limit: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words."""
    sizes, frequent = mined(documents, longest, least, limit)
    top = first(maximal(tables.staged(scored(frequent), "candidates")), most)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of 2 or 3 words that occur 10 times or more."""
    return collocations(tables.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces
  from documents),
p as (select lang, unnest(pieces) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
grams as (
  select lang, k as length, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase
  from w, (values (1), (2), (3)) v(k) where len(w) >= k),
f as (select lang, length, phrase, count(*) as f from grams group by all having count(*) >= 10),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
cuts as (
  select lang, length, phrase, f as a, unnest(range(1, length)) as k, string_split(phrase, ' ') as w from f where length > 1),
s as (
  select c.lang, c.length, c.phrase, c.a, c.k, l.f as l, r.f as r,
         cast(1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f) as bigint) as score
  from cuts c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, sub, max(a) as a from (
    select lang, a, unnest([array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') for i in range(1, length)]) as sub from best where length > 2)
  group by lang, sub),
kept as (
  select b.* from best b left join longer o on o.lang = b.lang and o.sub = b.phrase
  where o.a is null or 100 * o.a < 50 * b.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join n on n.lang = kept.lang
qualify rank <= 2000
"""
