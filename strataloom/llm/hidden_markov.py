"""A hidden Markov language model, trained by Baum-Welch over partitions.

Tokens are words between ASCII white space, A-Z in lower case, and one end for
each text. A state emits a class, a class its words. Words that make up
1/16384 of all training tokens or more are classes of their own (at most
16,384 by that rule); all others share 4,096 classes, by their last three
bytes, and a class emits its words as often as they were counted, plus one,
with one more for all words that it never saw. So the model's size is bounded
at any size of the corpus, while every word keeps its count, and the model is
a distribution over all texts: with one state it is the add-one unigram model,
save for the share of unknown words.

Each round every partition adds up its expected counts by scaled forward and
backward recursions, vectorised over its sequences; Spark adds up the
partitions' counts, and the driver holds parameters only. Training takes texts
in sequences of up to 1,024 tokens; scoring runs the forward recursion over
each whole text, so the likelihood is exact. Counts are summed as whole
multiples of 2**-16, so their sum doesn't depend on the order.

Cases: a null text is empty and has its end only; a null doc_id is learned
from; words of more than 48 bytes are told apart by a 128-bit digest; a text
of any length is read in parts of some 4 MB; repeated rows count again; without
training texts all counts are 0; columns besides doc_id and text are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables, textkit

STATES, ROUNDS, SEQUENCE = 8, 6, 1024
CLASSES, BUCKETS = 1 << 14, 1 << 12
LONGEST_WORD = 48
#: The end's key: no word has a space.
END = " "
#: Weight of the prior of a state's emissions and of its transitions, in tokens.
EMISSION_PRIOR, MOVE_PRIOR = 200.0, 1.0
FIXED = 1 << 16
PART_BYTES = 1 << 22


def keys(words: pa.Array) -> pa.Array:
    """Words as they are told apart: long ones by a space and their digest."""
    long = pc.greater(pc.binary_length(words), LONGEST_WORD)
    if not pc.any(long).as_py():
        return words
    found = [f" {hashlib.blake2b(w.encode(), digest_size=16).hexdigest()}" for w in words.filter(long).to_pylist()]
    return pc.replace_with_mask(words, long, pa.array(found, words.type))


def read(texts: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, bool, pa.Array, np.ndarray]]:
    """(first row, words of each row, whether the last row ends, distinct keys, number of each word) of runs of texts."""
    for first, last, data, offsets in textkit.chunks(texts, limit):
        begin = 0
        while begin < len(data) or not begin:
            end = len(data)
            if last == first + 1 and end - begin > limit:
                white = np.flatnonzero(textkit.WHITE[data[begin + limit :]])
                end = begin + limit + int(white[0]) if len(white) else end
            part = data[begin:end]
            bounds = offsets if not begin and end == len(data) else np.array([0, len(part)])
            inside = np.zeros(len(part) + 2, bool)
            inside[1:-1] = ~textkit.WHITE[part]
            # A text's first word is not joined to the last one of the text before.
            fresh = np.zeros(len(part) + 1, bool)
            fresh[bounds] = True
            starts = np.flatnonzero(inside[1:-1] & (fresh[:-1] | ~inside[:-2]))
            ends = np.flatnonzero(inside[1:-1] & (fresh[1:] | ~inside[2:])) + 1
            spans = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(textkit.LOWER[part[inside[1:-1]]].tobytes())])
            coded = words.dictionary_encode()
            yield first, np.diff(np.searchsorted(starts, bounds)), end == len(data), keys(coded.dictionary), coded.indices.to_numpy()
            begin = end
            if end == len(data):
                break


def learned_from(documents: DataFrame, folds: int = 7, held: int = 2):
    """False for rows that are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held, F.lit(True))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, c), staged: the keys of all texts, and their ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(texts)], pa.int64())], names=["word", "c"])
            for _, _, _, words, ids in read(texts):
                n = np.bincount(ids, minlength=len(words)).astype(np.int64)
                found = pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "c"])
                yield from (found.slice(at, 1 << 16) for at in range(0, len(n), 1 << 16))

    rows = documents.select(tables.text_or_empty().alias("text")).mapInArrow(count, "word string, c long")
    return tables.staged(rows.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def bucket(words: pa.Array) -> np.ndarray:
    """The shared class of each key, by its last three bytes."""
    words = words.cast(pa.large_string())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    value = np.zeros(len(words), np.uint64)
    for k in range(1, 4):
        at = bounds[1:] - k
        value = value * np.uint64(257) + np.where(at >= bounds[:-1], data[np.maximum(at, 0)] if len(data) else 0, 256).astype(np.uint64)
    return (textkit.mix(value) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Classes:
    """Words with classes of their own (the end is the last), their counts, and the weight of each shared class."""

    own: pa.Array
    own_counts: np.ndarray
    shared: np.ndarray
    tokens: int
    distinct: int

    @property
    def n(self) -> int:
        return len(self.own) + BUCKETS

    def prior(self) -> np.ndarray:
        """The add-one share of each class; the shared classes have one more for words never seen."""
        weight = np.concatenate([self.own_counts + 1.0, self.shared + 1.0])
        return weight / weight.sum()


def classes(counts: DataFrame) -> Classes:
    """From all words' counts; what comes to the driver is bounded by CLASSES words of at most 48 bytes, and BUCKETS sums."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.filter(F.col("word") == END)
    frequent = (F.col("c") * CLASSES >= total.n) & (F.col("word") != END)
    own = counts.filter(frequent).toArrow().sort_by("word")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(bucket(batch.column(0)), weights=batch.column(1).to_numpy() + 1.0, minlength=BUCKETS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["bucket", "n"])

    sums = counts.filter(~frequent & (F.col("word") != END)).select("word", "c").mapInArrow(weigh, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    shared = np.zeros(BUCKETS)
    shared[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    end = ends.first()
    words = pa.concat_arrays([*own["word"].cast(pa.large_string()).chunks, pa.array([END], pa.large_string())])
    return Classes(words, np.append(own["c"].to_numpy(), end.c if end else 0).astype(np.int64), shared, total.n, total.v)


ENCODED = "doc_id long, row long, held_out boolean, n_tokens long, ids binary, known long, weight double, apart double, rare array<string>, times array<long>"


def encoded(documents: DataFrame, known: Classes) -> DataFrame:
    """Every text as the classes of its tokens, staged: rows of ENCODED.

    ``known`` counts tokens of own classes that were counted, ``weight`` adds
    up log10(c + 1) over tokens of own classes and ``apart`` log10 of the
    shared classes' weights over the other tokens; ``rare`` and ``times`` are
    the words of those, with how often each occurs.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.own
        logs = np.concatenate([np.log10(shared.value.own_counts + 1.0), np.log10(shared.value.shared + 1.0)])
        seen = np.append(shared.value.own_counts > 0, np.zeros(BUCKETS, bool))
        end = len(own) - 1
        for batch in batches:
            held: list[pa.RecordBatch] = []
            for first, sizes, ended, words, numbers in read(batch.column(3)):
                own_class = pc.index_in(words, value_set=own).fill_null(-1).to_numpy().astype(np.int64)
                kind = np.where(own_class < 0, len(own) + bucket(words), own_class)[numbers]
                n, texts = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
                mine, value = kind < len(own), logs[kind]
                total = lambda x: np.bincount(texts, weights=x, minlength=n)  # noqa: E731, B023
                ids = np.full(len(kind) + n * ended, end, "<u2")
                ids[np.arange(len(kind)) + texts * ended] = kind
                lengths = sizes + ended
                # A text's rare words, each once.
                key, times = np.unique(texts[~mine] * len(words) + numbers[~mine], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * len(words)).astype(np.int32))
                rare = words.take(pa.array(key % max(len(words), 1))).cast(pa.string())
                columns = [
                    pa.array(lengths.astype(np.int64)), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(2 * lengths)]).astype(np.int32)), pa.py_buffer(ids)]),
                    pa.array((total(seen[kind]) + ended * bool(seen[end])).astype(np.int64)), pa.array(total(value * mine) + ended * logs[end]), pa.array(total(value * ~mine)),
                    pa.ListArray.from_arrays(offsets, rare), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ]
                rows = batch.select(range(3)).slice(first, n)
                found = pa.RecordBatch.from_arrays([*rows.columns, *columns], names=names)
                if held or not ended:
                    held.append(found)
                    found = merged(held) if ended else None
                if ended:
                    held = []
                    yield found

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One text's row of the rows of its parts."""
        column = lambda i: [p.column(i)[0].as_py() for p in parts]
        chained = lambda i: [[x for part in column(i) for x in part]]
        values = [sum(column(3)), b"".join(column(4)), *(sum(column(i)) for i in range(5, 8))]
        columns = [pa.array([v], parts[0].schema.field(i + 3).type) for i, v in enumerate(values)] + [pa.array(chained(i), parts[0].schema.field(i).type) for i in (8, 9)]
        return pa.RecordBatch.from_arrays([*parts[0].columns[:3], *columns], names=names)

    names = ["doc_id", "row", "held_out", "n_tokens", "ids", "known", "weight", "apart", "rare", "times"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), (~learned_from(documents)).alias("held_out"), tables.text_or_empty().alias("text"))
    return tables.staged(rows.mapInArrow(encode, ENCODED), "classes")


@dataclass
class Model:
    """start (states), move (states, states), emit (classes, states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(prior: np.ndarray, states: int) -> Model:
    """States that last, each with the prior's emissions, weighed by hashes of (class, state)."""
    u = (textkit.mix(np.arange(len(prior) * states, dtype=np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float) / 2.0**53
    emit = prior[:, None] * (0.5 + u.reshape(-1, states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


class ByTime:
    """Sequences laid out by time: at each time the sequences that are that long, the longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        sizes = np.array([len(sequences[i]) for i in self.order])
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        self.begins = np.concatenate([[0], np.cumsum(self.active)])
        time = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = self.begins[time] + np.repeat(np.arange(len(sizes)), sizes)
        self.ids = np.empty(len(at), np.int64)
        self.ids[at] = np.concatenate([sequences[i] for i in self.order])


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion."""
    laid = ByTime(sequences)
    out, state = np.zeros(len(sequences)), None
    for t, n in enumerate(laid.active):
        seen = model.emit[laid.ids[laid.begins[t] : laid.begins[t] + n]]
        state = seen * (model.start if state is None else state[:n] @ model.move)
        scale = state.sum(1)
        state /= scale[:, None]
        out[:n] += np.log10(scale)
    found = np.empty(len(sequences))
    found[laid.order] = out
    return found


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and log10 of the probability, of some sequences."""
    laid = ByTime(sequences)
    forward, scales = np.empty((len(laid.ids), len(model.start))), np.empty(len(laid.ids))
    seen = model.emit[laid.ids]
    for t, n in enumerate(laid.active):
        here = slice(laid.begins[t], laid.begins[t] + n)
        state = seen[here] * (model.start if not t else forward[laid.begins[t - 1] : laid.begins[t - 1] + n] @ model.move)
        scales[here] = scale = state.sum(1)
        np.divide(state, scale[:, None], out=forward[here])
    seen /= scales[:, None]
    back = np.ones_like(forward)
    turned = np.ascontiguousarray(model.move.T)
    for t in range(len(laid.active) - 2, -1, -1):
        n, here = laid.active[t + 1], laid.begins[t + 1]
        ahead = seen[here : here + n]
        ahead *= back[here : here + n]
        back[laid.begins[t] : laid.begins[t] + n] = ahead @ turned
    first = laid.active[0]
    later = np.arange(first, len(laid.ids))
    before = later - np.repeat(laid.active[:-1], laid.active[1:])
    moves = model.move * (forward[before].T @ seen[first:])
    forward *= back
    emissions = np.column_stack([np.bincount(laid.ids, weights=forward[:, k], minlength=len(model.emit)) for k in range(len(model.start))])
    return forward[:first].sum(0), moves, emissions, float(np.log10(scales).sum())


def batched(column: pa.Array, sequence: int | None, tokens: int) -> Iterator[list[np.ndarray]]:
    """The sequences of a column of ids, cut to ``sequence`` tokens if given, by length and some ``tokens`` at a time."""
    rows = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
    if sequence:
        rows = [r[i : i + sequence] for r in rows for i in range(0, len(r), sequence)]
        rows.sort(key=len)
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r)
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def improved(sequences: DataFrame, model: Model, prior: np.ndarray) -> tuple[Model, float]:
    """The model after one round of Baum-Welch, and log10 of the probability under the model before."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    n, states = model.emit.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n + states + 2, states))
        for batch in batches:
            for held in batched(batch.column(0), SEQUENCE, 1 << 18):
                start, moves, emissions, score = expected(shared.value, held)
                counts[:n] += emissions
                counts[n : n + states] += moves
                counts[n + states] += start
                counts[n + states + 1, 0] += score
        whole = np.rint(counts * FIXED).astype(np.int64)
        used = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(whole[used, k]) for k in range(states))], names=["at", *(f"k{k}" for k in range(states))])

    schema = "at long, " + ", ".join(f"k{k} long" for k in range(states))
    found = sequences.select("ids").mapInArrow(gather, schema).groupBy("at").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in range(states))).toArrow()
    shared.unpersist()
    counts = np.zeros((n + states + 2, states))
    counts[found["at"].to_numpy()] = np.column_stack([found[f"k{k}"].to_numpy() for k in range(states)]) / FIXED
    emit = counts[:n] + EMISSION_PRIOR * prior[:, None]
    move, start = counts[n : n + states] + MOVE_PRIOR / states, counts[n + states] + MOVE_PRIOR / states
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), counts[n + states + 1, 0]


def trained(rows: DataFrame, known: Classes, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """A model of the rows that are not held out."""
    prior, learned = known.prior(), rows.filter("not held_out")
    model = first_model(prior, states)
    for _ in range(rounds):
        model, _ = improved(learned, model, prior)
    return model


def scored(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    counts = word_counts(documents.filter(learned_from(documents)))
    known = classes(counts)
    rows = encoded(documents, known)
    shared = documents.sparkSession.sparkContext.broadcast(trained(rows, known, states, rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy()
            batch = batch.take(pa.array(np.argsort(lengths, kind="stable")))
            found = [log_likelihoods(shared.value, held) for held in batched(batch.column(1), None, 1 << 21)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["row", "hmm"])

    likely = rows.select("row", "ids").mapInArrow(score, "row long, hmm double")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_weight"))
    found = rows.drop("ids", "rare", "times").join(likely, "row").join(rare, "row", "left").na.fill(0, ["_known"]).na.fill(0.0, ["_weight"])
    seen = F.col("weight") + F.col("_weight")
    base = seen - F.col("n_tokens") * F.lit(float(np.log10(known.tokens + known.distinct + 1.0)))
    # The model's own classes emit their one word; a shared class emits a word by its count.
    score_ = F.col("hmm") + F.col("_weight") - F.col("apart")
    return found.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("_known")).alias("n_known"), F.lit(int(known.tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score_.alias("score"))


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and exact log10 likelihood of every document."""
    return scored(tables.table(spark, sf_dir, "documents"))
