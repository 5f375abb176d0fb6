"""Removal of long repeated substrings by a sparse, range-partitioned suffix array.

Every window of ``length`` bytes names an anchor: the place of the least hashed
k-mer in it (the last of equals). Equal windows have their anchors at the same
offset, so a repeat is found among the suffixes that start at anchors, about
one in 170 bytes. The windows of one anchor are consecutive; with the
bytes that they span they are a *run*.

1. Runs whose leading k bytes start no other run are dropped (a count by hash).
2. Equal runs become one, with their number. Two or more equal runs repeat whole.
3. The suffixes are range-partitioned by their leading k bytes, with Spark's
   sampled splitters; leading bytes of more than 4,096 different runs are split
   further, so that a very common passage is no hot bucket. A bucket is worked
   through in blocks of bounded size. In a block, multikey quicksort over 8-byte words puts the
   suffixes in order; the longer common prefix with a neighbour bounds how far
   right a run's repeats can reach. Windows within that bound are found by
   fingerprints and compared byte by byte.
4. Comparison across boundaries: leading bytes that were split go on in other
   blocks. Where two blocks share them, their runs are
   joined by 128-bit BLAKE2 digests: first of the bytes that 16 neighbouring
   windows have in common, then of the windows where those bytes met others.
5. Repeated windows return to their documents and the bytes they cover go.

Texts are anchored in pieces of 256 KB that overlap by a window, whatever
their length, and runs that a piece's end cuts are put together again.

Cases: a null text is empty; texts shorter than ``length`` keep everything; of
equal rows each is a copy of the other; a null doc_id is a key like any other;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables, textkit
from strataloom.llm.textkit import U64, mix

LENGTH = 400
LEAD = 64
PIECE = 1 << 18
BLOCK_BYTES = 1 << 20
MOST = 4096
CELL = 16
KEY = ["doc_id", "t1", "t2"]
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def tokens(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes at each place, put together from hashes of half as many."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a * U64(0x9E3779B97F4A7C15)
        out += b
        out ^= out >> U64(29)
        out *= U64(0xBF58476D1CE4E5B9)
        return out

    value, have = _BYTES[data], 1
    while have * 2 <= width:
        value = joined(value[:-have], value[have:])
        have *= 2
    if have < width:
        n = len(data) - width + 1
        value = joined(value[:n], value[width - have : width - have + n])
    value ^= value >> U64(32)
    return value


def _least(best: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, have = len(best) - width + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    return np.minimum(best[:n], best[width - have : width - have + n]) if have < width else best[:n]


def _piece_runs(data: np.ndarray, offsets: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    n = len(data) - length + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),)
    if n <= 0:
        return none
    token = tokens(data, lead)
    low = U64((1 << 32) - 1)  # half of the hash, then the place: a fixed split, so that equal windows agree in every chunk
    best = _least((token & ~low) | (low - np.arange(len(token), dtype=U64)), length - lead + 1)
    anchor = (low - (best & low)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), "right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
    whole = np.flatnonzero(np.arange(n) + length <= offsets[text + 1])
    if not len(whole):
        return none
    a = anchor[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (a[1:] != a[:-1]) | (whole[1:] != whole[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = whole[begin], whole[np.append(begin[1:], len(whole)) - 1]
    return text[first], a[begin], first, last, token[a[begin]]


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, lead: int = LEAD, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, hash of the leading bytes) of the runs of a chunk; places in the chunk.

    Only a chunk of one long text is worked through in pieces.
    """
    if len(offsets) != 2 or len(data) <= piece + length:
        return _piece_runs(data, offsets, length, lead)
    found = []
    for begin in range(0, len(data) - length + 1, piece):
        part = data[begin : begin + piece + length - 1]
        text, anchor, first, last, token = _piece_runs(part, np.array([0, len(part)]), length, lead)
        found.append((text, anchor + begin, first + begin, last + begin, token))
    text, anchor, first, last, token = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)
    begin = np.flatnonzero(new)
    return text[begin], anchor[begin], first[begin], last[np.append(begin[1:], len(first)) - 1], token[begin]


def suffix_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes sorted within their groups, and each one's common prefix with the next in order.

    Multikey quicksort: all groups are divided by one 8-byte word at a time,
    and only suffixes that are still equal to another go on to the next word.
    ``group`` is in ascending order; across groups the common prefix is 0.
    """
    n = len(starts)
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    part = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if n else np.zeros(0, np.int64)
    places, depth = np.arange(n), 0
    while True:
        same = np.zeros(len(places), bool)
        if len(places) > 1:
            equal = part[1:] == part[:-1]
            same[1:] |= equal
            same[:-1] |= equal
        places, part = places[same], part[same]
        if not len(places):
            return order, common
        item = order[places]
        left = ends[item] - starts[item] - depth
        if (left <= 0).all():
            common[places[:-1][part[1:] == part[:-1]]] = depth
            return order, common
        spot = np.minimum(starts[item] + depth, len(data))[:, None] + np.arange(8)
        raw = np.where(np.arange(8) < left[:, None], padded[np.minimum(spot, len(padded) - 1)], 0).astype(np.uint8)
        word = raw.view(">u8").reshape(-1).astype(U64)
        rank = np.lexsort((left, word, part))
        item, word = item[rank], word[rank]
        order[places] = item
        size = np.minimum(ends[item] - starts[item] - depth, 8).clip(0)
        equal = part[1:] == part[:-1]
        differ = word[1:] ^ word[:-1]
        bytes_equal = np.where(differ == 0, 8, (63 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).clip(0, 63).astype(np.int64)) // 8)
        # A float's logarithm may round up at a byte's edge, never by more than one bit: verify with a shift.
        shift = U64(8) * (U64(7) - np.minimum(bytes_equal, 7).astype(U64))
        bytes_equal = np.where((differ != 0) & ((differ >> shift) == 0), bytes_equal + 1, bytes_equal)
        reach = depth + np.minimum(bytes_equal, np.minimum(size[1:], size[:-1]))
        common[places[:-1]] = np.where(equal, reach, common[places[:-1]])
        split = ~equal | (differ != 0) | (np.minimum(size[1:], size[:-1]) < 8)
        part = np.concatenate([[0], np.cumsum(split)])
        depth += 8


def equal_spans(data: np.ndarray, p: np.ndarray, q: np.ndarray, length: int, most: int = 1 << 21) -> np.ndarray:
    """Whether the ``length`` bytes at p are those at q, pair by pair.

    Neighbouring pairs at one distance are compared as one stretch, some
    ``most`` bytes at a time.
    """
    low, far = np.minimum(p, q), np.abs(q - p)
    order = np.lexsort((low, far))
    low, far = low[order], far[order]
    new = np.ones(len(low), bool)
    new[1:] = (far[1:] != far[:-1]) | (low[1:] != low[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(low))) + length - 1
    ends = np.cumsum(size)
    good = np.ones(len(low), bool)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        own = slice(at, to)
        places = textkit.ragged(low[begin[own]], size[own])
        differ = data[places] != data[places + np.repeat(far[begin[own]], size[own])]
        if differ.any():
            total = np.concatenate([[0], np.cumsum(differ)])
            windows = size[own] - length + 1
            spot = textkit.ragged(np.cumsum(size[own]) - size[own], windows)
            good[textkit.ragged(begin[own], windows)] = total[spot + length] == total[spot]
        at = to
    out = np.empty(len(low), bool)
    out[order] = good
    return out


def equal_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each place is equal, byte by byte, to one at another place."""
    prints = tokens(data, length)[at]
    rank = np.argsort(prints, kind="stable")
    same = prints[rank[1:]] == prints[rank[:-1]]
    hit = np.zeros(len(at), bool)
    left, right = rank[:-1][same], rank[1:][same]
    good = equal_spans(data, at[left], at[right], length)
    hit[left[good]] = hit[right[good]] = True
    if not good.all():  # different windows with one fingerprint: these are told apart by their bytes
        doubtful = np.flatnonzero(np.isin(prints, np.unique(prints[left[~good]])))
        each = [data[i : i + length].tobytes() for i in at[doubtful]]
        count = Counter(each)
        hit[doubtful] = [count[x] > 1 for x in each]
    return hit


def repeated_windows(data, starts, anchors, lasts, group, alone, length: int = LENGTH) -> np.ndarray:
    """Whether each window of the runs (one after the other) lies in another run, too.

    starts, anchors, lasts: of each run its first window, anchor and last window in ``data``; group: ascending.
    """
    ends = lasts + length
    order, common = suffix_order(data, anchors, ends, group)
    reach = np.zeros(len(starts), np.int64)
    np.maximum.at(reach, order, common)
    np.maximum.at(reach, order[1:], common[:-1])
    # Window s needs s + length - anchor bytes to the right of its anchor.
    final = np.minimum(lasts, anchors + reach - length)
    sizes = np.maximum(final - starts + 1, 0)
    at = textkit.ragged(starts, sizes)
    total = lasts - starts + 1
    out = np.zeros(int(total.sum()), bool)
    if len(at):
        out[textkit.ragged(np.cumsum(total) - total, sizes)] = equal_windows(data, at, length)
    whole = ~alone
    out[textkit.ragged((np.cumsum(total) - total)[whole], total[whole])] = True
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _digests(spans: list) -> np.ndarray:
    """(n, 2): 128-bit BLAKE2 digests of byte strings."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in spans]), np.int64).reshape(-1, 2)


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    raw = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def anchored(texts: DataFrame, length: int, lead: int) -> DataFrame:
    """(key, lead hash, anchor, first, last) of every run; places in the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in textkit.chunks(batch.column(3), PIECE):
                text, anchor, begin, end, token = runs(data, offsets, length, lead)
                rows = pa.array(first + text)
                base = offsets[text]
                keys = [batch.column(i).take(rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(_signed(token)), *(pa.array((x - base).astype(np.int32)) for x in (anchor, begin, end))], names=[*KEY, "token", "anchor", "first", "last"])

    return texts.mapInArrow(find, "doc_id long, t1 long, t2 long, token long, anchor int, first int, last int")


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """(key, first, off, size, c1, c2, bytes) of the runs listed with each text; c1, c2 name the bytes."""
    names = [*KEY, "first", "off", "size", "c1", "c2", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _binary(batch.column(3).cast(pa.large_string()).cast(pa.large_binary()))
            listed = batch.column(4)
            edges = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            first, last, anchor = (listed.flatten().field(k).to_numpy() for k in ("first", "last", "anchor"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            begin = bounds[row] + first
            end = bounds[row] + last + length
            part = np.cumsum(end - begin) // (1 << 22)  # rows of some 4 MB leave together
            for a, b in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
                own = slice(a, b)
                each = [data[x:y].tobytes() for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
                name = _digests(each)
                columns = [*(batch.column(i).take(pa.array(row[own])) for i in range(3)), pa.array(first[own]), pa.array(anchor[own] - first[own]), pa.array(last[own] - first[own] + 1), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(cut, "doc_id long, t1 long, t2 long, first int, off int, size int, c1 long, c2 long, bytes binary")


FOUND = "c1 long, c2 long, from int, to int, head binary, block long, off int, size int, bytes binary, mask binary"


def searched(distinct: DataFrame, length: int, lead: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of FOUND from (c1, c2, head, hot, off, size, n, bytes): repeated windows of the runs, block by block.

    Rows with a ``head`` are the runs of ``hot`` leading bytes, for the
    comparison across boundaries; the bits of ``mask`` are their windows that
    were found repeated. All runs of other leading bytes are in one block.
    """
    names = ["c1", "c2", "from", "to", "head", "block", "off", "size", "bytes", "mask"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            off, size, n = (table.column(k).to_numpy() for k in ("off", "size", "n"))
            data, bounds = _binary(table.column("bytes"))
            starts = bounds[:-1]
            flags = repeated_windows(data, starts, starts + off, starts + size - 1, group, n == 1, length)
            ends = np.cumsum(size)
            # Runs lie one after the other; a gap between them keeps spans apart.
            spaced = np.zeros(len(flags) + len(size), bool)
            spaced[np.arange(len(flags)) + np.repeat(np.arange(len(size)), size)] = flags
            a, b = _spans(spaced)
            run = np.searchsorted(ends + np.arange(1, len(size) + 1), a, "right")
            base = (ends - size + np.arange(len(size)))[run]
            take = lambda k, rows: table.column(k).combine_chunks().take(pa.array(rows))
            void = lambda kind, rows: pa.nulls(len(rows), kind)
            columns = [take("c1", run), take("c2", run), pa.array((a - base).astype(np.int32)), pa.array((b - base - 1).astype(np.int32)), *(void(k, run) for k in kinds[4:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            own = np.flatnonzero(table.column("hot").to_numpy())
            block = int(table.column("c1")[0].as_py() ^ table.column("c2")[-1].as_py())
            columns = [take("c1", own), take("c2", own), void(kinds[2], own), void(kinds[3], own), take("head", own), pa.array(np.full(len(own), block)), *(take(k, own) for k in ("off", "size", "bytes"))]
            columns.append(pa.array([np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends[own].tolist(), size[own].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def groups(table: pa.Table) -> np.ndarray:
            head = _binary(table.column("head"))[0].reshape(-1, lead)
            return np.concatenate([[0], np.cumsum((head[1:] != head[:-1]).any(axis=1))])

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                held.append(batch.slice(at, 512))
                size += held[-1].nbytes
                if size < block_bytes:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                group = groups(table)
                # The last leading bytes wait for the next block, unless they are split anyway.
                edge = table.num_rows if table.column("hot")[-1].as_py() else int(np.searchsorted(group, group[-1]))
                if edge:
                    yield from done(table.slice(0, edge), group[:edge])
                held = table.slice(edge).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held) if edge else 0  # one group: look again after another block
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, groups(table))

    spread = F.when(F.col("hot"), F.col("c1")).otherwise(0)
    dealt = distinct.repartitionByRange(tables.partitions(distinct.sparkSession), F.col("head"), spread).sortWithinPartitions("head", "c1", "c2")
    return dealt.select("c1", "c2", "head", "off", "size", "n", "bytes", "hot").mapInArrow(search, FOUND)


def _cells(edge: DataFrame, length: int, cell: int) -> DataFrame:
    """(c1, c2, block, k, w1, w2): for each ``cell`` windows of a run, counted from the anchor, a digest of the bytes that all of them have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, bounds = _binary(part.column(5))
                off, size = part.column(3).to_numpy().astype(np.int64), part.column(4).to_numpy()
                low = (off - size + 1) // cell
                n = off // cell - low + 1
                row, k = np.repeat(np.arange(len(off)), n), textkit.ragged(low, n)
                begin = bounds[row] + off[row] - cell * k
                raw = data.tobytes()
                name = _digests([raw[x : x + length - cell + 1] for x in begin.tolist()])
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(own) for i in range(3)), pa.array(k.astype(np.int32)), pa.array(name[:, 0]), pa.array(name[:, 1])], names=["c1", "c2", "block", "k", "w1", "w2"])

    return edge.select("c1", "c2", "block", "off", "size", "bytes").mapInArrow(cut, "c1 long, c2 long, block long, k int, w1 long, w2 long")


def _windows(edge: DataFrame, length: int, cell: int) -> DataFrame:
    """(c1, c2, block, from, w1, w2): digests of the windows of the cells ``ks`` of each run.

    Windows that were found repeated only have to meet others: of equal ones a
    batch gives one, without the run's name.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, known = [], set()
            for c1, c2, block, off, size, raw, mask, ks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flags = np.unpackbits(np.frombuffer(mask, np.uint8), count=size)
                for k in ks:
                    for w in range(max(0, off - cell * k - cell + 1), min(size, off - cell * k + 1)):
                        name = hashlib.blake2b(raw[w : w + length], digest_size=16).digest()
                        if not flags[w]:
                            held.append((c1, c2, block, w, name))
                        elif (block, name) not in known:
                            known.add((block, name))
                            held.append((None, None, block, w, name))
            name = np.frombuffer(b"".join([x[4] for x in held]), np.int64).reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in held], kind) for i, kind in enumerate(kinds)), pa.array(name[:, 0]), pa.array(name[:, 1])], names=["c1", "c2", "block", "from", "w1", "w2"])

    return edge.select("c1", "c2", "block", "off", "size", "bytes", "mask", "ks").mapInArrow(cut, "c1 long, c2 long, block long, from int, w1 long, w2 long")


def across(found: DataFrame, length: int) -> DataFrame:
    """(c1, c2, from, to): windows of the runs at the edges of blocks (rows of FOUND with a head) that occur in another block."""
    cell = max(1, min(CELL, length // 2))
    elsewhere = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo <> hi").select(*keys)
    edge = found.filter("head is not null")
    shared = tables.staged(elsewhere(edge, "head"), "heads")
    edge = tables.staged(edge.join(shared, "head", "left_semi"), "edge")
    cells = tables.staged(_cells(edge, length, cell), "cells")
    met = tables.staged(elsewhere(cells, "w1", "w2"), "met")
    open_ = cells.join(met, ["w1", "w2"]).groupBy("c1", "c2", "block").agg(F.collect_set("k").alias("ks"))
    each = tables.staged(_windows(edge.join(open_, ["c1", "c2", "block"]), length, cell), "windows")
    twice = tables.staged(elsewhere(each, "w1", "w2"), "twice")
    return each.filter("c1 is not null").join(twice, ["w1", "w2"]).select("c1", "c2", "from", F.col("from").alias("to"))


def repeated_spans(held: DataFrame, length: int, lead: int, block_bytes: int = BLOCK_BYTES, most: int = MOST) -> DataFrame:
    """(c1, c2, from, to) of the runs in ``held``: their windows that lie in another run, too."""
    headed = held.withColumn("head", F.expr(f"substring(bytes, off + 1, {lead})"))
    sizes = headed.select("head", "c1", "c2").distinct().groupBy("head").agg(F.count("*").alias("runs"))
    hot = tables.staged(sizes.filter(F.col("runs") > most).select("head", F.lit(True).alias("hot")), "hot")
    merged = headed.groupBy("c1", "c2", "off", "size").agg(F.count("*").alias("n"), F.first("head").alias("head"), F.first("bytes").alias("bytes"))
    merged = merged.join(hot, "head", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    found = tables.staged(searched(merged, length, lead, block_bytes), "searched")
    spans = found.filter("head is null").select("c1", "c2", "from", "to")
    return spans if hot.isEmpty() else spans.unionByName(across(found, length))


def stripped(texts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) from (doc_id, text, sorted spans)."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            data, bounds = _binary(batch.column(1).cast(pa.large_string()).cast(pa.large_binary()))
            listed = batch.column(2)
            edges = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            lefts, rights = (listed.flatten().field(k).to_numpy() for k in ("a", "b"))
            out, held = [[] for _ in kinds], 0
            for i, doc in enumerate(batch.column(0).to_pylist()):
                raw = data[bounds[i] : bounds[i + 1]]
                left, right = lefts[edges[i] : edges[i + 1]], np.maximum.accumulate(rights[edges[i] : edges[i + 1]])
                new = np.ones(len(left), bool)
                new[1:] = left[1:] > right[:-1]
                begin, end = left[new], right[np.append(np.flatnonzero(new)[1:], len(left)) - 1]
                rest = b"".join(raw[x:y].tobytes() for x, y in zip(np.append(0, end), np.append(begin, len(raw)), strict=True))
                row = (doc, len(raw), len(raw) - len(rest), len(begin), hashlib.sha256(rest).hexdigest(), rest)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                held += len(rest)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    out, held = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("doc_id", "text", "spans").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def removed(documents: DataFrame, length: int = LENGTH, lead: int = LEAD, block_bytes: int = BLOCK_BYTES, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    ``kept``: the bytes that stay, as binary (a cut may fall inside a character); null where nothing goes.
    """
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_or_empty().alias("text"))
    text = text.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "text")
    found = tables.staged(anchored(text, length, lead), "runs")
    # Staged, so that the join deals both of its sides anew and Spark can split a hot token.
    twice = tables.staged(found.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "tokens")
    listed = found.join(twice, "token").groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "anchor")).alias("found"))
    listed = tables.staged(listed, "listed")
    near = tables.sieve(text, listed.select(*KEY), KEY)
    equal = lambda a, b: [a[k].eqNullSafe(b[k]) for k in KEY]
    texts = near.join(listed, equal(near, listed)).select(near["doc_id"], near["t1"], near["t2"], "text", "found")
    held = tables.staged(contexts(texts, length), "contexts")
    spans = tables.staged(repeated_spans(held, length, lead, block_bytes, most), "spans")
    own = held.select(*KEY, "first", "c1", "c2").distinct().join(spans, ["c1", "c2"])
    own = own.select(*KEY, F.struct((F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + length).alias("b")).alias("span"))
    gone = tables.staged(own.groupBy(*KEY).agg(F.array_sort(F.collect_set("span")).alias("spans")), "gone")
    near = tables.sieve(text, gone.select(*KEY), KEY)
    changed = stripped(near.join(gone, equal(near, gone)).select(near["doc_id"], "text", "spans"))
    whole = text.select(*KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    whole = whole.join(gone.select(*KEY), equal(whole, gone), "left_anti")
    zero = F.lit(0).cast("long")
    same_text = whole.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    return changed.unionByName(same_text)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that occur elsewhere."""
    return removed(tables.table(spark, sf_dir, "documents")).drop("kept")
