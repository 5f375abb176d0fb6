"""Byte-level work on Arrow text columns, vectorised with numpy.

A column is taken in chunks of whole texts; within a chunk the UTF-8 bytes of
all texts lie one after the other, so that words are spans of one byte array.
Spans are told apart by hashes of two polynomials over primes, taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: Primes below 2**31 and a base for each. Modulo a power of two every odd base has short colliding words; modulo a prime it has none of that form.
_PRIMES = (U64(2147483647), U64(2147483629))
_BASES = (1337420069, 1881210719)
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit moves every output bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUES = [mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(k)) % (p - U64(1)) + U64(1) for k, p in enumerate(_PRIMES)]


def _power_row(n: int, base: int, prime: int) -> np.ndarray:
    """1, base, base**2, ... modulo the prime, by doubling."""
    out = np.ones(n, U64)
    done = 1
    while done < n:
        step = U64(pow(base, done, prime))
        out[done : 2 * done] = out[: min(done, n - done)] * step % U64(prime)
        done *= 2
    return out.astype(np.uint32)


@lru_cache(maxsize=2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(_power_row(n, b, int(p)) for b in (base, pow(base, -1, int(p)))) for base, p in zip(_BASES, _PRIMES, strict=True)]


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, n at least."""
    return _powers(max(CHUNK_BYTES * 2, 1 << int(n).bit_length()))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts.

    A run ends once it holds ``limit`` bytes; one text is never divided.
    """
    column = text_array(column)
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, last row + 1, bytes, offsets, ended): ``chunks`` whose long texts come in several parts.

    A text of more than ``limit`` bytes is cut before spaces between two ASCII
    letters, where a word ends under any rule of words; all its parts but the
    last are not ``ended``. A text without such a place is one part.
    """
    for first, last, data, offsets in chunks(column, limit):
        begin = 0
        while last == first + 1 and len(data) - begin > limit:
            cut = _cut(data, begin + limit)
            if cut is None:
                break
            yield first, last, data[begin:cut], np.array([0, cut - begin]), False
            begin = cut
        yield first, last, data[begin:], offsets if not begin else np.array([0, len(data) - begin]), True


def _cut(data: np.ndarray, at: int, step: int = 1 << 16) -> int | None:
    """The first place from ``at`` on that holds a space between two ASCII letters."""
    while at < len(data) - 1:
        near = data[at - 1 : at + step + 1]
        letter = ASCII_LETTER[near]
        found = np.flatnonzero((near[1:-1] == 32) & letter[:-2] & letter[2:])
        if len(found):
            return at + int(found[0])
        at += step
    return None


def prefix_hash(data: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Polynomial prefix sums of the bytes for both primes, folded by a table of 256 if given."""
    out = np.zeros((2, len(data) + 1), U64)
    if len(data):
        for row, values, prime, (up, _) in zip(out, _BYTE_VALUES, _PRIMES, powers(len(data)), strict=True):
            np.cumsum((values if fold is None else values[fold])[data] * up[: len(data)] % prime, out=row[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal spans have equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, U64)
    h = (ends - starts).astype(U64) * U64(0xA24BAED4963EE407)
    for k, (row, prime, (_, down)) in enumerate(zip(prefix, _PRIMES, powers(prefix.shape[1]), strict=True)):
        h ^= ((row[ends] - row[starts]) % prime * down[starts] % prime) << U64(32 * k)
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space, and the texts' word offsets."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WHITE[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[1:-1][edges]
    stops[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ``range(start, start + length)``."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)


class UnitCache:
    """Values of text units; each distinct unit is encoded once.

    ``encode`` maps a list of byte strings to a list of integer lists. Hashes
    lie in an open-addressing table that numpy probes for many units at once.
    Every hit is compared with the bytes of the unit it was stored for; units
    whose hash belongs to another unit have a dictionary by their bytes.
    When the table is half full, or the bytes exceed ``most_bytes``, it starts
    anew, so that it never grows with the input.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], bits: int = 22, dtype=np.uint16, most_bytes: int = 1 << 26):
        self.encode, self.mask, self.dtype, self.most_bytes = encode, (1 << bits) - 1, dtype, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, U64)
        self.slot = np.zeros(self.mask + 1, np.int32)
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.texts, self.text_starts, self.text_lengths = np.zeros(1 << 18, np.uint8), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = self.held = 0
        self.others: dict[bytes, int] = {}

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes in the table; -1 where one is absent."""
        at = (hashes & U64(self.mask)).astype(np.int64)
        key = self.keys[at]
        at[key == 0] = -1
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            key = self.keys[at[left]]
            at[left[key == 0]] = -1
            left = left[(key != hashes[left]) & (key != 0)]
        return at

    def _insert(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at = (hashes & U64(self.mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            placed = self.keys[at] == hashes
            self.slot[at[placed]] = slots[placed]
            hashes, slots, at = hashes[~placed], slots[~placed], (at[~placed] + 1) & self.mask

    def _store(self, units: list[bytes]) -> np.ndarray:
        """Slots of new units, their values and bytes stored."""
        values = self.encode(units)
        n, m = self.count, self.count + len(units)
        sizes, widths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (values, units))
        total, more = int(sizes.sum()), int(widths.sum())
        self.pool, self.texts = _room(self.pool, self.used + total), _room(self.texts, self.held + more)
        self.starts, self.lengths, self.text_starts, self.text_lengths = (_room(x, m) for x in (self.starts, self.lengths, self.text_starts, self.text_lengths))
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(values), self.dtype, total)
        self.texts[self.held : self.held + more] = np.frombuffer(b"".join(units), np.uint8)
        self.starts[n:m], self.lengths[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.text_starts[n:m], self.text_lengths[n:m] = self.held + np.cumsum(widths) - widths, widths
        self.used, self.held, self.count = self.used + total, self.held + more, m
        return np.arange(n, m, dtype=np.int32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each unit; values lie in ``pool`` at ``starts[slot]``."""
        if self.count + len(self.others) and self.held > self.most_bytes:
            self.clear()
        hashes = np.where(hashes == 0, U64(1), hashes)
        at = self._probe(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.count + len(new) > self.mask // 2:
                if self.count:
                    self.clear()
                    return self.find(data, starts, ends, hashes)
                while len(new) > self.mask // 2:  # one text of millions of distinct units
                    self.mask = 2 * self.mask + 1
                self.clear()
            pick = missing[first]
            self._insert(new, self._store(_units(data, starts[pick], ends[pick])))
            at[missing] = self._probe(hashes[missing])
        slots = self.slot[at]
        for i in self._unlike(data, starts, ends, slots):
            unit = data[starts[i] : ends[i]].tobytes()
            if unit not in self.others:
                self.others[unit] = int(self._store([unit])[0])
            slots[i] = self.others[unit]
        return slots

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray, step: int = 1 << 17) -> list[int]:
        """Units whose bytes are not those of their slot."""
        out = []
        for a in range(0, len(starts), step):
            own = slice(a, a + step)
            width, begin = ends[own] - starts[own], self.text_starts[slots[own]]
            unlike = width != self.text_lengths[slots[own]]
            width = np.where(unlike, 0, width)
            differ = data[ragged(starts[own], width)] != self.texts[ragged(begin, width)]
            if differ.any():
                unlike[np.repeat(np.arange(len(width)), width)[differ]] = True
            out += (np.flatnonzero(unlike) + a).tolist()
        return out

    def values(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the units one after the other, and each unit's length."""
        lengths = self.lengths[slots].astype(np.int64)
        return self.pool[ragged(self.starts[slots].astype(np.int64), lengths)], lengths


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for n elements, doubled as often as it takes."""
    while n > len(x):
        x = np.concatenate([x, np.zeros_like(x)])
    return x


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
