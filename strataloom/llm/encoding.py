"""Token ids of whole texts by the ``tokenizers`` library, distinct words once.

The byte-level BPE of the vocabulary file never merges across the words of
its own splitting pattern. The pattern is applied with numpy to the bytes of
many texts at once, and every distinct word goes through the library; texts
that hold an added token's string or a character whose class may differ
between Unicode versions go through the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from strataloom.llm import textkit

OTHER, LETTER, NUMBER, SPACE, UNSURE = 3, 1, 2, 4, 5
#: Characters of Unicode's White_Space property (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; all others are unsure."""
    names = {"L": LETTER, "N": NUMBER}
    table = np.array([UNSURE if (c := unicodedata.category(chr(i))) in ("Cn", "Cs") else names.get(c[0], OTHER) for i in range(0x10000)], np.uint8)
    table[WHITE_SPACE] = SPACE
    return np.append(table, np.uint8(UNSURE))


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and code points of the characters; beyond the basic plane 0x10000."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int64)
    more = np.flatnonzero(code >= 0xC0)
    if len(more):
        lead, p = code[more], at[more]
        tail = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64) & 0x3F
        two, three = ((lead & 0x1F) << 6) | tail[p + 1], ((lead & 0x0F) << 12) | (tail[p + 1] << 6) | tail[p + 2]
        code[more] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, 0x10000))
    return at, code


def byte_bpe_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the words of the splitting pattern, and a flag for each text that is unsure.

    The pattern takes, in this order: a contraction of an apostrophe, letters
    with a space before them, digits likewise, other signs likewise, white
    space up to the last one before a word, white space.
    """
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_texts, bool)
    at, code = _characters(data)
    kind = _classes()[code]
    begins = np.zeros(len(at) + 1, bool)
    begins[np.searchsorted(at, offsets)] = True
    ends, begins = begins[1:], begins[:-1]
    before = np.concatenate([[0], kind[:-1]])
    after = np.concatenate([kind[1:], [0]])
    before[begins], after[ends] = 0, 0
    white = kind == SPACE
    run = kind != before
    blank_before = np.concatenate([[False], code[:-1] == 32]) & ~begins
    start = np.where(white, run | ((after != SPACE) & (after != 0)), run & ~blank_before)
    quote = np.flatnonzero(start & (code == 39) & (after == LETTER))
    if len(quote):
        padded = np.concatenate([code, [0, 0, 0]])
        same = np.concatenate([~begins, [False, False, False]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = same[quote + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        quote, step = quote[short | long], np.where(short, 2, 3)[short | long]
        start[quote + 1] = False
        rest = quote + step
        fits = rest < len(at)
        rest = rest[fits]
        rest = rest[~begins[rest] & (kind[rest] == LETTER)]
        start[rest] = True
    unsure = np.zeros(n_texts, bool)
    odd = at[kind == UNSURE]
    unsure[np.searchsorted(offsets, odd, "right") - 1] = True
    return at[start], unsure


class ByteBpe:
    """Ids of whole texts as the library gives them without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [str(t.content).encode() for t in self.library.get_added_tokens_decoder().values()]
        self.cache = textkit.UnitCache(self._words)

    def _words(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, their offsets)."""
        starts, unsure = byte_bpe_words(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = textkit.span_hash(textkit.prefix_hash(data), starts, ends)
        ids, lengths = self.cache.values(self.cache.find(data, starts, ends, hashes)) if len(starts) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        raw = data.tobytes()
        for word in self.added:
            found = raw.find(word)
            while found >= 0:
                unsure[np.searchsorted(offsets, found, "right") - 1] = True
                found = raw.find(word, found + 1)
        if unsure.any():
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(offsets) - 1)]
            for i in np.flatnonzero(unsure):
                text = raw[offsets[i] : offsets[i + 1]].decode()
                parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, ids.dtype)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder of the vocabulary file."""
    return ByteBpe(path)


def encoded(column: pa.Array, path: str):
    """(row, ids) of each text of an Arrow column, in order; long texts are encoded in parts."""
    encoder, held = byte_bpe(path), []
    for first, last, data, offsets, ended in textkit.parts(column):
        ids, bounds = encoder.encode(data, offsets)
        if held or not ended:
            held.append(ids)
            if ended:
                yield first, np.concatenate(held)
                held = []
            continue
        for i in range(last - first):
            yield first + i, ids[bounds[i] : bounds[i + 1]]
