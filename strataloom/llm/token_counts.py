"""Exact token counts at every prefix by dynamic programming.

The vocabulary has no piece that goes on past a run of spaces or holds a line
feed (this is checked when a model is loaded), so a text falls into units,
each begun by such a run or a line feed, that are tokenised independently. The
count at the end of a unit is the count at its start plus the unit's own, and
each distinct unit is tokenised once.

Inside a unit the count of each prefix comes from a shorter one: the last
token of a prefix is the one piece that ends there and is stable beside the
last token of the prefix before it (the two, encoded together, stay as they
are), and the count is one more than that prefix's. So questions of truncation
and budget are answered without encoding a text or a prefix again, in time
linear in the unit, however long it is.

Cases: a null or empty text has 0 tokens; the strings of special tokens are
ordinary text, as the library takes them; equal rows get equal results; other
columns are ignored; texts are counted whole, long ones in parts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables, textkit

#: The library's sign for a space, which it also takes as one in a text.
BLANK = "▁".encode()


class PieceCounts:
    """Token counts of units and of prefixes, by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = textkit.UnitCache(self._units, dtype=np.int32)
        ids = [i for i in range(self.library.get_piece_size()) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.ids = {self.library.id_to_piece(i): i for i in ids}
        self.longest = max(map(len, self.ids))
        blank = BLANK.decode()
        if any("\n" in p or blank in p.lstrip(blank) for p in self.ids) or len(self.library.encode("\n")) != 2:
            raise ValueError(f"units are not independent in the vocabulary of {path}")
        self.stable: dict[tuple[int, int], bool] = {}
        self.loose: dict[str, int] = {}

    def _units(self, units: list[bytes]) -> list[list[int]]:
        return [[n] for n in self.unit_counts(units)]

    def unit_counts(self, units: list[bytes]) -> list[int]:
        """Tokens of units; the library itself puts a space before a text."""
        bare = [(u[1:] if u[:1] == b" " else u[3:] if u[:3] == BLANK else u).decode() for u in units]
        sizes = [len(x) for x in self.library.encode(bare, num_threads=1)]
        return [max(n, 1) if u[:1] == b" " or u[:3] == BLANK else n - 1 for u, n in zip(units, sizes, strict=True)]

    def prefixes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk whose texts each begin with a space: (unit starts, counts before them, first unit of each text)."""
        wide = np.zeros(len(data), bool)
        if len(data) > 2 and (data == 0xE2).any():
            wide[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        blank = (data == 32) | wide
        before = np.zeros(len(data), bool)
        before[1:] = data[:-1] == 32
        before[3:] |= wide[:-3]
        begins = blank & ~before | (data == 10)
        heads = offsets[:-1]
        begins[heads[offsets[1:] > heads]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = textkit.span_hash(textkit.prefix_hash(data), starts, ends)
        counts = self.cache.values(self.cache.find(data, starts, ends, hashes))[0] if len(starts) else np.zeros(0, np.int64)
        return starts, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.searchsorted(starts, offsets)

    def _stays(self, a: int, b: int, text: str) -> bool:
        """Whether the library leaves the tokens a (-1: none) and b beside each other; a line feed keeps them from the beginning."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > 1 << 20:
                self.stable.clear()
            found = self.stable[a, b] = self.library.encode("\n" + text)[2:] == ([b] if a < 0 else [a, b])
        return found

    def prefix_counts(self, unit: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of every prefix of a unit that ends with a character, the empty one first."""
        raw = unit.decode()
        text = raw.replace(" ", BLANK.decode())
        counts, last, begin = [0], [-1], [0]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.ids.get(text[start:end])
                if piece is not None and (last[start] == -2 or self._stays(last[start], piece, text[begin[start] : end])):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    begin.append(start)
                    break
            else:  # a character without a piece is tokens of its own
                sign = text[end - 1]
                if sign not in self.loose:
                    self.loose[sign] = len(self.library.encode("\n" + sign)) - 2
                counts.append(counts[-1] + self.loose[sign])
                last.append(-2)
                begin.append(end - 1)
        return np.concatenate([[0], np.cumsum([len(c.encode()) for c in raw], dtype=np.int64)]), np.array(counts)

    def longest_prefix(self, unit: bytes, budget: int) -> int:
        """Bytes of the longest prefix of a unit within the budget, by whole characters."""
        sizes, counts = self.prefix_counts(unit)
        return int(sizes[counts <= budget].max(initial=0))


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    """The worker's counter for the model file."""
    return PieceCounts(path)


def counted(documents: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_bytes).

    ``fit_bytes``: bytes of the text's longest prefix of at most ``limit``
    tokens, ends of units and, in the last unit, of characters.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counts(path)
        for batch in batches:
            docs, sizes, tokens, fits = batch.column(0).cast(pa.int64()), [], [], []
            held = (0, 0, 0)  # bytes, tokens and fitting bytes of a long text's parts so far
            for _, _, data, offsets, ended in textkit.parts(batch.column(1)):
                own = np.diff(offsets)
                # The library puts a space before a text; later parts of a text begin with one.
                filled = (own > 0) & (held[0] == 0)
                data = np.insert(data, offsets[:-1][filled], 32)
                offsets = np.concatenate([[0], np.cumsum(own + filled)])
                starts, before, first = counter.prefixes(data, offsets)
                n = before[first[1:]] - before[first[:-1]]
                fit = own.copy()
                for i in np.flatnonzero(n + held[1] > limit):
                    budget = before[first[i]] + limit - held[1]
                    if budget < before[first[i]]:  # an earlier part has gone beyond the limit
                        fit[i] = 0
                        continue
                    unit = first[i] + int(np.searchsorted(before[first[i] : first[i + 1] + 1], budget, "right")) - 1
                    end = starts[unit + 1] if unit + 1 < first[i + 1] else offsets[i + 1]
                    fit[i] = max(0, starts[unit] - offsets[i] - int(filled[i]) + counter.longest_prefix(data[starts[unit] : end].tobytes(), int(budget - before[unit])))
                if held != (0, 0, 0) or not ended:
                    held = (held[0] + int(own[0]), held[1] + int(n[0]), held[2] + int(fit[0]))
                    if not ended:
                        continue
                    own, n, fit, held = *(np.array([x]) for x in held), (0, 0, 0)
                sizes.append(own)
                tokens.append(n)
                fits.append(fit)
            whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, tokens, fits)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(whole[0]), pa.array(whole[1]), pa.array(whole[1] > limit), pa.array(whole[2])], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_or_empty().alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return counted(tables.table(spark, sf_dir, "documents"))
