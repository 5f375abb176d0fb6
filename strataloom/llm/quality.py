"""Quality rules, line first.

Every line is judged by itself, failing lines are removed, and a document that
loses more than half of its word characters is rejected. A line fails if it is

* navigation: three separators ``|`` or more, or three ``>`` or more;
* symbols: more than a tenth of its word characters are of ``#*$%&|<>``;
* boilerplate: it has one of the PHRASES, in any case;
* unpunctuated: it has none of ``. ! ?`` or their wide forms or an ellipsis.

Blank lines never fail. Base measures of the whole text reject a document
before that: fewer than 10 words, or more than a fifth of the words in 5-word
windows that occur twice or more.

Cases: a null or empty text has no words and is rejected; equal rows get equal
results; other columns are kept by ``cleaned`` and ignored otherwise; a text of
any length is judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables

SYMBOLS = b"#*$%&|<>"
STOPS = tuple(s.encode() for s in (".", "!", "?", "…", "。", "！", "？"))
PHRASES = (b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use", b"terms of service", b"subscribe to our newsletter", b"javascript is disabled", b"enable javascript", b"lorem ipsum")
WHITE = b" \t\n\r\x0b\f"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def characters(raw: bytes) -> int:
    """Code points outside ASCII white space."""
    return len(raw.translate(None, WHITE).decode("utf-8", "replace"))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, bound = number[:n], len(ids)
    for k in range(1, window):
        if bound * len(ids) >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            bound = len(distinct)
        key = key * len(ids) + number[k : n + k]
        bound *= len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def line_fails(line: bytes, chars: int) -> bool:
    """Whether a line with word characters is to be removed."""
    if line.count(b"|") >= 3 or line.count(b">") >= 3:
        return True
    if 10 * (len(line) - len(line.translate(None, SYMBOLS))) > chars:
        return True
    if not any(s in line for s in STOPS):
        return True
    low = line.lower()
    return any(p in low for p in PHRASES)


def judged(text: str) -> tuple[list[int], bool, bool, int, list[str]]:
    """(measures, base_failed, kept, characters kept, lines kept)."""
    raw = text.encode()
    words = raw.split()
    repeats = repeated_words(words)
    seen: set[bytes] = set()
    total = held = twice = 0
    lines: list[bytes] = []
    for line in raw.split(b"\n"):
        chars = characters(line)
        if not chars:
            lines.append(line)
            continue
        twice += line in seen
        seen.add(line)
        total += chars
        if not line_fails(line, chars):
            held += chars
            lines.append(line)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    measures = [len(words), total, len(raw) - len(raw.translate(None, SYMBOLS)), twice, repeats]
    return measures, failed, not failed and 2 * held >= total, held, lines


def _rows(texts: list[str]) -> tuple[list, list[str]]:
    out = [judged(t or "") for t in texts]
    columns = [pa.array([x[0][i] for x in out], pa.int64()) for i in range(5)]
    columns += [pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.bool_()), pa.array([x[3] for x in out], pa.int64())]
    return columns, ["\n".join(b.decode() for b in x[4]) for x in out]


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept, kept_chars) of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, _ = _rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES, "base_failed", "kept", "kept_chars"])

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean, kept_chars long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def cleaned(documents: DataFrame) -> DataFrame:
    """The rows that are kept, ``text`` without its failing lines, other columns as they are.

    A column ``n_chars`` is set to the new text's length in characters.
    """
    schema = documents.schema
    at = documents.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = _rows(batch.column(at).to_pylist())
            out = list(batch.columns)
            out[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(out, schema=batch.schema).filter(columns[6])

    out = documents.mapInArrow(clean, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return measured(tables.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
words as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
spots as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5),
grams as (select doc_id, i, array_to_string(w[i:i+4], ' ') as g from spots),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
hit as (select distinct doc_id, i + k as p from twice, range(5) r(k)),
repeats as (select doc_id, count(*) as n_repeat_words from hit group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
m as (
  select doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols,
         length(line) - length(replace(line, '|', '')) as bars, length(line) - length(replace(line, '>', '')) as arrows
  from l),
v as (
  select *, bars >= 3 or arrows >= 3 or 10 * symbols > chars or not regexp_matches(line, '[.!?…。！？]')
         or regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|subscribe to our newsletter|javascript is disabled|enable javascript|lorem ipsum') as fails
  from m where chars > 0),
lines as (
  select doc_id, sum(chars) as word_chars, count(*) - count(distinct line) as n_dup_lines,
         coalesce(sum(chars) filter (where not fails), 0) as kept_chars
  from v group by doc_id),
b as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(coalesce(kept_chars, 0) as bigint) as kept_chars
  from d join words using (doc_id) left join lines using (doc_id) left join repeats using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 2 * kept_chars >= word_chars as kept
from b
"""
