"""Collocations against brute force, whatever the blocks' size, and against their SQL on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from strataloom.llm import collocations, tables

SCHEMA = "doc_id long, text string, lang string, words int, phrase string, f long, source string"


def plainly(rows, longest=3, least=10, most=2000):
    sizes, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang, words] = (a, f[lang, words[:k]], f[lang, words[k:]], score)
    covered = {}
    for (lang, words), (a, *_) in found.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                part = lang, words[i : i + n]
                covered[part] = max(covered.get(part, 0), a)
    out = Counter()
    for lang in sizes:
        kept = [(-s, -a, " ".join(w).encode(), l, r) for (g, w), (a, l, r, s) in found.items() if g == lang and 100 * covered.get((g, w), 0) < 50 * a]
        for rank, (s, a, w, l, r) in enumerate(sorted(kept)[:most], 1):
            out[lang, rank, w.decode(), -a, l, r, sizes[lang], -s] += 1
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "city", "é漢", "the", "of", "a'b", "x" * 40, "7", "NEW"]
    gaps = [" "] * 9 + ["  ", "\t", ", ", ".", "\n", "\r\n", " ; ", "!"]
    texts = ["".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    rows = [(rng.choice(["en", "en", "en", None, "ä", "und"]), t) for t in texts]
    return rows + [("en", None), (None, None), ("en", ""), ("en", " \n "), *rows[:3], ("en", "new york city " * 900), ("en", "one-word" * 3000), ("zz", "a b " * 9)]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("limit", "longest", "least"), [(1 << 22, 3, 10), (64, 3, 10), (300, 4, 3), (50, 2, 5)])
def test_collocations_equal_brute_force(spark, limit, longest, least):
    rows = rows_of(limit, 300)
    frame = spark.createDataFrame([(i, t, g, 1, "x", 2, "s") for i, (g, t) in enumerate(rows)], SCHEMA)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(frame, longest, least, 2000, limit).collect())
    assert got == plainly(rows, longest, least)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = rows_of(5, 200)
    frame = spark.createDataFrame([(i, t, g, 1, "x", 2, "s") for i, (g, t) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(tables, "MOST_BITS", 7)
    monkeypatch.setattr(tables, "bitmap_bits", lambda n: None)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(frame, 3, 10, 5).collect())
    assert got == plainly(rows, most=5)


def test_collocations_equal_their_sql(spark, tmp_path):
    for name, rows in (("some", rows_of(9, 200)), ("none", [])):
        spark.createDataFrame([(i, t, g, 1, "x", 2, "s") for i, (g, t) in enumerate(rows)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        duck = duckdb.connect()
        duck.execute(f"create view documents as select * from '{tmp_path}/{name}/documents.parquet/*.parquet'")
        got = Counter(tuple(r[c] for c in COLUMNS) for r in collocations.op11_collocations(spark, f"{tmp_path}/{name}").collect())
        assert got == Counter(duck.execute(f"select {', '.join(COLUMNS)} from ({collocations.OP11_SQL})").fetchall()) == plainly(rows)


def test_products_beyond_64_bits(spark):
    a = 3 * 10**12
    frame = spark.createDataFrame([("x", "p", 1, 7 * a), ("x", "q", 1, a + 1), ("x", "p q", 2, a)], "lang string, phrase string, length int, f long")
    (row,) = collocations.scored(frame).collect()
    assert row.score == 10**6 * a * a // (7 * a * (a + 1))


def test_groups_of_many_words():
    ids = np.random.default_rng(1).integers(0, 3, (500, 5)).astype(np.int32)
    first, n = collocations.groups(ids, 1 << 20)
    assert Counter({tuple(ids[i]): k for i, k in zip(first, n.tolist(), strict=True)}) == Counter(map(tuple, ids))


def test_blocks_go_to_python_a_few_at_once(spark, monkeypatch):
    """A block is megabytes: of many blocks in a task only some 16 MB go to Python at once, and the session's own limits stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, **kwargs: seen.append((path.split("/")[-1].split("-")[0], int(spark.conf.get(key).rstrip("b")))) or write(self, path, *args, **kwargs))
    documents = spark.createDataFrame([("a b a b", "en")] * 20, "text string, lang string")
    collocations.mined(documents, longest=2)
    assert {n for name, n in seen if name in ("occurrences", "frequent")} == {1 << 24}
    assert spark.conf.get(key) == before
