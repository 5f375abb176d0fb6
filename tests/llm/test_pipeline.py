"""The pipeline by its stages: each decision against a plain one."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from strataloom.llm import mixing, quality, tables
from tests.llm.test_operators import lower, near_classes

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, held = tables.table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, tables.staged(stage(spark, docs, DATA), name)
        held[name] = (before, docs)
    before, after = held["quality_rules"]
    want = Counter()
    for r in before.collect():
        *_, kept, _, lines = quality.judged(r.text or "")
        if kept:
            want[r.doc_id, "\n".join(x.decode() for x in lines)] += 1
    assert want == Counter((r.doc_id, r.text) for r in after.collect())
    before, after = held["exact_dedup"]
    best = {}
    for r in before.collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert set(best.values()) == {r.doc_id for r in after.collect()}
    before, after = held["near_dedup"]
    assert after.count() == sum(near_classes(before).values())
    before, after = held["mixing"]
    taken = {r.doc_id: r.copies for r in mixing.rated(before, 1.5, 2, mixing.WEIGHTS, "mix").collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({d: n for d, n in taken.items() if n})
    before, after = held["packing"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r.length for r in rows) == total
    assert len({r.sequence_id for r in rows}) <= 1.05 * np.ceil(total / 2048) + 4
    assert before.columns == tables.table(spark, DATA, "documents").columns
