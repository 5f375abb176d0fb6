"""The text operators with an oracle against DuckDB, and toxicity against brute force."""

from __future__ import annotations

import glob
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from strataloom.llm import registry, tool_calls, toxicity

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in registry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def terms_of(text):
    return Counter(re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def test_toxicity_equals_a_brute_force_vote(spark, tmp_path):
    rng = random.Random(8)
    bad, good = ["vile", "Rotten", "disgusting", "scum"], ["table", "river", "lantern", "of", "mountain", "grün", "GREEN", "of"]
    rare = ["".join(rng.choice("xyzwvu") for _ in range(3)) for _ in range(150)]
    rows, labels = [], {}
    for i in range(400):
        toxic = int(i % 5 == 0)
        words = rng.choices(good, k=rng.randint(0, 8)) + rng.choices(rare, k=rng.randint(0, 5)) + rng.choices(bad, k=rng.randint(1, 3) if toxic or i % 29 == 0 else 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words) if i else None, "x"))
        if i % 10 < 8:
            labels[i] = toxic
    rows.append(rows[7])
    spark.createDataFrame(rows, "doc_id long, text string, label string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels.items(), (9, 2), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = [(i, terms_of(text)) for i, text, _ in rows]
    examples = [(c, labels[i]) for i, c in counts if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    df = Counter(k for _, c in counts for k in c)
    hits, others = (Counter(k for c, v in examples if v == own for k in c) for own in (1, 0))
    n_hits = sum(v for _, v in examples)
    base = n_hits / len(examples)

    def vector(c):
        rf = {k: math.log2(2 + (hits[k] / n_hits) / (max(others[k], 1) / (len(examples) - n_hits))) for k in c if hits[k] + others[k]}
        rf = {k: x * (1 + max(0, (hits[k] - (m := hits[k] + others[k]) * base) / math.sqrt(m * base * (1 - base) + 1))) for k, x in rf.items()}
        w = {k: (1 + math.log(c[k])) * (1 + math.log((1 + len(rows)) / (1 + df[k]))) * r for k, r in rf.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {k: x / size for k, x in w.items()}

    known = [(vector(c), v) for c, v in examples]
    want = Counter()
    for i, c in counts:
        own = vector(c)
        near = sorted(((sum(x * w.get(k, 0) for k, x in own.items()), v) for w, v in known), reverse=True)
        near = [x for x in near if x[0] > 0 and x[0] >= near[toxicity.NEIGHBOURS - 1][0] - 1e-12]
        score = (sum(s * v for s, v in near) + toxicity.PRIOR * base) / (sum(s for s, _ in near) + toxicity.PRIOR)
        want[i, len(near), round(score, 7), int(score >= 0.7)] += 1
    found = toxicity.scored(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))).collect()
    assert want == Counter((r.doc_id, r.votes, round(r.score, 7), r.predicted) for r in found)


def test_toxicity_of_held_out_rows(spark):
    """At the smallest scale with enough labels: held-out rows whose label is known."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op5_toxicity(spark, data).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    found = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert found[1, 1] >= 0.9 * (found[1, 1] + found.get((1, 0), 0)) and found.get((0, 1), 0) <= 0.005 * found[0, 0]


def test_tool_calls_of_odd_turns_equal_their_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, role, f"text {rng.randrange(9)}" if rng.random() < 0.8 else None, "x", 1) for c in (1, 2, None) for t, role in enumerate(["system", *["user", "assistant"] * 9, "tool"])]
    rows += [(1, 2, "assistant", "again", "x", 1), (1, 3, "user", "again", "x", 1), (2, None, "user", "when", "x", 1), (2, None, "assistant", None, "x", 1), (3, 0, None, None, "x", 1), (None, None, None, None, None, None)]
    rows += [(4, t, "user", "same", "x", 1) for t in range(1, 40, 2)] + [(5, 4, "assistant", "alone", "x", 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, level int").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for where in ("true", "false"):
        spark.read.parquet(f"{tmp_path}/conversations.parquet").filter(where).coalesce(1).write.parquet(f"{tmp_path}/{where}/conversations.parquet")
        frame = registry.queries()["op9_tool_calls"](spark, f"{tmp_path}/{where}")
        duck = duckdb.connect()
        duck.execute(f"create view conversations as select * from '{tmp_path}/{where}/conversations.parquet/*.parquet'")
        found = duck.execute(registry.oracle_sql()["op9_tool_calls"])
        names = [d[0] for d in found.description]
        assert Counter(tuple(r[c] for c in names) for r in frame.collect()) == Counter(map(tuple, found.fetchall()))
        assert frame.count() == (len(rows) if where == "true" else 0)


def test_tool_call_lines_hold_whole_texts(spark, tmp_path):
    """The operator's lines carry the texts; only the query puts digests in their place."""
    texts = [("user", 'say "x"\n\u00e9\t\\'), ("assistant", "yes, " * 50), ("system", "be brief"), ("user", None)]
    spark.createDataFrame([("a", i, r, t) for i, (r, t) in enumerate(texts)], "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.turn: json.loads(r.json) for r in tool_calls.conversations(spark, str(tmp_path)).collect()}
    assert found[0]["arguments"]["query"] == texts[0][1] and found[3]["arguments"]["query"] == ""
    assert found[1]["content"] == texts[1][1] and found[2]["content"] == texts[2][1]
    short = {r.turn: json.loads(r.json) for r in tool_calls.op9_tool_calls(spark, str(tmp_path)).collect()}
    assert short[1]["content"] == hashlib.md5(texts[1][1].encode()).hexdigest()
    assert short[0]["arguments"] == found[0]["arguments"] | {"query": hashlib.md5(texts[0][1].encode()).hexdigest()[:8]}
