"""The Merkle manifest against a tree that is built plainly, and against its SQL on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from strataloom.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def proof_and_root(digests, at):
    """The siblings of a place, as (left, right), and the root."""
    beside = []
    while len(digests) > 1:
        run = at // 3 * 3
        beside.append((digests[run:at], digests[at + 1 : run + 3]))
        digests, at = [H(*digests[i : i + 3]) for i in range(0, len(digests), 3)], at // 3
    return beside, digests[0]


def plainly(rows):
    found, sources = [], sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((r[0] is not None, r[0], leaf(*r), r) for r in rows if r[1] == s), key=lambda x: (x[0], x[1] or 0, x[2])) for s in sources}
    subroots = [proof_and_root([x[2] for x in trees[s]], 0)[1] for s in sources]
    for at, s in enumerate(sources):
        for place, (_, doc, own, r) in enumerate(trees[s]):
            path = proof_and_root([x[2] for x in trees[s]], place)[0]
            upper, root = proof_and_root(subroots, at)
            digest = leaf(*r[:4], r[4].replace("\n", "")) if doc is not None and r[4] is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else own
            for left, right in path + upper:
                digest = H(*left, digest, *right)
            found.append((doc, own, subroots[at], root, H(*(x for a, b in path + upper for x in a + b)), digest, digest == root))
    return Counter(found)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, place int, tree string"


def rows_of(n, sources):
    rng = random.Random(n)
    texts = [None, "", "a\nb", "\n\n", "ä 漢\nx", "plain", "x" * 5000 + "\n"]
    rows = [(i * 7, rng.choices(sources, [9] + [1] * (len(sources) - 1))[0], rng.choice([None, "en"]), rng.choice([None, i]), rng.choice(texts)) for i in range(n)]
    return rows + (rows[:3] + [(None, None, None, None, None), (None, sources[0], "de", 1, "no\nnumber"), (14, "b", None, 3, "same number\n")] if n > 2 else [])


@pytest.mark.parametrize(("n", "sources"), [(0, ["a"]), (1, ["a"]), (4, ["a", "Z"]), (700, ["a", "b", None, "ä", "Z", "null", "t"]), (300, ["a"])])
def test_manifest_equals_a_plain_tree_and_its_sql(spark, tmp_path, n, sources):
    rows = rows_of(n, sources)
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect())
    assert got == plainly(rows)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(duck.execute(f"select {', '.join(COLUMNS)} from ({merkle.OP12_SQL})").fetchall())


def test_versions_share_what_they_do_not_copy(spark):
    rows = rows_of(400, ["a", "b"])
    found = merkle.manifest(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).cache()
    changed = {(r.doc_id, r.leaf): r for r in found.filter("tampered <> leaf").collect()}
    nodes = merkle.version_nodes(found).collect()
    assert changed and {x.doc_id for x in nodes} == {d for d, _ in changed}
    depth = {r.doc_id: len(r.copies) for r in changed.values()}
    assert max(depth.values()) <= 8
    assert all(Counter(x.level for x in nodes if x.doc_id == d)[depth[d]] >= 1 for d in depth)


def test_no_task_holds_the_paths_of_many_blocks():
    """However many blocks Spark gives at once, a task works on few: the paths of a block's nodes are some hundred KB."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["block"])
    pieces = list(merkle.in_pieces(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in pieces) <= merkle.AT_ONCE == 32
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(1000))
