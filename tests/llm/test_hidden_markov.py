"""The hidden Markov model against sums over all paths, plain counts, and held-out texts."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import hidden_markov as hm

SCHEMA = "doc_id long, text string, word string, row int, ids int, held_out int"


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def some_model(n, states, seed=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((n, states)), 0))


def paths(model, ids):
    """Each path's probability with these emissions."""
    for path in itertools.product(range(len(model.start)), repeat=len(ids)):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for (a, b), i in zip(itertools.pairwise(path), ids[1:], strict=True):
            p *= model.move[a, b] * model.emit[i, b]
        yield path, p


def test_recursions_equal_sums_over_all_paths():
    model, rng = some_model(5, 3), random.Random(1)
    sequences = [np.array([rng.randrange(5) for _ in range(n)], np.uint16) for n in (1, 6, 3, 3, 5, 1)]
    whole = [sum(p for _, p in paths(model, s)) for s in sequences]
    assert np.allclose(hm.log_likelihoods(model, sequences), np.log10(whole))
    start, moves, emissions, score = hm.expected(model, sequences)
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, total in zip(sequences, whole, strict=True):
        for path, p in paths(model, s):
            want[0][path[0]] += p / total
            for a, b in itertools.pairwise(path):
                want[1][a, b] += p / total
            for i, k in zip(s, path, strict=True):
                want[2][i, k] += p / total
    for got, right in zip((start, moves, emissions), want, strict=True):
        assert np.allclose(got, right)
    assert math.isclose(score, sum(np.log10(whole)))


def test_reading_words_in_parts():
    rng = random.Random(2)
    pool = ["a", "Bé", " ", "\n", "  ", "漢字", "\t", "x" * 60, "Z" * 60, ","]
    texts = [None, "", *("".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 200]))) for _ in range(60)), ""]
    for limit in (1 << 22, 90, 7):
        got: dict[int, list[str]] = {i: [] for i in range(len(texts))}
        for first, sizes, _, words, ids in hm.read(pa.array(texts), limit):
            at = 0
            for k, n in enumerate(sizes.tolist()):
                got[first + k] += [words[i].as_py() for i in ids[at : at + n]]
                at += n
        for i, text in enumerate(texts):
            want = tokens(text)[:-1]
            assert [w if len(w.encode()) <= hm.LONGEST_WORD else None for w in want] == [None if w[0] == " " else w for w in got[i]]
            assert len({w for w in got[i] if w[0] == " "}) == len({w for w in want if len(w.encode()) > hm.LONGEST_WORD})


def rows_of(n):
    rng = random.Random(n)
    tongues = [["the", "of", "And", "is"], ["der", "und", "ist", "das"]]
    rare = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(n):
        own = rng.choice(tongues)
        rows.append((i, " ".join(rng.choice(own) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randint(0, 40)))))
    return rows + [(None, "the of"), (n, None), (n + 1, ""), (n + 2, " \n"), rows[0], rows[0], (n + 3, "é" * 300), (n + 4, "word " * 5000), (n + 5, "unseen" + "q" * 70)] if n else []


def plainly(rows):
    """Base measures of every row."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return c, Counter((i, held(i), len(w := tokens(text)), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), 6)) for i, text in rows)


@pytest.mark.parametrize(("n", "share"), [(300, 1 << 14), (300, 16), (0, 16)])
def test_base_measures_and_a_single_state(spark, monkeypatch, n, share):
    monkeypatch.setattr(hm, "CLASSES", share)
    rows = rows_of(n)
    frame = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)
    c, want = plainly(rows)
    found = hm.scored(frame, states=1, rounds=1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    # One state: every class by its count and prior, every word by its share of the class.
    total, weight = sum(c.values()), Counter()
    own = {t for t, k in c.items() if k * share >= total} | {None}
    of = lambda t: t if t in own else int(hm.bucket(hm.keys(pa.array([t], pa.large_string())))[0])
    counts = Counter()
    for t, k in c.items():
        weight[of(t)] += k + 1
        counts[of(t)] += k
    norm = total + len(c) + hm.BUCKETS
    p = lambda t: (counts[of(t)] + hm.EMISSION_PRIOR * (weight[of(t)] + (of(t) not in own)) / norm) / (total + hm.EMISSION_PRIOR) * ((c[t] + 1) / (weight[of(t)] + (of(t) not in own)))
    texts = dict(rows)
    for r in found:
        assert math.isclose(r.score, sum(math.log10(p(t)) for t in tokens(texts[r.doc_id])), rel_tol=1e-6, abs_tol=1e-6)


def test_rounds_raise_the_likelihood_and_held_out_texts_gain(spark):
    rows = [r for r in rows_of(600) if r[0] is not None]
    frame = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], SCHEMA).repartition(4)
    counts = hm.word_counts(frame.filter(hm.learned_from(frame)))
    known = hm.classes(counts)
    sequences, prior = hm.encoded(frame, known).filter("not held_out"), known.prior()
    model, scores = hm.first_model(prior, 3), []
    for _ in range(5):
        model, score = hm.improved(sequences, model, prior)
        scores.append(score)
    assert all(b > a for a, b in itertools.pairwise(scores))
    found = [r for r in hm.scored(frame, states=4).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_held_out_documents_gain(spark):
    found = [r for r in hm.op13_hidden_markov(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    n = sum(r.n_tokens for r in found)
    assert sum(r.score for r in found) / n > sum(r.base_score for r in found) / n + 0.3
