"""The operators against brute force, on tables with every odd case and on empty ones."""

from __future__ import annotations

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

from strataloom.llm import binary_ids, encoding, exact_dedup, mixing, near_dedup, packing, quality, suffix_dedup, textkit, token_counts, tool_calls, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoding_equals_the_library(library, texts):
    rng = random.Random(1)
    parts = ["a", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "é", "!", "<|endoftext|>", "漢", "😀", "\x1c", "͸", "'re", "D"]
    odd = [*texts, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000))]
    for text, (_, ids) in zip(odd, encoding.encoded(pa.array(odd), TOKENIZER), strict=True):
        assert library.encode(text or "", add_special_tokens=False).ids == ids.tolist()


def colliding(n, a, b):
    """Two words of n letters whose hashes modulo a power of two are equal for any odd base."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_with_colliding_polynomials(library, n):
    counter = token_counts.piece_counts(public_tokenizers.path("piece_bpe_32k.model"))
    for a, b in (("a", "b"), ("i", "n"), ("e", "s")):
        words = colliding(n, a, b)
        for word, (_, ids) in zip(words, encoding.encoded(pa.array(words), TOKENIZER), strict=True):
            assert library.encode(word, add_special_tokens=False).ids == ids.tolist()
        data = np.frombuffer("".join(f" {w}" for w in words).encode(), np.uint8)
        _, before, _ = counter.prefixes(data, np.array([0, n + 1, 2 * n + 2]))
        assert np.diff(before).tolist() == [len(counter.library.encode(w)) for w in words]
        value = near_dedup.shingles(data, np.array([0, n + 1, 2 * n + 2]))[1]
        assert value[0] != value[1]


def test_units_with_one_hash_are_told_apart_by_bytes(library, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(20)) for _ in range(30)]
    real, encoder = textkit.span_hash, encoding.byte_bpe(TOKENIZER)
    monkeypatch.setattr(textkit, "span_hash", lambda *x: real(*x) % np.uint64(7))
    encoder.cache.clear()
    for text, (_, ids) in zip(texts, encoding.encoded(pa.array(texts), TOKENIZER), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist()
    encoder.cache.clear()


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["ab", "é", " ", "  ", "\n", "'s", "don't", "7", "<|endoftext|>", "漢", " x y"]) for _ in range(900)) for _ in range(6)]
    parts = textkit.parts
    monkeypatch.setattr(textkit, "parts", lambda column: parts(column, 64))
    assert sum(1 for _ in textkit.parts(pa.array(texts))) > 20
    for text, (_, ids) in zip(texts, encoding.encoded(pa.array(texts), TOKENIZER), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_packing_is_gapless_and_whole(library, documents):
    found = packing.pack(packing.pieces(documents)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id, r.start == 0 and r.piece == 0].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    want = Counter()
    for r in documents.select("doc_id", "text").collect():
        ids = ids_of(library, r.text)
        for n, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            want[r.doc_id, n, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    fit = packing.BestFit(10, 2)
    assert [fit.add(n)[0] for n in (6, 7, 8, 4, 3)] == [0, 1, 2, 0, 3]


def test_ranks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.integers(0, [1 << 8, 1 << 16, 1 << 24, 1 << 32][n % 4], n).astype(np.uint32)
        assert (binary_ids.decode_ranks(*binary_ids.encode_ranks(ranks), n) == ranks).all()


def test_binary_ids_are_read_back_in_order(spark, library, documents, tmp_path):
    binary_ids.write(documents, f"{tmp_path}/ids")
    found = binary_ids.read(spark, f"{tmp_path}/ids").collect()
    found.sort(key=lambda r: r.start)
    place = 0
    for r in found:
        assert (r.start, r.n_tokens * 4) == (place, len(r.ids))
        place += r.n_tokens
    numbers = [r.doc_id for r in found]
    assert numbers[0] is None and numbers[1:] == sorted(numbers[1:])
    want = Counter((r.doc_id, ids_of(library, r.text).tobytes()) for r in documents.select("doc_id", "text").collect())
    assert want == Counter((r.doc_id, bytes(r.ids)) for r in found)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_classes(documents):
    rows = [(r.doc_id, lower(r.text)) for r in documents.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text].append(doc)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = Counter((d, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    found = exact_dedup.classes(documents).collect()
    assert want == Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found)
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    left = exact_dedup.deduplicated(documents)
    assert left.columns == documents.columns and left.count() == len(groups)


def shingle_set(text):
    words = lower(text).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def linked_classes(sets):
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                parent[root(a)] = root(b)
    return [root(a) for a in range(len(sets))]


def near_classes(frame):
    rows = frame.select("doc_id", "text").collect()
    roots = linked_classes([shingle_set(r.text) for r in rows])
    want = defaultdict(Counter)
    for r, k in zip(rows, roots, strict=True):
        want[k][r.doc_id] += 1
    return Counter(tuple(sorted(map(str, c.elements()))) for c in want.values())


def test_near_classes(documents):
    found = near_dedup.classes(documents).collect()
    got = defaultdict(Counter)
    for r in found:
        got[r.class_id][r.doc_id] += 1
    assert Counter(tuple(sorted(map(str, c.elements()))) for c in got.values()) == near_classes(documents)
    assert sum(r.kept for r in found) == len(got)
    left = near_dedup.deduplicated(documents)
    assert left.columns == documents.columns and left.count() == len(got)


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark):
    """Copies of one text with edits: pairs about the threshold, no copy near all others."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(Counter)
    for r in near_dedup.classes(frame).collect():
        got[r.class_id][r.doc_id] += 1
    assert Counter(tuple(sorted(map(str, c.elements()))) for c in got.values()) == near_classes(frame)


def test_block_links_join_all_that_is_similar():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    sets = [np.sort(rng.choice(pool[k : k + 60], 50, replace=False)) for k in rng.integers(0, 30, 40)]
    blocks = [list(range(20)), list(range(20, 40))]
    links = []
    for sides in ([0], [1], [0, 1]):
        links += near_dedup.block_links([blocks[s] for s in sides], [blocks[s] for s in sides], [[sets[i].tobytes() for i in blocks[s]] for s in sides], 0.7)
    parent = list(range(40))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[root(a)] = root(b)
    for a in range(40):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if common >= 0.7 * (100 - common):
                assert root(a) == root(b)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 6, 60), rng.uniform(0.1, 6, 60)
    b[:30] = a[:30]
    size, doc = 4000, np.repeat([0, 1], 60)
    s = near_dedup.dart_signatures(doc, np.tile(elements, 2), np.concatenate([a, b]), 2, size)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    alone = near_dedup.dart_signatures(np.zeros(60, int), elements, a, 1, size)
    assert (alone[0] == s[0]).all()


def test_toxicity_learns_only_outside_the_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(40)] + (["vile", "rotten"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.scored(frame.union(spark.createDataFrame([(5000, None), (None, "vile rotten")], frame.schema)), known).collect()
    assert len(found) == 902
    for r in found:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
            assert r.predicted == int(r.doc_id % 5 == 0)
    held = [r.doc_id for r in found if r.held_out]
    flipped = known.rdd.map(lambda r: (r[0], 1 - r[1] if r[0] in held and r[1] is not None else r[1])).toDF(known.schema)
    again = {r.doc_id: r.score for r in toxicity.scored(frame, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in found if r.doc_id in again)
    assert toxicity.scored(frame, known.filter("false")).filter("score <> 0").count() == 0
    assert toxicity.scored(frame.filter("false"), known).count() == 0


def test_the_block_max_index_finds_the_nearest():
    rng = np.random.default_rng(7)
    n, n_terms = 700, 60
    chance = np.where(np.arange(n_terms) < 12, 0.4, 0.03)
    counts = np.where(rng.random((n, n_terms)) < chance, rng.integers(1, 4, (n, n_terms)), 0)
    examples = object.__new__(toxicity.Examples)
    examples.docs, examples.labels = np.arange(n), rng.integers(0, 2, n)
    examples.row, examples.term = np.nonzero(counts)
    examples.counts, examples.known = counts[examples.row, examples.term].astype(float), np.arange(n_terms, dtype=np.uint64)
    weight = rng.uniform(1, 5, n_terms)
    index = toxicity.BlockMaxIndex(examples, weight)
    assert 0 < len(index.most) < n_terms and index.blocks > 10
    queries = np.where(rng.random((90, n_terms)) < chance, rng.integers(1, 4, (90, n_terms)), 0)
    queries[0] = 0
    unit = lambda c: (x := np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * weight) / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    similar = unit(queries) @ unit(counts).T
    text, term = np.nonzero(queries)
    score, best, near, votes = index.scores(text, term, queries[text, term].astype(float), len(queries))
    for i, own in enumerate(similar):
        least = np.sort(own)[-toxicity.NEIGHBOURS]
        vote = np.where((own >= least - 1e-12) & (own > 0), own, 0)
        want = (vote @ examples.labels + toxicity.PRIOR * examples.labels.mean()) / (vote.sum() + toxicity.PRIOR)
        assert abs(score[i] - want) < 1e-9 and votes[i] == (vote > 0).sum() and abs(near[i] - own.max()) < 1e-9
        assert best[i] == -1 if not own.any() else abs(own[index.docs[best[i]]] - own.max()) < 1e-9


def test_targets_fill_up_to_the_cap(spark):
    sizes = {None: 400, "a": 1000, "b": 10, "c": 3000, "d": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            want |= {s: left * weight[s] / total for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert all(abs(found[s] - want[s]) < 1e-6 for s in sizes)


def test_mixed_rows_are_whole_copies(documents, nothing):
    taken = {}
    for r in mixing.rated(documents, 1.5, 2, mixing.WEIGHTS, "mix").collect():
        assert 0 <= r.copies <= 2
        taken[r.doc_id] = r.copies
    found = mixing.mixed(documents)
    assert found.columns == documents.columns
    rows, got = Counter(r.doc_id for r in documents.collect()), Counter(r.doc_id for r in found.collect())
    assert all(got[d] == n * taken[d] for d, n in rows.items())
    assert mixing.mixed(nothing).count() == 0


def test_token_counts_at_every_prefix(documents, texts):
    counter = token_counts.piece_counts(public_tokenizers.path("piece_bpe_32k.model"))
    count = lambda t: len(counter.library.encode(t))
    for r in token_counts.counted(documents, 50).collect():
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count(text), count(text) > 50)
        assert count(text.encode()[: r.fit_bytes].decode()) <= 50
        rest = text.encode()[r.fit_bytes :].decode()
        assert not rest or count(text[: len(text) - len(rest) + 1]) > 50


def test_prefix_counts_equal_the_library(texts):
    counter = token_counts.piece_counts(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(21)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCDE0123456789.,-_/'", "é", "漢", "😀", "ß", "the", "ing", "tion", "http", "    "]
    units = [" " * rng.randint(0, 3) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))).replace(" ", "") for _ in range(300)]
    units = [u if u[:1] == " " else "\n" + u for u in units] + [" internationalization", " ", "   ", "\n", " unbelievable-straightforward.example.org/path"]
    for unit in units:
        sizes, counts = counter.prefix_counts(unit.encode())
        ends = [unit.encode()[:n] for n in sizes]
        assert ends[-1] == unit.encode() and counts[0] == 0
        assert counter.unit_counts([e for e in ends if e]) == counts[1:].tolist()


def test_a_long_unit_is_answered_in_linear_time():
    counter = token_counts.piece_counts(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(22)
    unit = (" " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))).encode()
    begun = time.time()
    n = counter.longest_prefix(unit, 4096)
    assert time.time() - begun < 60
    assert counter.unit_counts([unit[:n]])[0] <= 4096 < counter.unit_counts([unit[: n + 1]])[0]


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    counter = token_counts.piece_counts(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(23)
    texts = ["".join(rng.choice(["ab", "é", " ", "  ", "\n", "the cat", "7", "漢", " x y", "▁"]) for _ in range(700)) for _ in range(5)] + [None, ""]
    real = textkit.parts

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            return list(f(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts])], names=["doc_id", "text"])])))

    monkeypatch.setattr(token_counts.textkit, "parts", lambda column: real(column, 50))
    for limit in (3, 200, 10_000):
        (batch,) = token_counts.counted(Rows(), limit)
        for text, row in zip(texts, batch.to_pylist(), strict=True):
            raw = (text or "").encode()
            assert (row["n_bytes"], row["n_tokens"]) == (len(raw), len(counter.library.encode(text or "")))
            rest = raw[row["fit_bytes"] :].decode()
            assert len(counter.library.encode(raw[: row["fit_bytes"]].decode())) <= limit
            assert not rest or len(counter.library.encode((text or "")[: len(text) - len(rest) + 1])) > limit


def test_quality_measures_by_brute_force(documents):
    for r, row in zip(sorted(quality.measured(documents).collect(), key=str), sorted(documents.collect(), key=lambda d: str(d.doc_id)), strict=False):
        assert r.kept <= (not r.base_failed)
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 30))]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        assert quality.repeated_words(words) == len(hit)


def test_quality_removes_failing_lines(spark, documents, nothing):
    text = "A good line of plain words that ends well.\nhome | about | contact | more\nAnother good line of words, which ends too.\nAll Rights Reserved.\n\nno stop here"
    frame = spark.createDataFrame([(1, text, 99), (2, None, 0)], "doc_id long, text string, n_chars long")
    found = quality.cleaned(frame).collect()
    assert [(r.doc_id, r.text) for r in found] == [(1, "A good line of plain words that ends well.\nAnother good line of words, which ends too.\n")]
    assert found[0].n_chars == len(found[0].text)
    assert quality.cleaned(documents).columns == documents.columns and quality.cleaned(nothing).count() == 0


def stripped(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize(("length", "block", "most"), [(40, 1 << 20, 4096), (40, 1, 1), (400, 1 << 20, 4096), (400, 1500, 2)])
def test_repeats_are_removed_byte_by_byte(documents, length, block, most):
    # With blocks of a run or two and a low ``most`` nearly everything is compared across boundaries.
    rows = documents.select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in rows]
    want = Counter((r.doc_id, len(t), hashlib.sha256(k).hexdigest()) for r, t, k in zip(rows, raw, stripped(raw, length), strict=True))
    found = suffix_dedup.removed(documents, length, 8 if length == 40 else 64, block, most).collect()
    assert want == Counter((r.doc_id, r.n_bytes, r.kept_sha256) for r in found)
    assert all((r.n_removed > 0) == (r.n_spans > 0) for r in found)


def test_a_common_passage_is_compared_across_boundaries(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(12))
    texts = [" ".join(word() for _ in range(9)) + passage + " ".join(word() for _ in range(9)) for _ in range(120)]
    raw = [t.encode() for t in texts]
    want = Counter(hashlib.sha256(k).hexdigest() for k in stripped(raw, 40))
    found = suffix_dedup.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40, 8, 700, 8).collect()
    assert want == Counter(r.kept_sha256 for r in found) and all(r.n_removed > 0 for r in found)


def test_pieces_of_a_long_text_have_the_same_runs():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 30_000).astype(np.uint8)
    data[9_000:13_000] = 97
    whole = suffix_dedup.runs(data, np.array([0, len(data)]), 40, 8)
    for piece in (1, 37, 4096):
        assert all((a == b).all() for a, b in zip(whole, suffix_dedup.runs(data, np.array([0, len(data)]), 40, 8, piece), strict=True))


def test_a_text_of_50_mb_takes_little_memory():
    data = np.random.default_rng(6).integers(97, 123, 50_000_000).astype(np.uint8)
    tracemalloc.start()
    text, anchor, first, last, _ = suffix_dedup.runs(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert first[0] == 0 and last[-1] == len(data) - suffix_dedup.LENGTH and (first[1:] == last[:-1] + 1).all()


def test_equal_fingerprints_are_told_apart_by_bytes(monkeypatch):
    rng = random.Random(7)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(400)).encode(), np.uint8)
    at = np.array(sorted(rng.sample(range(380), 200)))
    count = Counter(data[i : i + 9].tobytes() for i in at)
    want = [count[data[i : i + 9].tobytes()] > 1 for i in at]
    for n in (1, 5, 1 << 40):
        real = suffix_dedup.tokens(data, 9)
        monkeypatch.setattr(suffix_dedup, "tokens", lambda d, w, n=n, real=real: real % np.uint64(n))
        assert suffix_dedup.equal_windows(data, at, 9).tolist() == want
        monkeypatch.undo()


def test_suffixes_are_sorted_within_groups():
    rng = random.Random(3)
    for _ in range(60):
        data = np.array([rng.choice([0, 97, 98]) for _ in range(300)], np.uint8)
        starts = np.array([rng.randrange(250) for _ in range(40)])
        ends = np.minimum(starts + np.array([rng.randrange(1, 60) for _ in range(40)]), 300)
        group = np.sort(np.array([rng.randrange(4) for _ in range(40)]))
        order, common = suffix_dedup.suffix_order(data, starts, ends, group)
        raw = data.tobytes()
        for i in range(39):
            a, b = (raw[starts[k] : ends[k]] for k in order[i : i + 2])
            same = group[order[i]] == group[order[i + 1]]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) if same else 0
            assert common[i] == n and (not same or a <= b)


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"xxabcxxxxabc", np.uint8)
    h = textkit.span_hash(textkit.prefix_hash(data), np.array([2, 9]), np.array([5, 12]))
    assert h[0] == h[1]


def test_tool_calls_in_order(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "search", '{"query":"x","limit":"3"}', []), (1, 2, "b", "search", '{"limit":"no"}', ["a"]), (1, 3, "c", "none", "{}", ["z"]), (1, 5, "d", "search", None, ["b", "a"]), (1, 9, "a", "search", "{}", []), (2, 1, None, "search", "{}", [])],
        "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 4, "a", "r1"), (1, 6, "d", None), (1, 7, "q", "r3")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, tool_calls.SCHEMA_TYPE)
    rows = sorted(tool_calls.linked(calls, results, schemas, every=False).collect(), key=lambda r: r.place)
    assert [(r.call_id, r.kind, r.level) for r in rows] == [("a", "call", 0), ("a", "result", 0), ("b", "call", 1), ("d", "call", 2), ("d", "result", 2), ("c", "call", None), ("q", "result", None)]
    by = {(r.call_id, r.kind): r for r in rows}
    assert by["b", "call"].problems == "missing query; no integer limit" and by["c", "call"].problems == "unknown tool" and by["q", "result"].problems == "no call"
    assert "no object" in by["d", "call"].problems
    assert by["a", "call"].json == '{"arguments":{"limit":"3","query":"x"},"id":"a","role":"assistant","tool":"search"}' and by["a", "call"].linked and not by["b", "call"].linked
    assert tool_calls.linked(calls.filter("false"), results.filter("false"), schemas).count() == 0


def test_tool_arguments_keep_their_types(spark):
    given = [
        '{"limit":3,"query":"x","more":{"z":[true,null,1.5],"a":{"d":1,"c":"2"}}}', '{"limit":"3","query":5}', '{"limit":3.5,"query":"x"}', '{"limit":3.0,"query":null}',
        '{"query":"x","score":1.5,"on":true,"more":{},"list":[1],"none":null}', '{"query":"x","score":"1","on":1,"more":[],"list":{},"none":0,"odd":1}', "[1]",
    ]
    types = [("query", "string", True), ("limit", "integer", False), ("score", "number", False), ("on", "boolean", False), ("more", "object", False), ("list", "array", False), ("none", "null", False), ("odd", "date", False)]
    calls = spark.createDataFrame([(1, i, f"c{i}", "t", a, []) for i, a in enumerate(given)], "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("t", *t) for t in types], tool_calls.SCHEMA_TYPE)
    rows = sorted(tool_calls.linked(calls, results, schemas, every=False).collect(), key=lambda r: r.turn)
    assert [r.problems for r in rows] == [
        "", "no integer limit; no string query", "no integer limit", "missing query", "",
        "no array list; no boolean on; no null none; no number score; no object more; unknown type date of odd", "missing query; no object",
    ]
    assert rows[0].json == '{"arguments":{"limit":3,"more":{"a":{"c":"2","d":1},"z":[true,null,1.5]},"query":"x"},"id":"c0","role":"assistant","tool":"t"}'
    assert rows[3].json.startswith('{"arguments":{"limit":3,"query":null}') and rows[6].json == '{"id":"c6","role":"assistant","tool":"t"}'


CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"


def test_tool_calls_without_an_identifier_of_their_own_have_rows(spark):
    good = '{"query":"x"}'
    calls = [(1, 1, "a", "search", good, []), (1, 3, "a", "search", "{}", []), (1, 3, "a", "search", "{}", []), (1, 4, None, "search", good, ["a"]), (None, 1, "a", "search", good, []), (None, 2, "b", "search", good, ["a"])]
    results = [(1, 2, "a", "r"), (1, 5, "a", "s"), (1, 6, None, "t"), (None, 3, "b", "u")]
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, tool_calls.SCHEMA_TYPE)
    found = tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas, every=True).collect()
    rows = sorted(found, key=lambda r: (r.conv_id is None, r.place))
    assert [(r.conv_id, r.place, r.kind, r.turn, r.level, r.linked, r.problems) for r in rows] == [
        (1, 0, "call", 1, 0, True, ""), (1, 1, "result", 2, 0, True, ""), (1, 2, "call", 3, None, False, "repeated; missing query"), (1, 3, "call", 3, None, False, "repeated; missing query"),
        (1, 4, "call", 4, None, False, "no identifier"), (1, 5, "result", 5, None, False, "repeated"), (1, 6, "result", 6, None, False, "no identifier"),
        (None, 0, "call", 1, 0, False, ""), (None, 1, "call", 2, 1, True, ""), (None, 2, "result", 3, 1, True, ""),
    ]
    assert rows[4].json == '{"arguments":{"query":"x"},"role":"assistant","tool":"search"}'


def test_tool_call_query_keeps_repeated_turns(spark, tmp_path):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (None, 0, "user", "d"), (1, None, "user", "e")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(r.problems for r in tool_calls.op9_tool_calls(spark, str(tmp_path)).collect())["repeated"] == 1
    assert tool_calls.op9_tool_calls(spark, str(tmp_path)).count() == 5


def test_levels_of_deep_and_branching_calls(spark):
    rng = random.Random(5)
    needs = {("deep", f"d{i}"): [f"d{i - 1}"] * (i > 0) for i in range(300)}
    needs |= {("odd", k): v for k, v in {"a": ["b"], "b": ["a"], "c": ["a"], "d": ["none"], "e": ["d"], "f": ["f"], "g": ["h", "c"], "h": [], "i": ["h", "h"], "j": [None], "k": ["i", "none"], "l": ["k"], "m": None}.items()}
    needs |= {(None, f"n{i}"): [f"n{rng.randrange(max(0, i - 30), i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]) if i else 0)] for i in range(120)}
    want = {}
    while True:
        new = {(c, k): 1 + max((want[c, d] for d in v or []), default=-1) for (c, k), v in needs.items() if (c, k) not in want and all((c, d) in want for d in v or [])}
        if not new:
            break
        want |= new
    calls = spark.createDataFrame([(*k, v) for k, v in needs.items()], "conv_id string, call_id string, depends_on array<string>")
    found = tool_calls.levels(calls).collect()
    assert len(found) == len(want) and {(r.conv_id, r.call_id): r.level for r in found} == want and want["deep", "d299"] == 299


def test_tool_call_query_writes_numbers(spark):
    found = tool_calls.op9_tool_calls(spark, "/root/testdata/sf0.001").filter("kind = 'call'")
    limits = found.selectExpr("schema_of_variant(variant_get(parse_json(json), '$.arguments.limit')) as type").groupBy("type").count().collect()
    assert [r.type for r in limits] == ["BIGINT"]


def test_empty_tables(nothing, spark, tmp_path):
    assert packing.pack(packing.pieces(nothing)).count() == 0
    assert exact_dedup.classes(nothing).count() == 0 and exact_dedup.deduplicated(nothing).count() == 0
    assert near_dedup.classes(nothing).count() == 0
    assert suffix_dedup.removed(nothing).count() == 0
    assert token_counts.counted(nothing).count() == 0
    assert quality.measured(nothing).count() == 0
    binary_ids.write(nothing, f"{tmp_path}/none")
    assert binary_ids.read(spark, f"{tmp_path}/none").count() == 0
