from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import op1_minhash as m
from lodestrata.llm.components import components
from lodestrata.llm.words import hashed, split_words


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, least=0.8):
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in known}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if not a.keys().isdisjoint(b.keys()) and jaccard(a, b) >= least:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i, _ in known}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for k in range(40):
        words = [word() for _ in range(rng.choice([1, 3, 6, 30, 120]))]
        rows.append((k * 100, " ".join(words)))
        for c in range(rng.randrange(4)):  # near copies at all distances, also chains
            words = list(words)
            for _ in range(rng.choice([0, 1, 2, 5])):
                words[rng.randrange(len(words))] = word()
            rows.append((k * 100 + c + 1, "  ".join(words)))
    seed = [word() for _ in range(80)]
    for k in range(80):  # a large group of near copies
        words = list(seed)
        words[rng.randrange(80)] = word()
        rows.append((20_000 + k, " ".join(words)))
    rows += [(30_000 + k, "line of repeated words here now " * 20) for k in range(40)] + [(30_100, "line of repeated words here now " * 19)]
    return rows + [(40_000, None), (40_001, ""), (40_002, "  "), (None, "null id one"), (None, None), (40_003, "x " * 5_000), (100, rows[1][1])]


def test_classes_equal_brute_force(docs_of, corpus):
    got = m.near_classes(docs_of(corpus, 5)).collect()
    assert len(got) == len(corpus)
    want = brute(corpus)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    sizes = Counter(r.class_id for r in got if r.doc_id is not None)
    assert all(r.class_size == (sizes[r.class_id] if r.doc_id is not None else 1) and r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)


def test_blocks_and_joins_instead_of_broadcasts_change_nothing(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(m, "CELL_BYTES", 3000)
    got = m.near_classes(docs_of(corpus, 3), broadcast_ids=0, similarity=0.9).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute(corpus, 0.9)


def test_links_that_the_smallest_of_a_bucket_misses(docs_of):
    """b and c are similar, a is similar to neither, but shares bands with both."""
    base = [f"v{k}" for k in range(100)]
    a, b = base[:84] + [f"a{k}" for k in range(16)], base[:84] + [f"b{k}" for k in range(16)]
    c = [*b[:-1], "other"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))] + [(10 + k, " ".join([*a[:-1], f"n{k}"])) for k in range(20)]
    got = {r.doc_id: r.class_id for r in m.near_classes(docs_of(rows)).collect()}
    assert got == brute(rows) and got[2] == got[3] == 2


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    a = Counter({f"s{k}": rng.randrange(1, 6) for k in range(300)})
    b = Counter({k: v + (rng.random() < 0.3) for k, v in a.items() if rng.random() < 0.9})
    parts = []
    for x in (a, b):
        h = hashed([k.encode() for k in x.elements()])
        parts.append(m.regions(h)[0])
    sig = m.signatures(np.concatenate(parts), np.array([len(p) for p in parts]), 3000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.03
    assert m.weighted_jaccard(*parts) == pytest.approx(jaccard(a, b))


def test_fractional_weights():
    keys = hashed([f"k{n}".encode() for n in range(200)])
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0.1, 3, 200), rng.uniform(0.1, 3, 200)
    parts = [m.regions(keys, w) for w in (x, y)]
    sig = m.signatures(np.concatenate([p[0] for p in parts]), np.array([len(p[0]) for p in parts]), 4000, np.concatenate([p[1] for p in parts]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03


def test_short_signatures_are_full():
    sig = m.signatures(m.regions(hashed([b"one"]))[0], np.array([1]), 96)
    assert (sig != 0).all() and len(split_words(" a\tb\x0bc ")) == 3


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 3)], "a long, b long")
    got = dict(components(links).collect())
    assert set(got.values()) == {1, 100} and len(got) == 62 and got[60] == 1


def test_stage(docs_of, corpus):
    docs = docs_of(corpus)
    kept = m.drop_near_copies(docs)
    want = {i for i, top in brute(corpus).items() if i == top}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_blocks_are_bounded_in_bytes_and_long_texts_pass(docs_of, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(m, "CELL_BYTES", 2000)
    monkeypatch.setattr(m, "CHUNK_WORDS", 100)
    base = [f"v{k}" for k in range(100)]
    a, b = base[:84] + [f"a{k}" for k in range(16)], base[:84] + [f"b{k}" for k in range(16)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*b[:-1], "other"]))] + [(10 + k, " ".join([*a[:-1], f"n{k}"])) for k in range(20)]
    long = [f"w{k % 5000}" for k in range(200_000)]
    rows += [(100, " ".join(long)), (101, " ".join([*long[:-50], *base[:50]])), (102, " ".join(long[: len(long) // 2])), (103, "")]
    got = {r.doc_id: r.class_id for r in m.near_classes(docs_of(rows)).collect()}
    assert got == brute(rows) and got[101] == 100 and got[102] == 102


def test_clashing_columns(docs_of, corpus):
    names = ["id", "a", "b", "band", "bands", "label", "node", "class_id", "_gone", "regions", "grp", "cell", "text_key", "kept", "first"]
    docs = docs_of(corpus)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = m.drop_near_copies(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(names)]
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {i for i, top in brute(corpus).items() if i == top}


def test_empty_table(docs_of):
    assert m.near_classes(docs_of([])).count() == 0
