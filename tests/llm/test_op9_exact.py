from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import op9_exact as m


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        out.append((i, keep, len(g), (-len(t or ""), i) == (min(g)[0], keep), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(k * 3, rng.choice(base)) for k in range(300)]
    rows += [(2000 + k, "hot  text") for k in range(200)] + [(1999, "hot text"), (5000, None), (5001, ""), (5002, " \t\x0b"), (None, "hot text "), (None, "null id")]
    return rows + [(6000, "z" * 200_000), (6001, "z" * 200_000 + "y"), (6002, "z" * 100_000 + " " + "z" * 100_000), (10, "\x00nul"), (11, " keeps")]


def test_equals_brute_force(docs_of, corpus):
    got = sorted((tuple(r) for r in m.exact_groups(docs_of(corpus, 5)).collect()), key=repr)
    assert got == brute(corpus)


def test_small_tries_spill_and_agree(docs_of, corpus):
    def run(budget):
        held, m.TRIE_BYTES = m.TRIE_BYTES, budget
        batch = pa.RecordBatch.from_pylist([{"k": (t or "").encode(), "d": hashlib.sha256((t or "").encode()).digest(), "p": len(t or ""), "i": i or 0} for i, t in corpus])
        try:
            return [x for b in m.local_owners(iter([batch])) for x in b.to_pylist()]
        finally:
            m.TRIE_BYTES = held

    whole, spilled = run(1 << 30), run(64)
    assert len(spilled) > len(whole) == len({t or "" for _, t in corpus})
    merged = [x for b in m.final_owners(iter([pa.RecordBatch.from_pylist(sorted(spilled, key=lambda x: x["bytes"]), schema=m.PARTIAL)])) for x in b.to_pylist()]
    assert sum(x["group_size"] for x in merged) == len(corpus) and len(merged) == len(whole)


def test_the_last_trie_spills_and_agrees(corpus, monkeypatch):
    rng, rows = random.Random(9), []
    for _ in range(400):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) * rng.choice([1, 1, 40])
        rows.append({"bytes": key, "size": len(key), "digest": hashlib.sha256(key).digest(), "points": rng.randrange(5), "id": rng.randrange(9), "rows": rng.randrange(1, 4), "same": 1})
    rows.sort(key=lambda x: x["bytes"])
    want = {}
    for x in rows:
        want.setdefault(x["bytes"], []).append(x)
    for budget in (0, 10, 100, 1 << 30):
        monkeypatch.setattr(m, "TRIE_BYTES", budget)
        batches = [pa.RecordBatch.from_pylist(rows[k : k + 37], schema=m.PARTIAL) for k in range(0, len(rows), 37)]
        got = [x for b in m.final_owners(iter(batches)) for x in b.to_pylist()]
        assert len(got) == len(want)
        by = {x["digest"]: x for x in got}
        for key, xs in want.items():
            x, (points, i) = by[hashlib.sha256(key).digest()], min((-y["points"], y["id"]) for y in xs)
            assert (x["size"], x["points"], x["keep_id"], x["group_size"]) == (len(key), -points, i, sum(y["rows"] for y in xs))
            assert x["same"] == sum(y["same"] for y in xs if (-y["points"], y["id"]) == (points, i))
    with pytest.raises(ValueError):
        list(m.final_owners(iter([pa.RecordBatch.from_pylist(rows[::-1], schema=m.PARTIAL)])))


def test_one_digest_for_two_texts_of_a_node_is_an_error():
    with pytest.raises(ValueError):
        m.merge([1, 1, 1, 1, b"a"], [1, 2, 1, 1, b"b"])


def test_repeated_rows_keep_one(docs_of):
    docs = docs_of([(1, "a b"), (1, "a b"), (2, "ab"), (3, None), (3, None), (4, "c")])
    assert sorted(r["doc_id"] for r in m.drop_exact_copies(docs).collect()) == [1, 3, 4]
    assert m.drop_exact_copies(docs).columns == docs.columns


def test_empty_table(docs_of):
    assert m.exact_groups(docs_of([])).count() == 0


def test_copies_within_a_doc_id(docs_of):
    docs = docs_of([(1, "a  b"), (1, "a b"), (2, "ab"), (None, "x"), (None, " x")])
    assert sorted((r.text for r in m.drop_exact_copies(docs).collect())) == [" x", "a  b"]
    assert sorted((r.doc_id or 0, r.kept) for r in m.exact_groups(docs).collect()) == [(0, False), (0, True), (1, False), (1, True), (2, False)]


@pytest.mark.parametrize("broadcast_texts", [0, 1000])
def test_clashing_columns(docs_of, corpus, broadcast_texts):
    names = ["_size", "_keep", "_same", "_text", "_bytes", "_digest", "digest", "size", "points", "keep_id", "group_size", "same", "row", "i", "n", "kept"]
    docs = docs_of(corpus)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = m.drop_exact_copies(docs, broadcast_texts)
    assert out.columns == docs.columns and [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(names)]
    want = {(i, keep) for i, keep, _, kept, _ in brute(corpus) if kept}
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((i for i, _ in want), key=repr)
    assert m.exact_groups(docs).count() == len(corpus)


@pytest.mark.parametrize("length", [0, 6, 300])
def test_the_budget_counts_what_short_strings_take(length):
    rng = random.Random(5)
    rows = [(k, rng.randbytes(8 + length)) for k in range(20_000)]
    tracemalloc.start()
    trie = m.PatriciaTrie()
    for k, key in rows:
        trie.insert(bytes(bytearray(key)), [len(key), k + 1000, 1, 1, hashlib.sha256(key).digest()])
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.6 < trie.bytes / taken < 1.6 and sum(trie.weights.values()) == trie.bytes
    for _ in range(300):
        list(trie.spill_largest())
    assert trie.bytes == 0 and not trie.weights


@pytest.mark.parametrize("ids", [True, False])
def test_a_text_of_a_third_of_all_rows_is_dealt_over_salts(docs_of, monkeypatch, ids):
    monkeypatch.setattr(m, "HOT_SHARE", 1 / 50)
    rows = [(k if ids else None, "hot text" if k % 3 == 0 else f"text {k % 400}") for k in range(1200)]
    assert sorted((tuple(r) for r in m.exact_groups(docs_of(rows, 5)).collect()), key=repr) == brute(rows)
    if ids:
        assert sorted(r.doc_id for r in m.drop_exact_copies(docs_of(rows, 5), 0).collect()) == sorted({keep for _, keep, *_ in brute(rows)})
