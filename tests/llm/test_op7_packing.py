from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.op7_packing import Encoder, Plan, cut_points, encoder, pack

TEXTS = ["", " ", "a", " lead", "trail ", "two  spaces", "tab\tand\nnew \n line", "it's we'll", "日本語 テキスト", "naïve café", " nbsp   em", "x" * 500, "<|endoftext|> is text", "\x1c sep", "emoji 😀 x", "1234 +1 (5)"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizer(text):
    e = encoder(None)
    assert np.frombuffer(e.encode(text), np.uint32).tolist() == e.full.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é日 \n\t'1,. 　ɐ\x1f")), max_size=30))
def test_ids_equal_the_tokenizer_on_any_text(text):
    e = encoder(None)
    assert np.frombuffer(e.encode(text), np.uint32).tolist() == e.full.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("lodestrata.llm.op7_packing.CACHE_CHUNKS", 3)
    e = Encoder()
    e.encode("a b c d e f g h")
    assert len(e) == 3


def check_plan(histogram, capacity):
    plan = Plan(dict(histogram), capacity)
    assert not any(plan.count)
    bins, pieces = defaultdict(list), Counter()
    for n, first, count, first_bin, offset in plan.runs:
        pieces.update({(n, first + k): 1 for k in range(count)})
        for k in range(count):
            bins[first_bin + k].append((offset, n))
    assert all(v == 1 for v in pieces.values()) and sorted(pieces) == [(n, k) for n in sorted(histogram) for k in range(histogram[n])]
    assert sorted(bins) == list(range(plan.bins))
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return plan


def fewest(sizes, capacity):
    """By trying all assignments."""
    best = len(sizes)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for b in range(len(room)):
            if room[b] >= sizes[k] and room[b] not in room[:b]:
                place(k + 1, [*room[:b], room[b] - sizes[k], *room[b + 1 :]])
        place(k + 1, [*room, capacity - sizes[k]])

    place(0, [])
    return best


def test_plans_are_sound_and_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        plan = check_plan(Counter(sizes), capacity)
        best = fewest(sizes, capacity)
        assert plan.bins <= best + 1
        # what reduction fixed can be completed to an optimum
        fixed = [(n, first, count) for n, first, count, first_bin, _ in plan.runs if first_bin < plan.fixed]
        left = Counter(sizes) - Counter({n: 0 for n in sizes})
        for n, _, count in fixed:
            left[n] -= count
        rest = sorted(left.elements(), reverse=True)
        assert plan.fixed + (fewest(rest, capacity) if rest else 0) == best


def test_large_histogram_is_near_the_bound():
    rng = random.Random(2)
    sizes = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    plan = check_plan(sizes, 2048)
    assert plan.bins <= -(-sum(n * c for n, c in sizes.items()) // 2048) * 1.01 + 1


def test_cut_points():
    assert cut_points(1, 5) == [(0, 1)] and cut_points(5, 5) == [(0, 5)] and cut_points(12, 5) == [(0, 2), (2, 5), (7, 5)] and cut_points(10, 5) == [(0, 5), (5, 5)]


def test_pack(docs_of):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "béta", "gamma\n", "x"]) for _ in range(rng.randrange(60)))) for k in range(200)]
    rows += [(500, None), (501, ""), (None, "null id"), (502, "word " * 700)] + [(600 + k, "same copy here") for k in range(150)] + [(7, "again"), (7, "again")]
    got = pack(docs_of(rows), capacity=64).collect()
    e, want = encoder(None), Counter()
    for i, t in rows:
        ids = e.encode(t or "") + b"\0\0\0\0"
        want.update((i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids) // 4, 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1


def test_empty_table(docs_of):
    assert pack(docs_of([])).count() == 0


@pytest.mark.parametrize("doc_id", [None, 5])
def test_many_repeated_rows_are_spread(docs_of, monkeypatch, doc_id):
    from pyspark.sql import functions as F

    from lodestrata.llm import common, op7_packing

    monkeypatch.setattr(common, "BUCKET_ROWS", 20)
    monkeypatch.setattr(op7_packing, "BUCKET_ROWS", 20)
    docs = docs_of([(doc_id, None)] * 900 + [(k + 10, f"text {k}") for k in range(600)], 4)
    rows = pack(docs, capacity=16).collect()
    assert len(rows) == 1500
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, n in sorted(x):
            assert offset == end
            end += n
        assert end <= 16
    numbered = common.numbers_of_copies(common.cut(docs.withColumn("_row", F.monotonically_increasing_id())), ["doc_id", "text"], "_row")
    assert numbered.where("_row is not null").count() == 900 == numbered.where("text is null").select("_row").distinct().count()
    assert numbered.count() == 1500


ODD_TEXTS = TEXTS + ["a  b", "a \n b c ", "a \u00a0b \x1fc", "日本 テキ  スト x", "é \u3000 ü", "foo.\nBar foo.\nBar", "\n lead \t"]


def test_a_batch_gets_the_ids_of_its_texts():
    e = encoder(None)
    assert e.encode_all(pa.array(ODD_TEXTS * 2)) == [e.direct(t) for t in ODD_TEXTS * 2] and e.encode_all(pa.array([], pa.string())) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é日 \n\t'1,. \u3000ɐ\x1f\x85")), max_size=20), max_size=4))
def test_a_batch_of_any_texts_gets_their_ids(texts):
    e = encoder(None)
    assert e.encode_all(pa.array(texts, pa.string())) == [e.encode(t) for t in texts]


def test_new_chunks_of_a_batch_are_encoded_in_one_call(monkeypatch):
    from lodestrata.llm.op7_packing import pieces_of

    e, rng, calls = encoder(None), random.Random(5), []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return quick.encode_ordinary(text)

    quick = e.quick
    monkeypatch.setattr(e, "quick", Counted())
    texts = [" ".join(f"{rng.choice('aeiou')}{rng.randrange(10**9)}" for _ in range(100)) for _ in range(20)]
    out = list(pieces_of(iter([pa.record_batch([pa.array(range(20)), pa.array(texts)], names=["doc_id", "text"])]), 64, None))
    assert len(calls) == 21  # each text's first chunk, and all others at once
    want = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for t in texts for ids in [e.encode(t) + b"\0\0\0\0"] for s, n in cut_points(len(ids) // 4, 64)]
    assert out[0]["ids_crc32"].to_pylist() == want
