from __future__ import annotations

import math
import random
import zlib
from array import array

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import op5_sentencepiece as m


def best_score(pieces, marked):
    """By looking each piece up at each place, without an automaton."""
    score = pieces.table
    best = [0.0] + [float("-inf")] * len(marked)
    for e in range(1, len(marked) + 1):
        for s in range(e):
            if marked[s:e] in score:
                best[e] = max(best[e], best[s] + score[marked[s:e]])
        if marked[e - 1] not in pieces.single:
            best[e] = max(best[e], best[e - 1] + pieces.unknown * len(m.Pieces.spelled(marked[e - 1])))
    return best[-1]


def small(by_word=True, seed=0):
    rng = random.Random(seed)
    texts = list({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(40)} | {"a", "b", "▁", "▁a", "▁ab"})
    if not by_word:
        texts.append("a▁b")
    listed = [("<unk>", 0.0, "other")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)] + [(t, -float(rng.randrange(1, 40)), "normal") for t in sorted(texts)]
    p = m.Pieces(listed)
    p.table = {t: s for t, s, k in listed if k == "normal"}
    p.score_of = [s if k == "normal" else p.unknown for _, s, k in listed]
    return p


@pytest.mark.parametrize("by_word", [True, False])
def test_paths_are_best_and_texts_come_back(by_word):
    rng = random.Random(1)
    for seed in range(6):
        p = small(by_word, seed)
        assert p.by_word == by_word
        for _ in range(80):
            text = "".join(rng.choice("abcé  z▁\n") for _ in range(rng.randrange(1, 14)))
            ids = p.encode(text)
            assert p.decode(ids) == text
            marked = m.MARK + text.replace(m.MARK, m.OWN_MARK).replace(" ", m.MARK)
            assert sum(p.score_of[i] for i in array("I", ids)) == pytest.approx(best_score(p, marked))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_round_trip_of_the_real_model(text):
    p = m.model(None)
    if not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        assert p.decode(p.encode(text)) == text


def test_any_character_comes_back():
    p = m.model(None)
    for text in ("\U0010fffd", "a\U0010fffd▁b ▁\U0010fffd", "\x00\x01 \uffff", "▁", " ", "  ", "▁▁ ▁"):
        assert p.decode(p.encode(text)) == text


def test_a_word_of_a_million_characters():
    p, rng = m.model(None), random.Random(2)
    text = "".join(rng.choice("theofandé日▁") for _ in range(1_000_000))
    assert p.decode(p.encode(text)) == text


def test_merge_ranks_become_log_probabilities():
    pieces = [("<unk>", 0.0, "other"), ("<0x00>", 0.0, "byte"), ("▁a", 0.0, "normal"), ("b", -1.0, "normal"), ("c", -2.0, "normal")]
    got = m.log_probabilities(pieces)
    assert sum(math.exp(s) for _, s, k in got if k == "normal") == pytest.approx(1) and [s for _, s, k in got if k != "normal"] == [0.0, 0.0]
    assert got[2][1] > got[3][1] > got[4][1] and got[2][1] - got[4][1] == pytest.approx(math.log((2 + m.RANK_SHIFT) / m.RANK_SHIFT))
    given = [("a", -1.5, "normal"), ("b", -2.0, "normal")]
    assert m.log_probabilities(given) == given
    p = m.model(None)
    for text, ids in (("Hello world, this is a test of pieces.", 10), ("don't stop international", 5)):  # as many as merging gives
        assert len(p.encode(text)) // 4 == ids


def test_words_share_no_pieces_and_the_cache_is_bounded(monkeypatch):
    p = m.model(None)
    assert p.by_word
    monkeypatch.setattr(m, "CACHE_WORDS", len(p))
    n = len(p)
    p.encode("quitenewword1 quitenewword2")
    assert len(p) == n
    text = "Hello  wörld \n the end of the text"
    marked = m.MARK + text.replace(" ", m.MARK)
    assert p.encode(text) == p.path(marked).tobytes()


def test_table(docs_of):
    rows = [(1, "the quick  brown"), (2, ""), (3, None), (4, "日本 ▁ x\n"), (None, "null id"), (5, "long " * 30_000), (5, "again")]
    out = m.encode(docs_of(rows))
    got = {(r.doc_id, r.n_ids): r for r in out.collect()}
    assert len(got) == len(rows) and all(r.round_trip for r in got.values() if r.ids is not None)
    p = m.model(None)
    for i, t in rows:
        ids = p.encode(t or "")
        r = got[i, len(ids) // 4]
        assert r.ids_crc32 == zlib.crc32(ids) and r.ids == (None if t is None else array("I", ids).tolist())
    assert sorted((tuple(r) for r in m.decode(out).collect()), key=repr) == sorted(rows, key=repr)
    assert m.encode(docs_of([])).count() == 0


@pytest.mark.parametrize("by_word", [True, False])
def test_a_batch_gets_the_ids_of_its_texts(by_word, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    rng = random.Random(3)
    for p in [small(by_word, seed) for seed in range(4)] + [m.model(None)]:
        texts = ["".join(rng.choice("abcé  z▁\n日\U0010fffd") for _ in range(rng.randrange(14))) for _ in range(150)] + ["", " ", "x" * 90, "▁" * 50 + " a"]
        assert p.encode_all(pa.array(texts)) == [p.encode(t) for t in texts] and p.encode_all(pa.array([], pa.string())) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_a_batch_of_any_texts_gets_their_ids(texts):
    p = m.model(None)
    assert p.encode_all(pa.array(texts, pa.string())) == [p.encode(t) for t in texts]


def test_new_words_of_a_batch_take_their_steps_together(monkeypatch):
    p, rng, alone = m.model(None), random.Random(4), []
    path = p.path
    monkeypatch.setattr(p, "path", lambda marked: alone.append(marked) or path(marked))
    words = ["".join(rng.choice("etaoinshr") for _ in range(9)) + str(k) for k in range(3000)]
    batch = pa.record_batch([pa.array(range(300)), pa.array([" ".join(words[10 * k : 10 * k + 10]) for k in range(300)])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(m.encoded(iter([batch]), None))
    assert not alone and len(rows) == 300 and all(rows["round_trip"].to_pylist())
    assert rows["ids"].to_pylist() == [array("I", p.encode(t)).tolist() for t in batch["text"].to_pylist()]
