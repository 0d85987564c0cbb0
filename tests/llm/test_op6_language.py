from __future__ import annotations

import random
import zlib
from collections import Counter

from lodestrata.llm import op6_language as m

WORDS = {"en": "the of and tion wher ing thes wand", "fr": "le une été que ment çaux ouille", "de": "der und ein schön ung über straße"}


def corpus(n=300):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", ".", "!!", " 42"]) for _ in range(rng.randrange(5, 60)))
        rows.append((k, text, lang if k % 4 else None))
    return rows


def plain_grams(text):
    word = "".join(c if c.isalpha() else "\x01" for c in text.lower())
    out = Counter()
    for w in filter(None, word.split("\x01")):
        out.update(w)
        p = f"\x01{w}\x01"
        for n in (2, 3):
            out.update(p[k : k + n] for k in range(len(p) - n + 1))
    return {k: v for k, v in out.items() if len(k) < 3 or k[1] != "\x01"}


def test_grams_equal_plain_counts():
    for text in ["Hello, world!", "été 12 œuvre", "a", "  ", "1 2", "日本 text", "x" * 50, "don't", "𐐀𐐁 z"]:
        codes, n = m.grams(text)
        name = lambda c: "".join(chr(x) for x in ((c >> 42) & 0x1FFFFF, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x)
        assert {name(int(c)): int(k) for c, k in zip(codes, n)} == plain_grams(text)


def test_held_out_accuracy(docs_of):
    rows = corpus() + [(900, None, "en"), (901, "", "fr"), (902, "12 !! 34", "de"), (None, "the of and", "en")]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in m.identify(docs, m.learn(docs, profile=200, sample_per_language=1000)).collect()}
    assert len(got) == len(rows)
    truth = {k: lang for k, _, lang in rows if lang and k is not None and k < 900}
    for k, r in got.items():
        assert r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1
    right = [got[k].lang_pred == lang for k, lang in truth.items() if got[k].held_out]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert got[None].lang_pred == "en"


def test_only_the_learning_fold_counts(docs_of):
    rows = corpus()
    spoiled = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 5 == 0 else lang) for k, t, lang in rows]
    assert m.learn(docs_of(spoiled), 100).languages == ["de", "en", "fr"]


def test_out_of_place_distance_by_hand():
    p = m.Profiles({"a": [ord("x"), ord("y")], "b": [ord("y")]}, 2)
    # the document's list is y, x (plus longer n-grams that rank below): y at 0, x at 1
    codes = [int(c) for c in m.ranked(*m.grams("yyyx"), 2)]
    assert codes[0] == ord("y")
    lang, score = p.predict("yyyx")
    far = {k: sum(abs(r.index(c) - n) if c in r else 2 for n, c in enumerate(codes)) for k, r in {"a": [ord("x"), ord("y")], "b": [ord("y")]}.items()}
    assert lang == min(far, key=lambda k: (far[k], k)) and abs(score - (1 - far[lang] / 4)) < 1e-12


def test_nothing_to_learn_from_and_empty(docs_of):
    docs = docs_of([(1, "some text", None), (2, "more", None)])
    assert {r.lang_pred for r in m.identify(docs, m.learn(docs)).collect()} == {"und"}
    assert m.identify(docs_of([]), m.learn(docs)).count() == 0


def test_stage_keeps_prose_and_drops_the_rest(docs_of):
    rows = corpus() + [(900, "1234 5678", None), (901, None, None), (902, "これは日本語です", None)]
    docs = docs_of(rows)
    kept = m.drop_unidentified(docs, m.learn(docs), 0.1)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(300))
