from __future__ import annotations

import hashlib
import math
import random
import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import op4_pii as m

sys.set_int_max_str_digits(0)

ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d * 2 > 9 else d * 2
        total += d
    return total % 10 == 0


def plain(text):
    """The contract's patterns as they stand."""
    out = [("email", *x.span()) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *x.span()) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in x[0].split("."))]
    for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", x[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *x.span()))
    out += [("phone", *x.span()) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", x[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


TEXTS = ["", "mail a.b+c@d-e.co.uk, x", "a@b.c@d.e", "a@b", "@x.y", "..@a.b.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234x", "++12345678901", "é 00.0.0.0é@é.b z@q.w", "+1.2.3.4.5.6.7.8.9", "1" * 5000 + ".1.1.1", "a" * 3000, "4" * 16]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert m.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a@.-+ 01259()é%")), max_size=40))
def test_base_spans_on_any_text(text):
    assert m.base_spans(text) == plain(text)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    vocabulary = [word() for _ in range(4000)]
    rows = []
    for k in range(200):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if k % 10 == 0:  # a term that goes with one entity and no other text
            words[30:30] = [rng.choice(vocabulary), "zzkovacs", "kov.acs@mail.example.com", rng.choice(vocabulary)]
        if k % 7 == 0:
            words.insert(5, f"u{k}@x.example.org")
        rows.append((k, " ".join(words)))
    rows += [(500 + k, rows[1][1].replace(rows[1][1].split()[3], "copy@ed.example.com " + "qqrare")) for k in range(50)]  # copies are no evidence
    near = rows[2][1].split()
    for k in range(60):  # near copies neither: each context has another edit
        words = [*near[:30], "qqneighbour", "near@ed.example.com", *near[30:]]
        words[24 + k % 15 if k % 15 not in (6, 7) else 20] = f"edit{k}"
        rows.append((700 + k, " ".join(words)))
    return [*rows, (900, None), (901, ""), (None, "null a@b.cd"), (902, "plain ZZKovacs here"), (902, "plain ZZKovacs here")]


def test_terms_that_disclose(docs_of, corpus):
    docs = docs_of(corpus)
    terms = dict(m.disclosing_terms(docs).collect())
    assert terms == {"zzkovacs": "remove"}
    got = {r.doc_id: r for r in m.find(docs).collect()}
    assert got[902].spans == "term:6:14" and got[902].n_email == 0 and got[902].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, text in corpus:
        base = plain(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert got[i].n_email == sum(x[0] == "email" for x in base)
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("term")] == [f"{a}:{b}:{c}" for a, b, c in base]


def test_wide_term_sets_are_joined(docs_of, corpus):
    docs = docs_of(corpus)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(m.find(docs, broadcast_terms=0)) == key(m.find(docs))
    assert key(m.sanitise(docs, broadcast_terms=0)) == key(m.sanitise(docs))


def test_sanitised_texts(docs_of, corpus):
    docs = docs_of(corpus)
    out = m.sanitise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[902] == "plain  here" and got[900] is None and got[None] == "null [EMAIL]"
    clean = [i for i, t in corpus if t and i and i < 200 and not plain(t)]
    assert clean and all(got[i] == dict(corpus)[i] for i in clean)
    assert not any(plain(t or "") for t in got.values())


def test_empty_table(docs_of):
    assert m.find(docs_of([])).count() == 0 and m.sanitise(docs_of([])).count() == 0


def groups(sets):  # all pairs; the operator finds them by minimum hashes, which are sure for copies and not for chance overlaps of half
    """The number of each set's group: sets that share half of the smaller one's members, directly or by way of others."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 2 * len(a & sets[j]) >= min(len(a), len(sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def plain_terms(texts, reach=8, significance=0.01, generalise_from=0.9, remove_from=0.95):
    """The disclosing terms by definition: all contexts and all sightings, compared with each other."""
    term, contexts, sights, vocabulary, words = re.compile(r"[^\W_]{3,}"), {}, {}, set(), 0
    for text in texts:
        text = text or ""
        vocabulary |= set(term.findall(text.lower()))
        words += len(term.findall(text))
        spans, clear = plain(text), text
        for _, s, e in spans:
            clear = clear[:s] + " " * (e - s) + clear[e:]
        found = [(x.start(), x[0].lower()) for x in term.finditer(clear)]
        near = {}
        for kind, s, e in spans:
            before, after = [k for k, x in enumerate(found) if x[0] < s][-reach:], [k for k, x in enumerate(found) if x[0] >= e][:reach]
            name = m.entity(kind, text[s:e])
            contexts.setdefault(name, set()).add(tuple(found[k][1] for k in before + after))
            for k in before + after:
                near.setdefault(k, set()).add(name)
        for k, (_, t) in enumerate(found):
            window = frozenset(x for _, x in found[max(0, k - reach) : k + reach + 1] if x != t) or frozenset([t])
            sights.setdefault(t, {}).setdefault(window, set()).update(near.get(k, ()))
    best = {}
    for name, held in contexts.items():
        held = [frozenset(x) for x in held]
        label = groups(held)
        n_c = len(set(label))
        q = min(0.5, 2 * reach * n_c / words)
        for t in frozenset().union(*held):
            n_ct = len({g for g, x in zip(label, held) if t in x})
            group = groups(list(sights[t]))
            n_t = n_ct + len(set(group)) - len({g for g, x in zip(group, sights[t].values()) if name in x})
            share = n_ct / n_t
            p = 1.0 if share <= q else math.exp(-n_t * (share * math.log(share / q) + (0 if share == 1 else (1 - share) * math.log((1 - share) / (1 - q)))))
            ic = -math.log2(n_c / words)
            degree = (ic + math.log2(share)) / ic
            if p * len(contexts) * len(vocabulary) <= significance and degree >= generalise_from:
                best[t] = max(best.get(t, 0), degree)
    return {t: "remove" if x >= remove_from else "generalise" for t, x in best.items()}


def planted(seed, vocabulary):
    """Entities of one to eight contexts with terms of their own, terms that also stand elsewhere, copies, and entities beside each other."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(vocabulary)]
    words = lambda n: [rng.choice(known) for _ in range(n)]
    rows = []
    for n in range(1, 9):
        rows += [" ".join([*words(12), f"own{n}", f"e{n}@ed.example.com", *words(12)]) for _ in range(n)]
    for n in range(6):
        rows += [" ".join([*words(9), "shared", f"10.0.0.{n}", *words(9)]) for _ in range(4)]
        rows += [" ".join([*words(9), f"mixed{n}", "mix@ed.example.com" if k < 6 else "", *words(9)]) for k in range(6 + n)]
    rows += rows[30:34] + [f"short {x}" for x in rows[30:34]]
    return rows + [" ".join(words(30)) for _ in range(30)] + ["", None, "+1 (555) 555-1234", "lonely 10.9.8.7"]


@pytest.mark.parametrize("seed,vocabulary", [(1, 400), (2, 1500)])
def test_terms_equal_the_definition(docs_of, seed, vocabulary):
    rows = planted(seed, vocabulary)
    want = plain_terms(rows)
    docs = docs_of(list(enumerate(rows)))
    for broadcast_terms in (m.BROADCAST_TERMS, 0):
        found = m.disclosing_terms(docs, broadcast_terms=broadcast_terms)
        assert (dict(found.collect()) if found is not None else {}) == want
    assert "own8" in want and "own1" not in want


def test_significance_decides_and_not_a_number_of_contexts(docs_of):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(n)]
    rows = [(k, " ".join([*words(20), "zzkovacs", "four@ed.example.com", *words(20)])) for k in range(5)]
    rows += [(10 + k, " ".join([*words(20), "qqonce", f"once{k}@ed.example.com", *words(20)])) for k in range(1)]
    near = rows[-1][1].split()
    rows += [(20 + k, " ".join([*near[:16], f"edit{k}", *near[17:]])) for k in range(30)]  # near copies add no context
    rows += [(100 + k, " ".join(words(60))) for k in range(50)]
    assert dict(m.disclosing_terms(docs_of(rows)).collect()) == {"zzkovacs": "remove"} == plain_terms([t for _, t in rows])
    assert m.disclosing_terms(docs_of(rows), significance=1e-30) is None


def test_contexts_are_terms_and_not_characters():
    text = "x" * 5000 + " mid-dle " + "long" * 100 + " a.b@example.org +1 (555) 555-1234 " + "é" * 3000 + " end"
    spans = m.base_spans(text)
    places, terms = m.terms_of(text, spans)
    assert terms == ["x" * 5000, "mid", "dle", "long" * 100, "é" * 3000, "end"]
    assert m.around(places, *spans[0][1:], 3) == [1, 2, 3, 4, 5] and m.around(places, *spans[1][1:], 1) == [3, 4] and m.around(places, 0, 0, 2) == [0, 1]


def test_clashing_columns(docs_of, corpus):
    names = ("_key", "_own", "_terms", "_actions", "term", "action", "key", "own", "terms", "actions", "entity", "context", "near", "group")
    docs = docs_of(corpus[-120:])
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    terms = docs.sparkSession.createDataFrame([("kovacs", "remove"), ("edit5", "generalise")], "term string, action string")
    own = m.with_own_terms(docs, terms)
    assert own.columns[: len(docs.columns)] == docs.columns and len(own.columns) == len(docs.columns) + 2
    out = m.sanitise(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 120 and all(tuple(r[n] for n in names) == names for r in rows)


def test_a_term_of_one_entity_stays_at_every_size(docs_of):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(k, " ".join([*words(20), "zzmany", "many@ed.example.com", *words(20)])) for k in range(400)]
    rows += [(1000 + k, " ".join([*words(20), "qqcopied", "few@ed.example.com", *words(20)])) for k in range(5)]
    copied = rows[-1][1].split()
    rows += [(2000 + k, " ".join(copied)) for k in range(300)]  # exact copies
    rows += [(3000 + k, " ".join([*copied[:17], f"edit{k}", *copied[18:]])) for k in range(300)]  # near copies
    rows += [(4000 + k, " ".join([*words(20), "loose", *(["loose@ed.example.com"] if k % 10 == 0 else []), *words(20)])) for k in range(100)]
    docs = docs_of(rows)
    for broadcast_terms in (m.BROADCAST_TERMS, 0):
        assert dict(m.disclosing_terms(docs, broadcast_terms=broadcast_terms).collect()) == {"zzmany": "remove", "qqcopied": "remove"}
