from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm.op10_substring import TEXTS, deduplicate, group_of, grouped, texts


def brute(rows, window=20):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for i, text in order:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        stay = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(stay)).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda n=400: f"w{rng.randrange(n)}é"
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 33, 70]))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.choice([0, 1, 5, 19, 20, 50, 300]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i * 7, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000 + k, rows[40][1]) for k in range(30)]  # copies
    rows += [(2000, "a " * 200), (2001, "a " * 100), (2002, "a b " * 40)]  # overlaps itself
    rows += [(3000, None), (3001, ""), (3002, " \n "), (None, rows[40][1]), (None, None)]
    rows.append((5, "x".join(str(k) + " " for k in range(30_000))))  # very long
    return rows


def test_equals_brute_force(docs_of, corpus):
    assert result(deduplicate(docs_of(corpus, 5))) == brute(corpus)


def test_other_sizes(docs_of, corpus):
    assert result(deduplicate(docs_of(corpus, 2), window=9, block=5)) == brute(corpus, 9)


def test_repeated_rows(docs_of, corpus):
    rows = corpus[:30] + corpus[:30]
    got = result(deduplicate(docs_of(rows)))
    assert got == brute(rows)


def test_empty_table(docs_of):
    assert deduplicate(docs_of([])).count() == 0


def test_texts(docs_of):
    words = [f"q{k}" for k in range(25)]
    got = {r["doc_id"]: r["text"] for r in deduplicate(docs_of([(1, " ".join(words)), (2, "start " + "  ".join(words) + " end")]), output=texts, schema=TEXTS).collect()}
    assert got == {1: " ".join(words), 2: "start end"}


def test_groups_keep_the_order_and_are_split():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(-50, 50, 400), np.full(900, 7), rng.integers(10**9, 10**9 + 400, 800), rng.integers(-(10**12), 10**12, 50)])
    missing, ties = rng.random(len(ids)) < 0.3, rng.random(len(ids))
    marks = np.sort(np.quantile(ids, np.arange(1, 40) / 40, method="lower").astype(np.int64))
    for each in (1, 3):
        got = group_of(ids, missing, ties, marks, each, 12)
        order = sorted(range(len(ids)), key=lambda k: (bool(missing[k]), 0 if missing[k] else ids[k], ties[k]))
        assert (np.diff(got[order]) >= 0).all()
        counts = np.bincount(got)
        assert counts.max() < 0.06 * len(ids)


def test_rows_without_doc_id_or_of_one_are_split(docs_of):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(30))
    rows = [(None, text()) for _ in range(300)] + [(7, text()) for _ in range(300)] + [(k, text()) for k in range(60)]
    dealt = grouped(docs_of(rows).select("doc_id", "text"), 30, sum(len(t) for _, t in rows))
    sizes = [r["count"] for r in dealt.groupBy("grp").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 90
    passage = " ".join(f"p{k}" for k in range(25))
    out = deduplicate(docs_of([(None, f"{passage} x{k}") for k in range(40)] + [(7, f"{passage} y{k}") for k in range(40)]))
    assert sorted(r.n_removed for r in out.collect()) == [0] + [25] * 79 and out.where("n_removed = 0").first().doc_id == 7


def test_clashing_columns(docs_of, corpus):
    docs = docs_of(corpus)
    for n in ("grp", "tie", "bucket", "found", "kind", "probes", "x"):
        docs = docs.withColumn(n, F.lit(n))
    assert result(deduplicate(docs)) == brute(corpus)


def test_window_must_hold_a_block(docs_of):
    with pytest.raises(ValueError):
        deduplicate(docs_of([]), window=10, block=10)
