from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))

from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import op4_pii
from lodestrata.llm.op7_packing import cut_points, encoder
from test_op1_minhash import brute as near_brute


def corpus():
    rng = random.Random(12)
    words = {"en": "the of and tion wher ing thes wand", "fr": "le une été que ment çaux ouille"}
    rows = []
    for k in range(80):
        lang = "en" if k % 2 else "fr"
        rows.append((k, " ".join(rng.choice(words[lang].split()) + rng.choice(["", "a", "e", "io"]) for _ in range(60)), lang, f"s{k % 3}"))
    rows += [(100 + k, rows[k][1].replace(" ", "  "), rows[k][2], "copy") for k in range(10)]  # exact but for white space, and longer
    near = rows[20][1].split()
    for k in range(12):
        w = list(near)
        w[5 * k % 60] = f"edit{k}"
        rows.append((200 + k, " ".join(w), "fr", "near"))
    rows += [(300, "mail me at some.one@example.org or +1 (555) 555-1234 the of and tion", "en", None), (301, None, "en", None), (302, "0000 1111", None, None), (303, "これは文です", None, None)]
    return rows


def plain(rows):
    """The stages in plain Python, for prose that all profiles accept."""
    docs = {i: t for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t) and i != 303}
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[re.sub(r"\s", "", t)].append((-len(t), i))
    kept = {min(g)[1] for g in groups.values()}
    docs = {i: t for i, t in docs.items() if i in kept}
    classes = near_brute(list(docs.items()))
    docs = {i: t for i, t in docs.items() if classes[i] == i}
    return {i: op4_pii.sanitised(t, op4_pii.base_spans(t), {}) for i, t in docs.items()}


def test_stages_and_run(spark, docs_of, tmp_path):
    rows = corpus()
    docs_of(rows).drop("length").write.parquet(str(tmp_path / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    want = plain(rows)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    e, pieces = encoder(None), Counter()
    for i, t in want.items():
        pieces.update((i, k, s, n) for k, (s, n) in enumerate(cut_points(len(e.encode(t)) // 4 + 1, 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == pieces


def test_stages_on_empty_tables_and_clashing_columns(spark, docs_of):
    names = ["id", "key", "row", "digest", "keep_id", "class_id", "lang_pred", "score", "terms", "actions", "_u", "_gone", "piece", "length_"]
    rows = [(1, None), (None, "the of and tion"), (2, ""), (3, "the of and tion wher", "en"), (3, "the of and tion wher", "en"), (4, "mail a.b@example.org the of", "en"), (None, None)]
    for docs in (docs_of([]), docs_of(rows)):
        for n in names:
            docs = docs.withColumn(n, F.lit(n))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            found = out.collect()
            assert all(r[n] == n for r in found for n in names), name
            assert len(found) == 0 or docs.count(), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert packed.count() == docs.count()
