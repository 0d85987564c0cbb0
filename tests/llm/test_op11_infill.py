from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import op11_infill as m

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    u = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, None, text
    p, mid, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm_rate:
        return doc_id, len(u), "spm", p, mid, s, f"<S>{s}<P>{p}<M>{mid}"
    return doc_id, len(u), "psm", p, mid, s, f"<P>{p}<S>{s}<M>{mid}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé日𝒳<PSM>.\x00  ") for _ in range(rng.randint(1, 6)))
    texts = ["".join(rng.choice(["", " ", "\n", "\t ", "\x0b\x0c\r"]) + word() for _ in range(rng.randint(0, 40))) + rng.choice(["", " ", "\n\n"]) for _ in range(300)]
    texts += [None, "", " ", "\n", "x", "a <P> b", "<S>", "c<M>", "<", "<P", "P> <S", "<<P", "a<\x00P>"] * 4 + ["long word " * 30_000]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "a b c d"), (None, None), (7, "copies of a row"), (7, "copies of a row"), (-3, "d e f")]


@pytest.mark.parametrize("how", [{}, {"seed": 1, "rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}, {"rate": 0}])
def test_equals_brute_force(docs_of, rows, how, monkeypatch):
    made = m.fill_in_middle(docs_of(rows), **how).withColumn("back", m.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted([(r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in made], key=key) == sorted([brute(*r, **how) for r in rows], key=key)
    assert all(r.back == (r.text or "") for r in made)
    assert all(r.length == "x" for r in made)  # other columns stay
    assert len({r.form for r in made}) == (3 if not how else 1 if how["rate"] == 0 else 2)


def test_pieces(docs_of, rows, monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array([t for _, t in rows])})
    for most in (1, 100, 10_000):
        monkeypatch.setattr(m, "PIECE_BYTES", most)
        got = list(m.pieces(batch, 0))
        assert pa.Table.from_batches(got).column("text").to_pylist() == [t for _, t in rows]
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most for p in got)


def test_clashing_names_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "")]).withColumn("N", F.lit(9)).withColumn("output", F.lit("mine"))
    assert m.names(docs) == ["n_", "form", "prefix", "middle", "suffix", "output_"]
    made = m.fill_in_middle(docs, rate=100).orderBy("doc_id").collect()
    assert [(r["N"], r.n_, r.output) for r in made] == [(9, 2, "mine"), (9, 0, "mine")]
    assert made[0].output_ == brute(1, "a b", rate=100)[-1]
    assert m.fill_in_middle(docs_of([]).limit(0)).count() == 0
    assert m.fill_in_middle(spark.createDataFrame([("7", "x y z")], "doc_id string, text string"), rate=100).first().output == brute(7, "x y z", rate=100)[-1]


def test_query_and_sql(spark, docs_of, rows, tmp_path):
    import duckdb

    docs_of(rows).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    made = [tuple(r) for r in m.query(spark, f"file://{tmp_path}").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, n, f, None if p is None else len(p), None if p is None else len(mid), sha(o), sha(t or "")) for (i, n, f, p, mid, _, o), (_, t) in ((brute(*r), r) for r in rows)]
    assert sorted(made, key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(m.ORACLE).fetchall(), key=str) == sorted(want, key=str)
