from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestrata.llm.common import unit31
from lodestrata.llm.op2_sharding import interleaved_shards


def corpus():
    rows = [(k, f"text {k} é", None, "hot" if k % 3 == 0 else f"s{k % 11}") for k in range(3000)]
    rows += [(9000 + k, None if k % 2 else "", None, None) for k in range(7)] + [(9100 + k, "solo", None, f"solo{k}") for k in range(60)]
    return rows + [(None, "null id", None, "hot")] * 3 + [(1, "text 1 é", None, "s1")] * 5


def test_law_slots_and_mixture(docs_of):
    rows = corpus()
    got = interleaved_shards(docs_of(rows, 4)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(40))
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    for x in shards.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    n = Counter(s for *_, s in rows)
    for source in ("hot", "s1", "s2"):
        each = [sum(r.source == source for r in x) for x in shards.values()]
        assert max(each) - min(each) <= 3 and abs(sum(each) / 40 - n[source] / 40) < 1e-9


def test_same_result_from_other_partitions(docs_of):
    rows = [r for r in corpus() if r[0] is not None][:2000]
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(interleaved_shards(docs_of(rows, 2))) == key(interleaved_shards(docs_of(rows, 7)))


def test_seed_changes_the_order(docs_of):
    rows = corpus()[:500]
    assert interleaved_shards(docs_of(rows), seed=1).collect() != interleaved_shards(docs_of(rows), seed=2).collect()


def test_fewer_rows_than_shards_and_empty(docs_of):
    got = interleaved_shards(docs_of([(1, "a"), (2, "b")])).collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}
    assert interleaved_shards(docs_of([])).count() == 0


def test_a_row_that_fills_a_third_of_the_table(docs_of, monkeypatch):
    monkeypatch.setattr("lodestrata.llm.op2_sharding.BUCKET_ROWS", 50)
    rows = [(7, "same", None, "hot")] * 1500 + [(None, None, None, None)] * 700 + [(k, f"t{k}", None, f"s{k % 3}") for k in range(2000)]
    got = interleaved_shards(docs_of(rows, 4)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert all(len(x) == 105 and sorted(r.slot for r in x) == list(range(105)) for x in shards.values()) and len(shards) == 40
    each = [sum(r.doc_id == 7 for r in x) for x in shards.values()]
    assert max(each) - min(each) <= 2


def test_equals_plain_interleaving(spark, docs_of):
    rows = [r for r in dict.fromkeys(corpus()) if r[0] is not None]
    docs = docs_of(rows, 3)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    hashed = docs.select("doc_id", "source", crc.alias("c"), unit31(F.lit(17), F.col("doc_id"), crc, F.lit(None).cast("long")).alias("u"), key.alias("k"), (unit31(F.lit(18), key) / 2.0**31).alias("s")).collect()
    by = defaultdict(list)
    for r in hashed:
        by[r.k].append(r)
    placed = []
    for k, x in by.items():
        x.sort(key=lambda r: (r.u, r.doc_id, r.c))
        placed += [((n + r.s) / len(x), k, n, r.doc_id) for n, r in enumerate(x)]
    placed.sort()
    want, slots = {}, Counter()
    for n, (*_, i) in enumerate(placed):
        shard = n * 40 // len(placed)
        want[i] = (shard, slots[shard])
        slots[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in interleaved_shards(docs).collect()} == want


def test_clashing_columns(docs_of):
    docs = docs_of([(k, f"t{k}", None, "a") for k in range(50)])
    for n in ("size", "shard", "slot", "_key", "_row", "_u", "_of", "_n", "_often"):
        docs = docs.withColumn(n, F.lit(n))
    assert interleaved_shards(docs).select("doc_id").distinct().count() == 50
