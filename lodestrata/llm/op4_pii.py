r"""Information-theoretic sanitisation of personal data.

Base spans are found by form: email, ip, card (Luhn), phone. Each value found is a protected entity. The corpus then says
how strongly other terms (runs of three or more letters and digits, without regard to case) reveal an entity c: with n_t the
distinct sightings of a term in the corpus, n_ct the distinct contexts of c (`reach` terms to either side) that hold t, n_c
the distinct contexts of c and M the terms of the corpus,

    IC(c) = -log2(n_c / M)    PMI(c, t) = IC(c) + log2(n_ct / n_t)    disclosure(c, t) = PMI(c, t) / IC(c)

A disclosure of 1 means that the term gives the entity away completely. Terms from `remove_from` on are removed, terms from
`generalise_from` on are replaced by a placeholder, wherever they occur.

Chance is no evidence. Every term beside a value that occurs once would reveal it fully by this formula, so a disclosure
counts only if it is significant: were t independent of c, each of its n_t sightings would fall into a context of c with
q = 2 reach n_c / M, and n_ct or more of them with p <= exp(-n_t KL(n_ct / n_t || q)). This bound times the number of
hypotheses (entities times distinct terms of the corpus) has to stay within `significance`. There is no least number of
contexts: a rare term needs few, a common one many, and one context is enough where that cannot be chance.

Copies are no evidence either. Equal contexts count once, and so do contexts of an entity that share `COPY_FROM` of the smaller
one's terms (so a context that a text's start or end cuts short is a copy of the whole one), directly or by way of others:
n_c and n_ct count groups of such contexts. They are linked within buckets of equal minimum hashes, each to the bucket's
first context. n_t is n_ct plus the sightings of t that are not in a context of c. Sightings (`reach` terms to either side) are grouped the
same way, so a term that stands beside c only has a disclosure of 1, however often it is copied. A term with more sightings
away from all entities than any disclosure of `generalise_from` allows is given up by the task that finds them.

Statistics cover all documents. Entities and pairs are counted with map-side partial sums; what reaches a worker whole is
the set of candidate terms and the set of disclosing terms, up to `broadcast_terms` each. Beyond that the terms of
documents are joined with these sets instead.

Defined results: a null text is empty and has no spans (and stays null when sanitised); spans are in code points with the
end exclusive; base spans of different kinds may overlap and all stay; a term span that overlaps a base span is left out;
rows that repeat give repeated rows; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_names, no_broadcast_bound, read, small_batches
from .components import components

KINDS = ("email", "ip", "card", "phone", "term")
PLACE = {kind: k for k, kind in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a run of digits that can't start a match can't do so further on, so runs are tried once
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\W_]{3,}")

REACH, SIGNIFICANCE = 8, 0.01
GENERALISE_FROM, REMOVE_FROM = 0.9, 0.95
BROADCAST_TERMS = 100_000
#: Share of the smaller context's terms from which two contexts are copies, and the minimum hashes by which they are found.
COPY_FROM, HASHES = 0.5, 16

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, found from their @ signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then by kind."""
    spans: list[Span] = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans, key=lambda x: (x[1], PLACE[x[0]], x[2]))


def entity(kind: str, value: str) -> str:
    """The value under which all spellings of an entity are counted."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{NO_DIGIT.sub('', value)}"


def terms_of(text: str, spans: list[Span]) -> tuple[list[int], list[str]]:
    """Places and terms of a text in order; all base spans are blank."""
    out, at = [], 0
    for _, s, e in spans:
        if e > at:
            out += [text[at : max(at, s)], " " * (e - max(at, s))]
            at = e
    found = list(TERM.finditer("".join(out) + text[at:]))
    return [m.start() for m in found], [m[0].lower() for m in found]


def around(places: list[int], start: int, end: int, reach: int) -> list[int]:
    """The numbers of the terms within reach terms of a span, in order."""
    low, high = bisect_left(places, start), bisect_left(places, end)
    return [*range(max(0, low - reach), low), *range(high, min(len(places), high + reach))]


MENTIONS = pa.schema([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))])


def mentions(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(entity, hash of the context, its distinct terms) of each base span; equal rows of a batch once."""
    for batch in batches:
        found: dict[tuple[str, int], list[str]] = {}
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            places, every = terms_of(text, spans) if spans else ([], [])
            for kind, s, e in spans:
                terms = [every[k] for k in around(places, s, e, reach)]
                found[entity(kind, text[s:e]), xxhash.xxh3_64_intdigest(" ".join(terms)) - 2**63] = sorted(set(terms))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.string()))], schema=MENTIONS)


def similar(a: frozenset[str], b: frozenset[str]) -> bool:
    return len(a & b) >= COPY_FROM * min(len(a), len(b))


SIGHTINGS = pa.schema([("term", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


class Sightings:
    """The sightings of one term in a task, copies once; full if more than `most` of them are away from all entities."""

    __slots__ = ("buckets", "found", "away")

    def __init__(self) -> None:
        self.buckets, self.found, self.away = {}, [], 0

    def add(self, terms: frozenset[str], near: set[str], most: float) -> bool:
        """Whether the term is full now."""
        least = [(k, min(row)) for k, row in enumerate(zip(*map(hashes, terms)))]
        known = next((x for x in map(self.buckets.get, least) if x and similar(x[0], terms)), None)
        if known is None:
            self.found.append(known := (terms, set(near)))
            self.away += not near
        elif near:
            self.away -= not known[1]
            known[1].update(near)
        for x in least:
            self.buckets.setdefault(x, known)
        return self.away > most


@functools.lru_cache(50_000)
def hashes(term: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh3_64_intdigest(term, k) for k in range(HASHES))


def sightings(batches: Iterator[pa.RecordBatch], most: dict[str, float] | float, reach: int) -> Iterator[pa.RecordBatch]:
    """(term, hash of a sighting, its terms, the entities near it) for the terms of most, or all with one bound.

    A term that is full has one row without terms.
    """
    held: dict[str, Sightings | bool | None] = {}  # None if full, False if that has been told
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for term, x in held.items():
            rows += [(term, None, None, None)] if x is None else [] if x is False else [(term, xxhash.xxh3_64_intdigest(" ".join(sorted(terms))) - 2**63, sorted(terms), sorted(near)) for terms, near in x.found]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SIGHTINGS)], schema=SIGHTINGS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans, near = base_spans(text), {}
            places, found = terms_of(text, spans)
            if isinstance(most, dict) and not any(x in most and held.get(x, True) for x in found):
                continue
            for kind, s, e in spans:
                for k in around(places, s, e, reach):
                    near.setdefault(k, set()).add(entity(kind, text[s:e]))
            for i, term in enumerate(found):
                bound = most.get(term) if isinstance(most, dict) else most
                if bound is None:
                    continue
                x = held[term] if term in held else held.setdefault(term, Sightings())
                if not x:
                    continue
                before = len(x.found)
                window = frozenset(t for t in found[max(0, i - reach) : i + reach + 1] if t != term) or frozenset([term])
                full = x.add(window, near.get(i, set()), bound)
                size += len(x.found) - before
                if full:
                    size -= len(x.found)
                    held[term] = None
        if size > 20_000:
            yield flush()
            # terms that are full stay so
            held, size = {k: False for k, x in held.items() if not x} if isinstance(most, dict) else {}, 0
    yield flush()


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): the distinct terms of each batch, n the batch's terms on one of its rows."""
    for batch in batches:
        held, n = set(), 0
        for text in batch.column(0).to_pylist():
            if text:
                found = TERM.findall(text.lower())
                held.update(found)
                n += len(found)
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([0] * len(held) + [n], pa.int64())], names=["term", "n"])


def grouped(seen: DataFrame) -> DataFrame:
    """seen (key, context, terms; distinct) with the group of copies that a context belongs to."""
    seen = cut(seen.withColumn("_node", F.xxhash64("key", "context")))
    least_of = lambda k: F.array_min(F.transform("terms", lambda t: F.xxhash64(t, F.lit(k))))
    least = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), least_of(k).alias("least")) for k in range(HASHES))))
    rows = seen.where(F.size("terms") > 0).select("key", "_node", "terms", least.alias("_x")).select("key", "_node", "terms", "_x.k", "_x.least")
    first = rows.groupBy("key", "k", "least").agg(F.min(F.struct("_node", "terms")).alias("_first"))
    shared = F.size(F.array_intersect("terms", "_first.terms"))
    links = rows.join(first, ["key", "k", "least"]).where("_node <> _first._node").where(shared >= COPY_FROM * F.least(F.size("terms"), F.size("_first.terms")))
    links = cut(links.select(F.col("_node").alias("a"), F.col("_first._node").alias("b")).distinct())
    if not links.limit(1).count():
        return seen.withColumnRenamed("_node", "group")
    labels = components(links).select(F.col("node").alias("_node"), "label")
    return seen.join(labels, "_node", "left").withColumn("group", F.coalesce("label", "_node")).drop("_node", "label")


def chance(n_ct: Column, n_t: Column, q: Column) -> Column:
    """The logarithm of a bound for the probability that n_ct or more of n_t sightings fall into a context: Chernoff's."""
    share = n_ct / n_t
    rest = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - q))).otherwise(0.0)
    return F.when(share > q, -n_t * (share * F.ln(share / q) + rest)).otherwise(0.0)


def disclosing_terms(docs: DataFrame, reach: int = REACH, significance: float = SIGNIFICANCE, generalise_from: float = GENERALISE_FROM, remove_from: float = REMOVE_FROM, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame | None:
    """term and action (generalise or remove) of the terms that reveal an entity; None if no term beside one can be significant."""
    texts = small_batches(docs).select("text")
    seen = texts.where(F.col("text").rlike("[0-9@]")).mapInArrow(lambda it: mentions(it, reach), "entity string, context long, terms array<string>")
    seen = cut(seen.groupBy("entity", "context").agg(F.first("terms").alias("terms")))
    protected = seen.agg(F.approx_count_distinct("entity", 0.02)).first()[0]
    if not protected:
        return None
    words, distinct = texts.mapInArrow(vocabulary, "term string, n long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.approx_count_distinct("term", 0.02)).first()
    if not words:
        return None
    # logarithm of the largest p of a single hypothesis
    least = math.log(significance) - math.log(protected) - math.log(max(1, distinct))
    q_of = lambda n_c: F.least(F.lit(0.5), n_c * F.lit(2 * reach / words))
    # no term of an entity can be significant if one in all of its contexts and nowhere else is not
    entities = seen.groupBy("entity").agg(F.count("*").alias("_contexts"))
    entities = entities.where(F.col("_contexts") * F.ln(F.lit(2 * reach / words)) <= least)
    if not entities.limit(1).count():
        return None
    contexts = cut(grouped(seen.join(entities.select("entity"), "entity", "left_semi").withColumnRenamed("entity", "key")).withColumnRenamed("key", "entity"))
    entities = contexts.groupBy("entity").agg(F.count_distinct("group").alias("n_c"))
    pairs = contexts.select("entity", "group", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    pairs = pairs.join(entities, "entity").where(chance(F.col("n_ct").cast("double"), F.col("n_ct").cast("double"), q_of(F.col("n_c"))) <= least)
    pairs = cut(pairs)
    bound = F.col("n_ct") * (F.pow(F.greatest(F.lit(1.0), F.lit(words) / F.col("n_c")), F.lit(1 - generalise_from)) - 1) * (1 + 1e-9)
    candidates = cut(pairs.groupBy("term").agg(F.max(bound).alias("most")))
    if no_broadcast_bound(candidates, broadcast_terms):
        most = candidates.agg(F.max("most")).first()[0]
    else:
        most = dict(candidates.collect())
        if not most:
            return None
    found = cut(texts.mapInArrow(lambda it: sightings(it, most, reach), "term string, context long, terms array<string>, near array<string>"))
    full = found.where("terms IS NULL").select("term").distinct()
    kept = found.where("terms IS NOT NULL").join(candidates.select("term"), "term", "left_semi").join(full, "term", "left_anti")
    kept = cut(kept.groupBy("term", "context").agg(F.first("terms").alias("terms"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    seen_at = grouped(kept.select(F.col("term").alias("key"), "context", "terms")).select(F.col("key").alias("term"), "context", "group")
    placed = cut(seen_at.join(kept.select("term", "context", "near"), ["term", "context"]))
    counts = placed.groupBy("term").agg(F.count_distinct("group").alias("_all"))
    beside = placed.select("term", "group", F.explode("near").alias("entity")).distinct().groupBy("term", "entity").agg(F.count("*").alias("_beside"))
    scored = pairs.join(counts, "term").join(beside, ["term", "entity"], "left")
    scored = scored.withColumn("n_t", F.col("n_ct") + F.col("_all") - F.coalesce("_beside", F.lit(0)))
    ic = -F.log2(F.col("n_c") / F.lit(float(words)))
    degree = 1 + F.log2(F.col("n_ct") / F.col("n_t")) / ic
    scored = scored.where(ic > 0).where(chance(F.col("n_ct").cast("double"), F.col("n_t").cast("double"), q_of(F.col("n_c"))) <= least).groupBy("term").agg(F.max(degree).alias("degree")).where(F.col("degree") >= generalise_from)
    return cut(scored.select("term", F.when(F.col("degree") >= remove_from, "remove").otherwise("generalise").alias("action")))


def all_spans(text: str, terms: dict[str, str]) -> list[Span]:
    """Base spans and spans of disclosing terms, by start, then by kind."""
    spans = base_spans(text)
    if not terms:
        return spans
    more, k, covered = [], 0, 0
    for m in TERM.finditer(text):
        if m[0].lower() in terms:
            while k < len(spans) and spans[k][1] < m.end():
                covered, k = max(covered, spans[k][2]), k + 1
            if m.start() >= covered:
                more.append(("term", *m.span()))
    return sorted(spans + more, key=lambda x: (x[1], PLACE[x[0]], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


def sanitised(text: str, spans: list[Span], terms: dict[str, str]) -> str:
    """text with each span replaced by its kind; of overlapping spans the first one's kind stands for all."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], "" if kind == "term" and terms.get(text[s:e].lower()) == "remove" else f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


REPORT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(batches: Iterator[pa.RecordBatch], terms: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
    """The third column, if there is one, holds a row's own disclosing terms."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        own = [terms or {}] * len(texts) if terms is not None else [{t: "remove" for t in x or ()} for x in batch.column(2).to_pylist()]
        found = [all_spans(x or "", t) for x, t in zip(texts, own)]
        base = [[y for y in x if y[0] != "term"] for x in found]
        n = [Counter(y[0] for y in x) for x in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([x[kind] for x in n], pa.int64()) for kind in KINDS[:4]), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in found], pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def rewritten(batches: Iterator[pa.RecordBatch], at: int, terms: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
    """Batches with column at sanitised. With terms None, the last two columns hold a row's own terms and actions and go."""
    for batch in batches:
        texts, names = batch.column(at).to_pylist(), batch.schema.names
        own = [terms] * len(texts) if terms is not None else [dict(zip(t or (), a or ())) for t, a in zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist())]
        new = [x if x is None else sanitised(x, all_spans(x, t), t) for x, t in zip(texts, own)]
        width = batch.num_columns - 2 * (terms is None)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(width)], names=names[:width])


def held_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term): the distinct terms of each text."""
    for batch in batches:
        found = [(k, t) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in {m.lower() for m in TERM.findall(x or "")}]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["key", "term"])


def with_own_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs and, as last columns, the disclosing terms that a row's text holds and their actions. For term sets that are too large to broadcast."""
    key, own, words, actions = free_names(docs.columns, "key", "own", "terms", "actions")
    hashed = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = docs.select(hashed.alias("key"), "text").mapInArrow(held_terms, "key binary, term string").distinct()
    found = found.join(terms, "term").groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("term", "action")).alias(own))
    rows = docs.withColumn(key, hashed).join(found, key, "left")
    return rows.select(*docs.columns, F.col(own)["term"].alias(words), F.col(own)["action"].alias(actions))


def find(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS, **thresholds) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = disclosing_terms(docs, broadcast_terms=broadcast_terms, **thresholds)
    if terms is not None and no_broadcast_bound(terms, broadcast_terms):
        return with_own_terms(docs, terms).mapInArrow(lambda it: report(it, None), REPORT_DDL)
    known = dict(terms.collect()) if terms is not None else {}
    return docs.mapInArrow(lambda it: report(it, known), REPORT_DDL)


def sanitise(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS, **thresholds) -> DataFrame:
    """docs with personal data generalised or removed in text."""
    at = docs.columns.index("text")
    terms = disclosing_terms(docs, broadcast_terms=broadcast_terms, **thresholds)
    if terms is not None and no_broadcast_bound(terms, broadcast_terms):
        return with_own_terms(docs, terms).mapInArrow(lambda it: rewritten(it, at, None), docs.schema)
    known = dict(terms.collect()) if terms is not None else {}
    return docs.mapInArrow(lambda it: rewritten(it, at, known), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
