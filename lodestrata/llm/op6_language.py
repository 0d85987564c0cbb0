"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams (1 to 3, words padded with blanks). A
document's own ranked list is compared with each profile by the out-of-place measure: the sum over the document's n-grams
of the distance between their ranks, with a fixed penalty for an n-gram that the profile lacks. The nearest profile wins.

Learning reads text and lang of labelled documents outside the held-out fold. It takes a sample of about
`sample_per_language` documents per language (documented bound, chosen by a hash of doc_id), each of them whole. Counts are
summed in Spark; what the driver collects is `profile` n-grams a language.

Prediction reads the whole text and nothing else.

Defined results: a null text or one without a letter is `und` with score 0; a null doc_id is not held out and not learned
from; without any labelled document everything is `und`; equal distances go to the language that sorts first; repeated rows
give repeated rows; an empty table gives no rows; columns other than doc_id, text and lang are ignored. More than
MAX_LANGUAGES label values are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, small_batches, unit31

MAX_LANGUAGES = 2000
UNDETERMINED = "und"
#: Stands for everything between words; not a letter, so no text has it.
BLANK = np.uint64(1)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else BLANK."""
    if not _LETTERS:
        table = np.ones(0x110000, dtype=np.uint64)
        known = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and chr(i).isalpha()]
        table[known] = known
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of text, rising, and their counts. Each n-gram is up to three code points of 21 bits."""
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = np.empty(len(codes) + 2, dtype=np.uint64)
    c[0] = c[-1] = BLANK
    c[1:-1] = codes
    word = c != BLANK
    keep = word.copy()
    keep[0] = True
    keep[1:] |= word[:-1]
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    found = np.concatenate([c[c != BLANK], two, three[c[1:-1] != BLANK]])
    found.sort()
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[at], np.diff(np.append(at, len(found)))


def ranked(distinct: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller code."""
    return distinct[np.argsort(-counts, kind="stable")[:most]]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's labelled documents."""
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        distinct, inverse = np.unique(codes, return_inverse=True)
        return distinct, np.bincount(inverse, weights=n).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(grams(text))
            if len(held[lang]) >= 64:
                held[lang] = [merged(held[lang])]
    for lang, parts in held.items():
        distinct, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(distinct.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Profiles:
    """Ranked n-grams by language, as one table of ranks over all n-grams that any profile has."""

    def __init__(self, by_language: dict[str, list[int]], size: int) -> None:
        self.languages, self.size = sorted(by_language), size
        self.codes = np.unique(np.array([g for x in by_language.values() for g in x], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int32)
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(by_language[lang], dtype=np.uint64)), k] = np.arange(len(by_language[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        distinct, counts = grams(text or "")
        if not len(distinct) or not self.languages:
            return UNDETERMINED, 0.0
        top = ranked(distinct, counts, self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == top, at, len(self.codes))
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        k = int(np.argmin(out))
        return self.languages[k], float(1 - out[k] / (len(top) * self.size))


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, profile: int = 400, sample_per_language: int = 1500) -> Profiles:
    labelled = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} label values")
    if not sizes:
        return Profiles({}, profile)
    most = docs.sparkSession.createDataFrame([(x["lang"], min(2**31, 2**31 * sample_per_language // x["count"])) for x in sizes], "lang string, _most long")
    sample = labelled.select("lang", "text", unit31(F.lit(5), F.col("doc_id")).alias("_u")).join(F.broadcast(most), "lang").where("_u < _most")
    counts = sample.select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_k") <= profile)
    found: dict[str, list] = {x["lang"]: [] for x in sizes}
    for x in sorted(top.select("lang", "gram", "_k").collect(), key=lambda x: x["_k"]):  # languages times profile rows
        found[x["lang"]].append(x["gram"])
    return Profiles({k: v for k, v in found.items() if v}, profile)


def identified(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    """Batches with lang_pred and score added; the column named text is read."""
    for batch in batches:
        found = [profiles.predict(x) for x in batch.column("text").to_pylist()]
        columns = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
        names = [k for k in batch.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: identified(it, profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def kept(batches: Iterator[pa.RecordBatch], profiles: Profiles, text_at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [profiles.predict(x) for x in batch.column(text_at).to_pylist()]
        yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))


def drop_unidentified(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """docs without the rows whose text has no language or whose best score is under least."""
    at = docs.columns.index("text")
    return small_batches(docs).mapInArrow(lambda it: kept(it, profiles, at, least), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
