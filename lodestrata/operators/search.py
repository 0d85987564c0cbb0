"""Search over names and contents: token prefixes, substrings and regular expressions."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col, icontains
from ..schema import text
from .listing import page

#: Characters of a content chunk.
CHUNK = 256 * 1024
#: A pattern may have so many characters.
MOST_PATTERN = 128


def query_tokens(query: str) -> list[str]:
    """The terms of a query: its words, and of these the runs of letters and digits, in lower case."""
    return [t for word in query.split() for t in re.findall(r"[^\W_]+", word.lower())]


def tokens(*columns: Column | str) -> Column:
    joined = F.lower(F.concat_ws(" ", *[col(c) for c in columns]))
    return F.split(joined, r"[^\p{L}\p{N}]+")


def _starts_with(term: str):
    return lambda t: t.startswith(term)


def match_tokens(query: str, *columns: Column | str) -> Column:
    """Each term of the query is the start of some token; a query without a term matches nothing."""
    terms = query_tokens(query)
    if not terms:
        return F.lit(False)
    found, out = tokens(*columns), F.lit(True)
    for term in terms:
        out &= F.exists(found, _starts_with(term))
    return out


def match_substring(query: str, *columns: Column | str) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= icontains(text(col(c)), query)
    return out


def readable(pattern: str) -> bool:
    """Whether the engine that will run a pattern, Java's, can read it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def match_regex(pattern: str, *columns: Column | str) -> Column:
    """Case-insensitive search; a pattern that is too long or that the engine can't read matches nothing."""
    if len(pattern) > MOST_PATTERN or not readable(pattern):
        return F.lit(False)
    return F.concat_ws(" ", *[col(c) for c in columns]).rlike(f"(?i){pattern}")


NAMES = ("name", "path", "extension")


def search_files(files: DataFrame, query: str, mode: str = "auto") -> DataFrame:
    """Files whose name, path or extension matches.

    mode: token (all terms, as prefixes), substring (name or path), regex (name and path), or auto: token, and substring
    if that finds nothing; the fallback is part of the plan, so nothing is run twice.
    """
    if mode == "token":
        return files.where(match_tokens(query, *NAMES))
    if mode == "substring":
        return files.where(match_substring(query, "name", "path"))
    if mode == "regex":
        return files.where(match_regex(query, "name", "path"))
    marked = files.withColumns({"_token": match_tokens(query, *NAMES), "_sub": match_substring(query, "name", "path")}).where("_token OR _sub")
    some = marked.agg(F.max("_token").alias("_any"))
    return marked.join(F.broadcast(some), F.lit(True)).where(F.col("_token") | ~F.coalesce("_any", F.lit(False))).select(*files.columns)


def search_count(files: DataFrame, query: str, mode: str = "auto") -> DataFrame:
    return search_files(files, query, mode).agg(F.count("*").alias("n"))


def content_chunks(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file_id, chunk_no, body): texts (file_id, body) in windows of size characters; empty ones have none."""
    n = F.ceil(F.length("body") / F.lit(size)).cast("int")
    parts = texts.where(F.length("body") > 0).select("file_id", "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return parts.select("file_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.substring("body", F.col("chunk_no") * size + 1, F.lit(size)).alias("body"))


def content_index(chunks: DataFrame) -> DataFrame:
    """(token, file_id, chunk_no): postings, for prefix search without reading bodies. Write it partitioned or sorted by token."""
    words = chunks.select("file_id", "chunk_no", F.explode(F.array_distinct(tokens("body"))).alias("token"))
    return words.where("token <> ''").select("token", "file_id", "chunk_no")


def search_postings(postings: DataFrame, query: str) -> DataFrame:
    """file_id of chunks that hold all terms; the range conditions reach a scan that is sorted by token."""
    terms = list(dict.fromkeys(query_tokens(query)))
    if not terms:
        return postings.select("file_id").limit(0)
    hit = [F.col("token").between(t, t + "\U0010ffff") & F.col("token").startswith(t) for t in terms]
    some = hit[0]
    for h in hit[1:]:
        some |= h
    per_chunk = postings.where(some).groupBy("file_id", "chunk_no").agg(*[F.max(h).alias(f"_{k}") for k, h in enumerate(hit)])
    all_terms = F.lit(True)
    for k in range(len(hit)):
        all_terms &= F.col(f"_{k}")
    return per_chunk.where(all_terms).select("file_id").distinct()


def search_content_page(files: DataFrame, chunks: DataFrame, query: str, offset: int, limit: int, mode: str = "token") -> DataFrame:
    """A page of the files that search_content finds, by id."""
    return page(search_content(files, chunks, query, mode), offset, limit, "id")


def search_content_count(files: DataFrame, chunks: DataFrame, query: str, mode: str = "token") -> DataFrame:
    return search_content(files, chunks, query, mode).agg(F.count("*").alias("n"))


def search_content(files: DataFrame, chunks: DataFrame, query: str, mode: str = "token") -> DataFrame:
    """Files with a chunk that holds all terms (token) or the query itself (substring, which is marked in source)."""
    hit = match_tokens(query, "body") if mode == "token" else icontains("body", query)
    found = chunks.where(hit).select(F.col("file_id").alias("id"))
    rows = files.join(found, "id", "left_semi")
    return rows if mode == "token" else rows.withColumn("source", F.concat(text("source"), F.lit("+content")))


def content_indexed_count(files: DataFrame, *chunk_tables: DataFrame) -> DataFrame:
    """How many files have a chunk in any of the tables."""
    ids = chunk_tables[0].select(F.col("file_id").alias("id"))
    for other in chunk_tables[1:]:
        ids = ids.union(other.select("file_id"))
    return files.join(ids, "id", "left_semi").agg(F.count("*").alias("n"))


def content_index_complete(files: DataFrame, *chunk_tables: DataFrame) -> DataFrame:
    """One row: whether all files have a chunk. Both counts are of the same files."""
    have = content_indexed_count(files, *chunk_tables)
    return have.join(F.broadcast(files.agg(F.count("*").alias("_all"))), F.lit(True)).select((F.col("n") >= F.col("_all")).alias("complete"))


def content_sample(chunks: DataFrame) -> DataFrame:
    """The first chunk of each file."""
    return chunks.groupBy("file_id").agg(F.min_by("body", "chunk_no").alias("body"))


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the files that new has, and new."""
    return old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def prefix_lines(lines: DataFrame, key: str) -> DataFrame:
    """The last line of each kind of log line. key: a column expression that names the kind."""
    last = Window.partitionBy("kind").orderBy(F.desc("line_no"))
    return lines.withColumn("kind", F.expr(key)).where("kind <> ''").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


