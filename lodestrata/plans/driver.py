"""The library's operators applied to the driver's tables, each with the SQL that says the same.

documents serve as file rows, events as a timeline, orders as scans, the region-nation-customer hierarchy as directories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, raid, text, times
from ..operators import aggregates, enrich, graph, intervals, lifecycle, listing, search, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The sources that documents stand for, by doc_id.
SOURCES = ("ntfs_mft", "carver", "carver_bgc", "carver_duplicate", "usn_journal", "fat", "ext4_dirent", "hfs_catalog")
EXTENSIONS = ("jpg", "PDF", "zip", "txt", "mp3", "bin", "mov")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), i.cast("string"), F.lit("."), pick(EXTENSIONS, i))
    rows = (read(spark, sf_dir, "documents") if documents is None else documents).select(
        i.alias("id"), (i % 2 + 1).alias("scan_id"), name.alias("name"), F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("size_bytes"), (i % 3).cast("int").alias("status"), (i * 7 % 101).cast("int").alias("confidence"), pick(SOURCES, i).alias("source"),
        (i * 40 % 100_003).alias("start_sector"), "text",
    )
    rows = rows.withColumn("end_sector", F.col("start_sector") + F.floor(F.col("size_bytes") / 512))
    return rows.withColumns({"extension": text.extension_of("name"), "category": classify.category_for_name("name")})


_LISTS = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"
FILES_SQL = f"""f0 AS (
  SELECT doc_id AS id, doc_id % 2 + 1 AS scan_id, 'f' || doc_id || '.' || ({_LISTS(EXTENSIONS)})[doc_id % 7 + 1] AS name, lang, source AS folder,
         n_chars AS size_bytes, CAST(doc_id % 3 AS INTEGER) AS status, CAST(doc_id * 7 % 101 AS INTEGER) AS confidence,
         ({_LISTS(SOURCES)})[doc_id % 8 + 1] AS source, doc_id * 40 % 100003 AS start_sector, text
  FROM documents),
f1 AS (SELECT *, '/' || lang || '/' || folder || '/' || name AS path, start_sector + size_bytes // 512 AS end_sector,
       lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS extension FROM f0),
files AS (SELECT *, CASE {" ".join(f"WHEN extension IN {_IN(v)} THEN '{k}'" for k, v in classify.NAME_CATEGORIES.items())} ELSE 'Other' END AS category FROM f1)"""
DISCOVERY_SQL = ", ".join(f"'{x}'" for x in listing.DISCOVERY_SOURCES)
KINDS = {"signup": "create", "error": "delete", "click": "rename_old", "purchase": "rename_new"}


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    named = F.lit("touch")
    for k, v in KINDS.items():
        named = F.when(kind == k, v).otherwise(named)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 2 + 1).alias("scan_id"), F.unix_timestamp("ts").alias("timestamp"), named.alias("event_type"), F.col("user_id").alias("mft_ref"), "value")


TIMELINE_SQL = f"""timeline AS (
  SELECT event_id AS id, user_id % 2 + 1 AS scan_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
         CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'touch' END AS event_type, user_id AS mft_ref, value
  FROM events)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Lists, counts, summaries.


@query(f"WITH {FILES_SQL} SELECT id, name, category, source, size_bytes FROM files WHERE status = 0 AND NOT source ILIKE 'carver%' AND source <> 'carver_duplicate' AND source NOT IN ({DISCOVERY_SQL}) ORDER BY id LIMIT 50 OFFSET 20")
def file_list_page(spark, sf_dir):
    return listing.file_page(files(spark, sf_dir), None, 20, 50, listing.chip_filter("deleted")).select("id", "name", "category", "source", "size_bytes")


@query(f"WITH {FILES_SQL} SELECT id, name FROM files WHERE id > 100 ORDER BY id LIMIT 40")
def file_keyset_page(spark, sf_dir):
    return listing.page_after(files(spark, sf_dir), 100, 40).select("id", "name")


@query(f"WITH {FILES_SQL} SELECT count(*) AS n FROM files WHERE scan_id = 1 AND category = 'Image' AND source <> 'carver_duplicate' AND source NOT IN ({DISCOVERY_SQL})")
def file_count_filtered(spark, sf_dir):
    return listing.file_count(files(spark, sf_dir), 1, listing.chip_filter("all", "img"))


@query(f"WITH {FILES_SQL} SELECT source, count(*) AS n FROM files WHERE source ILIKE 'CARVER%' GROUP BY source UNION ALL SELECT 'not carved', count(*) FROM files WHERE NOT source ILIKE 'CARVER%'")
def source_like_notlike(spark, sf_dir):
    rows, f = files(spark, sf_dir), listing.FileFilter
    shown = {"include_duplicates": True, "include_discovery": True}
    carved = listing.files(rows, None, f(source_like="CARVER%", **shown)).groupBy("source").agg(F.count("*").alias("n"))
    return carved.unionByName(listing.files(rows, None, f(source_not_like="CARVER%", **shown)).agg(F.lit("not carved").alias("source"), F.count("*").alias("n")))


@query(f"WITH {FILES_SQL} SELECT id, name, path FROM files WHERE id = 77")
def file_by_id(spark, sf_dir):
    return listing.file_by_id(files(spark, sf_dir), 77).select("id", "name", "path")


@query(f"""WITH {FILES_SQL}, {TIMELINE_SQL},
a AS (SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 0 AND NOT source ILIKE 'carver%') AS deleted_files, count(*) FILTER (WHERE category = 'Image') AS image_files,
  count(*) FILTER (WHERE category = 'Document') AS document_files, count(*) FILTER (WHERE category = 'Video') AS video_files, count(*) FILTER (WHERE category = 'Audio') AS audio_files,
  count(*) FILTER (WHERE category = 'Archive') AS archive_files, count(*) FILTER (WHERE source IN ('carver', 'carver_bgc')) AS carved_files
  FROM files WHERE scan_id = 2 AND source NOT IN ({DISCOVERY_SQL})),
b AS (SELECT count(*) AS timeline_events, count(*) FILTER (WHERE event_type = 'create') AS usn_creates, count(*) FILTER (WHERE event_type = 'delete') AS usn_deletes,
  count(*) FILTER (WHERE event_type IN ('rename_old', 'rename_new')) AS usn_renames FROM timeline WHERE scan_id = 2)
SELECT *, total_files - image_files - document_files - video_files - audio_files - archive_files AS other_files, total_files - deleted_files AS allocated_files FROM a, b""")
def scan_summary(spark, sf_dir):
    return listing.report_remainders(listing.scan_summary(files(spark, sf_dir), timeline(spark, sf_dir), 2))


@query(f"WITH {TIMELINE_SQL} SELECT id, timestamp, event_type FROM timeline WHERE event_type = 'delete' ORDER BY timestamp, id LIMIT 200 OFFSET 100")
def timeline_page(spark, sf_dir):
    return listing.timeline_page(timeline(spark, sf_dir), 100, 200, None, "delete").select("id", "timestamp", "event_type")


@query(f"WITH {TIMELINE_SQL} SELECT count(*) AS timeline_events, count(*) FILTER (WHERE event_type = 'create') AS usn_creates, count(*) FILTER (WHERE event_type = 'delete') AS usn_deletes, count(*) FILTER (WHERE event_type IN ('rename_old', 'rename_new')) AS usn_renames FROM timeline")
def timeline_counts(spark, sf_dir):
    return listing.timeline_counts(timeline(spark, sf_dir))


@query(f"WITH {TIMELINE_SQL} SELECT event_type, count(*) AS n FROM timeline GROUP BY event_type")
def timeline_histogram(spark, sf_dir):
    return listing.timeline_histogram(timeline(spark, sf_dir))


@query("SELECT coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus IN ('O', 'P')), -1) AS scan_id FROM orders")
def latest_scan(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 4).otherwise(3)
    return listing.latest_scan(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")), usable_only=True)


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_tail(spark, sf_dir):
    return listing.tail(read(spark, sf_dir, "events"), 200, "ts", "event_id").select("event_id", "event_type")


# Search.

_TOKENS = r"regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+')"
_NAMES = _TOKENS.format("concat_ws(' ', name, path, extension)")
_PREFIX = "len(list_filter({}, lambda t: starts_with(t, '{}'))) > 0"


@query(f"SELECT doc_id AS id FROM documents WHERE {_PREFIX.format(_TOKENS.format('text'), 'ment')} AND {_PREFIX.format(_TOKENS.format('text'), 'ou')}")
def keyword_token_and(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(search.match_tokens("MENT ou", "text")).select(F.col("doc_id").alias("id"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example.net/fr') OR contains(lower(html), 'id=\"main')")
def keyword_substring(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.where(search.match_substring("Example.NET/fr", "url") | search.match_substring('id="MAIN', "html")).select("page_id")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+\\.html', 'i')")
def keyword_regex(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(search.match_regex(r"/(EN|fr)/[0-9]+\.html", "url")).select("page_id", "url")


@query(f"WITH {FILES_SQL} SELECT id FROM files WHERE contains(lower(name), '1.pd') OR contains(lower(path), '1.pd')")
def keyword_auto_fallback(spark, sf_dir):
    # no token starts with "pd" and "1" but f...1.PDF; "1.pD" has the terms 1 and pd, and no name has a token that starts with 1
    return search.search_files(files(spark, sf_dir), "1.pD").select("id")


@query(f"WITH {FILES_SQL} SELECT count(*) AS n FROM files WHERE {_PREFIX.format(_NAMES, 'src1')} AND {_PREFIX.format(_NAMES, 'pdf')}")
def search_count(spark, sf_dir):
    return search.search_count(files(spark, sf_dir), "src1 pdf")


_CHUNKS = "c AS (SELECT doc_id AS file_id, k AS chunk_no, substr(text, k * 262144 + 1, 262144) AS body FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 262144) AS BIGINT))) AS k FROM documents WHERE length(text) > 0))"


def chunks(spark, sf_dir):
    return search.content_chunks(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("body")), 262144)


@query(f"WITH {_CHUNKS} SELECT file_id, min(chunk_no) AS first_chunk, count(*) AS hits FROM c WHERE contains(lower(body), 'license') GROUP BY file_id")
def content_chunk_hits(spark, sf_dir):
    hits = chunks(spark, sf_dir).where(search.match_substring("License", "body"))
    return hits.groupBy("file_id").agg(F.min("chunk_no").alias("first_chunk"), F.count("*").alias("hits"))


@query(f"WITH {_CHUNKS} SELECT DISTINCT file_id AS id FROM c WHERE {_PREFIX.format(_TOKENS.format('body'), 'released')} AND {_PREFIX.format(_TOKENS.format('body'), 'lic')}")
def content_token_search(spark, sf_dir):
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return search.search_content(ids, chunks(spark, sf_dir), "released LIC").select("id")


@query(f"WITH {_CHUNKS}, p AS (SELECT DISTINCT file_id, chunk_no, unnest({_TOKENS.format('body')}) AS token FROM c) SELECT DISTINCT file_id FROM (SELECT file_id, chunk_no FROM p WHERE starts_with(token, 'mit') OR starts_with(token, 'license') GROUP BY file_id, chunk_no HAVING bool_or(starts_with(token, 'mit')) AND bool_or(starts_with(token, 'license')))")
def content_postings_search(spark, sf_dir):
    return search.search_postings(search.content_index(chunks(spark, sf_dir)), "mit license")


@query("SELECT doc_id AS file_id, md5(substr(text, 1, 262144)) AS sample_md5 FROM documents WHERE length(text) > 0")
def content_sample(spark, sf_dir):
    return search.content_sample(chunks(spark, sf_dir)).select("file_id", F.md5(F.col("body").cast("binary")).alias("sample_md5"))


@query("SELECT count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_index_count(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")
    return search.content_indexed_count(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), labels.where("toxic = 1"), labels.where("quality = 1"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_backfill(spark, sf_dir):
    return enrich.backfill(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


# Scalar functions.


@query(f"""SELECT event_id, CASE {" ".join(f"WHEN (m & {bit}) <> 0 THEN '{kind}'" for bit, kind in classify.USN_REASONS)} ELSE 'touch' END AS event_type
FROM (SELECT event_id, CAST(event_id * 7919 % 262144 AS INTEGER) & 196639 AS m FROM events)""")
def usn_reason_decode(spark, sf_dir):
    reason = (F.col("event_id") * 7919 % 262144).cast("int").bitwiseAND(196639)
    return read(spark, sf_dir, "events").select("event_id", classify.usn_event_type(reason).alias("event_type"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events")
def filetime_unix(spark, sf_dir):
    filetime = F.unix_timestamp("ts") * times.STEPS + times.EPOCH_1601 + 7
    return read(spark, sf_dir, "events").select("event_id", times.filetime_to_unix(filetime).alias("unix"))


@query("SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 3600 * (o_orderkey % 24) + 60 * (o_orderkey % 60) + 2 * (o_orderkey % 30) AS unix FROM orders")
def dos_unix(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    date = F.shiftleft(F.year(d) - 1980, 9) + F.shiftleft(F.month(d), 5) + F.dayofmonth(d)
    time = F.shiftleft((k % 24).cast("int"), 11) + F.shiftleft((k % 60).cast("int"), 5) + (k % 30).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", times.dos_to_unix(date, time).alias("unix"))


@query("SELECT l_orderkey, l_linenumber, CAST(epoch(date_trunc('second', l_shipdate)) AS BIGINT) AS unix FROM lineitem")
def exif_unix(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", times.exif_to_unix(F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")).alias("unix"))


@query(f"WITH {FILES_SQL} SELECT id, extension, category, CASE {' '.join(f'WHEN extension IN {_IN(v)} THEN {chr(39)}{k}{chr(39)}' for k, v in classify.CHIPS.items())} ELSE 'other' END AS chip FROM files")
def extension_category(spark, sf_dir):
    return files(spark, sf_dir).select("id", "extension", "category", classify.type_chip("extension").alias("chip"))


@query(f"""WITH {FILES_SQL} SELECT id,
  CASE WHEN source IN ('carver', 'carver_bgc') THEN CASE WHEN confidence >= 85 THEN 'likely complete' WHEN confidence >= 60 THEN 'doubtful' ELSE 'weak' END
       WHEN confidence > 0 THEN CASE WHEN confidence >= 85 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END ELSE '-' END AS hint,
  CASE WHEN source LIKE 'carver%' THEN 'carved' WHEN status = 1 THEN 'allocated' ELSE 'deleted' END AS state,
  NOT (source IN ({DISCOVERY_SQL}, 'carver_duplicate')) AS recoverable,
  CASE WHEN source = 'carver_duplicate' THEN 'Carved copy (overlaps the MFT)' WHEN source = 'usn_journal' THEN 'USN timeline' ELSE source END AS label FROM files""")
def file_labels(spark, sf_dir):
    return files(spark, sf_dir).select("id", classify.quality_hint("source", "confidence").alias("hint"), classify.status_label("status", "source").alias("state"), classify.is_recoverable("source", F.lit(False)).alias("recoverable"), classify.source_label("source").alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN 'Bad' WHEN p_size % 5 = 0 OR p_size % 3 = 0 THEN 'Warning' ELSE 'Good' END AS ata FROM part")
def health_triage(spark, sf_dir):
    one = lambda k: F.when(F.col("p_size") % k == 0, 1).otherwise(0)
    return read(spark, sf_dir, "part").select("p_partkey", classify.ata_health(one(5), one(3)).alias("ata"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  CASE WHEN regexp_matches(g, '[",\n;]') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS cell
FROM (SELECT doc_id, text, CASE WHEN regexp_matches(text, '^[=+\\-@]') THEN '''' || text ELSE text END AS g FROM documents)""")
def csv_and_html(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.html_escape("text").alias("html"), text.csv_cell("text").alias("cell"))


@query("""WITH n AS (SELECT doc_id, n_chars * (1 + doc_id % 3 * 4096) AS n FROM documents), u AS (SELECT *, CASE WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END AS u FROM n),
h AS (SELECT *, CAST(floor(n * 100 / CAST(u AS DOUBLE) + 0.5) AS BIGINT) AS h FROM u)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE h // 100 || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS size FROM h""")
def format_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.format_size(F.col("n_chars") * (1 + F.col("doc_id") % 3 * 4096)).alias("size"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 < 3 THEN CASE WHEN o_orderkey % 5 > 0 THEN 100 ELSE 75 END ELSE greatest(0, least(95, 45 + CASE WHEN o_orderkey % 4 = 0 THEN 35 ELSE 10 END - CASE WHEN o_orderkey % 11 = 0 THEN 10 ELSE 0 END - CASE WHEN o_orderkey % 5 > 0 THEN 0 ELSE 20 END)) END AS INTEGER) AS score FROM orders")
def mft_confidence(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", classify.mft_confidence(k % 7 < 3, k % 5 > 0, k % 11 == 0, F.lit(10), k % 4 == 0, F.lit(False)).alias("score"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    body = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(body).alias("md5"), F.sha2(body, 256).alias("sha256"))


@query("SELECT l_orderkey, l_linenumber, CAST(3 - b % 4 AS INTEGER) AS parity5, CAST(d + CASE WHEN d >= 3 - b % 4 THEN 1 ELSE 0 END AS INTEGER) AS data5, CAST(5 - b % 6 AS INTEGER) AS p6, CAST((10 - b % 6) % 6 AS INTEGER) AS q6, CAST(b % 3 * 2 AS INTEGER) AS mirror_a FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_linenumber AS b, l_linenumber % 3 AS d FROM lineitem)")
def raid_layout_map(spark, sf_dir):
    b, d = F.col("l_orderkey") * 3 + F.col("l_linenumber"), F.col("l_linenumber") % 3
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", raid.raid5_parity(b, 4).alias("parity5"), raid.raid5_data(b, d, 4).alias("data5"), raid.raid6_p(b, 6).alias("p6"), raid.raid6_q(b, 6).alias("q6"), raid.raid10_members(b, 6)[0].alias("mirror_a")
    )


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '[[' || o_orderkey || ',8]]' WHEN 2 THEN '[[' || o_orderkey || ',8],[18446744073709551615,4]]' ELSE '[[oops]]' END AS runs FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN runs ELSE '' END AS runs, CAST(CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS n FROM r""")
def runs_codec(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("[["), k, F.lit(",8]]"))).when(kind == 2, F.concat(F.lit("[["), k, F.lit(",8],[18446744073709551615,4]]"))).otherwise("[[oops]]")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", lifecycle.decode_runs(raw).alias("r"))
    return rows.select("o_orderkey", lifecycle.encode_runs("r").alias("runs"), F.size("r").alias("n"))


# Aggregates, intervals, graphs, joins.


@query("""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch)
SELECT doc_id, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id""")
def doc_entropy(spark, sf_dir):
    found = aggregates.symbol_entropy(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("""WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE md5(line) IN (SELECT md5(text) FROM benchmark UNION ALL SELECT md5(line) FROM h GROUP BY line HAVING count(*) > 3)) AS known FROM h GROUP BY doc_id""")
def hash_known(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.upper(F.md5(F.col("line").cast("binary"))).alias("md5"))
    listed = read(spark, sf_dir, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("md5")).unionByName(lines.groupBy("md5").count().where("count > 3").select(F.lower("md5").alias("md5")))
    return enrich.flag_known(lines, listed).groupBy("doc_id").agg(F.count_if("known").alias("known"))


@query("""WITH r AS (SELECT doc_id AS seq, source AS volume_id, md5(text) AS mft_record, CAST(doc_id * 7 % 101 AS INTEGER) AS confidence FROM documents)
SELECT volume_id, seq, confidence FROM r QUALIFY row_number() OVER (PARTITION BY volume_id, mft_record ORDER BY confidence DESC, seq) = 1""")
def best_record(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.md5(F.col("text").cast("binary")).alias("mft_record"), (F.col("doc_id") * 7 % 101).cast("int").alias("confidence"), F.lit("ntfs_mft").alias("source"), F.col("source").alias("volume_id"))
    return enrich.best_record(rows, keys=["volume_id"]).select("volume_id", "seq", "confidence")


_SPANS = "s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 100) AS BIGINT) + 1 AS e FROM events)"


@query(f"""WITH {_SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s WHERE start < e),
g AS (SELECT *, sum(CASE WHEN start <= r THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(start) AS start, max(e) AS "end" FROM g GROUP BY user_id, k""")
def extent_merge(spark, sf_dir):
    start = F.unix_timestamp("ts")
    rows = read(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.floor(F.col("value") * 100) + 1).alias("end"))
    return intervals.merge(rows, ["user_id"])


@query("""WITH g AS (SELECT o_custkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS k, o_orderkey, o_custkey % 50 AS b FROM orders)
SELECT b, min(o_orderkey) AS start, max(o_orderkey) + 1 AS "end" FROM g GROUP BY b, k""")
def free_runs(spark, sf_dir):
    return intervals.islands(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("b"), "o_orderkey"), ["b"], "o_orderkey")


@query("""WITH n AS (SELECT b, k, lead(k) OVER (PARTITION BY b ORDER BY k) AS x FROM (SELECT DISTINCT o_custkey % 50 AS b, o_orderkey AS k FROM orders))
SELECT b, k + 1 AS start, x AS "end" FROM n WHERE x > k + 1""")
def gap_runs(spark, sf_dir):
    return intervals.gaps(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("b"), "o_orderkey"), ["b"], "o_orderkey")


@query(f"""WITH {FILES_SQL}, k AS (SELECT * FROM files WHERE NOT source LIKE 'carver%'), c AS (SELECT * FROM files WHERE source LIKE 'carver%'),
p AS (SELECT c.id, min_by(k.path, (k.start_sector, k.id)) AS of FROM c JOIN k ON c.scan_id = k.scan_id AND c.start_sector <= k.end_sector AND k.start_sector <= c.end_sector
  AND 2 * (least(c.end_sector, k.end_sector) - greatest(c.start_sector, k.start_sector) + 1) >= least(c.end_sector - c.start_sector, k.end_sector - k.start_sector) + 1 GROUP BY c.id)
SELECT c.id, CASE WHEN of IS NULL THEN source ELSE 'carver_duplicate' END AS source, CASE WHEN of IS NULL THEN path ELSE '/dup_of' || of END AS path,
  CASE WHEN of IS NULL THEN confidence ELSE least(confidence, 35) END AS confidence FROM c LEFT JOIN p ON c.id = p.id""")
def overlap_dedup(spark, sf_dir):
    rows = files(spark, sf_dir).drop("text")
    carved = classify.is_carved("source")
    return intervals.mark_copies(rows.where(carved), rows.where(~carved), ["scan_id"], width=64).select("id", "source", "path", "confidence")


@query("""WITH RECURSIVE c AS (SELECT c_custkey % 3 AS v, * FROM customer),
e AS (SELECT 10 + r_regionkey AS node, 5 AS parent, r_name AS name, v FROM region, range(3) t(v) UNION ALL SELECT 100 + n_nationkey, 10 + (n_regionkey + v) % 5, n_name, v FROM nation, range(3) t(v)
  UNION ALL SELECT 1000 + c_custkey // 3, 100 + c_nationkey, c_name, v FROM c),
p AS (SELECT v, node, '/' || name AS path FROM e WHERE parent = 5 UNION ALL SELECT e.v, e.node, p.path || '/' || e.name FROM e JOIN p ON e.parent = p.node AND e.v = p.v)
SELECT CAST(v AS BIGINT) AS v, CAST(node AS BIGINT) AS node, path FROM p""")
def path_rebuild(spark, sf_dir):
    # three volumes whose record numbers are the same, and whose folders lie elsewhere
    long = lambda c: F.col(c).cast("long")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("v")
    regions = read(spark, sf_dir, "region").select(each, (long("r_regionkey") + 10).alias("node"), F.lit(5).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nations = read(spark, sf_dir, "nation").select("*", each).select("v", (long("n_nationkey") + 100).alias("node"), ((long("n_regionkey") + F.col("v")) % 5 + 10).alias("parent"), F.col("n_name").alias("name"))
    customers = read(spark, sf_dir, "customer").select((long("c_custkey") % 3).alias("v"), (F.floor(long("c_custkey") / 3) + 1000).alias("node"), (long("c_nationkey") + 100).alias("parent"), F.col("c_name").alias("name"))
    return graph.rebuild_paths(regions.union(nations).union(customers), deepest=8, keys=["v"])


@query(f"""WITH {FILES_SQL}, d AS (SELECT unnest(['/', '/' || lang, '/' || lang || '/' || folder]) AS directory FROM files) SELECT directory, count(*) AS files FROM d GROUP BY directory""")
def tree_rollup(spark, sf_dir):
    return graph.tree_rollup(files(spark, sf_dir).select("path"))


@query(f"""WITH {FILES_SQL}, d AS (SELECT unnest([{{'directory': '/', 'name': lang, 'is_directory': true}}, {{'directory': '/' || lang, 'name': folder, 'is_directory': true}},
  {{'directory': '/' || lang || '/' || folder, 'name': name, 'is_directory': false}}], recursive := true) FROM files) SELECT directory, name, is_directory, count(*) AS files FROM d GROUP BY ALL""")
def tree_children(spark, sf_dir):
    return graph.tree_children(files(spark, sf_dir).select("path"))


@query("""SELECT doc_id, CASE WHEN known OR ref THEN least(100, c + 12) ELSE c END AS confidence, CASE WHEN known OR ref THEN 'ntfs_mft_logfile' ELSE 'ntfs_mft' END AS source FROM
(SELECT d.doc_id, CAST(d.doc_id * 7 % 101 AS INTEGER) AS c, lower(d.source || d.doc_id) IN (SELECT lower('src0' || doc_id) FROM labels) AS known, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS ref FROM documents d)""")
def confirm_by_log(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(i.alias("mft_record"), F.concat(F.upper("source"), i.cast("string")).alias("name"), (i * 7 % 101).cast("int").alias("confidence"), F.lit("ntfs_mft").alias("source"), i)
    hints = read(spark, sf_dir, "labels").select(F.concat(F.lit("src0"), i.cast("string")).alias("name_lower"), F.when(F.col("toxic") == 1, i).alias("mft_ref"))
    return enrich.confirm_by_log(rows, hints).select("doc_id", "confidence", "source")


@query("""SELECT doc_id, CASE WHEN hit THEN least(100, c + 15) ELSE c END AS confidence, CASE WHEN hit THEN 'ntfs_mft_usn' ELSE 'ntfs_mft' END AS source FROM
(SELECT doc_id, CAST(doc_id * 7 % 101 AS INTEGER) AS c, doc_id % 3 = 0 AND doc_id IN (SELECT user_id FROM events WHERE event_type = 'error') AS hit FROM documents)""")
def confirm_by_journal(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(i.alias("mft_record"), (i % 3).cast("int").alias("status"), (i * 7 % 101).cast("int").alias("confidence"), F.lit("ntfs_mft").alias("source"), i)
    deleted = timeline(spark, sf_dir).where("event_type = 'delete'").select((F.col("mft_ref") + F.lit(3 << 48)).alias("file_reference"))
    return enrich.confirm_by_journal(rows, deleted).select("doc_id", "confidence", "source")


@query("""SELECT o.o_orderkey AS inode, CASE WHEN o.o_orderkey = 0 THEN 45 WHEN c.c_custkey IS NULL THEN 50 WHEN c.c_acctbal < 0 THEN 60 ELSE 95 END AS confidence,
CASE WHEN o.o_orderkey = 0 OR c.c_acctbal < 0 THEN 0 ELSE 1 END AS status FROM orders o LEFT JOIN customer c ON o.o_orderkey = c.c_custkey""")
def entries_with_inodes(spark, sf_dir):
    entries = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inode"), F.lit(1).alias("file_type"))
    inodes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("inode"), (F.col("c_acctbal") < 0).alias("deleted"))
    return enrich.entries_with_inodes(entries, inodes).select("inode", "confidence", "status")


@query("""SELECT coalesce(l.doc_id, p.page_id) AS oid, CASE WHEN l.doc_id IS NULL THEN 'apfs_extent' ELSE 'apfs_file' END AS source,
CASE WHEN l.doc_id IS NULL THEN 60 WHEN p.page_id IS NULL THEN 70 ELSE 85 END AS confidence, CASE WHEN p.page_id IS NULL THEN 0 ELSE 512 * length(p.url) END AS size_bytes
FROM labels l FULL JOIN pages p ON l.doc_id = p.page_id""")
def names_with_extents(spark, sf_dir):
    names = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("oid"), F.concat(F.lit("n_"), F.col("doc_id").cast("string")).alias("name"))
    run = F.struct(F.col("page_id").alias("start_sector"), F.length("url").cast("long").alias("sector_count"), F.lit(False).alias("is_sparse"))
    found = enrich.names_with_extents(names, read(spark, sf_dir, "pages").select(F.col("page_id").alias("oid"), F.array(run).alias("runs")))
    return found.select(F.regexp_extract("name", r"_(\d+)$", 1).cast("long").alias("oid"), "source", "confidence", "size_bytes")


@query("""SELECT s.s_suppkey, count(*) AS hits, count(*) > 1 AS collision FROM supplier s JOIN customer c ON s.s_nationkey + 1 = c.c_nationkey + 1
AND (s.s_suppkey % 20 = c.c_custkey % 20 OR s.s_suppkey % 20 = 0 OR c.c_custkey % 20 = 0) GROUP BY s.s_suppkey""")
def bind_snapshots(spark, sf_dir):
    snaps = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("serial"), (F.col("s_suppkey") % 20).alias("size_bytes"))
    volumes = read(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1).alias("serial"), (F.col("c_custkey") % 20).alias("size_bytes"))
    return enrich.bind_snapshots(snaps, volumes).select("s_suppkey", "hits", "collision")


# Lifecycle, progress, chains.


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 2 = 0 OR o_custkey % 2 = 0) THEN 1 ELSE 4 END ELSE 2 END AS status, o_orderkey % 5 = 0 AS changed FROM orders""")
def reclaim_orphans(spark, sf_dir):
    k = F.col("o_orderkey")
    scans = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, 0).otherwise(2).alias("status"), F.lit(100).alias("total_sectors"), F.when(k % 3 == 0, 100).otherwise(40).alias("scanned_sectors"),
        F.when(k % 2 == 0, "quick").otherwise("deep").alias("scan_type"), (F.col("o_custkey") % 2 == 0).alias("metadata_complete"),
    )
    return lifecycle.reclaim_orphans(scans).select("id", "status", "changed")


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS id, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE 'new ' || n.c_name END AS investigator, coalesce(o.c_custkey, n.c_custkey + 1000000) AS created_at
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey""")
def case_upsert(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer")
    old = rows.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("investigator"), k.alias("created_at"), F.lit(1).alias("updated_at"))
    new = rows.where(k % 2 == 0).select(k.alias("id"), F.concat(F.lit("new "), "c_name").alias("investigator"), (k + 1_000_000).alias("created_at"), F.lit(2).alias("updated_at"))
    return lifecycle.upsert_case(old, new).select("id", "investigator", "created_at")


@query("SELECT user_id AS id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return lifecycle.latest(rows).select("id", "event_type")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS meter FROM events")
def monotonic_meter(spark, sf_dir):
    return windows.monotonic(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", "meter").select("event_id", "meter")


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey * 1000000007::HUGEINT >= 10000000000000 THEN 999 ELSE l_orderkey * 1000000007::HUGEINT * 999 // 10000000000000 END AS BIGINT) AS share FROM lineitem")
def work_to_budget(spark, sf_dir):
    done = F.col("l_orderkey") * 1_000_000_007
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", windows.work_to_budget(done, F.lit(10**13), F.lit(1000)).alias("share"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type || event_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
h AS (SELECT user_id, k, sha256(repeat('0', 64) || m) AS head FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, sha256(h.head || o.m) FROM o JOIN h ON o.user_id = h.user_id AND o.k = h.k + 1)
SELECT user_id, max_by(head, k) AS head, max(k) AS links FROM h GROUP BY user_id""")
def audit_chain(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.col("event_id").cast("string")).alias("m"))
    return aggregates.hash_chain(lines, ["user_id"], "event_id", "m")
