"""Fill-in-middle transformation: DuckDB inside mapInArrow.

A text is cut into units (a word with the blanks before it, or blanks at the end), two seeded cuts part the units into
prefix, middle and suffix, and these are written in the order in which a model learns to fill the middle: prefix, suffix,
middle (psm) or suffix, prefix, middle (spm). The two cuts and the form follow from the SHA-256 of seed and doc_id alone, so
a row's result depends on no other row, no task and no order, and a lost executor's rows come out alike.

Each batch is cut into pieces of about PIECE_BYTES of text. A piece is registered as a table with one DuckDB connection of
the task, SQL does the rest (regexp_extract_all, list_slice, array_to_string, sha256), and its Arrow columns are put beside
those of the batch; no Python code sees a row. There is no shuffle. A text is one value, and DuckDB holds its units with it,
about eight times its bytes.

restored() undoes the forms with column functions. As a text that holds a marker stays plain, markers part an output in one
way only.

Defined results: a null text counts as empty; an empty text, a text that holds one of the three markers and a text outside
the share of `rate` stay as they are (form plain, null prefix, middle and suffix); a null doc_id is hashed as no digits; a
part may be empty; repeated rows give repeated rows; an empty table gives no rows. All columns of the table stay; where one
has the name of a new column, the new one gets an underscore at the end (the names are those of `names`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import free_names, read, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that DuckDB gets at once; a longer text comes alone.
PIECE_BYTES = 8 << 20
NEW = ["n", "form", "prefix", "middle", "suffix", "output"]
TYPES = [LongType(), *[StringType()] * 5]

SQL = rf"""
WITH cut AS (
  SELECT i, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256(concat({{seed}}, ':', k)) AS h,
    t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') AS bare
  FROM piece),
drawn AS (
  SELECT i, t, u, len(u) AS n, bare, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS two,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS chance, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS kind
  FROM cut),
parted AS (
  SELECT i, t, n, CASE WHEN bare OR chance >= {{rate}} THEN 'plain' WHEN kind < {{spm_rate}} THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(one, two)), '') END AS p,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(one, two) + 1, greatest(one, two)), '') END AS m,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(one, two) + 1, n), '') END AS s
  FROM drawn)
SELECT CAST(n AS BIGINT) AS n, form, p, m, s,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m) ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END AS output
FROM parted ORDER BY i
"""


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about PIECE_BYTES of text (column at), a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and total + size > PIECE_BYTES:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += size
    yield batch.slice(first)


def transformed(batches: Iterator[pa.RecordBatch], key: int, text: int, names: list[str], sql: str) -> Iterator[pa.RecordBatch]:
    """Batches with the new columns; key and text are the places of doc_id and text."""
    import duckdb

    with duckdb.connect(config={"threads": 1}) as db:
        for batch in batches:
            for piece in pieces(batch, text) if batch.num_rows else ():
                k = pc.fill_null(pc.cast(piece.column(key), pa.string()), "")
                t = pc.fill_null(pc.cast(piece.column(text), pa.string()), "")
                db.register("piece", pa.table({"i": pa.array(range(piece.num_rows), pa.int64()), "k": k, "t": t}))
                made = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("piece")
                new = [pc.cast(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0), pa.int64() if j == 0 else pa.string()) for j, c in enumerate(made.columns)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=names)


def names(docs: DataFrame) -> list[str]:
    """The names of the new columns: those of NEW, but for clashes."""
    return free_names(docs.columns, *NEW)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """docs with n (units), form, prefix, middle, suffix and output. Of 100 texts about rate change, and of these spm_rate of 100 are spm."""
    places = [c.lower() for c in docs.columns]
    new = names(docs)
    schema = StructType([*docs.schema.fields, *(StructField(c, t) for c, t in zip(new, TYPES))])
    sql = SQL.format(seed=int(seed), rate=int(rate), spm_rate=int(spm_rate))
    key, text, out = places.index("doc_id"), places.index("text"), [*docs.columns, *new]
    return small_batches(docs).mapInArrow(lambda it: transformed(it, key, text, out, sql), schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    front, middle = part(output, MIDDLE, 1), part(output, MIDDLE, 2)
    psm = F.concat(part(part(front, SUFFIX, 1), PREFIX, 2), middle, part(front, SUFFIX, 2))
    spm = F.concat(part(front, PREFIX, 2), middle, part(part(front, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs, seed=42, rate=50, spm_rate=80)
    chars = lambda c: F.char_length(c).cast("long")
    return made.select(
        "doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), '') AS x FROM documents),
h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    list_transform(range(4), lambda g: list_sum(list_transform(range(8), lambda j: (strpos('0123456789abcdef', x[g * 8 + j + 1]) - 1) * CAST(power(16, 7 - j) AS BIGINT)))) AS h
  FROM d),
c AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
