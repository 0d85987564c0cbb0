"""A corpus pipeline of five stages: language, exact copies, near copies, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); run() applies them to the table documents. All but the last return
the columns of docs, whatever their names, and work on all rows that their predecessor kept. An empty table gives an empty
table in each stage; columns other than doc_id, text and (for learning languages) lang decide nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import op1_minhash, op4_pii, op6_language, op7_packing, op9_exact
from lodestrata.llm.common import read, remove, shared_folder

#: Documents whose best language profile is no nearer than this are rejected. Prose of any length in a learned language
#: scores over 0.4; text in another script, or none at all, scores near 0.
LEAST_LANGUAGE_SCORE = 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose text is in a language that the labelled rows of docs teach.

    A null or empty text and one without letters go; a long text is judged whole; a null doc_id or lang only keeps a row from
    being learned from; of languages that are as near, the first by name counts; repeated rows are judged each. Without a
    label nothing can be identified and all rows go.
    """
    return op6_language.drop_unidentified(docs, op6_language.learn(docs), LEAST_LANGUAGE_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: of the most code points, then of the smallest doc_id.

    Null and empty texts are one text; texts of any length are compared whole; a null doc_id comes after all others; of rows
    that repeat doc_id and text one stays.
    """
    return op9_exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each class of near copies.

    Rows without doc_id, text or words are alone in their class and stay; texts of any length are compared whole; rows of one
    doc_id count as one document and stay or go together.
    """
    return op1_minhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data and terms that disclose it generalised or removed in text; no row goes.

    A null text stays null and an empty one empty; texts are searched whole; where spans overlap, the first one's kind stands
    for all; repeated rows stay and count once as evidence. Other columns, n_chars too, keep what they hold.
    """
    return op4_pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the pieces of all docs in sequences of 2048 tokens.

    A null or empty text is one token; longer texts than a sequence are cut; a null doc_id and repeated rows are packed like
    others; pieces of like length may change places.
    """
    return op7_packing.pack(docs, capacity=2048)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Signatures, the disclosure statistics and token ids have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage is written to the shared folder and read by the next one; what was read goes."""
    docs, last = read(spark, sf_dir, "documents"), None
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if last:
            remove(spark, last)
        last = f"{at}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)
