"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage is one of the subpackage's operators.  ``run`` writes every stage's result
and hands the reread table to the next, as the stages' names and order in ``STAGES``
say.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm.common import BATCH_BYTES, tune, written
from quillscan.llm.jaccard import near_duplicates
from quillscan.llm.langid import UNKNOWN, identify, train
from quillscan.llm.mixing import mix
from quillscan.llm.packing import pack_documents
from quillscan.llm.pii import sanitise
from quillscan.llm.tokenizing import TOKEN_SLICE


#: Text bytes that travel to a worker at once and that packing encodes at a time: half of what operators take on their own, as the stages before leave an executor's heap full.
BATCH, SLICE = BATCH_BYTES // 2, TOKEN_SLICE // 2


def _new_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any language (null text or no letter); a missing label is filled with the prediction.

    Repeated rows and ids, null ones too, are judged row by row. Without documents, or without any label, all that
    have a letter would be unknown, so none stay.
    """
    tune(spark, BATCH)
    pred, score = _new_name(docs, "lang_pred"), _new_name(docs, "lang_score")
    found = identify(docs, train(docs), pred_col=pred, score_col=score).filter(F.col(pred) != UNKNOWN)
    return found.select(*(F.coalesce("lang", pred).alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the least id.

    Rows that share an id count as one document: one of them stays (the longest text,
    then the greatest).  Rows with a null id take no part in the join and all stay.
    """
    tune(spark, BATCH)
    keep = near_duplicates(docs).filter("component_id = doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["doc_id"].alias("_id"))
    none = rows.filter("_id IS NULL").select("_row")
    one = rows.join(keep, rows["_id"] == keep["_kept"], "left_semi").groupBy("_id").agg(F.max_by("_row", F.struct(F.coalesce(F.length("_row.text"), F.lit(-1)), F.coalesce("_row.text", F.lit("")))).alias("_row")).select("_row")
    return one.unionByName(none).select("_row.*")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes the terms that disclose it.

    Every row stays, each with its own text: null and empty texts as they are, rows that share an id or have none by themselves.
    """
    tune(spark, BATCH)
    return _counted(docs, sanitise(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; documents appear as often as the mix takes them.

    Null sources are one source. Texts without words, null ones too, are never taken; rows that are equal are taken by themselves.
    """
    tune(spark, BATCH)
    return _counted(docs, mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences; one row per piece.

    A null or empty text is the end mark alone. Rows that share an id, as a mix makes them, are packed each; an empty table gives no rows.
    """
    tune(spark, BATCH)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), slice_bytes=SLICE)


def _counted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express cross parsing or the packing program; tests compare what stages keep with plain versions, and their operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
