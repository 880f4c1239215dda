"""A corpus pipeline: language ID, SimHash near-dedup, redaction of personal data, packing.

Each stage takes the documents that its predecessor kept, as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.llm import langid, packing, pii, simhash
from understory.llm.common import fresh_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows, with ``lang`` as predicted; texts without letters go."""
    docs = docs.select(COLUMNS)
    carry = tuple(c for c in COLUMNS if c not in ("doc_id", "lang"))
    out = langid.predicted(docs, langid.fitted(docs), carry=carry)
    return out.where(F.col("lang_pred") != langid.UNKNOWN).withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redacted(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row a piece."""
    return packing.pieces(packing.pack_documents(docs))


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Trees, tokens and segmentations aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
