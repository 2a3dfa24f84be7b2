"""The corpus pipeline: filters, deduplication and packing of documents, one operator of ``lectern.llm`` each.

Every stage takes the documents that its predecessor kept and works on all of them. The filters and
the deduplication return the columns of ``documents``; the last stage returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.line_dedup import dedupe_lines
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import pack, pieces
from lectern.llm.quality import fit_quality, keep_good
from lectern.llm.toxicity import drop_toxic, fit_toxicity
from lectern.plans.scratch import settle


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, fit_toxicity(docs, _labels(spark, sf_dir)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as junk go."""
    return keep_good(docs, fit_quality(docs, _labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay only in the largest of them; every document stays."""
    out = dedupe_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences of at most 4096 tokens."""
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line dedup", lines), ("near dedup", near_dedup), ("packing", packing)]

#: The filters are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "_"))
    return docs
