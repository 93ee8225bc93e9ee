"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before kept and is written as Parquet before the next begins. All stages but the last return the columns of
``documents``, whatever others there are. Language, like the ids of the last stage, can't be told in SQL, so there is no SQL for the whole;
the stages are tested against plain versions. An empty table gives no rows in every stage; null ids stay and rank as the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roundhouse.llm import exact_dedup, languages, minhash, mixing, packing
from roundhouse.llm.queries import domain, target
from roundhouse.llm.shared import Scratch, cleared
from roundhouse.llm.tokens import BYTE_BPE

#: share of the tokens that the mixture takes
MIXTURE = 0.9
END_ID = 50256
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, a null ``lang`` filled by the prediction; null texts and texts without a letter go."""
    return languages.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; a row that is repeated stays once."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: runs of five words, similarity 0.8. Texts without words stay."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights take, each once; a null source counts as ''."""
    mixed = mixing.mix(docs, domain(), target, share=MIXTURE, max_epochs=1, seed=10)
    return mixed.where(mixed[mixed.columns[-1]] > 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs, BYTE_BPE, END_ID, window=2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way, and what it read, goes once its own rows are written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with cleared():
            kept = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return docs
