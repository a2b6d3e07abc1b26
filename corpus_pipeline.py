"""documents to packed sequences: quality, near-duplicates, personal data, mix, packing.

Each stage takes all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import OWN, clear_staged, remove, shared_dir, staged_so_far, table
from folioscope.llm.mixing import mixed_documents
from folioscope.llm.packing import pack
from folioscope.llm.pii import find_personal_data
from folioscope.llm.quality import classify
from folioscope.llm.simhash import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-pooled classifier keeps. A null text is judged as an empty one; without labels of both classes all stay."""
    return classify(docs, table(spark, sf_dir, "labels")).where(f"{OWN}kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 of 5-word shingles), the smallest doc_id. Texts without words are one group; rows without an id stay, same texts once."""
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced; n_chars follows the text. A null text becomes an empty one."""
    out = find_personal_data(docs, texts=True).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each copy taken, none of texts without words; null sources are a source."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens; a null text is the closing id alone."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("packing", packing)]

#: No stage can be put in SQL: a fitted classifier, XXH64 fingerprints, pattern walks, hashed ranks and byte-pair ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again.

    Null texts and ids, empty tables, repeated rows and extra columns pass through the stages as their docstrings say. What a stage
    has staged, and the stage before it has written, is removed once the stage is written; the last stage's table stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = staged_so_far()
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear_staged(spark, mark)
        remove(spark, [before] if before else [])
        before = path
    return docs
