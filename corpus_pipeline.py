"""Cleaning of a document corpus in stages. Each stage is written and read again before the next one.

Each function takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns of documents; the
last one returns packed pieces. Null texts have no language and go with the first stage, as texts without letters do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, ngram_join, packing, pii, suffix_dedup
from plumbline.llm.common import written
from plumbline.llm.queries import vocabulary
from plumbline.runtime import recorded, remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some language; those that are `und` go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose word shingles link them, directly or by others, the one with the smallest id stays.

    Rows without an id come after all others, and rows of one id with different texts are documents of their own; of
    rows that repeat both id and text one stays. Such tables are numbered in order of id first, which sorts the texts.
    """
    key, rows = "doc_id", docs
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        key, rows = "_row", docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "_at")
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()).drop("_at"), "rows")
    with recorded() as folders:
        found = ngram_join.join(rows.select(F.col(key).alias("doc_id"), "text"))
    first = written(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)), "first")
    remove(spark, folders)
    return rows.hint("merge").join(first, key, "left_semi").select(docs.columns)  # one plan at every size


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes or more that documents with smaller ids have; emptied ones go."""
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each piece of personal data replaced by its kind."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary(), window=1024, end_id=0)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folders = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        with recorded() as made:
            docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folders += made
            with recorded() as made:
                docs = written(docs, name)
            remove(spark, folders)  # the stage's own and what it read
            folders = made
    return docs
