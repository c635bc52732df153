"""The corpus pipeline: five stages over documents, each the operator of one module of siftspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs. Each runs over all that its predecessor kept. Nulls, empty and
repeated rows, ties and extra columns are handled as the operators' docstrings say; an
empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import mixing, packing, quality_qda, quality_rules, simhash
from siftspark.llm.common import crc_fold, fresh_path, table
from siftspark.llm.queries import QUALITY_FROM


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that the rules fail are removed; documents without words, of repeated words or losing too much go.

    Short documents are judged by their lines alone. n_chars follows the cleaned text.
    """
    kept = quality_rules.judge(docs, least_words=1).where("quality.kept")
    own = {"text": F.col("quality.clean"), "n_chars": F.length("quality.clean").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as label 0 go. The classifier learns from the labelled documents as they came, held-out ones excepted."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_qda.fit(raw.where(crc_fold(F.col("doc_id"), 5) != 0), table(spark, sf_dir, "labels"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, quality_qda.scores(F.col("text"), model).alias("score")).where(F.col("score") >= QUALITY_FROM).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.near_deduplicate(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources above their target thin out, others repeat, up to three times."""
    return mixing.mix(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    return packing.pack_texts(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", by_rules), ("quality classifier", by_classifier), ("near-dedup", near_dedup), ("mixing", to_weights), ("packing", into_sequences)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
