"""Incremental scans: a stream of files, each batch scanned by the batch plan and merged into the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftspark.operators import history
from siftspark.plans.scan import scan
from siftspark.sources.files import FILE_SCHEMA


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files as they arrive: Parquet with (path, size, language, text)."""
    return spark.readStream.schema(FILE_SCHEMA).parquet(path)


def learn(stream: DataFrame, findings_path: str, kb_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends each batch's findings, and writes the knowledge base after each batch as a version of its own.

    A batch that is run again overwrites its own findings and version, so both stay right
    after a failure.
    """

    def batch(files: DataFrame, epoch: int) -> None:
        spark = files.sparkSession
        found = scan(spark, files, **options).findings.persist()
        found.write.mode("overwrite").parquet(f"{findings_path}/batch={epoch}")
        seen = history.observe(found)
        kb = spark.read.parquet(f"{kb_path}/version={epoch - 1}") if epoch else spark.createDataFrame([], history.KB)
        history.upsert(kb, seen).write.mode("overwrite").parquet(f"{kb_path}/version={epoch}")
        found.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
