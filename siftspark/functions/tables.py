"""Small fixed tables that need no Python worker to read."""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a table that the JVM makes of one literal; for some hundreds of rows of JSON's types."""
    of = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(of.names, r, strict=True)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), ArrayType(of))))


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, computed once, for results that read them many times: written to the folder that driver and executors share.

    Where no such folder is set (spark.checkpoint.dir), they are kept on the executors' disks, and computed again if one is lost.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{shared.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
