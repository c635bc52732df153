"""Helpers that the corpus operators share.

Operators take column names as parameters and work on private aliases, so extra
columns of any name in the input can neither clash with theirs nor be lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern, as Java and RE2 write it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df written once to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder. As cut, but joins are planned by its true size: a checkpoint keeps its plan's estimate, which grows from turn to turn of a loop."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key from which they are not dealt by it.
HOT = 100_000


def met(rows: DataFrame, table: DataFrame, key: str, keep: str | None = None) -> DataFrame:
    """rows joined with the row of table that has their key; rows without one go.

    table has a key once, and in its column n how many rows have it, which is kept under the
    name keep or left out. Keys of very many rows are few (at most one in HOT rows) and sent
    to all executors, so that such rows stay where they are; all others are dealt by key.
    """
    table = table.withColumnRenamed("n", "_n")
    both = rows.join(F.broadcast(table.where(F.col("_n") > HOT)), key)
    both = both.union(rows.join(table.where(F.col("_n") <= HOT), key).select(both.columns))
    return both.drop("_n") if keep is None else both.withColumnRenamed("_n", keep)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body names it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds
