"""A table of register entries on disk, replaced category by category.

The table is a folder of Parquet files, partitioned by source and category; beside it lies a log of the batches that were
loaded. A batch is staged before anything is touched; then each of its categories is overwritten by itself, and last of all
the batch is logged. A run that fails leaves what was there, or some categories of the batch whole; running it again
completes it, and running a logged batch again changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofsieve.session import checkpointed, remove

KEYS = ("source", "category", "registration_no")
MARKS = "batch string, first_seen_at timestamp, last_seen_at timestamp"
LOG = "batch string, source string, category string, inserted long, updated long, kept long, removed long"


def _log(table: str) -> str:
    return table.rstrip("/") + "_batches"


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a folder, none if it isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def entries(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The table's rows: those of schema, which has KEYS, and the batch and times that they were seen in."""
    marks = spark.createDataFrame([], MARKS).schema
    return _read(spark, table, StructType([*schema, *marks]))


def batches(spark: SparkSession, table: str) -> DataFrame:
    """What each batch did to each category."""
    return _read(spark, _log(table), LOG)


def compare(old: DataFrame, new: DataFrame, batch: str, at: Column) -> DataFrame:
    """What becomes of old entries and new ones: rows of both, with batch, first_seen_at, last_seen_at and change.

    Entries that go have change removed and keep their old values; others have the new ones, and are inserted, updated or
    kept. What has been seen before keeps its first time. Repeated keys count once, by the least of their rows.
    """
    columns = new.columns
    first = new.groupBy(*KEYS).agg(F.min(F.struct(*(c for c in columns if c not in KEYS))).alias("now"))
    was = old.select(*KEYS, F.struct(*(c for c in columns if c not in KEYS)).alias("was"), F.col("first_seen_at").alias("first"), F.col("last_seen_at").alias("last"), F.col("batch").alias("seen"))
    both = was.join(first, list(KEYS), "full")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("seen").isNull(), "inserted").when(F.col("was") == F.col("now"), "kept").otherwise("updated")
    gone = F.col("now").isNull()
    own = F.coalesce("now", "was")
    values = [F.col(c) if c in KEYS else own[c].alias(c) for c in columns]
    return both.select(*values, F.when(gone, F.col("seen")).otherwise(batch).alias("batch"), F.coalesce("first", at).alias("first_seen_at"), F.when(gone, F.col("last")).otherwise(at).alias("last_seen_at"), change.alias("change"))


def replace(table: str, new: DataFrame, batch: str, at: Column) -> DataFrame:
    """Makes the table's categories that new (KEYS, ...) has hold its rows alone; returns the batch's rows of the log.

    Categories that new doesn't have stay. A batch of that name that is logged already is left as it is.
    """
    spark = new.sparkSession
    done = batches(spark, table).where(F.col("batch") == batch)
    if done.count():  # a row for each category
        return done
    touched = new.select("source", "category").distinct()
    old = entries(spark, table, new.schema).join(F.broadcast(touched), ["source", "category"], "left_semi")  # a row for each category
    staged = checkpointed(compare(old, new, batch, at))
    counts = checkpointed(staged.groupBy("source", "category").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated", "kept", "removed"))).select(F.lit(batch).alias("batch"), "source", "category", "inserted", "updated", "kept", "removed"))
    kept = staged.where("change <> 'removed'").drop("change")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "category").parquet(table)
    counts.write.mode("append").parquet(_log(table))
    return counts


def forget(spark: SparkSession, table: str) -> None:
    """Removes a table and its log."""
    remove(spark, table)
    remove(spark, _log(table))
