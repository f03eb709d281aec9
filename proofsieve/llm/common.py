"""Pieces that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.session import checkpointed

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component being its smallest node.

    Alternates large-star and small-star steps over aggregated joins, so that no neighbourhood is gathered in one
    place, and cuts the lineage after each round in the shared folder. Nodes without an edge have no row.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        # Large star: every larger neighbour of a node moves to the smallest node of its neighbourhood.
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node").unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before = state


def numbered(df: DataFrame, group: str, by: list[str], name: str = "slot") -> DataFrame:
    """df with gapless numbers from 0 in each group, in the order of the columns `by`, which tell all rows apart.

    Rows are dealt by ranges of (group, by) and numbered where they lie; what lies before each range is a sum over a
    table with a row for each range and group, so that no group has to fit in one task. The result is checkpointed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, group, *by).sortWithinPartitions(group, *by)
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")))
    same = placed[group].eqNullSafe(offsets["_group"]) & (placed["_part"] == offsets["_of"])
    return placed.join(F.broadcast(offsets), same).withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_group", "_of", "_offset")
