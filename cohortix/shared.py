"""What all operators share: the folder that every executor sees, cutting lineage there, and places in a global order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: later plans read them from there, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with place, from 0, in the order of columns that make rows distinct, and _part, the range of the order a row is in.

    Ranges are ordered side by side; only their sizes, one row for each, meet in one task."""
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn("place", place).drop("_before")


def kth_largest(df: DataFrame, value: Column, place: int, bins: int = 4096, few: int = 200_000) -> float | None:
    """The value of place, from 0, in descending order; null values don't count, and None is beyond the last.

    Counts of equal bins, bins + 1 rows at most, narrow the range down until few values are left in it, or equal ones only."""
    rows = durable(df.select(value.cast("double").alias("s")).where("s is not null"))
    while True:
        low, high, n = rows.agg(F.min("s"), F.max("s"), F.count("*")).first()
        if place >= n:
            return None
        if low == high:
            return low
        if n <= few:
            return rows.orderBy(F.desc("s")).limit(place + 1).agg(F.min("s")).first()[0]
        width = (high - low) / bins
        bin_of = F.least(F.lit(bins - 1), F.floor((F.lit(high) - F.col("s")) / F.lit(width)).cast("int"))
        for b, k in sorted((r["b"], r["n"]) for r in rows.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()):
            if place < k:
                rows = rows.where(bin_of == b)
                break
            place -= k
