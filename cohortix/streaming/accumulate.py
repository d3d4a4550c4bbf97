"""Permutations in instalments: each batch of permutation ids is scored once and appended; p-values come from what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(spark: SparkSession, wanted: DataFrame, folder: str) -> DataFrame:
    """Permutations (perm) of wanted that folder has no maximum of yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return wanted
    return wanted.join(spark.read.parquet(folder).select("perm"), "perm", "left_anti")


def append_maxima(spark: SparkSession, wanted: DataFrame, folder: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores what is pending, score(perms) -> (perm, vmax), appends it, and returns all: the largest for each permutation, so that a repeated append changes nothing."""
    todo = pending(spark, wanted, folder)
    if not todo.isEmpty():
        score(todo).select("perm", "vmax").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).groupBy("perm").agg(F.max("vmax").alias("vmax"))
