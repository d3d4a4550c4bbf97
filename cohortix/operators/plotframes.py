"""Tidy frames behind figures: importances, thresholds, colour ranges, type tests. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_bars(values: DataFrame, top: int = 5, threshold: float | None = None) -> DataFrame:
    """(name, value) with |value| of threshold or more, or the top largest, and the top smallest too where values have both signs."""
    if threshold is not None:
        return values.where(F.abs("value") >= threshold)
    both = values.agg((F.min("value") < 0).alias("neg"), (F.max("value") > 0).alias("pos"))
    high = values.orderBy(F.desc("value"), "name").limit(top)
    low = values.crossJoin(F.broadcast(both)).where("neg and pos").drop("neg", "pos").orderBy("value", "name").limit(top)
    return high.unionByName(low).distinct()


def display_threshold(values: DataFrame, threshold: float | str | None = "auto", rois: bool = False, percentile: float = 0.75) -> DataFrame:
    """(threshold): as given; auto: 0.5 for regions, else the percentile of values that aren't 0, less 1e-5; None: the least |v| above 0 over 5."""
    spark = values.sparkSession
    if threshold is None:
        return values.where("v <> 0").agg((F.min(F.abs("v")) / 5).alias("threshold"))
    if threshold not in ("auto", "default") or rois:
        return spark.createDataFrame([(0.5 if threshold in ("auto", "default") else float(threshold),)], "threshold double")
    return values.where("v <> 0").agg((F.percentile("v", F.lit(percentile)) - 1e-5).alias("threshold"))


def colour_range(values: DataFrame, symmetric: bool | None = None) -> DataFrame:
    """(vmin, vmax, is_symmetric) of non-null values; symmetric about 0 if asked for, or, unless said, where both signs occur."""
    facts = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    both = F.lit(symmetric) if symmetric is not None else (F.col("lo") < 0) & (F.col("hi") > 0)
    top = F.greatest(F.abs("lo"), F.abs("hi"))
    return facts.select(F.when(both, -top).otherwise(F.col("lo")).alias("vmin"), F.when(both, top).otherwise(F.col("hi")).alias("vmax"), both.alias("is_symmetric"))


def is_parcellation(values: DataFrame) -> DataFrame:
    """(is_parcellation): all values are whole numbers."""
    return values.agg(F.bool_and(F.col("v") == F.floor("v")).alias("is_parcellation"))


def average_method(values: DataFrame, rois: bool = False) -> DataFrame:
    """(method): median for regions, and where distinct values are 5 % of those that aren't 0 or fewer; else mean."""
    if rois:
        return values.sparkSession.createDataFrame([("median",)], "method string")
    facts = values.where("v <> 0").agg(F.count_distinct("v").alias("d"), F.count("*").alias("n"))
    return facts.select(F.when(F.col("d") / F.col("n") > 0.05, "mean").otherwise("median").alias("method"))


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): the mean of each column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], columns, "name", "value")
