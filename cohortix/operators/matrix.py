"""Subjects x features in long form (subject, feat, v) and wide form (subject, array): conversion, masks, slices, missing values, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(wide: DataFrame, subject: str, data: str, *keep: str) -> DataFrame:
    """(subject, *keep, feat, v): one row for each array entry, feat from 0; NaN becomes null."""
    v = F.col("v").cast("double")
    out = wide.select(F.col(subject).alias("subject"), *keep, F.posexplode(data).alias("feat", "v"))
    return out.withColumn("v", F.when(~F.isnan(v), v))


def to_wide(long: DataFrame, *keep: str) -> DataFrame:
    """(subject, *keep, data): the values of each subject in the order of feat."""
    pairs = F.array_sort(F.collect_list(F.struct("feat", "v")))
    return long.groupBy("subject", *keep).agg(F.transform(pairs, lambda p: p.v).alias("data"))


def apply_mask(long: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows whose feature has m = 1 in mask (feat, m), renumbered from 0 in the order of feat as pos."""
    kept = mask.where("m = 1")
    kept = kept.select("feat", (F.row_number().over(Window.orderBy("feat")) - 1).alias("pos"))
    return long.join(kept, "feat")


def check_mask(mask: DataFrame) -> None:
    """A mask must hold exactly two distinct values."""
    n = mask.select("m").distinct().limit(3).count()
    if n != 2:
        raise ValueError(f"a mask holds 2 distinct values, not {n}")


def reverse_mask(values: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """(subject, feat, v) over all features of mask: the value at pos of each subject in its place, 0 where m isn't 1.

    values: (subject, pos, value)."""
    slots = mask.select("feat", F.when(F.col("m") == 1, F.sum((F.col("m") == 1).cast("int")).over(Window.orderBy("feat")) - 1).alias("pos"))
    subjects = values.select("subject").distinct()
    full = subjects.crossJoin(F.broadcast(slots))
    return full.join(values.select("subject", "pos", F.col(value).alias("_v")), ["subject", "pos"], "left").select("subject", "feat", F.coalesce("_v", F.lit(0.0)).alias("v"))


def index_slice(long: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows of features start, start + step, ... below stop; on long tables the range reaches the scan as a filter."""
    keep = F.col("feat") >= start
    if stop is not None:
        keep &= F.col("feat") < stop
    if step != 1:
        keep &= (F.col("feat") - start) % step == 0
    return long.where(keep)


def zero_as_null(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(0).cast(df.schema[column].dataType)))


def null_as_zero(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(0).cast(df.schema[column].dataType)))


def recode(df: DataFrame, column: str, zero_as_nan: bool = False, nan_as_zero: bool = False) -> DataFrame:
    """Either recoding; asking for both is an error."""
    if zero_as_nan and nan_as_zero:
        raise ValueError("zero_as_nan and nan_as_zero exclude each other")
    return zero_as_null(df, column) if zero_as_nan else null_as_zero(df, column) if nan_as_zero else df


def drop_top_outliers(long: DataFrame, top: int = 50) -> DataFrame:
    """(subject, mean_abs) without the top subjects by mean |v|; a subject without values goes first, ties by subject. top 0 drops none."""
    means = long.groupBy("subject").agg(F.avg(F.abs("v")).alias("mean_abs"))
    worst = means.orderBy(F.desc_nulls_first("mean_abs"), "subject").limit(top).select("subject")
    return means.join(worst, "subject", "left_anti") if top else means


def demean(long: DataFrame) -> DataFrame:
    """v less the mean of its feature."""
    means = long.groupBy("feat").agg(F.avg("v").alias("_mean"))
    return long.join(means, "feat").withColumn("v", F.col("v") - F.col("_mean")).drop("_mean")


def lower_triangle(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """(pos, i, j, w) of the cells (i, j, w) below the diagonal, or on it too, in row-major order from 0; pos is i (i -+ 1) / 2 + j."""
    kept = cells.where("i >= j" if diagonal else "i > j")
    step = F.col("i") + 1 if diagonal else F.col("i") - 1
    return kept.select(((F.col("i") * step) / 2 + F.col("j")).cast("long").alias("pos"), "i", "j", "w")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both cells of each pair (i, j, w), and a zero diagonal."""
    both = pairs.select("i", "j", "w").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    nodes = both.select("i").distinct()
    return both.where("i <> j").unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(0.0).alias("w")))
