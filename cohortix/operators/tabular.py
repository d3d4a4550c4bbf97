"""Covariate tables: event filters, missing-value codes, encodings, alignment of tables by subject, set operations."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The codes that stand for missing in covariate files.
SENTINELS = ["777", "999"]


def sentinel_null(column: Column) -> Column:
    """Null where the value, as text, is a missing-value code."""
    return F.when(~column.cast("string").isin(SENTINELS), column)


def filter_events(df: DataFrame, events: str | list[str] | None, column: str = "eventname") -> DataFrame:
    """Rows of the events; the event column stays unless exactly one event is asked for. None keeps all rows."""
    if events is None:
        return df
    names = [events] if isinstance(events, str) else list(events)
    out = df.where(F.col(column).isin(names))
    return out.drop(column) if len(names) == 1 else out


def ordinal_encode(df: DataFrame, column: str, to: str) -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct values; null stays null. The values, not the rows, are ranked."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = values.select(column, (F.dense_rank().over(Window.orderBy(column)) - 1).alias(to))
    return df.join(codes, column, "left")


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, int]:
    """(rows without a null or NaN in any of columns, or in any at all; how many rows that leaves out)."""
    out = df.dropna("any", subset=columns)
    return out, df.count() - out.count()


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """The sorted distinct values; more than most can't become columns."""
    out = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect())
    if len(out) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return out


def one_hot(df: DataFrame, column: str, drop_first: bool = False) -> DataFrame:
    """A 0/1 column `<column>_<level>` for each sorted level in place of column, without the first for dummy coding."""
    names = levels(df, column)[1 if drop_first else 0 :]
    return df.select(*[c for c in df.columns if c != column], *[F.when(F.col(column) == x, 1).otherwise(0).alias(f"{column}_{x}") for x in names])


def overlap(subjects: DataFrame, *others: DataFrame, key: str = "subject") -> DataFrame:
    """Subjects that every other table has, in their own order column if they have one."""
    for o in others:
        subjects = subjects.join(o.select(key).distinct(), key, "left_semi")
    return subjects


def missing(subjects: DataFrame, other: DataFrame, key: str = "subject") -> DataFrame:
    return subjects.join(other.select(key), key, "left_anti")


def align(subjects: DataFrame, table: DataFrame, key: str = "subject", check: bool = True) -> DataFrame:
    """Rows of table for each subject; a subject that table lacks is an error, unless check is False. Repeated keys multiply."""
    if check and not missing(subjects, table, key).isEmpty():
        raise KeyError("subjects without a row in the table")
    return subjects.join(table, key)


def path_template(subject: Column, template: str | Callable[..., str], contrast: str | None = None) -> Column:
    """The template with SUBJECT and CONTRAST replaced, as text and not as patterns; or what a function of subject (and contrast) returns."""
    if callable(template):
        extra = () if contrast is None else (contrast,)

        @F.arrow_udf("string")
        def paths(subjects: pa.Array) -> pa.Array:
            return pa.array([None if s is None else template(s, *extra) for s in subjects.to_pylist()], pa.string())

        return paths(subject)
    if contrast is not None:
        template = template.replace("CONTRAST", contrast)
    return F.replace(F.lit(template), F.lit("SUBJECT"), subject.cast("string"))


def rename_columns(df: DataFrame, replace: str | list[str], by: str | list[str]) -> DataFrame:
    """Columns renamed by substring. With several substrings each column takes the last that it holds, on its own name."""
    old, new = ([replace], [by]) if isinstance(replace, str) else (list(replace), [by] * len(replace) if isinstance(by, str) else list(by))
    names = {}
    for c in df.columns:
        for o, n in zip(old, new):
            if o in c:
                names[c] = c.replace(o, n)
    return df.withColumnsRenamed(names)


def rename_values(column: Column, replace: str | list[str], by: str | list[str]) -> Column:
    """Substrings of values replaced one after the other, each on the result of the one before."""
    old, new = ([replace], [by]) if isinstance(replace, str) else (list(replace), [by] * len(replace) if isinstance(by, str) else list(by))
    for o, n in zip(old, new):
        column = F.replace(column, F.lit(o), F.lit(n))
    return column


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids, name, value): repeated measures from wide to long."""
    return df.unpivot(ids, values, "name", "value")


def clean_labels(labels: DataFrame) -> DataFrame:
    """Labels (feat, label) recoded to 0, 1, ... in order, 0 always among them. Labels, not features, are ranked."""
    spark = labels.sparkSession
    known = labels.select("label").unionByName(spark.range(1).select(F.lit(0).cast(labels.schema["label"].dataType).alias("label"))).distinct()
    codes = known.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("code"))
    return labels.join(codes, "label").select("feat", F.col("code").alias("label"))


def merge_hemispheres(left: DataFrame, right: DataFrame, threshold: float = 0.75, background: list[int] = [], clean: bool = True) -> DataFrame:  # noqa: B006
    """Labels (feat, label) of both sides as one: background becomes 0; where the share of left labels that right has too exceeds
    threshold, right labels but 0 are raised by the largest left label + 1; right features follow the left ones."""
    if background:
        zero = F.when(F.col("label").isin(background), 0).otherwise(F.col("label"))
        left, right = left.withColumn("label", zero), right.withColumn("label", zero)
    both = left.select("label").distinct().join(right.select(F.col("label").alias("r")).distinct(), F.col("label") == F.col("r"), "left")
    facts = both.agg(F.count("*").alias("n"), F.count("r").alias("common"), F.max("label").alias("top"))
    size = left.agg((F.max("feat") + 1).alias("size"))
    raised = right.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(size))
    shift = (F.col("common") > 0) & (F.col("common") / F.col("n") > threshold) & (F.col("label") != 0)
    raised = raised.select((F.col("feat") + F.col("size")).alias("feat"), F.when(shift, F.col("label") + F.col("top") + 1).otherwise(F.col("label")).alias("label"))
    out = left.select("feat", "label").unionByName(raised)
    return clean_labels(out) if clean else out


def roi_series(df: DataFrame) -> DataFrame:
    """(name, value) of a table of regions: of two columns the last whose values are numbers is the value; of more, each column's mean under its name."""
    if len(df.columns) > 2:
        numbers = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        return df.agg(*[F.avg(c).alias(c) for c in numbers]).unpivot([], numbers, "name", "value")
    if len(df.columns) != 2:
        raise ValueError("a table of regions has a name and a value column")
    text = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(CAST(`{c}` AS string) AS double)").isNull()).alias(c) for c in df.columns]).first().asDict()
    fits = [c for c in df.columns if text[c] == 0]
    if not fits:
        raise ValueError("no column holds numbers")
    value = fits[-1]
    name = next(c for c in df.columns if c != value)
    return df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))


def scale_fit(long: DataFrame) -> DataFrame:
    """(feat, lo, hi): the range of each feature."""
    return long.groupBy("feat").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def scale_apply(long: DataFrame, fit: DataFrame) -> DataFrame:
    """v scaled by the fitted range of its feature to 0..1 and clipped; a feature of one value becomes 0."""
    s = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return long.join(fit, "feat").withColumn("v", F.when(F.col("v").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))).drop("lo", "hi")
