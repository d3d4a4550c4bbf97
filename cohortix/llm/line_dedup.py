"""Operator 4: line deduplication by overlapping three-line windows. DataFrame functions only.

Three consecutive lines that are not blank make a window; lines are compared without blanks at their ends. A window that
occurs more than once in the corpus stays where it occurs first, by (doc_id, place). Later occurrences cover the lines
from their first to their last; the covered lines of a document are merged into ranges and cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, spread_join

LINES = 3
BLANKS = " \t\r"


def windows(lines: Column, size: int = LINES) -> Column:
    """Array of (h1, h2, first, last): a 128-bit hash of each window and the places of its first and last line."""
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    hashed = F.transform(F.filter(marked, lambda s: s.t != ""), lambda s: F.struct(s.i.alias("i"), F.xxhash64(s.t).alias("a"), F.xxhash64(s.t, F.lit("second")).alias("b")))

    def made(s: Column) -> Column:
        n = F.size(s) - (size - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        line = lambda i, k: F.get(s, i + k)
        return F.transform(
            at,
            lambda i: F.struct(
                F.xxhash64(*[line(i, k).a for k in range(size)]).alias("h1"),
                F.xxhash64(*[line(i, k).b for k in range(size)]).alias("h2"),
                line(i, 0).i.alias("first"),
                line(i, size - 1).i.alias("last"),
            ),
        )

    return F.element_at(F.transform(F.array(hashed), made), 1)


def line_dedup(documents: DataFrame, size: int = LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with their deduplicated text in place of text, and n_lines and n_removed.

    A document without size lines that are not blank has no window and stays as it is, as do those with null text (null)
    or null id (it has no place in the order). Rows with equal id and text are one document and get equal results. A
    document all of whose lines are covered gets an empty text. A hot window is pre-aggregated before the shuffle, and
    the join that finds its later occurrences can be split."""
    lines = F.split(F.col(text), "\n")
    key = F.xxhash64(F.col(text))
    own_id, own_key, own_cut = (free_name(documents, c) for c in ("id_of_line", "key_of_line", "cut_of_line"))
    found = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), key.alias("_key"), F.explode(windows(lines, size)).alias("w")).select("_id", "_key", "w.*")
    place = F.struct("_id", "_key", "first")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("_where"), F.max(place).alias("_last")).where("_where <> _last").drop("_last")
    later = spread_join(found, firsts, ["h1", "h2"]).where(place != F.col("_where")).select("_id", "_key", "first", "last").distinct()
    order = Window.partitionBy("_id", "_key").orderBy("first")
    ranges = later.withColumn("_new", F.when(F.col("first") <= F.lag("last").over(order), 0).otherwise(1)).withColumn("_range", F.sum("_new").over(order))
    ranges = ranges.groupBy("_id", "_key", "_range").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ranges = ranges.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_cut"))
    ranges = ranges.select(F.col("_id").alias(own_id), F.col("_key").alias(own_key), F.col("_cut").alias(own_cut))
    out = documents.withColumn(own_id, F.col(doc_id)).withColumn(own_key, key).join(ranges, [own_id, own_key], "left")
    cut = F.col(own_cut)
    kept = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["last"] + 1)).alias("a"),
        F.concat(F.transform(cut, lambda r: r["first"]), F.array(F.size(lines))).alias("b"),
    )
    left = F.flatten(F.transform(kept, lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])))
    removed = F.aggregate(cut, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_removed": F.coalesce(removed, F.lit(0)).cast("long"),
            text: F.when(cut.isNull(), F.col(text)).otherwise(F.array_join(left, "\n")),
        }
    ).drop(own_id, own_key, own_cut)
