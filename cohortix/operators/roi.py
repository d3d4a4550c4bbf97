"""Regions: hard labels and soft maps over features, and the way back to features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortix.shared import placed

REDUCERS = {
    "mean": F.avg,
    "median": F.median,
    "sum": F.sum,
    "min": F.min,
    "minimum": F.min,
    "max": F.max,
    "maximum": F.max,
    "std": F.stddev_pop,
    "standard_deviation": F.stddev_pop,
    "var": F.var_pop,
    "variance": F.var_pop,
}


def labelled(long: DataFrame, labels: DataFrame, background: list[int] = [0], exclude: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """long with the label of each feature, without background; exclude (feat, m): features with m = 1 are left out."""
    kept = labels.where(~F.col("label").isin(background)) if background else labels
    if exclude is not None:
        if exclude.count() != labels.count():
            raise ValueError("the mask and the labels differ in length")
        kept = kept.join(exclude.where("m = 1"), "feat", "left_anti")
    return long.join(kept, "feat")


def regions(long: DataFrame, labels: DataFrame, how: str | Column | Callable = "mean", background: list[int] = [0], exclude: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(subject, label, value): each region reduced, by name, by an aggregate expression of v, or by a function of a region's values as an array.

    A function gets the values of one subject's region in the order of its features, null as NaN; these meet in one task."""
    if isinstance(how, str) and how not in REDUCERS:
        raise ValueError(f"unknown reducer {how!r}")
    if callable(how) and not isinstance(how, Column):

        @F.arrow_udf("double")
        def reduced(values: pa.Array) -> pa.Array:
            return pa.array([float(how(np.array(x, dtype=float))) for x in values.to_pylist()], pa.float64())

        rows = labelled(long, labels, background, exclude).groupBy("subject", "label").agg(F.array_sort(F.collect_list(F.struct("feat", "v"))).alias("_v"))
        return rows.select("subject", "label", reduced(F.transform("_v", lambda x: x.v)).alias("value"))
    value = REDUCERS[how](F.col("v")) if isinstance(how, str) else how
    return labelled(long, labels, background, exclude).groupBy("subject", "label").agg(value.alias("value"))


def to_features(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, feat, v): every feature with its region's value, 0 where its label has none."""
    subjects = values.select("subject").distinct()
    full = subjects.crossJoin(labels)
    return full.join(values, ["subject", "label"], "left").select("subject", "feat", F.coalesce("value", F.lit(0.0)).alias("v"))


def index_map(labels: DataFrame, background: list[int] = [0]) -> DataFrame:  # noqa: B006
    """(label, roi): the place of each label among the sorted ones without background."""
    known = labels.where(~F.col("label").isin(background)).select("label").distinct()
    return placed(known, "label").select("label", F.col("place").alias("roi"))


def maps_average(long: DataFrame, maps: DataFrame) -> DataFrame:
    """(subject, map, value): weighted means by soft maps (feat, map, w); maps without weight are left out."""
    both = long.join(maps.where("w <> 0"), "feat")
    return both.groupBy("subject", "map").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("value")).where("value is not null")


def pseudo_inverse(maps: DataFrame, most: int = 4_000_000) -> DataFrame:
    """(feat, map, w) of the transposed pseudo-inverse of a maps matrix of bounded size."""
    rows = maps.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} map weights")
    feats, names = sorted({r["feat"] for r in rows}), sorted({r["map"] for r in rows})
    at, to = {f: i for i, f in enumerate(feats)}, {m: i for i, m in enumerate(names)}
    w = np.zeros((len(feats), len(names)))
    for r in rows:
        w[at[r["feat"]], to[r["map"]]] = r["w"]
    p = np.linalg.pinv(w)
    return maps.sparkSession.createDataFrame([(f, m, float(p[to[m], at[f]])) for f in feats for m in names], maps.select("feat", "map", "w").schema)


def maps_least_squares(long: DataFrame, maps: DataFrame) -> DataFrame:
    """(subject, map, value): the coefficients of the maps that fit each subject best, of least norm."""
    return long.join(pseudo_inverse(maps), "feat").groupBy("subject", "map").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def maps_inverse(values: DataFrame, maps: DataFrame) -> DataFrame:
    """(subject, feat, v): coefficients times maps."""
    return values.join(maps, "map").groupBy("subject", "feat").agg(F.sum(F.col("value") * F.col("w")).alias("v"))


def soft_regions(long: DataFrame, maps: DataFrame, how: str = "auto") -> DataFrame:
    """Average where all weights are at least 0, else least squares, unless said."""
    if how == "auto":
        how = "ls" if not maps.where("w < 0").isEmpty() else "average"
    return maps_average(long, maps) if how == "average" else maps_least_squares(long, maps)


def project(weights: DataFrame, importance: DataFrame) -> DataFrame:
    """(voxel, value): each region's value spread over its voxels by their share of the region's weight.

    weights: (voxel, roi, w); importance: (roi, fi)."""
    total = weights.groupBy("roi").agg(F.sum("w").alias("total")).join(importance, "roi")
    return weights.join(total, "roi").groupBy("voxel").agg(F.sum(F.col("w") * F.col("fi") / F.nullif(F.col("total"), F.lit(0.0))).alias("value"))
