"""Split-half reliability: how well effect maps of small samples of one half agree with the map of the other half."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortix.functions import special
from cohortix.shared import placed

from .blocks import shuffle_key
from .stats import residualize


def split_half(subjects: DataFrame, seed: int = 2, stratify: str | None = None, group: str | None = None) -> DataFrame:
    """(subject, half): halves 1 and 2; in each stratum, or with groups kept whole, the first half of a shuffled order (the smaller of an odd number)."""
    unit = group or "subject"
    units = subjects.select(unit, *([stratify] if stratify else [])).distinct()
    key = shuffle_key(seed, F.lit(0), unit)
    if stratify:
        of = Window.partitionBy(stratify)
        ranked = units.withColumn("_r", F.row_number().over(of.orderBy(key, unit))).withColumn("_n", F.count("*").over(of))
    else:
        total = F.broadcast(units.agg(F.count("*").alias("_n")))
        ranked = placed(units.withColumn("_key", key), "_key", unit).withColumn("_r", F.col("place") + 1).crossJoin(total)
    halves = ranked.select(unit, *([stratify] if stratify else []), F.when(F.col("_r") <= F.floor(F.col("_n") / 2), 1).otherwise(2).alias("half"))
    keys = [unit, *([stratify] if stratify else [])]
    return subjects.join(halves, keys).select("subject", "half")


def reliability_curve(long: DataFrame, halves: DataFrame, sizes: list[int], repeats: int, seed: int = 0, threshold: float | None = None, covariates: DataFrame | None = None, names: list[str] = [], scores: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(n, repeat, r, n_feats): correlation of the base map of half 1 with that of n subjects of half 2, drawn in a shuffled order.

    Maps are Cohen's d, or correlations with scores (subject, score); features without one in either map, or with a base
    of |threshold| or less, don't count. covariates (subject, names): each half is residualized on them, once."""
    spark = long.sparkSession
    if covariates is not None:
        split = [long.join(halves.where(F.col("half") == h), "subject", "left_semi") for h in (1, 2)]
        parts = [residualize(p, covariates, names) for p in split]
        long = parts[0].unionByName(parts[1])
    effect = F.try_divide(F.avg("v"), F.stddev_pop("v"))
    if scores is not None:
        long = long.join(scores.select("subject", F.col("score").cast("double").alias("score")), "subject")
        effect = F.corr("v", "score")
    base = long.join(halves.where("half = 1"), "subject").groupBy("feat").agg(effect.alias("base"))
    draws = spark.createDataFrame([(n, r) for n in sizes for r in range(repeats)], "n int, repeat int")
    pool = halves.where("half = 2").select("subject").crossJoin(F.broadcast(draws))
    name = F.concat_ws("-", F.col("n").cast("string"), F.col("repeat").cast("string"))
    order = Window.partitionBy("n", "repeat").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("subject").cast("string"))), "subject")
    drawn = pool.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("n")).select("n", "repeat", "subject")
    maps = drawn.join(long, "subject").groupBy("n", "repeat", "feat").agg(effect.alias("d")).join(base, "feat").where("d is not null and base is not null")
    if threshold is not None:
        maps = maps.where(F.abs("base") > threshold)
    return maps.groupBy("n", "repeat").agg(F.corr("d", "base").alias("r"), F.count("*").alias("n_feats"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """(n, r, sd, p): means and population standard deviations over repeats, and the mean p of the correlations."""

    def with_p(batches):
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "r": b["r"], "p": special.pearson_p(b["r"], b["n_feats"])})

    rows = curve.mapInPandas(with_p, "n int, r double, p double")
    return rows.groupBy("n").agg(F.avg("r").alias("r"), F.stddev_pop("r").alias("sd"), F.avg("p").alias("p"))
