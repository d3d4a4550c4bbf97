"""Permutation tests of a general linear model with variance groups (v statistic), family-wise corrected by the largest score.

The model: targets (subject, feat, v) on one tested variable and confounds. Targets and tested variable are residualized on
the confounds; a permutation moves the targets' residuals (Freedman and Lane). Features are scored in blocks: a task holds
one block of columns for all subjects and scores it under every permutation by matrix products, so what is shuffled is
the targets, once, and not subjects x features x permutations. Orders of all permutations are made once, on the driver,
and sent to the tasks, where they have at most MOST_DESIGN numbers; else each task makes them itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortix.functions import special
from cohortix.operators import blocks
from cohortix.shared import durable

#: Subjects and covariates are held by every task: at most so many numbers.
MOST_DESIGN = 20_000_000
#: Values of a block that are scored at once.
AT_ONCE = 1 << 19


@dataclass
class Design:
    subjects: np.ndarray
    x: np.ndarray  # tested variables without what confounds explain, a column for each
    basis: np.ndarray  # orthonormal columns that span the confounds
    group: np.ndarray  # variance groups, 0 to n - 1
    block: np.ndarray  # exchangeability blocks, a column for each level, outermost first
    residual_diagonal: np.ndarray
    flips: bool = False  # the tested variable is constant: signs flip, and nobody moves
    exchange: str = "within"  # within: members of a block; whole: blocks of equal size; nested: as the labels' signs say

    def __post_init__(self) -> None:
        n = len(self.subjects)
        self.x, self.block = self.x.reshape(n, -1), self.block.reshape(n, -1)

    def signs(self, perm: int, seed: int) -> np.ndarray:
        """+1 or -1 of each subject in a permutation, as blocks.sign_flips() gives them."""
        if perm == 0:
            return np.ones(len(self.subjects))
        return np.array([1.0 - 2.0 * (int(hashlib.md5(f"{seed}:{perm}:{s}".encode()).hexdigest()[0], 16) % 2) for s in self.subjects.tolist()])

    def order(self, perm: int, seed: int) -> np.ndarray:
        """Source of each subject in a permutation, as blocks.permute_within(), permute_whole() or permute_nested() gives it; 0 is the identity."""
        n = len(self.subjects)
        if perm == 0:
            return np.arange(n)
        if self.exchange == "nested":
            return blocks.permute_nested(self.block, seed, perm)
        label, out = self.block[:, 0], np.empty(n, dtype=np.int64)
        key = lambda x: hashlib.md5(f"{seed}:{perm}:{x}".encode()).hexdigest()
        plain = sorted(range(n), key=lambda i: (label[i], self.subjects[i]))
        if self.exchange == "within":
            keys = [key(s) for s in self.subjects.tolist()]
            out[plain] = sorted(range(n), key=lambda i: (label[i], keys[i], self.subjects[i]))
            return out
        members: dict[int, list[int]] = {}
        for i in plain:
            members.setdefault(int(label[i]), []).append(i)
        sizes: dict[int, list[int]] = {}
        for b, ms in members.items():
            sizes.setdefault(len(ms), []).append(b)
        for same in sizes.values():
            for to, source in zip(same, sorted(same, key=lambda b: (key(b), b))):
                out[members[to]] = members[source]
        return out

    def orders(self, n_perm: int, seed: int) -> np.ndarray | None:
        """Signs or sources in all permutations, a row for each; None where they are too many for one task."""
        if (n_perm + 1) * len(self.subjects) > MOST_DESIGN:
            return None
        return np.stack([self.signs(p, seed).astype(np.int8) if self.flips else self.order(p, seed).astype(np.int32) for p in range(n_perm + 1)])


def thin_basis(z: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the span of z, without directions of no length."""
    if not z.size:
        return np.zeros((len(z), 0))
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    return u[:, s > s.max() * max(z.shape) * np.finfo(float).eps] if s.max() > 0 else u[:, :0]


def design(subjects: DataFrame, tested: str | list[str], confounds: list[str], group: str | None, block: str | list[str], intercept: bool = True, exchange: str = "within", least: int = 1) -> Design:
    """Collects the model's columns, whose size is checked, and splits tested variables and confounds.

    Without group, subjects that can change places are a variance group; subjects of groups of fewer than least are left out."""
    tested, block = [tested] if isinstance(tested, str) else tested, [block] if isinstance(block, str) else block
    width = 3 + len(confounds) + len(tested) + len(block)
    columns = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(tested)] + [F.col(c).cast("double").alias(f"_z{k}") for k, c in enumerate(confounds)]
    labels = [F.col(c).alias(f"_b{k}") for k, c in enumerate(block)] + ([F.col(group).alias("_g")] if group else [])
    rows = subjects.select("subject", *columns, *labels).limit(MOST_DESIGN // width + 1).collect()
    if len(rows) * width > MOST_DESIGN:
        raise ValueError("the design is too large for one task")
    rows.sort(key=lambda r: r["subject"])
    code = lambda c: np.unique(np.array([r[c] for r in rows]), return_inverse=True)[1]
    label = np.array([[r[f"_b{k}"] for k in range(len(block))] for r in rows], dtype=np.int64) if exchange == "nested" else np.stack([code(f"_b{k}") if exchange == "within" else np.array([r[f"_b{k}"] for r in rows], dtype=np.int64) for k in range(len(block))], axis=1)
    vg = code("_g") if group else automatic_groups(label, exchange)
    keep = np.bincount(vg)[vg] >= least
    rows, label, vg = [r for r, k in zip(rows, keep) if k], label[keep], np.unique(vg[keep], return_inverse=True)[1]
    z = np.array([[r[f"_z{k}"] for k in range(len(confounds))] for r in rows], dtype=float).reshape(len(rows), len(confounds))
    x = np.array([[r[f"_x{k}"] for k in range(len(tested))] for r in rows], dtype=float).reshape(len(rows), len(tested))
    if np.isnan(x).any() or np.isnan(z).any():
        raise ValueError("the design has missing values")
    flips = len(tested) == 1 and len(set(x[:, 0].tolist())) == 1
    if intercept and not flips:
        z = np.concatenate((np.ones((len(rows), 1)), z), axis=1)
    basis = thin_basis(z)
    x = x - basis @ (basis.T @ x)
    both = thin_basis(x)
    diagonal = 1 - (basis**2).sum(axis=1) - (both**2).sum(axis=1)
    return Design(np.array([r["subject"] for r in rows]), x, basis, vg, label, diagonal, flips, exchange)


def automatic_groups(label: np.ndarray, exchange: str) -> np.ndarray:
    """Variance groups: sets of subjects that can change places."""
    if exchange == "nested":
        return blocks.variance_groups_nested(label)
    block = np.unique(label[:, 0], return_inverse=True)[1]
    if exchange == "within":
        return block
    order = np.argsort(block, kind="stable")
    place = np.empty(len(block), dtype=np.int64)
    size = np.bincount(block)
    place[order] = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    return np.unique(np.stack((size[block], place), axis=1), axis=0, return_inverse=True)[1].ravel()


def v_scores(y: np.ndarray, d: Design) -> tuple[np.ndarray, np.ndarray]:
    """(v, df) of the first tested variable in each column of y, subjects x features, residuals of the confounds moved or not.

    v is the slope over the root of its variance, in which each group's residual precision weighs its subjects."""
    y = y - d.basis @ (d.basis.T @ y)
    slope = np.linalg.lstsq(d.x, y, rcond=None)[0]
    rest = y - d.x @ slope
    n = d.group.max() + 1
    sums = np.zeros((n, y.shape[1]))
    np.add.at(sums, d.group, rest * rest)
    free = np.bincount(d.group, weights=d.residual_diagonal, minlength=n)
    products = np.stack([d.x[d.group == g].T @ d.x[d.group == g] for g in range(n)])
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = free[:, None] / sums
        if d.x.shape[1] == 1:
            v = slope[0] * np.sqrt((weight * products[:, 0]).sum(axis=0))
        else:
            gram = np.einsum("gf,gij->fij", weight, products)
            v = slope[0] / np.sqrt(np.linalg.pinv(gram)[:, 0, 0])
        size = weight * np.bincount(d.group, minlength=n)[:, None]
        df = (1 / 3) / ((1 - size / size.sum(axis=0)) ** 2 / free[:, None]).sum(axis=0)
    return v, df


def t_scores(y: np.ndarray, d: Design) -> tuple[np.ndarray, np.ndarray]:
    """(t, df) of the first tested variable in each column of y: ordinary least squares, one variance for all."""
    y = y - d.basis @ (d.basis.T @ y)
    slope = np.linalg.lstsq(d.x, y, rcond=None)[0]
    rest = y - d.x @ slope
    df = len(y) - d.basis.shape[1] - d.x.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return slope[0] / np.sqrt((rest * rest).sum(axis=0) / df * np.linalg.pinv(d.x.T @ d.x)[0, 0]), np.full(y.shape[1], float(df))


def missing_values(long: DataFrame, subjects: DataFrame) -> DataFrame:
    """(feat, n_missing) of the features that lack a value, or have null or NaN, for some of subjects; what scored() refuses."""
    known = long.join(subjects.select("subject"), "subject", "left_semi").where("v is not null and not isnan(v)").groupBy("feat").agg(F.count("*").alias("_n"))
    total = F.broadcast(subjects.agg(F.count("*").alias("_all")))
    counts = long.select("feat").distinct().join(known, "feat", "left").crossJoin(total)
    return counts.select("feat", (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("n_missing")).where("n_missing > 0")


def scored(long: DataFrame, d: Design, n_perm: int, seed: int = 0, use_z: bool = False, most_values: int = 4_000_000, statistic: str = "v") -> DataFrame:
    """(perm, feat, v) of every feature, observed (perm 0) and permuted; statistic v or t; use_z: as normal scores.

    A block of features holds most_values values at most, 8 bytes each, which arrive in batches and are scored AT_ONCE at a time, so
    that a task's memory is that of the block, not several times it. A feature without a value for each subject of the design is an
    error, as a missing target can't be permuted."""
    kind = {"v": v_scores, "t": t_scores}[statistic]
    spark = long.sparkSession
    orders = d.orders(n_perm, seed)
    sent = spark.sparkContext.broadcast((d, orders))

    width = max(1, min(4096, most_values // max(1, len(d.subjects))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, orders = sent.value
        y, first, seen = np.full((width, len(d.subjects)), np.nan), 0, np.zeros(width, dtype=bool)
        for b in batches:  # d.subjects are sorted, and hold all of these
            feat, v = b.column("feat").to_numpy(), b.column("v").to_numpy(zero_copy_only=False)
            if len(feat):
                first = int(feat[0]) // width * width
                y[feat - first, np.searchsorted(d.subjects, b.column("subject").to_numpy())] = v
                seen[feat - first] = True
        columns = np.flatnonzero(seen)
        bad = [int(k) for k in columns if np.isnan(y[k]).any()]
        if bad:
            raise ValueError(f"feature {first + bad[0]} has missing values; drop these subjects or features first")
        step = max(1, AT_ONCE // max(1, len(d.subjects)))
        parts = [columns[i : i + step] for i in range(0, len(columns), step)]
        for part in parts:
            y[part] -= (d.basis @ (d.basis.T @ y[part].T)).T
        for p in range(n_perm + 1):
            o = orders[p] if orders is not None else d.signs(p, seed) if d.flips else d.order(p, seed)
            for part in parts:
                rest = y[part].T
                v, df = kind(rest * o[:, None] if d.flips else rest[o], d)
                v = np.asarray(special.g_to_z(v, df) if use_z else v, dtype=float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, dtype=np.int32)), pa.array((first + part).astype(np.int32)), pa.array(v, from_pandas=True)], ["perm", "feat", "v"])

    known = F.broadcast(spark.createDataFrame([(int(s),) for s in d.subjects], "subject bigint"))  # bounded with the design
    rows = long.join(known, "subject", "left_semi").select("subject", "feat", F.col("v").cast("double").alias("v"), F.floor(F.col("feat") / width).alias("_block"))
    return rows.groupBy("_block").applyInArrow(score, "perm int, feat int, v double")


def null_maxima(scores: DataFrame, two_sided: bool = True) -> DataFrame:
    """(perm, vmax): the largest (absolute) score of each permutation, null and NaN aside."""
    v = F.abs("v") if two_sided else F.col("v")
    return scores.where("perm > 0").groupBy("perm").agg(F.max(F.when(~F.isnan(v), v)).alias("vmax"))


def corrected_p(scores: DataFrame, maxima: DataFrame, n_perm: int, two_sided: bool = True) -> DataFrame:
    """(feat, v, p): p from the number of permutations whose largest score is below the feature's."""
    observed = scores.where("perm = 0").select("feat", "v")
    v = F.abs("v") if two_sided else F.col("v")
    sorted_max = maxima.agg(F.array_sort(F.collect_list("vmax")).alias("_null"))  # n_perm numbers
    below = F.size(F.filter("_null", lambda m: m < v))
    return observed.crossJoin(F.broadcast(sorted_max)).select("feat", "v", ((n_perm + 1 - below) / F.lit(float(n_perm + 1))).alias("p"))


def permuted_v(long: DataFrame, subjects: DataFrame, tested: str | list[str], confounds: list[str], group: str | None, block: str | list[str], n_perm: int = 100, seed: int = 0, use_z: bool = False, two_sided: bool = True, exchange: str = "within", least: int = 1) -> DataFrame:
    """(feat, v, p) of the whole test; exchange, group and least as in design(). Scores are written to the shared folder once."""
    d = design(subjects, tested, confounds, group, block, exchange=exchange, least=least)
    scores = durable(scored(long, d, n_perm, seed, use_z))
    return corrected_p(scores, null_maxima(scores, two_sided), n_perm, two_sided)


def freedman_lane(long: DataFrame, moves: DataFrame) -> DataFrame:
    """(perm, subject, feat, v): means kept, deviations moved; the intercept is the only confound. A plain join, for small cases."""
    means = long.groupBy("feat").agg(F.avg("v").alias("_mean"))
    rest = long.join(means, "feat").select(F.col("subject").alias("src"), "feat", (F.col("v") - F.col("_mean")).alias("_r"), "_mean")
    return moves.join(rest, "src").select("perm", F.col("dst").alias("subject"), "feat", (F.col("_r") + F.col("_mean")).alias("v"))


def v_statistic(long: DataFrame, subjects: DataFrame, tested: str, group: str) -> DataFrame:
    """(feat, v) with the intercept as only confound, as joins and aggregates."""
    n_and_mean = subjects.agg(F.count("*").alias("n"), F.avg(tested).alias("xm"))
    x = subjects.crossJoin(F.broadcast(n_and_mean)).select("subject", F.col(group).alias("g"), (F.col(tested) - F.col("xm")).alias("x"), "n")
    total = x.agg(F.sum(F.col("x") * F.col("x")).alias("sxx"))
    x = x.crossJoin(F.broadcast(total))
    means = long.groupBy("feat").agg(F.avg("v").alias("_ym"))
    rows = long.join(means, "feat").join(x, "subject").withColumn("y", F.col("v") - F.col("_ym"))
    slopes = rows.groupBy("feat").agg((F.sum(F.col("x") * F.col("y")) / F.max("sxx")).alias("slope"))
    rest = rows.join(slopes, "feat")
    e = F.col("y") - F.col("slope") * F.col("x")
    by_group = rest.groupBy("feat", "g").agg(F.max("slope").alias("slope"), F.sum(1 - F.lit(1.0) / F.col("n") - F.col("x") * F.col("x") / F.col("sxx")).alias("free"), F.sum(e * e).alias("ss"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    return by_group.groupBy("feat").agg((F.max("slope") * F.sqrt(F.sum(F.col("free") / F.col("ss") * F.col("xx")))).alias("v"))
