"""Decompositions of cohort matrices: SVD, multi-subject PCA, group ICA, dictionary learning, explained variance.

Each subject is reduced in its own task; the stacked reductions, components x subjects rows, are decomposed in one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortix.operators import networks, roi

#: Entries of the stacked reductions that one task decomposes at most.
MOST_ENTRIES = 100_000_000


def fast_svd(x: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k singular triples: in full for up to 500 rows or columns, by random projection where k is small, signs by the largest entry of u."""
    if max(x.shape) <= 500 or not 1 <= k < 0.8 * min(x.shape):
        u, s, v = np.linalg.svd(x, full_matrices=False)
    else:
        q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 10, min(x.shape)))))[0]
        for _ in range(4):
            q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
        u, s, v = np.linalg.svd(q.T @ x, full_matrices=False)
        u = q @ u
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return (u * sign)[:, :k], s[:k], (v * sign[:, None])[:k]


def gram_eigen(long: DataFrame, k: int, centre: bool = True) -> DataFrame:
    """(component, value, ratio): the largest eigenvalues of the features' covariance, and their shares of all variance.

    The features' products are summed by pair, MOST_ENTRIES pairs at most, and decomposed on the driver. All features need
    a value of every subject."""
    features = long.select("feat").distinct().limit(int((2 * MOST_ENTRIES) ** 0.5) + 1).count()
    if features * (features + 1) // 2 > MOST_ENTRIES:
        raise ValueError("too many features for one task")
    rows = networks.pair_sums(long, diagonal=True).toPandas()
    feats, n = np.unique(rows["i"]), rows["n"].max() if len(rows) else 0
    if len(rows) != len(feats) * (len(feats) + 1) // 2 or (rows["n"] != n).any():
        raise ValueError("values are missing")
    i, j = np.searchsorted(feats, rows["i"]), np.searchsorted(feats, rows["j"])
    c = np.zeros((len(feats), len(feats)))
    xy, x, y = (rows[k].to_numpy() for k in ("xy", "x", "y"))
    c[i, j] = c[j, i] = (xy - x * y / n) / (n - 1) if centre else xy / n
    w = np.linalg.eigvalsh(c)[::-1]
    rows = [(i, float(x), float(x / w.sum())) for i, x in enumerate(w[:k])]
    return long.sparkSession.createDataFrame(rows, "component int, value double, ratio double")


def reduced(x: np.ndarray, ratio: float | str | None, k: int, seed: int = 0) -> np.ndarray:
    """U' S of one subject's image, time x features: as many rows as asked for, all for None, k for auto."""
    rows = len(x) if ratio is None else min(k, len(x)) if ratio == "auto" else max(1, int(round(ratio * len(x))))
    u, s, _ = fast_svd(x.T, rows, seed)
    return u.T * s[:, None]


def stacked(images: DataFrame, k: int, ratio: float | str | None = "auto", seed: int = 0) -> np.ndarray:
    """Reductions of all subjects (subject, t, data array) under one another, in the order of subject."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = reduced(np.stack(pdf.sort_values("t")["data"].map(np.asarray)).astype(float), ratio, k, seed)
        return pd.DataFrame({"subject": key[0], "row": range(len(r)), "data": r.tolist()})

    rows = images.groupBy("subject").applyInPandas(lambda key, pdf: one(key, pdf), "subject long, row int, data array<double>").orderBy("subject", "row").collect()
    m = np.array([r["data"] for r in rows])
    if m.size > MOST_ENTRIES:
        raise ValueError("reductions too large for one task; lower the reduction ratio")
    return m


def multi_pca(m: np.ndarray, k: int, cca: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(components, variances) of stacked reductions; cca: rows to unit length first, those of no length as they are."""
    size = np.linalg.norm(m, axis=1)
    size[size == 0] = 1
    u, s, v = fast_svd((m / size[:, None] if cca else m).T, k, seed)
    return u.T, s**2


def fast_ica(x: np.ndarray, seed: int, turns: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Independent rows of whitened x (components x features), all at once, with the cube as contrast."""
    x = x - x.mean(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    z = (u / np.where(s > 1e-12, s, 1)).T @ x * np.sqrt(x.shape[1])
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(z), len(z))))[0]
    for _ in range(turns):
        y = w @ z
        new = (y**3) @ z.T / z.shape[1] - 3 * np.diag((y**2).mean(axis=1)) @ w
        a, _, b = np.linalg.svd(new, full_matrices=False)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < tolerance
        w = new
        if done:
            break
    return w @ z


def can_ica(m: np.ndarray, k: int, threshold: float | str | None = "auto", n_init: int = 10, seed: int = 0) -> np.ndarray:
    """Of n_init runs that with the least largest L1 norm of its unit rows; small entries are zeroed to a share of 1 / k (auto), peaks made positive."""
    parts, _ = multi_pca(m, k, seed=seed)
    best = None
    for i in range(n_init):
        y = fast_ica(parts, seed + i)
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        score = np.abs(y).sum(axis=1).max()
        if best is None or score < best[0]:
            best = (score, y)
    y = best[1]
    if threshold is not None:
        ratio = 1.0 if threshold == "auto" else float(threshold)
        y = np.where(np.abs(y) >= np.percentile(np.abs(y), max(0.0, 100 - 100 / k * ratio)), y, 0)
    flip = np.sign(y[np.arange(len(y)), np.abs(y).argmax(axis=1)])
    return y * np.where(flip == 0, 1, flip)[:, None]


def dictionary(m: np.ndarray, k: int, alpha: float = 10.0, epochs: int = 1, batch: int = 20, seed: int = 0) -> np.ndarray:
    """Sparse unit rows: loadings of an ICA start, then codes by coordinate descent and dictionary updates over batches of features."""
    start = can_ica(m, k, None, 1, seed)
    d = m @ start.T @ np.linalg.inv(start @ start.T + 1e-8 * np.eye(k))
    d /= np.maximum(np.linalg.norm(d, axis=0), 1e-12)
    a, b = np.zeros((k, k)), np.zeros((len(m), k))
    order = np.random.default_rng(seed).permutation(m.shape[1])

    def codes(x: np.ndarray) -> np.ndarray:
        g, h, c = d.T @ d, d.T @ x, np.zeros((k, x.shape[1]))
        penalty = alpha * np.abs(h).max() / 100
        for _ in range(50):
            for j in range(k):
                r = h[j] - g[j] @ c + g[j, j] * c[j]
                c[j] = np.sign(r) * np.maximum(np.abs(r) - penalty, 0) / max(g[j, j], 1e-12)
        return c

    for _ in range(epochs):
        for i in range(0, len(order), batch):
            x = m[:, order[i : i + batch]]
            c = codes(x)
            a, b = a + c @ c.T, b + x @ c.T
            for j in range(k):
                if a[j, j] > 1e-12:
                    d[:, j] += (b[:, j] - d @ a[:, j]) / a[j, j]
                    d[:, j] /= max(np.linalg.norm(d[:, j]), 1.0)
    c = codes(m)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    flip = np.where((c > 0).sum(axis=1) < (c < 0).sum(axis=1), -1, 1)
    return c * flip[:, None]


def explained_variance(long: DataFrame, components: DataFrame) -> DataFrame:
    """(component, ev): the share of all values' variance that goes when each component (component, feat, w) alone is fitted by least squares, 0 at least."""
    both = long.join(components, "feat")
    load = both.groupBy("subject", "component").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("b"))
    rest = both.join(load, ["subject", "component"]).withColumn("e", F.col("v") - F.coalesce("b", F.lit(0.0)) * F.col("w"))
    return rest.groupBy("component").agg(F.greatest(F.lit(0.0), 1 - F.var_pop("e") / F.nullif(F.var_pop("v"), F.lit(0.0))).alias("ev"))


def loadings(long: DataFrame, components: DataFrame) -> DataFrame:
    """(subject, component, b): each subject's least-squares loadings on all components (component, feat, w) together."""
    maps = components.select("feat", F.col("component").alias("map"), "w")
    return roi.maps_least_squares(long, maps).select("subject", F.col("map").alias("component"), F.col("value").alias("b"))


def joint_explained_variance(long: DataFrame, components: DataFrame) -> DataFrame:
    """(ev): the share of all values' variance that goes when all components are fitted together, 0 at least."""
    fitted = loadings(long, components).join(components, "component").groupBy("subject", "feat").agg(F.sum(F.col("b") * F.col("w")).alias("_f"))
    rest = long.join(fitted, ["subject", "feat"]).withColumn("e", F.col("v") - F.col("_f"))
    return rest.agg(F.greatest(F.lit(0.0), 1 - F.var_pop("e") / F.nullif(F.var_pop("v"), F.lit(0.0))).alias("ev"))
