"""Linear mixed models, one for each feature, features in parallel: a random intercept, or one with a nested variance component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortix.functions import special


def reml(y: np.ndarray, x: np.ndarray, group: np.ndarray, nested: np.ndarray | None, ratios: tuple[float, ...]) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(-2 log restricted likelihood, effects, covariance, scale) for given ratios of variance to the residual's."""
    n, p = x.shape
    xvx, xvy, yvy, logdet = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
    for g in range(group.max() + 1):
        k = group == g
        z = np.ones((k.sum(), 1))
        d = [ratios[0]]
        if nested is not None:
            inner = (nested[k][:, None] == np.unique(nested[k])[None, :]).astype(float)
            z, d = np.concatenate((z, inner), axis=1), d + [ratios[1]] * inner.shape[1]
        d = np.array(d)
        core = np.eye(len(d)) + (z * d).T @ z
        solve = lambda m: m - (z * d) @ np.linalg.solve(core, z.T @ m)  # noqa: B023, E731
        vx, vy = solve(x[k]), solve(y[k])
        xvx += x[k].T @ vx
        xvy += x[k].T @ vy
        yvy += y[k] @ vy
        logdet += np.linalg.slogdet(core)[1]
    beta = np.linalg.solve(xvx, xvy)
    scale = max((yvy - xvy @ beta) / (n - p), 1e-300)
    return logdet + np.linalg.slogdet(xvx)[1] + (n - p) * np.log(scale), beta, scale * np.linalg.inv(xvx), scale


def fit(y: np.ndarray, x: np.ndarray, group: np.ndarray, nested: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[float], float]:
    """(effects, standard errors, variances, residual variance): a grid over log ratios, refined around the best."""
    sides = 1 if nested is None else 2
    best, centre, width = None, np.zeros(sides), 6.0
    for _ in range(9):
        steps = np.linspace(-width, width, 9)
        grid = np.array(np.meshgrid(*[steps] * sides)).reshape(sides, -1).T + centre
        for point in grid:
            value = reml(y, x, group, nested, tuple(np.exp(point)))
            if best is None or value[0] < best[0][0]:
                best = (value, point)
        centre, width = best[1], width / 3
    (_, beta, cov, scale), point = best
    return beta, np.sqrt(np.diag(cov)), [float(scale * r) for r in np.exp(point)], float(scale)


def mixed_models(long: DataFrame, fixed: list[str], random: str, nested: str | None = None) -> DataFrame:
    """(feat, effect, beta, se, z, p, group_var, scale). long: (feat, v, fixed..., random[, nested]); rows with null values go."""
    columns = ["feat", "v", *fixed, random, *([nested] if nested else [])]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(dtype=float) for c in fixed]])
        code = lambda c: np.unique(pdf[c].to_numpy(), return_inverse=True)[1]
        beta, se, variances, scale = fit(pdf["v"].to_numpy(dtype=float), x, code(random), code(nested) if nested else None)
        z = beta / se
        return pd.DataFrame({"feat": key[0], "effect": ["Intercept", *fixed], "beta": beta, "se": se, "z": z, "p": special.t_two_sided(z, np.full(len(z), 1e9)), "group_var": variances[0], "scale": scale})

    return long.select(columns).dropna().groupBy("feat").applyInPandas(lambda key, pdf: one(key, pdf), "feat int, effect string, beta double, se double, z double, p double, group_var double, scale double")
