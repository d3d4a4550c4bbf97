"""Mass-univariate statistics over (subject, feat, v): effect sizes, residuals, correlations, t, false discovery, orthogonal regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortix.functions import special
from cohortix.shared import durable


def cohens_d(long: DataFrame) -> DataFrame:
    """(feat, d): mean over population standard deviation; null where that is 0."""
    return long.groupBy("feat").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s")).select("feat", F.try_divide("_m", "_s").alias("d"))


def residualize(long: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """v less what the covariates explain of it, the intercept kept: least squares with intercept for each feature.

    Rows with a null covariate or value don't count in the fit, and a null value stays null; a feature with one value or
    none becomes null. One aggregate by feature of sums (partial on each task), small systems solved in the rows of the
    result, and a join back."""
    both = long.join(covariates.select("subject", *names), "subject")
    ok = F.col("v").isNotNull()
    for c in names:
        ok &= F.col(c).isNotNull()
    use = lambda x: F.when(ok, x)
    x = [F.col(c).cast("double") for c in names]
    sums = [F.count(use(F.lit(1))).alias("n"), F.sum(use(F.col("v"))).alias("sv"), *[F.sum(use(c)).alias(f"s{i}") for i, c in enumerate(x)]]
    sums += [F.sum(use(c * F.col("v"))).alias(f"v{i}") for i, c in enumerate(x)]
    sums += [F.sum(use(x[i] * x[j])).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    facts = both.groupBy("feat").agg(*sums)
    centred = lambda s, a, b: F.col(s) - F.col(a) * F.col(b) / F.col("n")
    if len(names) == 1:
        beta = F.array(F.coalesce(F.try_divide(centred("v0", "s0", "sv"), centred("s0_0", "s0", "s0")), F.lit(0.0)))
    else:
        gram = F.array(*[centred(f"s{min(i, j)}_{max(i, j)}", f"s{i}", f"s{j}") for i in range(len(x)) for j in range(len(x))])
        beta = solved(gram, F.array(*[centred(f"v{i}", f"s{i}", "sv") for i in range(len(x))]))
    fitted = facts.where("n > 1").select("feat", beta.alias("_beta"))
    back = both.join(fitted, "feat", "left")
    explained = sum((F.get("_beta", i) * c for i, c in enumerate(x)), F.lit(0.0))
    return back.withColumn("v", F.when(F.col("_beta").isNotNull(), F.col("v") - explained)).drop("_beta", *names)


def solved(gram: Column, right: Column) -> Column:
    """Least-squares solutions of the small symmetric systems in two array columns."""

    @F.arrow_udf("array<double>")
    def solve(g: pa.Array, r: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(g.to_pylist(), r.to_pylist()):
            if a is None or None in a or None in b:
                out.append(None)
            else:
                out.append(np.linalg.lstsq(np.array(a).reshape(len(b), len(b)), np.array(b), rcond=None)[0].tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return solve(gram, right)


def correlate(long: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """(feat, r): Pearson correlation of each feature with the subjects' score."""
    return long.join(scores.select("subject", F.col(score).cast("double").alias("_p")), "subject").groupBy("feat").agg(F.corr("v", "_p").alias("r"))


def t_one_sample(long: DataFrame, mean: float = 0.0) -> DataFrame:
    """(feat, n, t) against mean; null values don't count."""
    facts = long.groupBy("feat").agg(F.count("v").alias("n"), F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    return facts.select("feat", "n", F.try_divide(F.col("_m") - mean, F.col("_s") / F.sqrt("n")).alias("t"))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""

    @F.arrow_udf("double")
    def p(t: pa.Array, df: pa.Array) -> pa.Array:
        x, n = t.to_numpy(zero_copy_only=False).astype(float), df.to_numpy(zero_copy_only=False).astype(float)
        return pa.array(special.t_two_sided(x, n), pa.float64(), from_pandas=True)

    return p(t.cast("double"), df.cast("double"))


def fdr(df: DataFrame, p: str = "p", q: str = "q", *by: str) -> DataFrame:
    """Benjamini-Hochberg q of each row's p: the least p m / rank among those no better, 1 at most; null p has null q, and doesn't count.

    Equal p of a group have one q, that of the last rank, so distinct ones alone are ranked: in ranges of (by, p) side by side,
    each of which takes the ranks before and the least after it from one row for each range and group. Every window runs
    from its start on, as one towards the end takes the square of its rows."""
    rows = durable(df)  # q is joined by p, which has to be the same number both times
    known = F.col(p).isNotNull()
    counts = rows.where(known).groupBy(*by, p).agg(F.count("*").alias("_c"))
    ranged = durable(counts.repartitionByRange(*by, p).withColumn("_part", F.spark_partition_id()))
    of, start = Window.partitionBy(*by), Window.unboundedPreceding
    sizes = ranged.groupBy("_part", *by).agg(F.sum("_c").alias("_n"))
    sizes = sizes.select("_part", *by, F.sum("_n").over(of).alias("_m"), (F.sum("_n").over(of.orderBy("_part").rowsBetween(start, Window.currentRow)) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_part", *by)
    ranked = same_group(ranged, sizes, "_part", *by).withColumn("_rank", F.col("_before") + F.sum("_c").over(inside.orderBy(p).rowsBetween(start, Window.currentRow)))
    ranked = ranked.select("_part", *by, p, (F.col(p) * F.col("_m") / F.col("_rank")).alias("_r"))
    after = ranked.groupBy("_part", *by).agg(F.min("_r").alias("_r"))
    after = after.select("_part", *by, F.min("_r").over(of.orderBy(F.desc("_part")).rowsBetween(start, -1)).alias("_after"))
    least = F.min("_r").over(inside.orderBy(F.desc(p)).rowsBetween(start, Window.currentRow))
    values = same_group(ranked.withColumn("_least", least), after, "_part", *by).select(*by, p, F.least("_least", "_after", F.lit(1.0)).alias(q))
    out = same_group(rows.where(known), values, *by, p)
    return out.select(*df.columns, q).unionByName(rows.where(~known).select(*df.columns, F.lit(None).cast("double").alias(q)))


def same_group(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left with the further columns of right's row of the same keys; null is a key as any other."""
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"_on_{k}" for k in keys])


def one_sample_summary(long: DataFrame, covariates: DataFrame, names: list[str], mean: float = 0.0, mask: DataFrame | None = None) -> DataFrame:
    """(feat, n, t, p, q, d) of the residuals; with a mask, over all its features, 0 outside."""
    rest = residualize(long, covariates, names) if names else long
    out = t_one_sample(rest, mean).join(cohens_d(rest), "feat")
    out = fdr(out.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1)), "p", "q").select("feat", "n", "t", "p", "q", "d")
    if mask is None:
        return out
    return mask.select("feat").join(out, "feat", "left").na.fill(0.0)


#: Pairs of features, with what is known of them, that are sent to all tasks at most, and cells of their matrix for each of them.
MOST_PAIRS, SPARSE = 1_000_000, 8


def paired(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """(subject, i, j, x, y, further columns of pairs): both features' values of each subject, for each pair (i, j).

    A subject's values are gathered once, and meet one another and the pairs, which are sent, in one task: what is shuffled
    is the values, and not subjects x pairs. Pairs that are more than MOST_PAIRS or few of all those of their features
    are joined in shuffles."""
    pairs = durable(pairs)
    ends = pairs.select("i").union(pairs.select("j")).distinct()
    n = pairs.count()
    if n > MOST_PAIRS or ends.count() ** 2 > SPARSE * n:
        x, y = (long.select("subject", F.col("feat").alias(a), F.col("v").alias(b)) for a, b in ("ix", "jy"))
        return x.join(pairs, "i").join(y, ["subject", "j"])
    rows = long.where("subject is not null").join(F.broadcast(ends.select(F.col("i").alias("feat"))), "feat", "left_semi")
    both = rows.groupBy("subject").agg(F.collect_list(F.struct("feat", "v")).alias("_all"))
    for a, b in ("ix", "jy"):
        both = both.withColumn("_one", F.explode("_all")).withColumns({a: F.col("_one.feat"), b: F.col("_one.v")}).drop("_one")
    return both.drop("_all").join(F.broadcast(pairs), ["i", "j"])


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows joined with facts of their pair (i, j), sent to all tasks where they are MOST_PAIRS at most, so that rows stay where they are."""
    facts = durable(facts)
    return rows.join(F.broadcast(facts) if facts.count() <= MOST_PAIRS else facts, ["i", "j"])


def orthogonal_fit(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, slope, intercept, mx, my): total least squares of feature j on feature i for each pair (i, j).

    pairs name what is fitted; each pair's subjects meet in one aggregate with partial sums."""
    facts = paired(long, pairs).groupBy("i", "j").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("_xx"), F.var_samp("y").alias("_yy"), F.covar_samp("x", "y").alias("_xy"))
    d = F.col("_yy") - F.col("_xx")
    slope = F.try_divide(d + F.sqrt(d * d + 4 * F.col("_xy") * F.col("_xy")), 2 * F.col("_xy"))
    return facts.select("i", "j", slope.alias("slope"), "mx", "my").withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))


def orthogonal_distance(long: DataFrame, fits: DataFrame, centre: str = "data") -> DataFrame:
    """(subject, i, j, distance) of each subject to each fitted line, through the mean of the data (or of the fit)."""
    if centre == "data":
        means = long.groupBy("feat").agg(F.avg("v").alias("_m"))
        fits = fits.drop("mx", "my").join(means.select(F.col("feat").alias("i"), F.col("_m").alias("mx")), "i").join(means.select(F.col("feat").alias("j"), F.col("_m").alias("my")), "j")
    off = F.abs(F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx"))) / F.sqrt(1 + F.col("slope") * F.col("slope"))
    return paired(long, fits).select("subject", "i", "j", off.alias("distance"))
