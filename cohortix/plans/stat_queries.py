"""Queries of statistics, permutations, reliability and decompositions on the driver's tables, each with its SQL.

Covariates of a subject are rules of its number: age (s * 37 % 101 / 10) and site (s % 3); the tested variable is age."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortix.operators import blocks, decomposition, matrix, mixed, permutation, reliability, stats, tabular

from .matrix_queries import E, cohort, feats, holes, r6, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


AGE, SITE = "(subject * 37 % 101) / 10.0::DOUBLE", "(subject % 3)::DOUBLE"
HOLES = "h AS (SELECT subject, label, feat, CASE WHEN (subject * 7 + feat) % 13 <> 0 THEN v END AS v FROM e)"


def covariates(spark, d):
    s = F.col("vec_id")
    return table(spark, d, "embeddings").select(s.alias("subject"), "label", ((s * 37 % 101) / F.lit(10.0)).alias("age"), (s % 3).cast("double").alias("site"))


@query(f"WITH {E} SELECT feat, round(avg(v) / stddev_pop(v), 6) + 0.0 AS d FROM e GROUP BY feat")
def cohens_d(spark, d):
    return stats.cohens_d(cohort(spark, d)).select("feat", r6("d").alias("d"))


def _slope(t: str) -> str:
    return f"x AS (SELECT subject, feat, v, {AGE} AS a FROM {t}), b AS (SELECT feat, regr_slope(v, a) AS s FROM x GROUP BY feat)"


@query(f"WITH {E}, {_slope('e')} SELECT subject, feat, round(v - s * a, 6) + 0.0 AS v FROM x JOIN b USING (feat)")
def residualize_1(spark, d):
    return stats.residualize(cohort(spark, d), covariates(spark, d), ["age"]).select("subject", "feat", r6("v").alias("v"))


@query(
    f"WITH {E}, x AS (SELECT subject, feat, v, {AGE} AS a, {SITE} AS c FROM e), m AS (SELECT feat, var_pop(a) AS aa, var_pop(c) AS cc, covar_pop(a, c) AS ac, covar_pop(a, v) AS av, covar_pop(c, v) AS cv FROM x GROUP BY feat), "
    "b AS (SELECT feat, (cc * av - ac * cv) / (aa * cc - ac * ac) AS p, (aa * cv - ac * av) / (aa * cc - ac * ac) AS q FROM m) SELECT subject, feat, round(v - p * a - q * c, 6) + 0.0 AS v FROM x JOIN b USING (feat)"
)
def residualize_2(spark, d):
    return stats.residualize(cohort(spark, d), covariates(spark, d), ["age", "site"]).select("subject", "feat", r6("v").alias("v"))


@query(f"WITH {E}, {HOLES}, {_slope('h')} SELECT subject, feat, round(v - s * a, 6) + 0.0 AS v FROM x JOIN b USING (feat)")
def residualize_nulls(spark, d):
    return stats.residualize(holes(cohort(spark, d)), covariates(spark, d), ["age"]).select("subject", "feat", r6("v").alias("v"))


@query(f"WITH {E} SELECT feat, round(corr(v, {AGE}), 6) + 0.0 AS r FROM e GROUP BY feat")
def fast_corr(spark, d):
    return stats.correlate(cohort(spark, d), covariates(spark, d), "age").select("feat", r6("r").alias("r"))


@query(f"WITH {E}, {HOLES} SELECT feat, count(v) AS n, round((avg(v) - 0.1) / (stddev_samp(v) / sqrt(count(v))), 6) + 0.0 AS t FROM h GROUP BY feat")
def ttest_1samp_stat(spark, d):
    return stats.t_one_sample(holes(cohort(spark, d)), 0.1).select("feat", "n", r6("t").alias("t"))


@query(
    "WITH p AS (SELECT c_custkey, c_mktsegment AS s, ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE AS p FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY s) AS m, row_number() OVER (PARTITION BY s ORDER BY p) AS k FROM p) "
    "SELECT c_custkey, round(least(1.0, min(p * m / k) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r"
)
def bh_fdr(spark, d):
    p = table(spark, d, "customer").select("c_custkey", "c_mktsegment", ((F.col("c_custkey") * 7919 % 10007) / F.lit(10007.0)).alias("p"))
    return stats.fdr(p, "p", "q", "c_mktsegment").select("c_custkey", r6("q").alias("q"))


@query(f"WITH {E}, {_slope('e')}, r AS (SELECT feat, v - s * a AS v FROM x JOIN b USING (feat)) SELECT feat, count(v) AS n, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) + 0.0 AS t, round(avg(v) / stddev_pop(v), 6) + 0.0 AS d FROM r GROUP BY feat")
def onesample_summary(spark, d):
    return stats.one_sample_summary(cohort(spark, d), covariates(spark, d), ["age"]).select("feat", "n", r6("t").alias("t"), r6("d").alias("d"))


def p_sql(rows: str, t: str, df: str) -> str:
    """CTEs sk and pv: rows with p, two-sided, of Student's t: the share of cos^(df - 1) beyond the angle of t, by Simpson's rule."""
    angle, at = f"atan(abs({t}) / sqrt({df}))", "k / 2000.0::DOUBLE"
    inside, whole = f"sum(w * pow(cos({angle} * {at}), {df} - 1)) * any_value({angle})", f"sum(w * pow(cos(pi() / 2 * {at}), {df} - 1)) * pi() / 2"
    return f"sk AS (SELECT range AS k, CASE WHEN range IN (0, 2000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(2001)), pv AS (SELECT {rows}.*, p FROM {rows} JOIN (SELECT id, 1 - {inside} / ({whole}) AS p FROM {rows}, sk GROUP BY id) USING (id))"


@query(
    f"WITH {E}, {_slope('e')}, r AS (SELECT feat, v - s * a AS v FROM x JOIN b USING (feat)), t AS (SELECT feat AS id, feat, count(v) AS n, avg(v) / (stddev_samp(v) / sqrt(count(v))) AS t, avg(v) / stddev_pop(v) AS d FROM r GROUP BY feat), {p_sql('t', 't', '(n - 1)')}, "
    "k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pv) SELECT feat, n, round(t, 5) + 0.0 AS t, round(p, 5) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS q, round(d, 5) + 0.0 AS d FROM k"
)
def onesample_p_values(spark, d):
    out = stats.one_sample_summary(cohort(spark, d), covariates(spark, d), ["age"])
    return out.select("feat", "n", *[F.round(F.col(c), 5).alias(c) for c in ("t", "p", "q", "d")])


@query("WITH p AS (SELECT c_custkey, ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE AS p FROM customer), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM p) SELECT c_custkey, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def bh_fdr_all(spark, d):
    p = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 10007) / F.lit(10007.0)).alias("p"))
    return stats.fdr(p, "p", "q").select("c_custkey", r6("q").alias("q"))


@query(f"WITH {E}, {HOLES}, s AS (SELECT vec_id AS subject FROM embeddings) SELECT feat, count(*) FILTER (v IS NULL) AS n_missing FROM h GROUP BY feat HAVING count(*) FILTER (v IS NULL) > 0")
def perm_missing_rows(spark, d):
    """What the permutation test refuses: features that lack values of subjects, by null or by missing rows."""
    long = holes(cohort(spark, d)).where("v is not null")
    return permutation.missing_values(long, _subjects(spark, d))


# blocks and permutations

FAMILIES = (
    "WITH c AS (SELECT c_custkey AS subject, c_nationkey AS fam, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'twin' WHEN 'BUILDING' THEN 'triplet' WHEN 'FURNITURE' THEN 'single' WHEN 'HOUSEHOLD' THEN 'sibling' END AS rel, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'monozygotic' WHEN c_custkey % 3 = 1 THEN 'dizygotic' END AS zyg FROM customer), "
    "k AS (SELECT subject, fam, CASE WHEN rel IN ('twin', 'triplet') AND zyg IS DISTINCT FROM 'monozygotic' THEN 'sibling' ELSE rel END AS rel FROM c WHERE rel IS NOT NULL), "
    "s AS (SELECT fam, string_agg(rel, '|' ORDER BY subject) AS sig, min(subject) AS first FROM k GROUP BY fam), t AS (SELECT sig, row_number() OVER (ORDER BY min(first)) - 1 AS family_type FROM s GROUP BY sig) "
    "SELECT subject, CAST(family_type AS BIGINT) AS family_type, CAST(dense_rank() OVER (ORDER BY fam) - 1 AS BIGINT) AS family, CAST(dense_rank() OVER (ORDER BY rel) - 1 AS BIGINT) AS relation FROM k JOIN s USING (fam) JOIN t USING (sig)"
)


@query(FAMILIES)
def family_blocks(spark, d):
    seg = F.col("c_mktsegment")
    rel = F.when(seg == "AUTOMOBILE", "twin").when(seg == "BUILDING", "triplet").when(seg == "FURNITURE", "single").when(seg == "HOUSEHOLD", "sibling")
    zyg = F.when(F.col("c_custkey") % 3 == 0, "monozygotic").when(F.col("c_custkey") % 3 == 1, "dizygotic")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_custkey").alias("at"), F.col("c_nationkey").alias("fam"), rel.alias("rel"), zyg.alias("zyg"))
    return blocks.family_blocks(rows, "at", "fam", "rel", "zyg").select("subject", *[F.col(c).cast("long").alias(c) for c in ("family_type", "family", "relation")])


PERMS = "q AS (SELECT CAST(range AS INT) AS perm FROM range(1, {n}))"
WITHIN = "w AS (SELECT perm, {b} AS b, subject AS src, row_number() OVER (PARTITION BY perm, {b} ORDER BY md5('{s}:' || perm || ':' || subject), subject) AS k FROM {t}, q), a AS (SELECT {b} AS b, subject AS dst, row_number() OVER (PARTITION BY {b} ORDER BY subject) AS k FROM {t}), mv AS (SELECT perm, dst, src FROM w JOIN a USING (b, k))"
SUBJECTS = "su AS (SELECT vec_id AS subject, label FROM embeddings)"


def _subjects(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), "label")


@query(f"WITH {SUBJECTS}, {PERMS.format(n=11)}, {WITHIN.format(b='label', s=1, t='su')} SELECT perm, dst, src FROM mv")
def perm_within_block(spark, d):
    return blocks.permute_within(_subjects(spark, d), blocks.permutations(10, spark), "label", 1)


WHOLE = (
    "WITH su AS (SELECT c_custkey AS subject, c_nationkey AS b FROM customer), q AS (SELECT CAST(range AS INT) AS perm FROM range(1, 3)), m AS (SELECT b, subject, row_number() OVER (PARTITION BY b ORDER BY subject) AS k FROM su), "
    "z AS (SELECT b, count(*) AS size FROM su GROUP BY b), t AS (SELECT size, b AS bt, row_number() OVER (PARTITION BY size ORDER BY b) AS r FROM z), "
    "f AS (SELECT perm, size, b AS bf, row_number() OVER (PARTITION BY perm, size ORDER BY md5('2:' || perm || ':' || b), b) AS r FROM z, q) "
    "SELECT perm, x.subject AS dst, y.subject AS src FROM f JOIN t USING (size, r) JOIN m x ON x.b = bt JOIN m y ON y.b = bf AND y.k = x.k"
)


@query(WHOLE)
def perm_whole_block(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("b"))
    return blocks.permute_whole(s, blocks.permutations(2, spark), "b", 2)


@query(f"WITH {E}, {SUBJECTS}, {PERMS.format(n=3)}, {WITHIN.format(b='label', s=1, t='su')} SELECT perm, dst AS subject, feat, v FROM mv JOIN e ON e.subject = src")
def perm_apply(spark, d):
    return blocks.apply_permutation(cohort(spark, d), blocks.permute_within(_subjects(spark, d), blocks.permutations(2, spark), "label", 1))


@query("SELECT c_custkey AS subject, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS BIGINT) AS vg FROM customer")
def variance_groups_within(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("b"))
    return blocks.variance_groups_within(s, "b").select("subject", F.col("vg").cast("long").alias("vg"))


@query("WITH m AS (SELECT c_custkey AS subject, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer) SELECT subject, CAST(dense_rank() OVER (ORDER BY size, k) - 1 AS BIGINT) AS vg FROM m")
def variance_groups_whole(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("b"))
    return blocks.variance_groups_whole(s, "b").select("subject", F.col("vg").cast("long").alias("vg"))


@query("SELECT c_custkey AS subject FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) >= 60")
def min_vg_filter(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("b"))
    return blocks.min_group_filter(s, "b", 60).select("subject")


@query("SELECT q.range::INT AS perm, vec_id AS subject, CASE WHEN (strpos('0123456789abcdef', substr(md5('3:' || q.range || ':' || vec_id), 1, 1)) - 1) % 2 = 0 THEN 1 ELSE -1 END::INT AS sign FROM embeddings, range(1, 6) q")
def sign_flips(spark, d):
    return blocks.sign_flips(_subjects(spark, d), blocks.permutations(5, spark), 3)


@query(f"WITH {E}, {SUBJECTS}, {PERMS.format(n=3)}, {WITHIN.format(b='label', s=1, t='su')}, r AS (SELECT subject, feat, avg(v) OVER (PARTITION BY feat) AS m, v FROM e) SELECT perm, dst AS subject, feat, round((v - m) + m, 6) + 0.0 AS v FROM mv JOIN r ON r.subject = src")
def freedman_lane(spark, d):
    return permutation.freedman_lane(cohort(spark, d), blocks.permute_within(_subjects(spark, d), blocks.permutations(2, spark), "label", 1)).withColumn("v", r6("v"))


#: v statistics of targets y (perm, subject, feat, y, g) on a tested variable x (subject, x), the intercept confounding.
V = (
    "n AS (SELECT count(*) AS n, sum(x * x) AS sxx FROM x), sl AS (SELECT perm, feat, sum(x * y) / max(sxx) AS s FROM y JOIN x USING (subject), n GROUP BY perm, feat), "
    "gr AS (SELECT perm, feat, g, max(s) AS s, sum(1 - 1.0 / n - x * x / sxx) AS fr, sum((y - s * x) ** 2) AS ss, sum(x * x) AS xx FROM y JOIN x USING (subject) JOIN sl USING (perm, feat), n GROUP BY perm, feat, g), "
    "vs AS (SELECT perm, feat, max(s) * sqrt(sum(fr / ss * xx)) AS v FROM gr GROUP BY perm, feat)"
)


@query(f"WITH {E}, x AS (SELECT subject, a - avg(a) OVER () AS x FROM (SELECT DISTINCT subject, {AGE} AS a FROM e)), y AS (SELECT 0 AS perm, subject, feat, label AS g, v - avg(v) OVER (PARTITION BY feat) AS y FROM e), {V} SELECT feat, round(v, 6) + 0.0 AS v FROM vs")
def v_stat(spark, d):
    return permutation.v_statistic(cohort(spark, d), covariates(spark, d), "age", "label").select("feat", r6("v").alias("v"))


N_PERM = 20
#: The study: without the 25 outliers, permuted within labels, which are the variance groups too, those of 10 subjects or more.
STUDY = (
    f"WITH {E}, o AS (SELECT subject FROM (SELECT subject, avg(abs(v)) AS a FROM e GROUP BY subject) QUALIFY row_number() OVER (ORDER BY a DESC NULLS FIRST, subject) > 25), "
    f"su AS (SELECT vec_id AS subject, label FROM embeddings JOIN o ON vec_id = subject QUALIFY count(*) OVER (PARTITION BY label) >= 10), {PERMS.format(n=N_PERM + 1)}, {WITHIN.format(b='label', s=7, t='su')}, "
    f"pm AS (SELECT perm, dst, src FROM mv UNION ALL SELECT 0, subject, subject FROM su), x AS (SELECT subject, a - avg(a) OVER () AS x FROM (SELECT subject, {AGE} AS a FROM su)), "
    f"c AS (SELECT e.subject, feat, v - avg(v) OVER (PARTITION BY feat) AS y FROM e JOIN su USING (subject)), y AS (SELECT perm, dst AS subject, feat, l.label AS g, y FROM pm JOIN c ON c.subject = src JOIN su l ON l.subject = dst), {V} "
)


def _study(spark, d):
    long = cohort(spark, d)
    kept = matrix.drop_top_outliers(long, 25).select("subject")
    subjects = blocks.min_group_filter(covariates(spark, d).join(kept, "subject", "left_semi"), "label", 10)
    model = permutation.design(subjects, "age", [], "label", "label")
    return permutation.scored(long, model, N_PERM, seed=7)


@query(STUDY + ", mx AS (SELECT perm, max(abs(v)) AS vmax FROM vs WHERE perm > 0 GROUP BY perm) SELECT perm, round(vmax, 6) AS vmax FROM mx")
def vmax_null(spark, d):
    return permutation.null_maxima(_study(spark, d)).select("perm", r6("vmax").alias("vmax"))


@query(STUDY + f", mx AS (SELECT perm, max(abs(v)) AS vmax FROM vs WHERE perm > 0 GROUP BY perm) SELECT feat, round(max(v), 6) + 0.0 AS v, ({N_PERM + 1} - count(*) FILTER (vmax < abs(v))) / {N_PERM + 1}.0::DOUBLE AS p FROM vs, mx WHERE vs.perm = 0 GROUP BY feat")
def perm_pvalues(spark, d):
    scores = _study(spark, d)
    return permutation.corrected_p(scores, permutation.null_maxima(scores), N_PERM).select("feat", r6("v").alias("v"), "p")


def study_sql(subjects: str, moves: str, group: str) -> str:
    """Scores vs of all subjects under moves mv (perm, dst, src), variance groups by an expression of su."""
    return (
        f"WITH {E}, su AS ({subjects}), {moves}, pm AS (SELECT perm, dst, src FROM mv UNION ALL SELECT 0, subject, subject FROM su), x AS (SELECT subject, a - avg(a) OVER () AS x FROM (SELECT subject, {AGE} AS a FROM su)), vg AS (SELECT subject, {group} AS g FROM su), "
        f"c AS (SELECT e.subject, feat, v - avg(v) OVER (PARTITION BY feat) AS y FROM e JOIN su USING (subject)), y AS (SELECT perm, dst AS subject, feat, g, y FROM pm JOIN c ON c.subject = src JOIN vg ON vg.subject = dst), {V}, "
        "mx AS (SELECT perm, max(abs(v)) AS vmax FROM vs WHERE perm > 0 GROUP BY perm) SELECT feat, round(max(v), 6) + 0.0 AS v, (11 - count(*) FILTER (vmax < abs(v))) / 11.0::DOUBLE AS p FROM vs, mx WHERE vs.perm = 0 GROUP BY feat"
    )


TEN = "q AS (SELECT CAST(range AS INT) AS perm FROM range(1, 11))"
#: Blocks of five subjects that swap as wholes; those in one place of their blocks share a variance group.
SWAP = (
    f"{TEN}, m AS (SELECT b, subject, row_number() OVER (PARTITION BY b ORDER BY subject) AS k FROM su), z AS (SELECT b, count(*) AS size FROM su GROUP BY b), t AS (SELECT size, b AS bt, row_number() OVER (PARTITION BY size ORDER BY b) AS r FROM z), "
    "f AS (SELECT perm, size, b AS bf, row_number() OVER (PARTITION BY perm, size ORDER BY md5('4:' || perm || ':' || b), b) AS r FROM z, q), mv AS (SELECT perm, x.subject AS dst, y.subject AS src FROM f JOIN t USING (size, r) JOIN m x ON x.b = bt JOIN m y ON y.b = bf AND y.k = x.k)"
)


def _blocks5(spark, d):
    return covariates(spark, d).withColumn("b", F.floor(F.col("subject") / 5).cast("long"))


@query(study_sql("SELECT *, row_number() OVER (PARTITION BY b ORDER BY subject) AS k5, count(*) OVER (PARTITION BY b) AS n5 FROM (SELECT vec_id AS subject, vec_id // 5 AS b FROM embeddings)", SWAP, "n5 * 10 + k5"))
def perm_pvalues_whole(spark, d):
    """Blocks of equal size swap; variance groups are made from what can change places."""
    return permutation.permuted_v(cohort(spark, d), _blocks5(spark, d), "age", [], None, "b", 10, 4, exchange="whole").select("feat", r6("v").alias("v"), "p")


@query(study_sql("SELECT vec_id AS subject, label FROM embeddings QUALIFY count(*) OVER (PARTITION BY label) >= 12", f"{TEN}, {WITHIN.format(b='label', s=5, t='su')}", "label"))
def perm_pvalues_grouped(spark, d):
    """Members of a label change places; each label is a variance group, and those of fewer than 12 subjects are left out."""
    return permutation.permuted_v(cohort(spark, d), covariates(spark, d), "age", [], None, "label", 10, 5, least=12).select("feat", r6("v").alias("v"), "p")


@query()
def perm_pvalues_z(spark, d):
    return permutation.permuted_v(cohort(spark, d), covariates(spark, d), "age", ["site"], "label", "label", 10, 1, use_z=True)


# reliability

HALF = "hf AS (SELECT subject, CASE WHEN row_number() OVER (ORDER BY md5('2:0:' || subject), subject) <= floor(count(*) OVER () / 2) THEN 1 ELSE 2 END AS half FROM su)"


@query(f"WITH {SUBJECTS}, {HALF} SELECT subject, CAST(half AS INT) AS half FROM hf")
def split_half_plain(spark, d):
    return reliability.split_half(_subjects(spark, d))


@query("WITH su AS (SELECT c_custkey AS subject, c_mktsegment AS s FROM customer) SELECT subject, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY md5('2:0:' || subject), subject) <= floor(count(*) OVER (PARTITION BY s) / 2) THEN 1 ELSE 2 END::INT AS half FROM su")
def split_half_stratified(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("s"))
    return reliability.split_half(s, stratify="s")


@query("WITH g AS (SELECT DISTINCT c_nationkey AS g FROM customer), h AS (SELECT g, CASE WHEN row_number() OVER (ORDER BY md5('2:0:' || g), g) <= floor(count(*) OVER () / 2) THEN 1 ELSE 2 END::INT AS half FROM g) SELECT c_custkey AS subject, half FROM customer JOIN h ON c_nationkey = g")
def split_half_grouped(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("g"))
    return reliability.split_half(s, group="g")


@query(
    f"WITH {E}, {SUBJECTS}, {HALF}, bs AS (SELECT feat, avg(v) / stddev_pop(v) AS b FROM e JOIN hf USING (subject) WHERE half = 1 GROUP BY feat), dr AS (SELECT a.range::INT AS rep, b.n, subject FROM range(3) a, (VALUES (20), (60)) b(n), hf WHERE half = 2 "
    "QUALIFY row_number() OVER (PARTITION BY a.range, b.n ORDER BY md5('0:' || b.n || '-' || a.range || ':' || subject), subject) <= b.n), mp AS (SELECT n, rep, feat, avg(v) / stddev_pop(v) AS dd FROM dr JOIN e USING (subject) GROUP BY n, rep, feat) "
    'SELECT CAST(n AS INT) AS n, rep AS "repeat", round(corr(dd, b), 6) + 0.0 AS r, count(*) AS n_feats FROM mp JOIN bs USING (feat) GROUP BY n, rep'
)
def rely_curve(spark, d):
    halves = reliability.split_half(_subjects(spark, d))
    return reliability.reliability_curve(cohort(spark, d), halves, [20, 60], 3).withColumn("r", r6("r"))


@query(
    f"WITH {E}, {SUBJECTS}, {HALF}, xa AS (SELECT e.*, half, {AGE} AS a, {SITE} AS c FROM e JOIN hf USING (subject)), sl AS (SELECT half, feat, regr_slope(v, a) AS s FROM xa GROUP BY half, feat), rs AS (SELECT subject, half, feat, v - s * a AS v, c FROM xa JOIN sl USING (half, feat)), "
    "bs AS (SELECT feat, corr(v, c) AS b FROM rs WHERE half = 1 GROUP BY feat), dr AS (SELECT a.range::INT AS rep, subject FROM range(2) a, hf WHERE half = 2 QUALIFY row_number() OVER (PARTITION BY a.range ORDER BY md5('0:40-' || a.range || ':' || subject), subject) <= 40), "
    'mp AS (SELECT rep, feat, corr(v, c) AS dd FROM dr JOIN rs USING (subject) GROUP BY rep, feat) SELECT 40::INT AS n, rep AS "repeat", round(corr(dd, b), 6) + 0.0 AS r, count(*) AS n_feats FROM mp JOIN bs USING (feat) WHERE dd IS NOT NULL AND b IS NOT NULL GROUP BY rep'
)
def rely_residual(spark, d):
    halves = reliability.split_half(_subjects(spark, d))
    c = covariates(spark, d)
    return reliability.reliability_curve(cohort(spark, d), halves, [40], 2, covariates=c, names=["age"], scores=c.select("subject", F.col("site").alias("score"))).withColumn("r", r6("r"))


@query()
def rely_summary(spark, d):
    halves = reliability.split_half(_subjects(spark, d))
    return reliability.curve_summary(reliability.reliability_curve(cohort(spark, d), halves, [20, 60], 3))


# orthogonal regression

ORTH = (
    "pr AS (SELECT a.subject, a.feat AS i, b.feat AS j, a.v AS x, b.v AS y FROM e a JOIN e b ON a.subject = b.subject AND a.feat < b.feat), "
    "ft AS (SELECT i, j, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM pr {w} GROUP BY i, j), "
    "sl AS (SELECT i, j, mx, my, ((yy - xx) + sqrt((yy - xx) ** 2 + 4 * xy * xy)) / (2 * xy) AS s FROM ft)"
)


@query(f"WITH {E}, {ORTH.format(w='')} SELECT i, j, round(s, 6) + 0.0 AS slope, round(my - s * mx, 6) + 0.0 AS intercept FROM sl")
def orth_regression(spark, d):
    long = cohort(spark, d)
    from cohortix.operators import networks

    return stats.orthogonal_fit(long, networks.feature_pairs(long)).select("i", "j", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


DISTANCE = ", ds AS (SELECT subject, i, j, abs(y - m.my - s * (x - m.mx)) / sqrt(1 + s * s) AS distance FROM pr JOIN sl USING (i, j) JOIN (SELECT i, j, avg(x) AS mx, avg(y) AS my FROM pr GROUP BY i, j) m USING (i, j)) "


@query(f"WITH {E}, {ORTH.format(w='')} {DISTANCE} SELECT i, j, count(*) AS n, round(avg(distance), 6) AS mean, round(max(distance), 6) AS largest FROM ds GROUP BY i, j")
def orth_distance(spark, d):
    """Distances of all subjects to the lines of all pairs of features, told by pair."""
    from cohortix.operators import networks

    long = cohort(spark, d)
    out = stats.orthogonal_distance(long, stats.orthogonal_fit(long, networks.feature_pairs(long)))
    return out.groupBy("i", "j").agg(F.count("*").alias("n"), r6(F.avg("distance")).alias("mean"), r6(F.max("distance")).alias("largest"))


@query(f"WITH {E}, {ORTH.format(w='WHERE subject % 2 = 0')} {DISTANCE} SELECT subject, count(*) AS n, round(avg(distance), 6) AS mean, round(max(distance), 6) AS largest FROM ds GROUP BY subject")
def group_diff_network(spark, d):
    """Distances of all subjects to the lines of the reference subjects, for all pairs of features, told by subject."""
    from cohortix.operators import networks

    long = cohort(spark, d)
    out = networks.group_difference(long, _subjects(spark, d).where("subject % 2 = 0"))
    return out.groupBy("subject").agg(F.count("*").alias("n"), r6(F.avg("distance")).alias("mean"), r6(F.max("distance")).alias("largest"))


# decompositions and models


@query()
def pca_variance(spark, d):
    return decomposition.gram_eigen(cohort(spark, d), 10).select("component", r6("value").alias("value"), r6("ratio").alias("ratio"))


@query(
    f"WITH {E}, c AS (SELECT a.range::INT AS component, f.range::INT AS feat, sin((a.range + 1) * f.range)::DOUBLE AS w FROM range(3) a, range(64) f), x AS (SELECT subject, component, feat, v, w FROM e JOIN c USING (feat)), "
    "b AS (SELECT subject, component, sum(v * w) / sum(w * w) AS b FROM x GROUP BY subject, component) SELECT component, round(greatest(0, 1 - var_pop(v - b * w) / var_pop(v)), 6) AS ev FROM x JOIN b USING (subject, component) GROUP BY component"
)
def explained_variance(spark, d):
    f = feats(spark)
    parts = [f.select(F.lit(k).alias("component"), "feat", F.sin(F.lit(float(k + 1)) * F.col("feat")).alias("w")) for k in range(3)]
    components = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return decomposition.explained_variance(cohort(spark, d), components).select("component", r6("ev").alias("ev"))


COMPONENTS = "cp AS (SELECT f.range::INT AS feat, sin(f.range)::DOUBLE AS p, sin(2 * f.range)::DOUBLE AS q FROM range(64) f)"
JOINT = (
    f"WITH {E}, {COMPONENTS}, g AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq FROM cp), x AS (SELECT subject, sum(v * p) AS xp, sum(v * q) AS xq FROM e JOIN cp USING (feat) GROUP BY subject), "
    "b AS (SELECT subject, (qq * xp - pq * xq) / (pp * qq - pq * pq) AS b0, (pp * xq - pq * xp) / (pp * qq - pq * pq) AS b1 FROM x, g) "
)


def _components(spark):
    f = feats(spark)
    return f.select(F.lit(0).alias("component"), "feat", F.sin(F.col("feat").cast("double")).alias("w")).unionByName(f.select(F.lit(1).alias("component"), "feat", F.sin(2.0 * F.col("feat")).alias("w")))


@query(JOINT + "SELECT subject, 0::INT AS component, round(b0, 6) + 0.0 AS b FROM b UNION ALL SELECT subject, 1::INT, round(b1, 6) + 0.0 FROM b")
def component_loadings(spark, d):
    return decomposition.loadings(cohort(spark, d), _components(spark)).select("subject", F.col("component").cast("int").alias("component"), r6("b").alias("b"))


@query(JOINT + "SELECT round(greatest(0, 1 - var_pop(v - b0 * p - b1 * q) / var_pop(v)), 6) AS ev FROM e JOIN cp USING (feat) JOIN b USING (subject)")
def joint_explained_variance(spark, d):
    return decomposition.joint_explained_variance(cohort(spark, d), _components(spark)).select(r6("ev").alias("ev"))


@query(
    f"WITH {E}, h AS (SELECT subject, avg(v) FILTER (feat % 2 = 0) AS a, avg(v) FILTER (feat % 2 = 1) AS b FROM e GROUP BY subject), m AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM h), "
    "l AS (SELECT (aa + bb) / 2 AS c, sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS r FROM m) SELECT 0::INT AS component, round(c + r, 8) AS value, round((c + r) / (2 * c), 6) AS ratio FROM l UNION ALL SELECT 1::INT, round(c - r, 8), round((c - r) / (2 * c), 6) FROM l"
)
def pca_two(spark, d):
    """Eigenvalues of two features, the means of the even and of the odd places."""
    long = cohort(spark, d).groupBy("subject", (F.col("feat") % 2).alias("feat")).agg(F.avg("v").alias("v"))
    return decomposition.gram_eigen(long, 2).select("component", F.round("value", 8).alias("value"), r6("ratio").alias("ratio"))


@query()
def canica(spark, d):
    images = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("subject"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("data"))
    m = decomposition.stacked(images, 5)
    y = decomposition.can_ica(m, 5, n_init=3)
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(y) for j, v in enumerate(row)], "component int, feat int, w double")


@query()
def dictionary_learning(spark, d):
    images = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("subject"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("data"))
    y = decomposition.dictionary(decomposition.stacked(images, 5), 5)
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(y) for j, v in enumerate(row)], "component int, feat int, w double")


@query()
def mixed_model(spark, d):
    long = cohort(spark, d).join(covariates(spark, d), "subject")
    return mixed.mixed_models(long.select("feat", "v", "age", "label"), ["age"], "label")


@query("SELECT user_id AS subject, round(avg(value), 6) AS value FROM events WHERE event_type = 'view' AND user_id % 9 <> 0 GROUP BY user_id")
def longitudinal_means(spark, d):
    e = tabular.filter_events(table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_type", "value"), "view", "event_type")
    return e.where("subject % 9 <> 0").groupBy("subject").agg(r6(F.avg("value")).alias("value"))


@query(
    f"WITH {E}, {SUBJECTS}, q AS (SELECT range AS perm FROM range(0, 6)), sg AS (SELECT perm, subject, CASE WHEN perm = 0 OR (strpos('0123456789abcdef', substr(md5('3:' || perm || ':' || subject), 1, 1)) - 1) % 2 = 0 THEN 1 ELSE -1 END AS s FROM su, q), "
    "y AS (SELECT perm, feat, v * s AS y FROM e JOIN sg USING (subject)), t AS (SELECT perm, feat, avg(y) / (stddev_samp(y) / sqrt(count(*))) AS t FROM y GROUP BY perm, feat) SELECT CAST(perm AS INT) AS perm, round(max(abs(t)), 6) AS vmax FROM t WHERE perm > 0 GROUP BY perm"
)
def sign_flip_test(spark, d):
    subjects = _subjects(spark, d).withColumn("one", F.lit(1.0))
    model = permutation.design(subjects, "one", [], "label", "label")
    return permutation.null_maxima(permutation.scored(cohort(spark, d), model, 5, seed=3, statistic="t")).select("perm", r6("vmax").alias("vmax"))
