"""Queries of tables, matrices, regions and names on the driver's tables, each with its SQL.

Subjects are embeddings.vec_id, features the places in their vectors; regions are feat % 7 with 0 as background."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortix.functions import strings
from cohortix.operators import matrix, plotframes, roi, tabular
from cohortix.sources import sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Long form of the cohort matrix.
E = "e AS (SELECT vec_id AS subject, label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feat FROM embeddings)"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cohort(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return matrix.to_long(table(spark, d, "embeddings"), "vec_id", "embedding", *keep)


def holes(long: DataFrame) -> DataFrame:
    """Missing values by rule: null where (subject * 7 + feat) % 13 is 0."""
    return long.withColumn("v", F.when((F.col("subject") * 7 + F.col("feat")) % 13 != 0, F.col("v")))


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def feats(spark: SparkSession, n: int = 64) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("feat"))


def labels7(spark: SparkSession) -> DataFrame:
    return feats(spark).select("feat", (F.col("feat") % 7).alias("label"))


@query(f"WITH {E} SELECT subject, feat, v FROM e")
def matrix_long(spark, d):
    return cohort(spark, d).select("subject", "feat", "v")


@query(f"WITH {E} SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY feat) - 1 AS INT) AS pos, v FROM e WHERE feat % 3 = 1")
def mask_apply(spark, d):
    mask = feats(spark).select("feat", (F.col("feat") % 3 == 1).cast("int").alias("m"))
    return matrix.apply_mask(cohort(spark, d), mask).select("subject", F.col("pos").cast("int").alias("pos"), "v")


@query(f"WITH {E} SELECT subject, feat, CASE WHEN feat % 3 = 1 THEN v ELSE 0 END AS v FROM e")
def mask_reverse(spark, d):
    mask = feats(spark).select("feat", (F.col("feat") % 3 == 1).cast("int").alias("m"))
    return matrix.reverse_mask(matrix.apply_mask(cohort(spark, d), mask).select("subject", "pos", "v"), mask)


@query(f"WITH {E} SELECT subject, feat, v FROM e WHERE feat >= 10 AND feat < 50 AND feat % 4 = 2")
def index_slice(spark, d):
    return matrix.index_slice(cohort(spark, d), 10, 50, 4).select("subject", "feat", "v")


@query("SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS l_tax FROM lineitem")
def zero_as_null(spark, d):
    return matrix.zero_as_null(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), "l_tax")


@query(f"WITH {E} SELECT subject, feat, CASE WHEN (subject * 7 + feat) % 13 = 0 THEN 0 ELSE v END AS v FROM e")
def null_as_zero(spark, d):
    return matrix.null_as_zero(holes(cohort(spark, d)), "v").select("subject", "feat", "v")


@query(f"WITH {E}, m AS (SELECT subject, avg(abs(v)) AS a FROM e GROUP BY subject) SELECT subject, round(a, 6) AS mean_abs FROM m QUALIFY row_number() OVER (ORDER BY a DESC NULLS FIRST, subject) > 25")
def drop_top_outliers(spark, d):
    return matrix.drop_top_outliers(cohort(spark, d), 25).select("subject", r6("mean_abs").alias("mean_abs"))


@query(f"WITH {E} SELECT subject, feat, round(v - avg(v) OVER (PARTITION BY feat), 6) + 0.0 AS v FROM e")
def demean(spark, d):
    return matrix.demean(cohort(spark, d)).select("subject", "feat", r6("v").alias("v"))


# tables


@query("SELECT user_id, value FROM events WHERE event_type = 'click'")
def csv_event_filter_single(spark, d):
    return tabular.filter_events(table(spark, d, "events").select("user_id", "event_type", "value"), "click", "event_type")


@query("SELECT user_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def csv_event_filter_multi(spark, d):
    return tabular.filter_events(table(spark, d, "events").select("user_id", "event_type", "value"), ["click", "view"], "event_type")


@query("SELECT user_id, event_type, value FROM events")
def csv_event_filter_all(spark, d):
    return tabular.filter_events(table(spark, d, "events").select("user_id", "event_type", "value"), None, "event_type")


@query("SELECT p_partkey, CASE WHEN p_partkey % 50 IN (777 % 50, 999 % 50) THEN NULL ELSE p_size END AS p_size FROM part")
def na_sentinels(spark, d):
    coded = F.when(F.col("p_partkey") % 50 == 777 % 50, 777).when(F.col("p_partkey") % 50 == 999 % 50, 999).otherwise(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", tabular.sentinel_null(coded).alias("p_size"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 11 <> 0 AND user_id % 7 <> 0")
def dropna_rows(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return tabular.drop_missing(e)[0]


@query("SELECT 'rows left out' AS what, count(*) FILTER (event_id % 11 = 0 OR user_id % 7 = 0) AS n FROM events")
def dropna_count(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return spark.createDataFrame([("rows left out", tabular.drop_missing(e)[1])], "what string, n long")


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM customer")
def encode_ordinal(spark, d):
    out = tabular.ordinal_encode(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")
    return out.select("c_custkey", F.col("code").cast("long").alias("code"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def encode_onehot(spark, d):
    return tabular.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS \"c_mktsegment_{s}\"" for s in SEGMENTS[1:]) + " FROM customer")
def encode_dummy(spark, d):
    return tabular.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", drop_first=True)


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS BIGINT) AS code, CAST(-1 AS INT) AS neg_ones FROM customer")
def label_encode(spark, d):
    out = tabular.ordinal_encode(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "code")
    return out.select("c_custkey", F.col("code").cast("long").alias("code"), F.lit(-1).alias("neg_ones"))


def _orders(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("subject"))


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))


@query("SELECT c_custkey AS subject FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def overlap_subjects(spark, d):
    return tabular.overlap(_customers(spark, d), _orders(spark, d))


@query("SELECT c_custkey AS subject FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AND c_custkey IN (SELECT user_id FROM events)")
def overlap_multi(spark, d):
    return tabular.overlap(_customers(spark, d), _orders(spark, d), table(spark, d, "events").select(F.col("user_id").alias("subject")))


@query("SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def missing_subjects(spark, d):
    return tabular.missing(_customers(spark, d), _orders(spark, d))


@query("SELECT o_custkey AS subject, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def align_subjects(spark, d):
    some = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("subject"))
    return tabular.align(some, table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey", "o_totalprice"), check=False)


@query("SELECT c_custkey, '/data/' || c_custkey || '/rest_' || c_custkey || '.npy' AS path FROM customer")
def path_template(spark, d):
    return table(spark, d, "customer").select("c_custkey", tabular.path_template(F.col("c_custkey"), "/data/SUBJECT/CONTRAST_SUBJECT.npy", "rest").alias("path"))


@query("SELECT p_partkey, p_retailprice AS p_cost, p_size AS p_len FROM part")
def rename_columns(spark, d):
    return tabular.rename_columns(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["retailprice", "size"], ["cost", "len"])


@query("SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def melt_importances(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return tabular.melt(p, ["p_partkey"], ["size", "price"])


@query("WITH s AS (SELECT c_nationkey * 3 + 2 AS label, c_custkey FROM customer), l AS (SELECT DISTINCT label FROM s UNION SELECT 0), k AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM l) SELECT c_custkey AS feat, CAST(code AS BIGINT) AS label FROM s JOIN k USING (label)")
def clean_labels(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("feat"), (F.col("c_nationkey") * 3 + 2).alias("label"))
    return tabular.clean_labels(s).select("feat", F.col("label").cast("long").alias("label"))


@query(
    "WITH l AS (SELECT c_custkey AS feat, c_nationkey AS label FROM customer), r AS (SELECT s_suppkey AS feat, s_nationkey AS label FROM supplier), "
    "f AS (SELECT (SELECT count(DISTINCT label) FROM l) AS n, (SELECT count(*) FROM (SELECT label FROM l INTERSECT SELECT label FROM r)) AS c, (SELECT max(label) FROM l) AS top, (SELECT max(feat) + 1 FROM l) AS size), "
    "b AS (SELECT feat, label FROM l UNION ALL SELECT feat + size, CASE WHEN c > 0 AND c::DOUBLE / n > 0.75 AND label <> 0 THEN label + top + 1 ELSE label END FROM r, f), "
    "a AS (SELECT DISTINCT label FROM b UNION SELECT 0), k AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM a) SELECT CAST(feat AS BIGINT) AS feat, CAST(code AS BIGINT) AS label FROM b JOIN k USING (label)"
)
def merge_hemis(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("feat"), F.col("c_nationkey").alias("label"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("feat"), F.col("s_nationkey").alias("label"))
    return tabular.merge_hemispheres(left, right).select(F.col("feat").cast("long").alias("feat"), F.col("label").cast("long").alias("label"))


# regions


def _roi_sql(f: str) -> str:
    return f"WITH {E} SELECT subject, CAST(feat % 7 AS INT) AS label, round({f}, 6) + 0.0 AS value FROM e WHERE feat % 7 <> 0 GROUP BY subject, feat % 7"


def _roi(how):
    def run(spark, d):
        return roi.regions(cohort(spark, d), labels7(spark), how).select("subject", F.col("label").cast("int").alias("label"), r6("value").alias("value"))

    return run


for _how, _f in {"mean": "avg(v)", "median": "median(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_pop(v)", "var": "var_pop(v)"}.items():
    query(_roi_sql(_f), f"roi_{_how}")(_roi(_how))


@query(_roi_sql("max(v) - min(v)"))
def roi_custom_udaf(spark, d):
    return _roi(F.max("v") - F.min("v"))(spark, d)


@query(f"WITH {E} SELECT subject, CAST(feat % 7 AS INT) AS label, round(avg(v), 6) + 0.0 AS value FROM e WHERE feat % 7 <> 0 AND feat % 5 <> 0 GROUP BY subject, feat % 7")
def roi_excluded(spark, d):
    exclude = feats(spark).select("feat", (F.col("feat") % 5 == 0).cast("int").alias("m"))
    return roi.regions(cohort(spark, d), labels7(spark), "mean", exclude=exclude).select("subject", F.col("label").cast("int").alias("label"), r6("value").alias("value"))


@query(f"WITH {E} SELECT subject, feat, CASE WHEN feat % 7 = 0 THEN 0 ELSE round(avg(v) OVER (PARTITION BY subject, feat % 7), 6) + 0.0 END AS v FROM e")
def roi_inverse(spark, d):
    return roi.to_features(roi.regions(cohort(spark, d), labels7(spark)), labels7(spark)).select("subject", "feat", r6("v").alias("v"))


@query("SELECT c_nationkey AS label, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INT) AS roi FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (0, 7))")
def roi_index_map(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("feat"), F.col("c_nationkey").alias("label"))
    return roi.index_map(labels, [0, 7]).select("label", F.col("roi").cast("int").alias("roi"))


@query(_roi_sql("max(v) - min(v)"))
def roi_function(spark, d):
    """A reducer in Python, of a region's values as an array."""
    return _roi(lambda x: x.max() - x.min())(spark, d)


#: Soft maps: two overlapping ramps, in SQL and as a table.
MAPS = "m AS (SELECT CAST(f.range AS INT) AS feat, CAST(k.range AS INT) AS map, CAST(CASE WHEN k.range = 0 THEN f.range % 5 ELSE (f.range * 3) % 8 END AS DOUBLE) AS w FROM range(64) f, range(2) k)"


def maps2(spark):
    f = feats(spark)
    return f.select("feat", F.lit(0).alias("map"), (F.col("feat") % 5).cast("double").alias("w")).unionByName(f.select("feat", F.lit(1).alias("map"), (F.col("feat") * 3 % 8).cast("double").alias("w")))


@query(f"WITH {E}, {MAPS} SELECT subject, map, round(sum(v * w) / sum(w), 6) + 0.0 AS value FROM e JOIN m USING (feat) GROUP BY subject, map")
def maps_average(spark, d):
    return roi.maps_average(cohort(spark, d), maps2(spark)).select("subject", "map", r6("value").alias("value"))


LS = (
    f"WITH {E}, {MAPS}, w AS (SELECT feat, max(w) FILTER (map = 0) AS p, max(w) FILTER (map = 1) AS q FROM m GROUP BY feat), "
    "g AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq FROM w), x AS (SELECT subject, sum(v * p) AS xp, sum(v * q) AS xq FROM e JOIN w USING (feat) GROUP BY subject), "
    "b AS (SELECT subject, (qq * xp - pq * xq) / (pp * qq - pq * pq) AS b0, (pp * xq - pq * xp) / (pp * qq - pq * pq) AS b1 FROM x, g) "
)


@query(LS + "SELECT subject, CAST(0 AS INT) AS map, round(b0, 6) + 0.0 AS value FROM b UNION ALL SELECT subject, 1, round(b1, 6) + 0.0 FROM b")
def maps_ls(spark, d):
    return roi.maps_least_squares(cohort(spark, d), maps2(spark)).select("subject", "map", r6("value").alias("value"))


@query(LS + "SELECT subject, feat, round(b0 * p + b1 * q, 6) + 0.0 AS v FROM b, w")
def maps_ls_inverse(spark, d):
    return roi.maps_inverse(roi.maps_least_squares(cohort(spark, d), maps2(spark)), maps2(spark)).select("subject", "feat", r6("v").alias("v"))


@query("WITH w AS (SELECT p_partkey AS voxel, p_brand AS roi, p_size::DOUBLE AS w FROM part), t AS (SELECT roi, sum(w) AS t, avg(p_retailprice) AS fi FROM w JOIN part ON voxel = p_partkey GROUP BY roi) SELECT voxel, round(sum(w * fi / t), 6) AS value FROM w JOIN t USING (roi) GROUP BY voxel")
def project_map(spark, d):
    p = table(spark, d, "part")
    weights = p.select(F.col("p_partkey").alias("voxel"), F.col("p_brand").alias("roi"), F.col("p_size").cast("double").alias("w"))
    fi = p.groupBy(F.col("p_brand").alias("roi")).agg(F.avg("p_retailprice").alias("fi"))
    return roi.project(weights, fi).select("voxel", r6("value").alias("value"))


# names


@query("SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(lower('  ' || p_name || '_L-x.' || p_brand || '&z'), '.', ' '), '-', ' '), '_', ' '), '  ', ' '), '   ', ' '), chr(9), ' '), chr(10), ' '), '&', ' and ') AS key FROM part")
def clean_key(spark, d):
    raw = F.concat(F.lit("  "), "p_name", F.lit("_L-x."), "p_brand", F.lit("&z"))
    return table(spark, d, "part").select("p_partkey", strings.clean_key(raw).alias("key"))


@query("SELECT p_partkey, replace(replace(p_name, 'a', 'b'), 'bb', 'c') AS name FROM part")
def name_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", tabular.rename_values(F.col("p_name"), ["a", "bb"], ["b", "c"]).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1024.0 * 1024 * 1024 WHEN 1 THEN p_size * 1024.0 WHEN 2 THEN p_size::DOUBLE ELSE p_size * 1024.0 * 1024 END::DOUBLE AS bytes FROM part")
def size_to_bytes(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat("p_size", F.lit("G"))).when(k == 1, F.concat("p_size", F.lit(" KB"))).when(k == 2, F.col("p_size").cast("string")).otherwise(F.concat("p_size", F.lit("mb")))
    return table(spark, d, "part").select("p_partkey", strings.size_to_bytes(text).alias("bytes"))


#: The tokens of both sides, tried in order at the start, at the end and anywhere.
TRIES = ", ".join(f"({3 * i + j}, '{left}', '{right}', '{kind}')" for i, (left, right) in enumerate(zip(strings.LEFT_KEYS, strings.RIGHT_KEYS)) for j, kind in enumerate(("start", "end", "in")))


@query(
    f"WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'lh' ELSE 'rh' END || '#' || p_partkey AS name FROM part), t AS (SELECT * FROM (VALUES {TRIES}) t(rank, lh, rh, kind)), "
    "h AS (SELECT rank, lh, rh, kind, count(*) AS n, count(*) FILTER (CASE kind WHEN 'start' THEN starts_with(name, lh) WHEN 'end' THEN ends_with(name, lh) ELSE contains(name, lh) END) AS l, "
    "count(*) FILTER (CASE kind WHEN 'start' THEN starts_with(name, rh) WHEN 'end' THEN ends_with(name, rh) ELSE contains(name, rh) END) AS r FROM n, t GROUP BY rank, lh, rh, kind) "
    "SELECT CAST(rank AS INT) AS rank, lh, rh, kind FROM h WHERE abs(l - floor(n / 2)) < 0.15 * n AND abs(r - floor(n / 2)) < 0.15 * n ORDER BY rank LIMIT 1"
)
def lr_keys(spark, d):
    side = F.when(F.col("p_partkey") % 2 == 0, "lh").otherwise("rh")
    return strings.side_keys(table(spark, d, "part").select(F.concat(side, F.lit("#"), F.col("p_partkey").cast("string")).alias("name")), "name")


@query(
    "WITH n AS (SELECT DISTINCT p_name AS name FROM part), r AS (SELECT DISTINCT p_size % 5 AS ref, string_split(p_name, ' ')[1] AS label FROM part WHERE p_partkey % 50 = 0), "
    "h AS (SELECT ref, count(DISTINCT name) AS n FROM n JOIN r ON contains(name, label) GROUP BY ref) SELECT ref, n FROM h ORDER BY n DESC, ref LIMIT 1"
)
def best_parcel(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    refs = table(spark, d, "part").where("p_partkey % 50 = 0").select((F.col("p_size") % 5).alias("ref"), F.get(F.split("p_name", " "), 0).alias("label")).distinct()
    return strings.best_reference(names, refs)


@query(
    "WITH n AS (SELECT DISTINCT p_name AS name, replace(lower(p_name), '-', ' ') AS k FROM part), l AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS label FROM part WHERE p_partkey % 97 = 0), "
    "m AS (SELECT name, label, row_number() OVER (PARTITION BY name ORDER BY length(label) DESC, label) AS r FROM n JOIN l ON contains(k, lower(label))) SELECT n.name, m.label FROM n LEFT JOIN m ON n.name = m.name AND r = 1"
)
def name_resolve(spark, d):
    p = table(spark, d, "part")
    labels = p.where("p_partkey % 97 = 0").select(F.explode(F.split("p_name", " ")).alias("label")).distinct()
    return strings.resolve_names(p.select(F.col("p_name").alias("name")).distinct(), labels)


@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS t FROM documents) WHERE t > 1000000")
def lru_evict(spark, d):
    entries = table(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").alias("name"), F.col("n_chars").alias("size"), F.col("doc_id").alias("time"))
    return sinks.evicted(entries, 1_000_000).select("doc_id")


# frames of figures


@query("WITH b AS (SELECT p_name AS name, avg(p_retailprice) - 1500 AS value FROM part GROUP BY p_name), f AS (SELECT min(value) < 0 AND max(value) > 0 AS two FROM b) SELECT name, round(value, 6) AS value FROM (SELECT name, value FROM b ORDER BY value DESC, name LIMIT 5) UNION SELECT name, round(value, 6) FROM (SELECT name, value FROM b, f WHERE two ORDER BY value, name LIMIT 5)")
def bars_topn(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg((F.avg("p_retailprice") - 1500).alias("value"))
    return plotframes.top_bars(b, 5).select("name", r6("value").alias("value"))


@query(f"WITH {E} SELECT round(quantile_cont(v, 0.75) - 1e-5, 6) AS threshold FROM e WHERE v <> 0")
def display_threshold(spark, d):
    return plotframes.display_threshold(cohort(spark, d)).select(r6("threshold").alias("threshold"))


@query(f"WITH {E}, f AS (SELECT min(v) AS lo, max(v) AS hi FROM e) SELECT CASE WHEN lo < 0 AND hi > 0 THEN -greatest(abs(lo), abs(hi)) ELSE lo END AS vmin, CASE WHEN lo < 0 AND hi > 0 THEN greatest(abs(lo), abs(hi)) ELSE hi END AS vmax, lo < 0 AND hi > 0 AS is_symmetric FROM f")
def colour_range(spark, d):
    return plotframes.colour_range(cohort(spark, d))


@query("SELECT bool_and(p_size = floor(p_size)) AS is_parcellation FROM part")
def is_parcellation(spark, d):
    return plotframes.is_parcellation(table(spark, d, "part").select(F.col("p_size").alias("v")))


@query("SELECT CASE WHEN count(DISTINCT l_quantity)::DOUBLE / count(*) > 0.05 THEN 'mean' ELSE 'median' END AS method FROM lineitem WHERE l_quantity <> 0")
def average_method(spark, d):
    return plotframes.average_method(table(spark, d, "lineitem").select(F.col("l_quantity").alias("v")))


@query("SELECT 'l_quantity' AS name, round(avg(l_quantity), 6) AS value FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6) FROM lineitem")
def column_means(spark, d):
    return plotframes.column_means(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select("name", r6("value").alias("value"))


@query("WITH v AS (SELECT (n_nationkey * 2654435761) % 97 AS v, n_name AS name, n_regionkey FROM nation) SELECT name, v AS value FROM v WHERE n_regionkey IN (1, 3)")
def importance_frame(spark, d):
    n = table(spark, d, "nation")
    return n.where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_name").alias("name"), (F.col("n_nationkey").cast("long") * 2654435761 % 97).alias("value"))


@query("SELECT p_name AS a, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') AND NOT contains(p_name, 'z') GROUP BY p_name")
def name_filter(spark, d):
    p = table(spark, d, "part")
    keep = strings.select_names(F.col("p_brand"), [("Brand#1", "start")], []) & strings.select_names(F.col("p_name"), [], [("z", None)])
    return p.where(keep).groupBy(F.col("p_name").alias("a")).agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key FROM part UNION SELECT 'no such name'), n AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY length(name), name) AS r FROM k JOIN n ON contains(name, key)) SELECT k.key, h.name FROM k LEFT JOIN h ON k.key = h.key AND r = 1")
def shortest_match(spark, d):
    p = table(spark, d, "part")
    keys = p.select(F.get(F.split("p_name", " "), 0).alias("key")).unionByName(spark.createDataFrame([("no such name",)], "key string"))
    return strings.shortest_match(p.select(F.col("p_name").alias("name")), keys)


@query()
def most_similar(spark, d):
    n = table(spark, d, "nation")
    return strings.most_similar(table(spark, d, "part").select(F.col("p_name").alias("name")), n.select(F.lower("n_name").alias("label"))).withColumn("ratio", r6("ratio"))


@query()
def similarity_ratio(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    nxt = F.lead("a").over(Window.orderBy("a"))
    return p.select("a", nxt.alias("b")).where("b is not null").select("a", "b", r6(strings.similarity(F.col("a"), F.col("b"))).alias("ratio"))


@query()
def unique_markers(spark, d):
    names = sorted(r[0] for r in table(spark, d, "nation").select("n_name").collect())  # 25 names
    return spark.createDataFrame(list(zip(names, strings.unique_markers(names))), "name string, marker string")
