"""Queries that go through files and encodings: what is written, or encoded, and read back has to be the table it was."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortix.functions import strings
from cohortix.operators import geometry, roi, tabular
from cohortix.shared import shared_dir
from cohortix.sources import arrays, sinks
from cohortix.streaming import accumulate

from .matrix_queries import E, MAPS, cohort, maps2, r6, table
from .network_queries import TR, VX, grid

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sources-{uuid.uuid4().hex}"


def encoded(k: int, x: np.ndarray) -> tuple[str, bytes]:
    """A vector as a file of kind k % 5."""
    if k % 5 == 0:
        return ".npy", sinks.npy(x)
    if k % 5 == 1:
        out = io.BytesIO()
        np.savez(out, data=x)
        return ".npz", out.getvalue()
    if k % 5 == 2:
        return ".nii", sinks.nifti(x.reshape(4, -1))
    if k % 5 == 3:
        return ".gii", sinks.gifti(x)
    return ".thickness", sinks.curv(x)


def files(spark, d):
    """(path, content): the vector of every subject as a file of one of five kinds."""

    def made(batches):
        for b in batches:
            out = [encoded(int(k), np.asarray(x, dtype=float)) for k, x in zip(b["vec_id"], b["embedding"])]
            yield pd.DataFrame({"path": [f"/data/{k}{suffix}" for k, (suffix, _) in zip(b["vec_id"], out)], "content": [raw for _, raw in out]})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(made, "path string, content binary")


#: Volumes are laid out the first place fastest and flattened the last place fastest, as they are read.
@query(f"WITH {E} SELECT CAST(subject AS VARCHAR) AS subject, CAST(feat AS INT) AS pos, round(v, 6) + 0.0 AS v FROM e")
def array_files(spark, d):
    out = arrays.decode_files(files(spark, d)).select("subject", F.posexplode("data").alias("pos", "v"))
    return out.withColumn("v", r6("v"))


@query(f"WITH {E} SELECT CAST(subject AS VARCHAR) AS subject, CAST(feat - 8 AS INT) AS pos, round(v, 6) + 0.0 AS v FROM e WHERE feat >= 8 AND feat < 24")
def array_slices(spark, d):
    out = arrays.decode_files(files(spark, d), start=8, stop=24).select("subject", F.posexplode("data").alias("pos", "v"))
    return out.withColumn("v", r6("v"))


def _covariates_csv(spark, d):
    """A covariate file of all customers: events by segment, codes of missing values, text and numbers."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    balance = F.when(k % 7 == 0, "777").when(k % 11 == 0, "999").when(k % 13 == 0, "").otherwise(F.format_string("%.2f", "c_acctbal"))
    path = folder(spark)
    c.select(F.concat(F.lit("S"), k).alias("src_subject_id"), F.col("c_mktsegment").alias("eventname"), F.col("c_nationkey").alias("nation"), balance.alias("balance"), F.col("c_name").alias("name")).write.option("header", True).option("emptyValue", "").csv(path)
    return path


BALANCE = "CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE round(c_acctbal, 2) END"


@query(f"SELECT 'S' || c_custkey AS src_subject_id, c_nationkey::DOUBLE AS nation, {BALANCE} AS balance FROM customer WHERE c_mktsegment = 'BUILDING'")
def csv_one_event(spark, d):
    return arrays.read_csv(spark, _covariates_csv(spark, d), ["C(nation)", "balance"], "BUILDING").withColumn("balance", F.round("balance", 2))


@query(f"SELECT 'S' || c_custkey AS src_subject_id, c_mktsegment AS eventname, c_name AS name, {BALANCE} AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND {BALANCE} IS NOT NULL")
def csv_events_complete(spark, d):
    out = arrays.read_csv(spark, _covariates_csv(spark, d), ["name", "balance"], ["BUILDING", "MACHINERY"], drop_missing=True)
    return out.select("src_subject_id", "eventname", "name", F.round("balance", 2).alias("balance"))


@query("SELECT CAST(p_size AS VARCHAR) AS p_size, p_name, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def tsv_round_trip(spark, d):
    path = folder(spark)
    sinks.write_tsv(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return sinks.read_tsv(spark, path, ["p_size", "p_name", "p_partkey"])


@query("SELECT 'k' || n_nationkey AS key, n_name AS value FROM nation")
def mapping_round_trip(spark, d):
    path = folder(spark)
    sinks.write_mapping(table(spark, d, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.col("n_name").alias("value")), path)
    return arrays.read_mapping(spark, path)


@query("SELECT 'S' || c_custkey AS subject FROM customer")
def subject_list(spark, d):
    path = folder(spark)
    table(spark, d, "customer").select(F.concat(F.lit(" S"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("value")).write.text(path)
    return arrays.read_subjects(spark, path)


@query("WITH f AS (SELECT '/ref/' || p_name || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'lh' ELSE 'rh' END || '_' || p_partkey || '.npy' AS path FROM part), n AS (SELECT path, string_split(path, '/')[3] AS name FROM f), k AS (SELECT * FROM (VALUES (0, 'nosuchname'), (1, 'e')) t(ki, key)) SELECT path FROM n JOIN k ON contains(name, key) WHERE contains(name, 'rh') ORDER BY ki, length(name), name LIMIT 1")
def catalog_lookup(spark, d):
    side = F.when(F.col("p_partkey") % 2 == 0, "lh").otherwise("rh")
    files = table(spark, d, "part").select(F.concat(F.lit("/ref/"), "p_name", F.lit("_"), side, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".npy")).alias("path"))
    return arrays.catalog_lookup(files, ["nosuchname", "e"], ["rh"])


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 AND n_name NOT IN ('FRANCE', 'CHINA', 'PERU')")
def space_options(spark, d):
    folders = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("_"), "n_name")).otherwise(F.col("n_name")).alias("name"))
    return arrays.space_options(folders, ["FRANCE", "CHINA", "PERU"])


def _surface(spark):
    """The grid as a GIFTI file, written and read."""
    v, t = (x.orderBy(k).toPandas() for x, k in zip(grid(spark), ("vertex", "tri")))  # 400 vertices
    path = folder(spark) + ".surf.gii"
    sinks.write_file(spark, path, sinks.gifti_surface(v[["x", "y", "z"]].to_numpy(), t[["a", "b", "c"]].to_numpy()))
    return arrays.load_surface(spark, path)


@query(f"WITH {VX} SELECT vertex, x, y, round(z, 5) AS z FROM vx")
def surface_vertices(spark, d):
    return _surface(spark)[0].select("vertex", "x", "y", F.round("z", 5).alias("z"))


@query(f"WITH {TR} SELECT tri, a, b, c FROM tr")
def surface_triangles(spark, d):
    return _surface(spark)[1]


@query(f"WITH {VX} SELECT vertex, x + 0.5 AS x, y, round(z, 6) AS z FROM vx")
def mid_surface(spark, d):
    v, _ = grid(spark)
    return geometry.mid_surface(v, v.withColumn("x", F.col("x") + 1)).withColumn("z", r6("z"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def cached_table(spark, d):
    """Computed and written at the first call, read at the second."""
    path, calls = folder(spark), []

    def compute():
        calls.append(1)
        return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))

    sinks.read_through(spark, path, {"columns": ["b", "a"], "file": f"{d}/customer.parquet"}, compute)
    out = sinks.read_through(spark, path, {"file": f"{d}/customer.parquet", "columns": ["a", "b"]}, compute)
    if len(calls) != 1:
        raise AssertionError("computed anew")
    return out


def _maxima(spark, d):
    return lambda perms: table(spark, d, "orders").join(perms, F.col("o_orderkey") % 20 + 1 == F.col("perm")).groupBy("perm").agg(F.max("o_totalprice").alias("vmax"))


@query("SELECT CAST(o_orderkey % 20 + 1 AS INT) AS perm, max(o_totalprice) AS vmax FROM orders GROUP BY o_orderkey % 20")
def maxima_in_instalments(spark, d):
    """Two instalments that overlap: what is there isn't scored again."""
    path, perms = folder(spark), spark.range(1, 21).select(F.col("id").cast("int").alias("perm"))
    accumulate.append_maxima(spark, perms.where("perm <= 12"), path, _maxima(spark, d))
    return accumulate.append_maxima(spark, perms, path, _maxima(spark, d))


@query("SELECT range::INT AS perm FROM range(13, 21)")
def pending_work(spark, d):
    path, perms = folder(spark), spark.range(1, 21).select(F.col("id").cast("int").alias("perm"))
    accumulate.append_maxima(spark, perms.where("perm <= 12"), path, _maxima(spark, d))
    return accumulate.pending(spark, perms, path)


# names and templates


@query("SELECT p_partkey, replace(replace(lower(p_name), 'a', 'e e'), 'e', 'o') AS name FROM part")
def mapping_chain(spark, d):
    """Keys and values are cleaned and replaced one after the other, in the mapping's order."""
    return table(spark, d, "part").select("p_partkey", strings.apply_mapping(F.lower("p_name"), [("A", "E-e"), ("E", "o")]).alias("name"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN substr(p_brand, 8) ELSE p_brand END AS a, CASE WHEN ends_with(p_brand, '3') THEN left(p_brand, length(p_brand) - 1) ELSE p_brand END AS b, replace(p_brand, 'an', '') AS c FROM part")
def affixes(spark, d):
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", strings.remove_affix(b, "Brand#1", "start").alias("a"), strings.remove_affix(b, "3", "end").alias("b"), strings.remove_affix(b, "an", None).alias("c"))


@query("SELECT p_partkey, unnest(list_distinct([x for x in string_split(p_name || '  ' || p_name, ' ') if x <> ''])) AS token FROM part")
def name_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(strings.pieces(F.concat("p_name", F.lit("  "), "p_name"))).alias("token"))


@query("SELECT c_custkey, '/x/' || c_nationkey || '/' || c_custkey || '.nii' AS path FROM customer")
def path_function(spark, d):
    made = lambda subject, contrast: f"/x/{contrast}/{subject}.nii"
    c = table(spark, d, "customer")
    rows = [r[0] for r in c.select("c_nationkey").distinct().collect()]  # 25 nations
    out = None
    for k in rows:
        part = c.where(F.col("c_nationkey") == k).select("c_custkey", tabular.path_template(F.col("c_custkey"), made, str(k)).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {E}, {MAPS} SELECT subject, map, round(sum(v * w) / sum(w), 6) + 0.0 AS value FROM e JOIN m USING (feat) GROUP BY subject, map")
def maps_auto(spark, d):
    """No weight is negative, so maps are averaged."""
    return roi.soft_regions(cohort(spark, d), maps2(spark)).select("subject", "map", r6("value").alias("value"))
