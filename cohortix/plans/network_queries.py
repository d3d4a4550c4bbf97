"""Queries of networks, meshes and volumes on the driver's tables and on meshes made by rule, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortix.operators import geometry, matrix, networks

from .matrix_queries import E, cohort, feats, holes, labels7, r6, table
from .stat_queries import DISTANCE, ORTH, p_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


#: Correlations of all pairs of features, upper triangle and full matrix.
C = f"WITH {E}, c AS (SELECT a.feat AS i, b.feat AS j, corr(a.v, b.v) AS w FROM e a JOIN e b ON a.subject = b.subject AND a.feat < b.feat GROUP BY a.feat, b.feat)"
M = C + ", m AS (SELECT i, j, w FROM c UNION ALL SELECT j, i, w FROM c UNION ALL SELECT range::INT, range::INT, 1.0 FROM range(64))"


def edges(spark, d):
    return networks.correlation_edges(cohort(spark, d))


def nodes(spark):
    return feats(spark).select(F.col("feat").alias("node"))


@query(C + " SELECT i, j, round(w, 6) + 0.0 AS w FROM c")
def corr_network(spark, d):
    return edges(spark, d).withColumn("w", r6("w"))


def _threshold(kind, cut):
    return lambda spark, d: networks.threshold_value(edges(spark, d), cut, kind).withColumn("w", r6("w"))


for _kind, _cut, _test in (("abs", 0.08, "abs(w) >= 0.08"), ("pos", 0.08, "w >= 0.08"), ("neg", -0.08, "w <= -0.08")):
    query(C + f" SELECT i, j, round(w, 6) + 0.0 AS w FROM c WHERE {_test}", f"threshold_{_kind}")(_threshold(_kind, _cut))


@query(M + " SELECT i, j, round(w, 6) + 0.0 AS w FROM m WHERE abs(w) >= (SELECT abs(w) FROM m ORDER BY abs(w) DESC LIMIT 1 OFFSET 818)")
def threshold_density(spark, d):
    return networks.threshold_density(networks.full_matrix(edges(spark, d)), 0.2).withColumn("w", r6("w"))


@query(C + ", b AS (SELECT max(abs(w)) AS b FROM c), s AS (SELECT greatest(0, ceil((0.9 - b) / 0.01 - 1e-9)) AS s FROM b) SELECT CAST(s AS INT) AS steps, round(0.9 - s * 0.01, 6) AS threshold FROM s")
def threshold_relax(spark, d):
    return networks.threshold_relaxed(edges(spark, d), 0.9).select("steps", r6("threshold").alias("threshold"))


@query(C + " SELECT i, j, round(w, 6) + 0.0 AS w FROM c WHERE w > (SELECT avg(w) + 2 * stddev_pop(w) FROM c)")
def mean_std_edges(spark, d):
    return networks.mean_std_edges(edges(spark, d), 2.0).withColumn("w", r6("w"))


@query(C + ", f AS (SELECT min(abs(w)) AS lo, max(abs(w)) AS hi FROM c) SELECT i, j, round((abs(w) - lo) / (hi - lo) * sign(w), 6) + 0.0 AS w FROM c, f")
def scaled_weights(spark, d):
    return networks.scale_weights(edges(spark, d)).withColumn("w", r6("w"))


@query(C + " SELECT node, round(sum(w), 6) + 0.0 AS degree FROM (SELECT i AS node, w FROM c UNION ALL SELECT j, w FROM c) GROUP BY node")
def weighted_degree(spark, d):
    return networks.weighted_degrees(edges(spark, d)).withColumn("degree", r6("degree"))


@query(M + " SELECT CAST(i * (i - 1) / 2 + j AS BIGINT) AS pos, i, j, round(w, 6) + 0.0 AS w FROM m WHERE i > j")
def tril_vectorize(spark, d):
    return matrix.lower_triangle(networks.full_matrix(edges(spark, d))).withColumn("w", r6("w"))


@query(C + " SELECT i, j, round(w, 6) + 0.0 AS w FROM c UNION ALL SELECT j, i, round(w, 6) + 0.0 FROM c UNION ALL SELECT range::INT, range::INT, 0.0 FROM range(64)")
def to_symmetric(spark, d):
    return matrix.symmetric(edges(spark, d)).withColumn("w", r6("w"))


#: The graph of strong correlations: both directions in g.
G = C + ", k AS (SELECT i, j FROM c WHERE abs(w) >= 0.06), g AS (SELECT i, j FROM k UNION SELECT j, i FROM k), n AS (SELECT range::INT AS node FROM range(64)), dg AS (SELECT node, count(j) AS degree FROM n LEFT JOIN g ON node = i GROUP BY node)"
T = G + ", tr AS (SELECT a.i AS node, count(*) / 2 AS t FROM g a JOIN g b ON a.j = b.i JOIN g x ON b.j = x.i AND x.j = a.i GROUP BY a.i), ms AS (SELECT node, degree, coalesce(t, 0)::BIGINT AS triangles, CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM dg LEFT JOIN tr USING (node))"


def graph(spark, d):
    return networks.threshold_value(edges(spark, d), 0.06).select("i", "j")


@query(G + " SELECT avg(degree) AS avg_degree FROM dg")
def avg_degree(spark, d):
    return networks.degrees(graph(spark, d), nodes(spark)).agg(F.avg("degree").alias("avg_degree"))


@query(T + " SELECT node, degree, triangles, round(clustering, 6) AS clustering FROM ms")
def triangles(spark, d):
    return networks.triangles(graph(spark, d), nodes(spark)).withColumn("clustering", r6("clustering"))


@query(T + " SELECT round(avg(clustering), 6) AS avg_cluster, round(avg(triangles), 6) AS avg_triangles FROM ms")
def clustering(spark, d):
    return networks.triangles(graph(spark, d), nodes(spark)).agg(r6(F.avg("clustering")).alias("avg_cluster"), r6(F.avg("triangles")).alias("avg_triangles"))


@query(T + " SELECT round(2.0 * sum(triangles) / sum(degree * (degree - 1)), 6) AS transitivity FROM ms")
def transitivity(spark, d):
    return networks.transitivity(networks.triangles(graph(spark, d), nodes(spark))).select(r6("transitivity").alias("transitivity"))


@query(G + " SELECT round(corr(a.degree, b.degree), 6) + 0.0 AS assortativity FROM g JOIN dg a ON g.i = a.node JOIN dg b ON g.j = b.node")
def assortativity(spark, d):
    return networks.assortativity(graph(spark, d), nodes(spark)).select(r6("assortativity").alias("assortativity"))


P = G.replace("WITH ", "WITH RECURSIVE ", 1) + ", wk(source, node, dist) AS (SELECT node, node, 0 FROM n UNION SELECT source, j, dist + 1 FROM wk JOIN g ON node = i WHERE dist < 8), sp AS (SELECT source, node, min(dist) AS dist FROM wk GROUP BY source, node HAVING min(dist) > 0)"


def _paths(spark, d):
    return networks.shortest_paths(graph(spark, d), nodes(spark))


@query(P + " SELECT source, node, CAST(dist AS INT) AS dist FROM sp")
def shortest_paths(spark, d):
    return _paths(spark, d)


@query(P + ", b AS (SELECT source, count(*) AS k, sum(dist) AS s FROM sp GROUP BY source) SELECT round((SELECT sum(1.0 / dist) FROM sp) / (64 * 63), 6) AS global_efficiency, round(sum(k::DOUBLE * k / s) / (63 * 64), 6) AS avg_closeness, round((SELECT avg(dist) FROM sp), 6) AS avg_path FROM b")
def global_eff(spark, d):
    return networks.path_measures(_paths(spark, d), 64).select(*[r6(c).alias(c) for c in ("global_efficiency", "avg_closeness", "avg_path")])


@query(P + " SELECT 64::BIGINT AS nodes, max(s) AS largest, max(s) / 64.0::DOUBLE AS ratio FROM (SELECT count(sp.node) + 1 AS s FROM n LEFT JOIN sp ON n.node = source GROUP BY n.node)")
def largest_component(spark, d):
    return networks.largest_component(_paths(spark, d), nodes(spark))


def _graph_measure(names):
    def run(spark, d):
        e = graph(spark, d).select(F.lit(0).cast("long").alias("graph"), "i", "j")
        n = nodes(spark).select(F.lit(0).cast("long").alias("graph"), "node")
        return networks.graph_measures(e, n, names)

    return run


for _name, _measures in {
    "pagerank": ["avg_pagerank"], "betweenness": ["avg_betweenness_centrality"], "eigenvector": ["avg_eigenvector_centrality"], "information": ["avg_information_centrality"],
    "modularity": ["modularity"], "small_world": ["sigma", "omega"], "local_efficiency": ["local_eff", "global_eff", "avg_closeness_centrality", "avg_shortest_path_length"],
}.items():
    query(None, _name)(_graph_measure(_measures))


def _node_measure(name):
    def run(spark, d):
        e = graph(spark, d).select(F.lit(0).cast("long").alias("graph"), "i", "j")
        out = networks.graph_measures(e, nodes(spark).select(F.lit(0).cast("long").alias("graph"), "node"), [name], each=True)
        return out.select("name", r6("value").alias("value"))

    return run


#: Shortest paths and their number, from every node, level by level.
SIGMA = P + ", sg(d, source, node, sigma) AS (SELECT 0, node, node, 1.0::DOUBLE FROM n UNION ALL (SELECT sg.d + 1, sg.source, g.j, sum(sigma) FROM sg JOIN g ON sg.node = g.i JOIN sp ON sp.source = sg.source AND sp.node = g.j AND sp.dist = sg.d + 1 GROUP BY sg.d, sg.source, g.j))"

query(
    SIGMA + ", bc AS (SELECT v.node, sum(x.sigma * y.sigma / z.sigma) AS b FROM n v JOIN sg x ON x.node = v.node JOIN sg y ON y.source = v.node JOIN sg z ON z.source = x.source AND z.node = y.node "
    "WHERE x.source <> v.node AND y.node <> v.node AND x.source <> y.node AND x.d + y.d = z.d GROUP BY v.node) SELECT 'avg_betweenness_centrality_' || n.node AS name, round(coalesce(b, 0) / (63 * 62), 6) AS value FROM n LEFT JOIN bc USING (node)",
    "betweenness_by_node",
)(_node_measure("avg_betweenness_centrality"))

query(
    P + ", nb AS (SELECT i AS c, j AS node FROM g), ed AS (SELECT a.c, g.i, g.j FROM g JOIN nb a ON a.node = g.i JOIN nb b ON b.c = a.c AND b.node = g.j), "
    "lw(c, source, node, dist) AS (SELECT c, node, node, 0 FROM nb UNION SELECT lw.c, source, ed.j, dist + 1 FROM lw JOIN ed ON ed.c = lw.c AND lw.node = ed.i WHERE dist < 10), ls AS (SELECT c, source, node, min(dist) AS dist FROM lw GROUP BY c, source, node HAVING min(dist) > 0), "
    "le AS (SELECT c, sum(1.0 / dist) AS e FROM ls GROUP BY c) SELECT 0::BIGINT AS graph, 'local_eff' AS name, round(sum(CASE WHEN degree > 1 THEN coalesce(e, 0) / (degree * (degree - 1)) ELSE 0 END) / 64, 6) AS value FROM dg LEFT JOIN le ON c = node",
    "local_efficiency_avg",
)(lambda spark, d: _graph_measure(["local_eff"])(spark, d).withColumn("value", r6("value")))


query(
    G.replace("WITH ", "WITH RECURSIVE ", 1) + ", pr(t, node, x) AS (SELECT 0, node, 1.0::DOUBLE / 64 FROM n UNION ALL (SELECT pr.t + 1, v.node, 0.15 / 64 + 0.85 * sum(CASE WHEN dg.degree = 0 THEN x / 64 WHEN g.j IS NOT NULL THEN x / dg.degree ELSE 0 END) "
    "FROM pr JOIN dg ON dg.node = pr.node CROSS JOIN n v LEFT JOIN g ON g.i = pr.node AND g.j = v.node WHERE pr.t < 150 GROUP BY pr.t, v.node)) SELECT 'avg_pagerank_' || node AS name, round(x, 6) AS value FROM pr WHERE t = 150",
    "pagerank_by_node",
)(_node_measure("avg_pagerank"))


def _estimate(spark, d):
    return networks.network_estimate(networks.full_matrix(edges(spark, d)), ["avg_degree", "avg_cluster", "transitivity", "assortativity", "avg_triangles"], 0.2)


#: The graph at a density of 0.2 of all cells, the measures of which the estimator gives.
DENSE = T.replace("WHERE abs(w) >= 0.06", "WHERE abs(w) >= (SELECT abs(w) FROM m ORDER BY abs(w) DESC LIMIT 1 OFFSET 818)").replace(", k AS (", ", m AS (SELECT i, j, w FROM c UNION ALL SELECT j, i, w FROM c UNION ALL SELECT range::INT, range::INT, 1.0 FROM range(64)), k AS (", 1)

query(
    DENSE + " SELECT 'avg_degree' AS name, round(avg(degree), 6) AS value FROM dg UNION ALL SELECT 'avg_cluster', round(avg(clustering), 6) FROM ms UNION ALL SELECT 'avg_triangles', round(avg(triangles), 6) FROM ms "
    "UNION ALL SELECT 'transitivity', round(2.0 * sum(triangles) / sum(degree * (degree - 1)), 6) FROM ms UNION ALL SELECT 'assortativity', round(corr(a.degree, b.degree), 6) + 0.0 FROM g JOIN dg a ON g.i = a.node JOIN dg b ON g.j = b.node",
    "network_estimate",
)(lambda spark, d: _estimate(spark, d).withColumn("value", r6("value")))


# similarity of regions: values of subject by its label

GV = f"WITH {E}, r AS (SELECT label AS grp, v FROM e)"
KS = (
    "z AS (SELECT grp, count(*) AS n FROM u GROUP BY grp), pr AS (SELECT a.grp AS a, b.grp AS b, a.n AS na, b.n AS nb FROM z a JOIN z b ON a.grp < b.grp), "
    "p AS (SELECT a, b, v, 1.0::DOUBLE / na AS s FROM pr JOIN u ON grp = a UNION ALL SELECT a, b, v, -1.0::DOUBLE / nb FROM pr JOIN u ON grp = b), q AS (SELECT a, b, v, sum(s) AS s FROM p GROUP BY a, b, v), "
    "w AS (SELECT a, b, abs(sum(s) OVER (PARTITION BY a, b ORDER BY v)) AS d FROM q) SELECT a, b, round(1 - max(d), 6) AS w FROM w GROUP BY a, b"
)


def _groups(spark, d):
    return cohort(spark, d, "label").select(F.col("label").alias("grp"), "v")


for _kind, _v in {"ks": "v", "ks_demean": "v - avg(v) OVER (PARTITION BY grp)", "ks_normalize": "(v - avg(v) OVER (PARTITION BY grp)) / stddev_pop(v) OVER (PARTITION BY grp)"}.items():
    query(f"{GV}, u AS (SELECT grp, {_v} AS v FROM r), {KS}", f"roi_network_{_kind}")(lambda spark, d, kind=_kind: networks.ks_similarity(_groups(spark, d), kind).withColumn("w", r6("w")))


@query(
    f"{GV}, f AS (SELECT grp, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM r GROUP BY grp), gd AS (SELECT grp, h, k.range AS k, lo + (hi - lo) * k.range / 255.0::DOUBLE AS x FROM f, range(256) k), "
    "dn AS (SELECT gd.grp, k, sum(exp(-((x - v) / h) * ((x - v) / h) / 2)) AS p FROM gd JOIN r ON gd.grp = r.grp GROUP BY gd.grp, k), pp AS (SELECT grp, k, p / sum(p) OVER (PARTITION BY grp) AS p FROM dn), "
    "t AS (SELECT a.grp AS a, b.grp AS b, CASE WHEN a.p > 0 THEN a.p * ln(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * ln(2 * b.p / (a.p + b.p)) ELSE 0 END AS s FROM pp a JOIN pp b ON a.k = b.k AND a.grp < b.grp) "
    "SELECT a, b, round(1 - sqrt(greatest(0, sum(s) / 2)), 6) AS w FROM t GROUP BY a, b"
)
def roi_network_jsd(spark, d):
    return networks.jsd_similarity(_groups(spark, d)).withColumn("w", r6("w"))


@query(
    f"WITH {E}, u AS (SELECT subject, feat % 7 AS grp, v FROM e), z AS (SELECT subject, grp, count(*) AS n FROM u GROUP BY subject, grp), "
    "pr AS (SELECT a.subject, a.grp AS a, b.grp AS b, a.n AS na, b.n AS nb FROM z a JOIN z b ON a.subject = b.subject AND a.grp < b.grp), "
    "p AS (SELECT pr.subject, a, b, v, 1.0::DOUBLE / na AS s FROM pr JOIN u ON u.subject = pr.subject AND grp = a UNION ALL SELECT pr.subject, a, b, v, -1.0::DOUBLE / nb FROM pr JOIN u ON u.subject = pr.subject AND grp = b), "
    "q AS (SELECT subject, a, b, v, sum(s) AS s FROM p GROUP BY subject, a, b, v), w AS (SELECT subject, a, b, abs(sum(s) OVER (PARTITION BY subject, a, b ORDER BY v)) AS d FROM q) SELECT subject, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(1 - max(d), 6) AS w FROM w GROUP BY subject, a, b"
)
def region_network(spark, d):
    return networks.region_network(cohort(spark, d), labels7(spark), "ks").select("subject", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), r6("w").alias("w"))


@query(f"WITH {E}, u AS (SELECT label AS grp, CASE WHEN label = 3 THEN 1 ELSE v END AS v FROM e), g AS (SELECT DISTINCT grp FROM u) SELECT a.grp AS a, b.grp AS b, a.grp = 3 OR b.grp = 3 AS unknown FROM g a JOIN g b ON a.grp < b.grp")
def roi_network_constant(spark, d):
    """A region of one value has no density."""
    flat = _groups(spark, d).withColumn("v", F.when(F.col("grp") == 3, 1.0).otherwise(F.col("v")))
    return networks.jsd_similarity(flat).select("a", "b", F.col("w").isNull().alias("unknown"))


@query(f"WITH {E}, h AS (SELECT subject, feat, CASE WHEN (subject * 7 + feat) % 13 <> 0 THEN v END AS v FROM e WHERE (subject + feat) % 17 <> 0) SELECT a.feat AS i, b.feat AS j, round(corr(a.v, b.v), 6) + 0.0 AS w FROM h a JOIN h b ON a.subject = b.subject AND a.feat < b.feat WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.feat, b.feat")
def corr_network_nulls(spark, d):
    """Nulls, and rows that are missing altogether: each pair of features counts the subjects that have both."""
    long = holes(cohort(spark, d)).where("(subject + feat) % 17 <> 0")
    return networks.correlation_edges(long).withColumn("w", r6("w"))


# a grid of 20 x 20 vertices, two triangles in each cell, on the surface z = (x + 2 y) % 5 / 10

VX = "vx AS (SELECT range AS vertex, (range % 20)::DOUBLE AS x, (range // 20)::DOUBLE AS y, ((range % 20 + 2 * (range // 20)) % 5) / 10.0::DOUBLE AS z FROM range(400))"
TR = "q AS (SELECT range AS q, (range // 19) * 20 + range % 19 AS o FROM range(361)), tr AS (SELECT 2 * q AS tri, o AS a, o + 1 AS b, o + 20 AS c FROM q UNION ALL SELECT 2 * q + 1, o + 1, o + 21, o + 20 FROM q)"


def grid(spark):
    k = F.col("id")
    v = spark.range(400).select(k.alias("vertex"), (k % 20).cast("double").alias("x"), F.floor(k / 20).cast("double").alias("y"), ((k % 20 + 2 * F.floor(k / 20)) % 5 / F.lit(10.0)).alias("z"))
    q = spark.range(361).select(k.alias("q"), (F.floor(k / 19) * 20 + k % 19).alias("o"))
    t = q.select((2 * F.col("q")).alias("tri"), F.col("o").alias("a"), (F.col("o") + 1).alias("b"), (F.col("o") + 20).alias("c"))
    return v, t.unionByName(q.select((2 * F.col("q") + 1).alias("tri"), (F.col("o") + 1).alias("a"), (F.col("o") + 21).alias("b"), (F.col("o") + 20).alias("c")))


AREA = (
    "ar AS (SELECT tri, a, b, c, sqrt(pow((q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y), 2) + pow((q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z), 2) + pow((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x), 2)) / 6 AS s "
    "FROM tr JOIN vx p ON p.vertex = a JOIN vx q ON q.vertex = b JOIN vx r ON r.vertex = c), va AS (SELECT vertex, sum(s) AS area FROM (SELECT a AS vertex, s FROM ar UNION ALL SELECT b, s FROM ar UNION ALL SELECT c, s FROM ar) GROUP BY vertex)"
)


@query(f"WITH {VX}, {TR}, {AREA} SELECT vertex, round(area, 6) AS area FROM va")
def vertex_areas(spark, d):
    return geometry.vertex_areas(*grid(spark)).withColumn("area", r6("area"))


@query(f"WITH {VX}, {TR} SELECT tri, round((p.z + q.z + r.z) / 3, 6) AS value FROM tr JOIN vx p ON p.vertex = a JOIN vx q ON q.vertex = b JOIN vx r ON r.vertex = c")
def face_agg(spark, d):
    v, t = grid(spark)
    return geometry.face_values(t, v.select("vertex", F.col("z").alias("v"))).withColumn("value", r6("value"))


@query(f"WITH {TR} SELECT DISTINCT least(p, q) AS i, greatest(p, q) AS j FROM (SELECT a AS p, b AS q FROM tr UNION ALL SELECT b, c FROM tr UNION ALL SELECT c, a FROM tr)")
def mesh_edges(spark, d):
    return geometry.mesh_edges(grid(spark)[1])


#: Weights by rule: forward gathers three old nodes; reverse scatters two, to new nodes that don't always gather them.
FW = "fw AS (SELECT n.range AS new, (n.range * 2 + o.range * 3) % 50 AS old, (o.range + 1) / 6.0::DOUBLE AS w FROM range(40) n, range(3) o)"
RV = "rv AS (SELECT o.range AS old, (o.range * 3 + n.range * 7) % 40 AS new, CASE WHEN n.range = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS w FROM range(50) o, range(2) n WHERE o.range % 4 <> 0)"


def _weights(spark):
    n, o = spark.range(40).withColumnRenamed("id", "n"), spark.range(3).withColumnRenamed("id", "o")
    forward = n.crossJoin(o).select(F.col("n").alias("new"), ((F.col("n") * 2 + F.col("o") * 3) % 50).alias("old"), ((F.col("o") + 1) / F.lit(6.0)).alias("w"))
    n, o = spark.range(2).withColumnRenamed("id", "n"), spark.range(50).withColumnRenamed("id", "o").where("o % 4 <> 0")
    reverse = o.crossJoin(n).select(F.col("o").alias("old"), ((F.col("o") * 3 + F.col("n") * 7) % 40).alias("new"), F.when(F.col("n") == 0, 0.75).otherwise(0.25).alias("w"))
    return forward, reverse


@query(f"WITH {FW} SELECT new, round(sum(w * (old * 7 % 11)), 6) AS v FROM fw GROUP BY new")
def resample_weights(spark, d):
    old = spark.range(50).select(F.col("id").alias("old"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    return geometry.resample(old, _weights(spark)[0]).withColumn("v", r6("v"))


@query(
    f"WITH {FW}, {RV}, ur AS (SELECT DISTINCT new FROM rv WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.new = rv.new AND fw.old = rv.old)), "
    "ga AS (SELECT new, old, w FROM fw WHERE new NOT IN (SELECT new FROM ur) UNION ALL SELECT new, old, w FROM rv WHERE new IN (SELECT new FROM ur)), "
    "gb AS (SELECT new, old, w * (1 + new % 3) AS w FROM ga), gc AS (SELECT new, old, w * (1 + old % 4) / sum(w) OVER (PARTITION BY old) AS w FROM gb) SELECT new, old, round(w / sum(w) OVER (PARTITION BY new), 6) AS w FROM gc"
)
def adaptive_area_weights(spark, d):
    forward, reverse = _weights(spark)
    old = spark.range(50).select(F.col("id").alias("old"), (1 + F.col("id") % 4).cast("double").alias("area"))
    new = spark.range(40).select(F.col("id").alias("new"), (1 + F.col("id") % 3).cast("double").alias("area"))
    return geometry.adaptive_area_weights(forward, reverse, old, new).withColumn("w", r6("w"))


@query("WITH p AS (SELECT range AS new, (range % 7) + 0.25 AS x, (range % 5) + 0.5 AS y FROM range(35)) SELECT new, round((x * 2 + y * 3)::DOUBLE, 6) AS v FROM p")
def trilinear(spark, d):
    k = F.col("id")
    axis = lambda c: spark.range(12).select(F.col("id").cast("int").alias(c))
    volume = axis("i").crossJoin(axis("j")).crossJoin(axis("k")).select("i", "j", "k", (F.col("i") * 2.0 + F.col("j") * 3.0).alias("v"))
    points = spark.range(35).select(k.alias("new"), (k % 7 + F.lit(0.25)).cast("double").alias("x"), (k % 5 + F.lit(0.5)).cast("double").alias("y"), F.lit(3.4).cast("double").alias("z"))
    return geometry.trilinear(points, volume).withColumn("v", r6("v"))


@query()
def nearest_triangle(spark, d):
    v, t = grid(spark)
    k = F.col("id")
    points = spark.range(200).select(k.alias("new"), (k * 0.37 % 19).cast("double").alias("x"), (k * 0.73 % 19).cast("double").alias("y"), F.lit(0.3).alias("z"))
    return geometry.nearest_triangle_weights(points, v, t)


@query()
def random_parcellation(spark, d):
    e = geometry.mesh_edges(grid(spark)[1])
    both = e.select(F.col("i").alias("v"), F.col("j").alias("nbr")).unionByName(e.select(F.col("j").alias("v"), F.col("i").alias("nbr")))
    return geometry.random_parcellations(both, [0, 1, 2], 12, spark.range(4).select(F.col("id").alias("seed")))


@query("SELECT * FROM (VALUES (642, 'fsaverage3', false), (32492, '32k_fs_LR', false), (29696, '32k_fs_LR', true), (40962, 'civet', false), (163842, 'fsaverage', false), (100, 'native', false)) t(n, space, needs_wall)")
def infer_space(spark, d):
    lengths = spark.createDataFrame([(n,) for n in (642, 32492, 29696, 40962, 163842, 100)], "n int")
    return geometry.infer_space(lengths)


@query("SELECT CASE WHEN max(greatest(p_size, 60)) <= 76 THEN 2.0 WHEN max(p_size) <= 95 THEN 1.6 ELSE 1.0 END::DOUBLE AS resolution FROM part")
def volume_resolution(spark, d):
    return geometry.volume_resolution(table(spark, d, "part").select(F.col("p_size").alias("i"), F.lit(60).alias("j"), F.lit(3).alias("k")))


@query(M + ", f AS (SELECT j AS feat, min(w) AS lo, max(w) AS hi FROM m WHERE i % 2 = 0 GROUP BY j) SELECT i AS subject, j AS feat, round(least(1, greatest(0, (w - lo) / (hi - lo))), 6) + 0.0 AS v FROM m JOIN f ON j = feat")
def minmax_scaled(spark, d):
    from cohortix.operators import tabular

    long = networks.full_matrix(edges(spark, d)).select(F.col("i").alias("subject"), F.col("j").alias("feat"), F.col("w").alias("v"))
    return tabular.scale_apply(long, tabular.scale_fit(long.where("subject % 2 = 0"))).select("subject", "feat", r6("v").alias("v"))


@query(C + " SELECT node, round(sum(w), 6) + 0.0 AS degree FROM (SELECT i AS node, w FROM c UNION ALL SELECT j, w FROM c) GROUP BY node ORDER BY abs(sum(w)) DESC, node LIMIT 10")
def top_nodes(spark, d):
    return networks.top_nodes(edges(spark, d), 10).withColumn("degree", r6("degree"))


#: Distances over a ring of 12 nodes with chords, weights by rule.
RING = "WITH RECURSIVE rg AS (SELECT range AS i, (range + 1) % 12 AS j, 1.0 + range % 3 AS w FROM range(12) UNION ALL SELECT range, (range + 5) % 12, 2.5 FROM range(0, 12, 4)), bo AS (SELECT i, j, w::DOUBLE AS w FROM rg UNION ALL SELECT j, i, w::DOUBLE FROM rg), wd(node, dist, n) AS (SELECT 0::BIGINT, 0::DOUBLE, 0 UNION SELECT j, dist + w, n + 1 FROM wd JOIN bo ON node = i WHERE n < 8)"


@query(RING + " SELECT node, min(dist) AS dist FROM wd WHERE node <> 0 GROUP BY node ORDER BY min(dist), node LIMIT 6")
def nearest_nodes(spark, d):
    k = F.col("id")
    ring = spark.range(12).select(k.alias("i"), ((k + 1) % 12).alias("j"), (1.0 + k % 3).cast("double").alias("w"))
    chords = spark.range(0, 12, 4).select(k.alias("i"), ((k + 5) % 12).alias("j"), F.lit(2.5).alias("w"))
    return networks.nearest_nodes(ring.unionByName(chords), 0, 6)


@query()
def connected_threshold(spark, d):
    return networks.connecting_threshold(edges(spark, d), 0.9)


@query(
    f"WITH {E}, {ORTH.format(w='WHERE subject % 2 = 0')} {DISTANCE}, cr AS (SELECT i, j, corr(x, y) AS r, count(*) AS n FROM pr WHERE subject % 2 = 0 GROUP BY i, j), tt AS (SELECT i * 1000 + j AS id, i, j, r * sqrt((n - 2) / (1 - r * r)) AS t, n FROM cr), "
    f"{p_sql('tt', 't', '(n - 2)')} SELECT ds.i, ds.j, CASE WHEN any_value(p) <= 0.5 THEN count(*) ELSE 0 END AS n, CASE WHEN any_value(p) <= 0.5 THEN round(avg(distance), 6) END AS mean FROM ds JOIN pv ON pv.i = ds.i AND pv.j = ds.j GROUP BY ds.i, ds.j"
)
def significant_differences(spark, d):
    long = cohort(spark, d)
    reference = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("subject"))
    out = networks.significant_distances(networks.group_difference(long, reference), long, reference, 0.5)
    return out.groupBy("i", "j").agg(F.count("distance").alias("n"), r6(F.avg("distance")).alias("mean"))


#: Grayordinates by rule: 30 left vertices of 40, 10 voxels in two structures.
IX = "ix AS (SELECT range AS pos, CASE WHEN range < 30 THEN 'left' WHEN range < 36 THEN 'thalamus' ELSE 'caudate' END AS structure, CASE WHEN range < 30 THEN range + range // 3 END AS vertex, CASE WHEN range >= 30 THEN (range % 4)::INT END AS i FROM range(40))"


def _index(spark):
    k = F.col("id")
    s = F.when(k < 30, "left").when(k < 36, "thalamus").otherwise("caudate")
    v, i = F.when(k < 30, k + F.floor(k / 3)), F.when(k >= 30, (k % 4).cast("int"))
    return spark.range(40).select(k.alias("pos"), s.alias("structure"), v.alias("vertex"), i.alias("i"), i.alias("j"), i.alias("k"))


@query(f"WITH {IX} SELECT v.range AS vertex, coalesce(pos * 1.5, 0)::DOUBLE AS v FROM range(40) v LEFT JOIN ix ON ix.vertex = v.range")
def medial_wall_fill(spark, d):
    return geometry.surface_values(spark.range(40).select(F.col("id").alias("pos"), (F.col("id") * 1.5).cast("double").alias("v")), _index(spark), "left", 40)


@query(f"WITH {IX} SELECT i, i AS j, i AS k, structure, (pos * 1.5)::DOUBLE AS v FROM ix WHERE i IS NOT NULL")
def subcortical_volume(spark, d):
    return geometry.volume_values(spark.range(40).select(F.col("id").alias("pos"), (F.col("id") * 1.5).cast("double").alias("v")), _index(spark))


@query(f"WITH {IX} SELECT pos, CASE structure WHEN 'left' THEN vertex % 5 WHEN 'thalamus' THEN 5 ELSE 6 END::INT AS label FROM ix")
def parcels_by_position(spark, d):
    labels = spark.range(40).select(F.lit("left").alias("structure"), F.col("id").alias("vertex"), (F.col("id") % 5).alias("label"))
    return geometry.parcels_by_position(labels, _index(spark), ["left"])


@query()
def resampled_surface(spark, d):
    v, t = grid(spark)
    v = v.withColumn("z", F.col("z") + 10)
    values = v.select(F.col("vertex").alias("old"), F.lit(3.0).alias("v"))
    return geometry.resample_surface(values, (v, t), (v.withColumn("x", F.col("x") * 0.9 + 0.3), t)).withColumn("v", r6("v"))
