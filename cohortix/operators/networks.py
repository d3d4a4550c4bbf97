"""Networks: correlation matrices, thresholds, graph measures, similarity of regions' distributions, group differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortix.functions import graphs
from cohortix.shared import durable, kth_largest

from .stats import orthogonal_distance, orthogonal_fit, with_facts


def feature_pairs(long: DataFrame) -> DataFrame:
    """(i, j), i < j, of all features: of the features and not of the rows."""
    feats = long.select(F.col("feat").alias("i")).distinct()
    return feats.join(feats.select(F.col("i").alias("j")), F.col("i") < F.col("j"))


def pair_sums(long: DataFrame, block: int = 512, diagonal: bool = False) -> DataFrame:
    """(i, j, n, xy, x, y, xx, yy), i < j (or i <= j): sums over the subjects that have a value of both features.

    Each subject's row meets the matrix once: a task holds its subjects, sums the products of one pair of feature blocks
    after the other, and puts out sums by pair, so subjects x pairs are never shuffled and no task holds all pairs."""
    wide = long.where("v is not null").groupBy("subject").agg(F.collect_list(F.struct("feat", "v")).alias("_p"))
    wide = wide.select(F.transform("_p", lambda p: p.feat).alias("f"), F.transform("_p", lambda p: p.v).alias("x"))

    def gram(batches):
        rows = [(np.asarray(f), np.asarray(x, dtype=float)) for b in batches for f, x in zip(b["f"], b["x"])]
        if not rows:
            return
        feats = np.unique(np.concatenate([f for f, _ in rows]))
        m, has = np.zeros((len(rows), len(feats))), np.zeros((len(rows), len(feats)))
        for k, (f, x) in enumerate(rows):
            at = np.searchsorted(feats, f)
            m[k, at], has[k, at] = x, 1.0
        for a in range(0, len(feats), block):
            p, x = m[:, a : a + block], has[:, a : a + block]
            for c in range(a, len(feats), block):
                q, y = m[:, c : c + block], has[:, c : c + block]
                n = x.T @ y
                left, right = feats[a : a + block][:, None], feats[c : c + block][None, :]
                i, j = np.nonzero(((left <= right) if diagonal else (left < right)) & (n > 0))
                sums = {"n": n, "xy": p.T @ q, "x": p.T @ y, "y": x.T @ q, "xx": (p * p).T @ y, "yy": x.T @ (q * q)}
                yield pd.DataFrame({"i": feats[a + i], "j": feats[c + j], **{k: v[i, j] for k, v in sums.items()}})

    parts = wide.mapInPandas(gram, "i int, j int, n double, xy double, x double, y double, xx double, yy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")])


def correlation_edges(long: DataFrame, block: int = 512) -> DataFrame:
    """(i, j, w), i < j: correlations of all pairs of features, over the subjects that have a value of both.

    Null and missing values don't count; pairs without two subjects in common, or of a constant, have null."""
    sums = pair_sums(long, block)
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    size = F.sqrt((F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2))
    return sums.select("i", "j", F.try_divide(cov, size).alias("w"))


def full_matrix(edges: DataFrame, diagonal: float = 1.0) -> DataFrame:
    """All cells of a symmetric matrix from its upper triangle, the diagonal too.

    Both cells of an edge come from one row: sums that are made twice may differ in their last bit, and a threshold would part them."""
    cell = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "w")
    both = edges.select(F.inline(F.array(cell("i", "j"), cell("j", "i"))))
    return both.unionByName(both.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(diagonal).alias("w")))


def keeps(kind: str, cut) -> object:
    w = F.col("w")
    return {"abs": F.abs(w) >= cut, "pos": w >= cut, "neg": w <= cut}[kind]


def threshold_value(cells: DataFrame, cut: float, kind: str = "abs") -> DataFrame:
    """Cells that pass: |w| >= cut, w >= cut, or for `neg` w <= cut."""
    return cells.where(keeps(kind, cut))


def threshold_density(cells: DataFrame, density: float, kind: str = "abs") -> DataFrame:
    """Cells as strong as the one of place round(cells x density) - 1 (0 at least), ties kept; of all cells, diagonal and all.

    Cells are written to the shared folder once; the threshold is found from counts of equal bins."""
    value = {"abs": F.abs("w"), "pos": F.col("w"), "neg": -F.col("w")}[kind]
    cells = durable(cells)
    cut = kth_largest(cells, value, max(round(cells.count() * density) - 1, 0))
    return cells.where(value >= F.lit(cut))


def threshold_relaxed(cells: DataFrame, cut: float, step: float = 0.01, kind: str = "abs") -> DataFrame:
    """(steps, threshold): how often cut has to be relaxed by step until a cell passes."""
    best = {"abs": F.max(F.abs("w")), "pos": F.max("w"), "neg": F.min("w")}[kind]
    gap = F.lit(cut) - F.col("b") if kind != "neg" else F.col("b") - F.lit(cut)
    steps = F.greatest(F.lit(0), F.ceil(gap / F.lit(step) - F.lit(1e-9))).cast("int")
    moved = F.lit(cut) - F.col("steps") * F.lit(step) if kind != "neg" else F.lit(cut) + F.col("steps") * F.lit(step)
    return cells.agg(best.alias("b")).select(steps.alias("steps")).select("steps", moved.alias("threshold"))


def mean_std_edges(cells: DataFrame, n_std: float | None) -> DataFrame:
    """Cells above the mean plus n_std population standard deviations of all; None keeps all."""
    if n_std is None:
        return cells
    facts = cells.agg((F.avg("w") + F.lit(n_std) * F.stddev_pop("w")).alias("_cut"))
    return cells.crossJoin(F.broadcast(facts)).where(F.col("w") > F.col("_cut")).drop("_cut")


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where("i <> j").select("i", "j")
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    ends = both_ways(edges).groupBy(F.col("i").alias("node")).agg(F.count("*").alias("d"))
    loops = edges.where("i = j").groupBy(F.col("i").alias("node")).agg((F.count("*") * 2).alias("l"))
    return nodes.join(ends, "node", "left").join(loops, "node", "left").select("node", (F.coalesce("d", F.lit(0)) + F.coalesce("l", F.lit(0))).alias("degree"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): sums of weights of edges i < j at both ends."""
    return edges.select(F.col("i").alias("node"), "w").unionByName(edges.select(F.col("j").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("degree"))


def triangles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering), loops aside: wedges are opened at the end of smaller degree only."""
    both = both_ways(edges)
    deg = both.groupBy("i").agg(F.count("*").alias("d"))
    ranked = both.join(deg, "i").join(deg.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    up = ranked.where((F.col("d") < F.col("dj")) | ((F.col("d") == F.col("dj")) & (F.col("i") < F.col("j")))).select("i", "j")
    wedge = up.select(F.col("i").alias("a"), F.col("j").alias("b")).join(up.select(F.col("i").alias("a"), F.col("j").alias("c")), "a").where("b < c")
    found = wedge.join(both.select(F.col("i").alias("b"), F.col("j").alias("c")), ["b", "c"])
    counts = found.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    out = nodes.join(deg.select(F.col("i").alias("node"), "d"), "node", "left").join(counts, "node", "left")
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("triangles", F.lit(0))
    return out.select("node", d.alias("degree"), t.alias("triangles"), F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def transitivity(measures: DataFrame) -> DataFrame:
    """(transitivity): closed wedges among all, from triangles(); NaN where there are none, null without nodes."""
    pairs = F.sum(F.col("degree") * (F.col("degree") - 1)).cast("double")
    return measures.agg(F.when(pairs == 0, float("nan")).otherwise(F.try_divide(2.0 * F.sum("triangles"), pairs)).alias("transitivity"))


def assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(assortativity): correlation of the degrees at both ends of all edges, both ways."""
    d = degrees(edges.where("i <> j"), nodes)
    both = both_ways(edges).join(d.select(F.col("node").alias("i"), F.col("degree").alias("a")), "i").join(d.select(F.col("node").alias("j"), F.col("degree").alias("b")), "j")
    return both.agg(F.corr("a", "b").alias("assortativity"))


def graph_measures(edges: DataFrame, nodes: DataFrame, names: list, seed: int = 0, most_nodes: int = 20_000, each: bool = False) -> DataFrame:
    """(graph, name, value) of measures that need a whole graph at once; graphs run in parallel, one in a task.

    edges: (graph, i, j); nodes: (graph, node). names: measures by name, or (name, function of adjacency and seed). A
    measure with a value for each node is averaged, or, with each, put out as `<name>_<place of the node>`."""
    known = [(n, graphs.MEASURES[n]) if isinstance(n, str) else n for n in names]

    def measured(key, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(n["node"].unique())
        if len(ids) > most_nodes:
            raise ValueError(f"a graph of more than {most_nodes} nodes")
        a = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, e["i"].to_numpy()), np.searchsorted(ids, e["j"].to_numpy())
        a[i, j] = a[j, i] = 1.0
        rows = []
        for name, measure in known:
            value = np.asarray(measure(a, seed), dtype=float)
            rows += [(key[0], f"{name}_{k}", float(v)) for k, v in enumerate(value)] if each and value.ndim else [(key[0], name, float(value.mean()))]
        return pd.DataFrame(rows, columns=["graph", "name", "value"])

    return nodes.groupBy("graph").cogroup(edges.groupBy("graph")).applyInPandas(lambda key, n, e: measured(key, e, n), "graph long, name string, value double")


#: Measures that are plans over all edges, beside those of graphs that fit one task.
PLANS = ("avg_degree", "avg_triangles", "transitivity", "assortativity")


def network_estimate(cells: DataFrame, measures: list[str], cut: float = 0.2, by: str = "density", kind: str = "abs", step: float = 0.01, relax: bool = True, seed: int = 0) -> DataFrame:
    """(name, value) of the measures of the network that a symmetric matrix (i, j, w), diagonal and all, has above a threshold.

    by: `density`, a share of all cells, or `value`. Where no edge passes, the threshold is relaxed by step until one does,
    unless relax is False, which makes that an error. Unknown names, kinds and shares are errors before anything runs."""
    unknown = [m for m in measures if m not in PLANS and m not in graphs.MEASURES]
    if unknown or not measures:
        raise ValueError(f"unknown measures {unknown}" if unknown else "no measures")
    if by not in ("density", "value") or kind not in ("abs", "pos", "neg") or step <= 0 or by == "density" and not 0 < cut <= 1:
        raise ValueError("by is density (a share in 0..1) or value, kind abs, pos or neg, and step is above 0")
    cells = durable(cells)
    nodes = cells.select(F.col("i").alias("node")).distinct()
    found = threshold_density(cells, cut, kind) if by == "density" else threshold_value(cells, cut, kind)
    edges = durable(found.where("i < j"))
    if edges.isEmpty():
        if not relax:
            raise ValueError("no edge passes the threshold")
        strong = cells.where("i < j")
        first = cut if by == "value" else kth_largest(strong, {"abs": F.abs("w"), "pos": F.col("w"), "neg": -F.col("w")}[kind], 0) * (-1 if kind == "neg" else 1)
        edges = durable(threshold_value(strong, threshold_relaxed(strong, first, step, kind).first()["threshold"], kind))
    rows = []
    shape = triangles(edges, nodes)
    for m in dict.fromkeys(measures):
        if m == "avg_degree":
            rows.append(degrees(edges, nodes).agg(F.avg("degree").alias("value")))
        elif m == "avg_triangles":
            rows.append(shape.agg(F.avg("triangles").alias("value")))
        elif m == "transitivity":
            rows.append(transitivity(shape).select(F.col("transitivity").alias("value")))
        elif m == "assortativity":
            rows.append(assortativity(edges, nodes).select(F.col("assortativity").alias("value")))
        else:
            graph = F.lit(0).cast("long").alias("graph")
            rows.append(graph_measures(edges.select(graph, "i", "j"), nodes.select(graph, "node"), [m], seed).select("value"))
        rows[-1] = rows[-1].select(F.lit(m).alias("name"), "value")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def shortest_paths(edges: DataFrame, nodes: DataFrame, every: int = 4) -> DataFrame:
    """(source, node, dist) of all reachable pairs of distinct nodes, breadth first, until nothing new is reached.

    Each turn's front is written to the shared folder, and what is reached every few turns, so plans stay short and lost
    executors cost one turn."""
    both = durable(both_ways(edges))
    reached = nodes.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"))
    front, d = reached, 0
    while True:
        d += 1
        new = front.join(both.select(F.col("i").alias("node"), F.col("j").alias("to")), "node").select("source", F.col("to").alias("node")).distinct()
        new = durable(new.join(reached.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(d)))
        if new.isEmpty():
            return reached.where("dist > 0")
        reached, front = reached.unionByName(new), new
        if d % every == 0:
            reached = durable(reached)


def path_measures(paths: DataFrame, n: int) -> DataFrame:
    """(global_efficiency, avg_closeness, avg_path) of a graph of n nodes; closeness is scaled by the share that is reached. Without paths all are null.

    try_divide, since the plan of a graph without edges has distances of 0 that are filtered out, and folds them before."""
    by_node = paths.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("k"), F.sum("dist").alias("s"))
    close = by_node.agg((F.sum(F.try_divide(F.col("k") * F.col("k"), F.col("s"))) / F.lit(float((n - 1) * n))).alias("avg_closeness"))
    rest = paths.agg((F.sum(F.try_divide(F.lit(1.0), "dist")) / F.lit(float(n * (n - 1)))).alias("global_efficiency"), F.avg("dist").alias("avg_path"))
    return rest.crossJoin(close).select("global_efficiency", "avg_closeness", "avg_path")


def largest_component(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, largest, ratio) from the pairs that reach one another."""
    sizes = nodes.join(paths.groupBy(F.col("source").alias("node")).agg((F.count("*") + 1).alias("s")), "node", "left")
    return sizes.agg(F.count("*").alias("nodes"), F.max(F.coalesce("s", F.lit(1))).alias("largest")).withColumn("ratio", F.col("largest") / F.col("nodes"))


def scale_weights(edges: DataFrame, invert: bool = False) -> DataFrame:
    """|w| scaled to 0..1, the sign kept; invert: 1 less that of |w|."""
    facts = edges.agg(F.min(F.abs("w")).alias("_lo"), F.max(F.abs("w")).alias("_hi"))
    s = F.try_divide(F.abs("w") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    out = 1 - s if invert else s * F.signum("w")
    return edges.crossJoin(F.broadcast(facts)).withColumn("w", out).drop("_lo", "_hi")


# Similarity of the distributions of values in two regions.


def prepared(values: DataFrame, kind: str, of: list[str]) -> DataFrame:
    """(of, grp, v) as they are, without their group's mean, or as its z scores (population); those of a constant group are 0."""
    if kind == "ks":
        return values
    facts = values.groupBy(*of, "grp").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    v = F.col("v") - F.col("_m")
    score = F.coalesce(F.try_divide(v, F.col("_s")), F.lit(0.0)) if kind == "ks_normalize" else v
    return values.join(facts, [*of, "grp"]).select(*of, "grp", score.alias("v"))


def ks_similarity(values: DataFrame, kind: str = "ks", of: list[str] = []) -> DataFrame:  # noqa: B006
    """(of, a, b, w), a < b: 1 less the largest distance of two groups' cumulative distributions; nulls don't count. of: columns that groups lie within."""
    values = prepared(values.where("v is not null"), kind, of)
    counts = values.groupBy(*of, "grp", "v").agg(F.count("*").alias("c"))  # equal values of a group meet other groups once
    sizes = counts.groupBy(*of, "grp").agg(F.sum("c").alias("n"))
    groups = sizes.select(*of, F.col("grp").alias("a"), F.col("n").alias("na"))
    other = groups.select(*of, F.col("a").alias("b"), F.col("na").alias("nb"))
    pairs = (groups.join(other, of) if of else groups.crossJoin(other)).where("a < b")
    one = lambda name: counts.select(*of, F.col("grp").alias(name), "v", "c")
    rows = pairs.join(one("a"), [*of, "a"]).select(*of, "a", "b", "v", (F.col("c") / F.col("na")).alias("s"))
    rows = rows.unionByName(pairs.join(one("b"), [*of, "b"]).select(*of, "a", "b", "v", (-F.col("c") / F.col("nb")).alias("s")))
    steps = rows.groupBy(*of, "a", "b", "v").agg(F.sum("s").alias("s"))
    run = F.sum("s").over(Window.partitionBy(*of, "a", "b").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("d", F.abs(run)).groupBy(*of, "a", "b").agg((1 - F.max("d")).alias("w"))


def jsd_similarity(values: DataFrame, points: int = 256, of: list[str] = []) -> DataFrame:  # noqa: B006
    """(of, a, b, w), a < b: 1 less the Jensen-Shannon distance of two groups' density estimates, each on its own grid from least to largest value.

    A constant group, or one of a single value, has no density, and its similarities are null; null values don't count."""
    values = values.where("v is not null")
    facts = values.groupBy(*of, "grp").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("s"))
    facts = facts.withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = facts.select(*of, "grp", "h", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "lo", "hi").withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / F.lit(float(points - 1)))
    z = F.try_divide(F.col("x") - F.col("v"), F.col("h"))
    density = grid.join(values, [*of, "grp"]).groupBy(*of, "grp", "k").agg(F.sum(F.exp(-z * z / 2)).alias("p"))
    total = density.groupBy(*of, "grp").agg(F.sum("p").alias("t"))
    p = density.join(total, [*of, "grp"]).select(*of, "grp", "k", F.try_divide("p", "t").alias("p"))
    both = p.select(*of, F.col("grp").alias("a"), "k", F.col("p").alias("pa")).join(p.select(*of, F.col("grp").alias("b"), "k", F.col("p").alias("pb")), [*of, "k"]).where("a < b")
    m = (F.col("pa") + F.col("pb")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / m)).when(F.col(c) == 0, 0.0)
    total = F.sum(part("pa") + part("pb")) / 2
    return both.groupBy(*of, "a", "b").agg(F.when(total.isNotNull(), 1 - F.sqrt(F.greatest(F.lit(0.0), total))).alias("w"))


def region_network(long: DataFrame, labels: DataFrame, metric: str = "jsd") -> DataFrame:
    """(subject, a, b, w) of each subject, for all pairs of labels, background too."""
    values = long.join(labels, "feat").select("subject", F.col("label").alias("grp"), "v")
    return jsd_similarity(values, of=["subject"]) if metric == "jsd" else ks_similarity(values, metric, ["subject"])


def group_difference(long: DataFrame, reference: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(subject, i, j, distance): distance of each subject to the lines that fit the reference subjects."""
    pairs = feature_pairs(long) if pairs is None else pairs
    fits = orthogonal_fit(long.join(reference.select("subject"), "subject", "left_semi"), pairs)
    return orthogonal_distance(long, fits)


def weighted_distances(edges: DataFrame, source: int) -> DataFrame:
    """(node, dist): least sums of weights from source over undirected edges (i, j, w), w >= 0; unreachable nodes are absent.

    Each turn relaxes the edges of nodes whose distance fell, until none does; negative weights are an error."""
    both = durable(edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")))
    if not both.where("w < 0").isEmpty():
        raise ValueError("distances need weights of 0 or more")
    known = edges.sparkSession.createDataFrame([(source, 0.0)], "node long, dist double")
    front = known
    while True:
        new = front.join(both, F.col("node") == F.col("i")).groupBy(F.col("j").cast("long").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        front = durable(new.join(known, "node", "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("node", F.col("new").alias("dist")))
        if front.isEmpty():
            return known
        known = durable(known.unionByName(front).groupBy("node").agg(F.min("dist").alias("dist")))


def nearest_nodes(edges: DataFrame, node: int, k: int) -> DataFrame:
    """(node, dist) of the k nodes nearest to one by weighted distance, ties by number."""
    return weighted_distances(edges, node).where(F.col("node") != node).orderBy("dist", "node").limit(k)


def top_nodes(edges: DataFrame, k: int) -> DataFrame:
    """(node, degree) of the k nodes of largest |weighted degree|, ties by number."""
    return weighted_degrees(edges).orderBy(F.desc(F.abs("degree")), "node").limit(k)


def connecting_threshold(edges: DataFrame, cut: float, ratio: float = 1.0, step: float = 0.01, kind: str = "abs", most_nodes: int = 20_000) -> DataFrame:
    """(steps, threshold): how often cut has to be relaxed by step until the largest component holds a share of ratio of all nodes.

    edges: (i, j, w) of one graph of bounded size, joined strongest first until they hold enough together."""

    def joined(key, e: pd.DataFrame) -> pd.DataFrame:
        strength = e["w"].abs() if kind == "abs" else e["w"] if kind == "pos" else -e["w"]
        order = np.argsort(-strength.to_numpy(), kind="stable")
        nodes = np.unique(np.concatenate((e["i"], e["j"])))
        if len(nodes) > most_nodes:
            raise ValueError(f"a graph of more than {most_nodes} nodes")
        root, size = {n: n for n in nodes.tolist()}, dict.fromkeys(nodes.tolist(), 1)

        def find(n):
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        goal = cut if kind != "neg" else -cut
        for o in order:
            a, b = find(int(e["i"].iloc[o])), find(int(e["j"].iloc[o]))
            if a != b:
                root[b], size[a] = a, size[a] + size[b]
                if size[a] >= ratio * len(nodes) - 1e-9:
                    goal = min(goal, float(strength.iloc[o]))
                    break
        first = cut if kind != "neg" else -cut
        steps = max(0, int(np.ceil((first - goal) / step - 1e-9)))
        return pd.DataFrame({"steps": [steps], "threshold": [cut - steps * step if kind != "neg" else cut + steps * step]})

    return edges.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda key, e: joined(key, e), "steps int, threshold double")


def significant_distances(distances: DataFrame, long: DataFrame, reference: DataFrame, p_threshold: float) -> DataFrame:
    """distances of group_difference(), null for pairs whose correlation in the reference group has a p above p_threshold."""
    from cohortix.functions import special

    group = long.join(reference.select("subject"), "subject", "left_semi")
    n = reference.count()

    def with_p(batches):
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "j": b["j"], "p": special.pearson_p(b["w"], np.full(len(b), n))})

    p = correlation_edges(group).mapInPandas(with_p, "i int, j int, p double")
    return with_facts(distances, p).withColumn("distance", F.when(F.col("p") <= p_threshold, F.col("distance"))).drop("p")
