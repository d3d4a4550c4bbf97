"""Meshes and volumes: areas, resampling weights, nearest triangles, growing parcels, space inference."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corners(triangles: DataFrame) -> DataFrame:
    """(tri, vertex) for the three corners of (tri, a, b, c)."""
    return triangles.select("tri", F.explode(F.array("a", "b", "c")).alias("vertex"))


def vertex_areas(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vertex, area): a third of the area of each triangle at the vertex. vertices: (vertex, x, y, z)."""
    out = triangles
    for c in "abc":
        out = out.join(vertices.select(F.col("vertex").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c)
    u, w = [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"], [F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz"]
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    area = F.sqrt(sum((x * x for x in cross[1:]), cross[0] * cross[0])) / 2
    return out.select(F.explode(F.array("a", "b", "c")).alias("vertex"), (area / 3).alias("_a")).groupBy("vertex").agg(F.sum("_a").alias("area"))


def face_values(triangles: DataFrame, values: DataFrame, how: str = "mean") -> DataFrame:
    """(tri, value): mean, median, min or max of the values (vertex, v) at the corners."""
    reduce = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[how]
    return corners(triangles).join(values, "vertex").groupBy("tri").agg(reduce("v").alias("value"))


def resample(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(new, v): weighted sums of old values. weights: (new, old, w); values: (old, v)."""
    return weights.join(values, "old").groupBy("new").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def adaptive_area_weights(forward: DataFrame, reverse: DataFrame, old_areas: DataFrame, new_areas: DataFrame) -> DataFrame:
    """(new, old, w): barycentric weights corrected for areas, each new node's adding up to 1.

    forward: (new, old, w) gathers old nodes; reverse: (old, new, w) scatters them. A new node uses its reverse weights if
    they reach an old node that its forward weights don't."""
    scattered = reverse.select("new", "old", "w")
    use_reverse = scattered.join(forward, ["new", "old"], "left_anti").select("new").distinct()
    gather = forward.select("new", "old", "w").join(use_reverse, "new", "left_anti").unionByName(scattered.join(use_reverse, "new", "left_semi"))
    gather = gather.join(new_areas.select("new", F.col("area").alias("_na")), "new").withColumn("w", F.col("w") * F.col("_na"))
    by_old = gather.groupBy("old").agg(F.sum("w").alias("_so")).join(old_areas.select("old", F.col("area").alias("_oa")), "old")
    gather = gather.join(by_old, "old").withColumn("w", F.try_divide(F.col("w") * F.col("_oa"), F.col("_so")))
    by_new = gather.groupBy("new").agg(F.sum("w").alias("_sn"))
    return gather.join(by_new, "new").select("new", "old", F.when(F.col("_sn") != 0, F.col("w") / F.col("_sn")).otherwise(F.col("w")).alias("w"))


def mid_surface(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vertex, x, y, z): halfway between two surfaces."""
    right = b.select("vertex", *[F.col(k).alias(f"_{k}") for k in "xyz"])
    return a.join(right, "vertex").select("vertex", *[((F.col(k) + F.col(f"_{k}")) / 2).alias(k) for k in "xyz"])


def change_radius(vertices: DataFrame, radius: float = 100.0) -> DataFrame:
    """Vertices at one distance from the origin."""
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return vertices.select("vertex", *[F.try_divide(F.col(k) * radius, size).alias(k) for k in "xyz"])


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """(i, j), i < j: each edge of the mesh once."""
    e = triangles.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("c").alias("q")), F.struct(F.col("c").alias("p"), F.col("a").alias("q")))).alias("e"))
    return e.select(F.least("e.p", "e.q").alias("i"), F.greatest("e.p", "e.q").alias("j")).distinct()


def barycentric(point: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, weights) of a point to triangles [n, 3, 3]: weights of the nearest point of each, on its face, an edge or a corner."""
    a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
    ab, ac, ap = b - a, c - a, point - a
    d1, d2, d3, d4, d5 = (ab * ap).sum(1), (ac * ap).sum(1), (ab * ab).sum(1), (ab * ac).sum(1), (ac * ac).sum(1)
    den = d3 * d5 - d4 * d4
    with np.errstate(divide="ignore", invalid="ignore"):
        v, w = (d5 * d1 - d4 * d2) / den, (d3 * d2 - d4 * d1) / den
    face = (v >= 0) & (w >= 0) & (v + w <= 1) & (den > 0)
    weights = np.stack((1 - v - w, v, w), axis=1)
    best = np.full(len(tri), np.inf)
    out = np.zeros((len(tri), 3))
    best[face] = np.linalg.norm((weights[face, :, None] * tri[face]).sum(1) - point, axis=1)
    out[face] = weights[face]
    for i, j in ((0, 1), (1, 2), (2, 0)):
        e = tri[:, j] - tri[:, i]
        size = (e * e).sum(1)
        t = np.clip(np.divide((e * (point - tri[:, i])).sum(1), size, out=np.zeros(len(tri)), where=size > 0), 0, 1)
        d = np.linalg.norm(tri[:, i] + t[:, None] * e - point, axis=1)
        nearer = d < best - 1e-12
        best[nearer] = d[nearer]
        out[nearer] = 0
        out[nearer, i], out[nearer, j] = 1 - t[nearer], t[nearer]
    return best, out


#: Rings of cells that a point looks at before it looks at all triangles, and edges of one mesh at most.
RINGS, MOST_EDGES = 12, 20_000_000


def nearest_triangle_weights(points: DataFrame, vertices: DataFrame, triangles: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(new, old, w): barycentric weights of each point (new, x, y, z) in its nearest triangle, weights of 0 left out.

    The mesh, of bounded size, goes to every task; points are independent. A point looks at the triangles of the cells of
    a grid around it, ring after ring, until no triangle beyond can be nearer; points far from the mesh look at all."""
    v, t = vertices.limit(most + 1).collect(), triangles.limit(most + 1).collect()
    if max(len(v), len(t)) > most:
        raise ValueError(f"a mesh of more than {most} parts")
    at = {r["vertex"]: np.array([r["x"], r["y"], r["z"]], dtype=float) for r in v}
    t.sort(key=lambda r: r["tri"])
    ids = np.array([[r["a"], r["b"], r["c"]] for r in t])
    tri = np.array([[at[i] for i in row] for row in ids.tolist()])
    centre = tri.mean(axis=1)
    radius = np.linalg.norm(tri - centre[:, None], axis=2).max(axis=1)

    low, side = centre.min(axis=0), max(2 * float(np.median(radius)), float(np.ptp(centre, axis=0).max()) / 256, 1e-12)
    cells: dict[tuple, list[int]] = {}
    for k, c in enumerate(np.floor((centre - low) / side).astype(np.int64).tolist()):
        cells.setdefault(tuple(c), []).append(k)
    widest = float(radius.max())

    def around(p: np.ndarray) -> np.ndarray:
        """Triangles that may be the nearest to p, in order."""
        at = np.floor((p - low) / side).astype(np.int64).tolist()
        seen: list[int] = []
        for ring in range(RINGS):
            span = range(-ring, ring + 1)
            seen += [k for i in span for j in span for m in (span if max(abs(i), abs(j)) == ring else {-ring, ring}) for k in cells.get((at[0] + i, at[1] + j, at[2] + m), ())]
            if seen and ring * side - widest > (np.linalg.norm(centre[seen] - p, axis=1) + radius[seen]).min():
                return np.array(sorted(seen))
        return np.arange(len(centre))

    def found(batches):
        for b in batches:
            rows = []
            for new, p in zip(b["new"], b[["x", "y", "z"]].to_numpy(dtype=float)):
                some = around(p)
                far = np.linalg.norm(centre[some] - p, axis=1)
                near = some[far - radius[some] <= (far + radius[some]).min()]
                d, w = barycentric(p, tri[near])
                k = int(np.argmin(d))
                rows += [(new, int(i), float(x)) for i, x in zip(ids[near[k]], w[k]) if x > 0]
            yield pd.DataFrame(rows, columns=["new", "old", "w"])

    return points.mapInPandas(found, "new bigint, old bigint, w double")


def grow_parcels(adjacency: dict[int, list[int]], n_parcels: int, walls: set[int], seed: int) -> dict[int, int]:
    """Label 1 to n_parcels of each vertex that is no wall, 0 of walls and of what no parcel reaches.

    Seeds are the first vertices in a shuffled order; parcels take turns, drawn with weights of their own, and each adds a
    free neighbour, the first in a shuffled order."""
    free = sorted(set(adjacency) - walls, key=lambda v: hashlib.md5(f"{seed}:{v}".encode()).hexdigest())
    if n_parcels > len(free):
        raise ValueError("more parcels than vertices")
    rank = {v: k for k, v in enumerate(free)}
    rng = np.random.default_rng(seed)
    weight = rng.random(n_parcels) + 0.1
    label = dict.fromkeys(adjacency, 0)
    border: list[set[int]] = []
    for p, v in enumerate(free[:n_parcels], 1):
        label[v] = p
    for v in free[:n_parcels]:
        border.append({w for w in adjacency[v] if w in rank and not label[w]})
    live = [p for p in range(n_parcels) if border[p]]
    while live:
        share = weight[live] / weight[live].sum()
        p = live[int(rng.choice(len(live), p=share))]
        border[p] = {v for v in border[p] if not label[v]}
        if border[p]:
            v = min(border[p], key=rank.__getitem__)
            label[v] = p + 1
            border[p] |= {w for w in adjacency[v] if w in rank and not label[w]}
            border[p].discard(v)
        live = [q for q in live if border[q]]
    return label


def random_parcellations(adjacency: DataFrame, walls: list[int], n_parcels: int, seeds: DataFrame) -> DataFrame:
    """(seed, vertex, label) of one parcellation for each seed; a parcellation grows in one task, seeds in parallel. adjacency: (v, nbr)."""
    rows: dict[int, list[int]] = {}
    edges = adjacency.limit(MOST_EDGES + 1).collect()  # one mesh
    if len(edges) > MOST_EDGES:
        raise ValueError(f"a mesh of more than {MOST_EDGES} edges")
    for r in edges:
        rows.setdefault(r["v"], []).append(r["nbr"])
    if bad := set(walls) - set(rows):
        raise IndexError(f"walls that are no vertices: {sorted(bad)[:5]}")

    def grown(batches):
        for b in batches:
            out = [(int(s), int(v), int(p)) for s in b["seed"] for v, p in grow_parcels(rows, n_parcels, set(walls), int(s)).items()]
            yield pd.DataFrame(out, columns=["seed", "vertex", "label"])

    return seeds.mapInPandas(grown, "seed bigint, vertex bigint, label int")


def trilinear(points: DataFrame, volume: DataFrame) -> DataFrame:
    """(new, v) at points (new, x, y, z), in voxel coordinates, of a volume (i, j, k, v); corners outside count as 0."""
    base = points.select("new", *[F.floor(c).cast("int").alias(f"{c}0") for c in "xyz"], *[(F.col(c) - F.floor(c)).alias(f"{c}f") for c in "xyz"])
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    share = lambda c, o: F.when(F.col(f"o.{o}") == 1, F.col(f"{c}f")).otherwise(1 - F.col(f"{c}f"))
    eight = base.select("*", F.explode(offsets).alias("o")).select("new", (F.col("x0") + F.col("o.a")).alias("i"), (F.col("y0") + F.col("o.b")).alias("j"), (F.col("z0") + F.col("o.c")).alias("k"), (share("x", "a") * share("y", "b") * share("z", "c")).alias("w"))
    return eight.join(volume, ["i", "j", "k"], "left").groupBy("new").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))


# Vertices of one hemisphere in each space, with and without its medial wall where the latter differs.
SPACES = [
    ("civet", 40962, 40962), ("fsaverage", 163842, 149955), ("41k_fsaverage", 40962, 37476), ("fsaverage5", 10242, 9354), ("fsaverage4", 2562, 2329),
    ("fsaverage3", 642, 578), ("164k_fs_LR", 163842, 149141), ("59k_fs_LR", 59292, 54216), ("32k_fs_LR", 32492, 29696), ("8k_fs_LR", 7842, 7270), ("4k_fs_LR", 4002, 3664),
]


def infer_space(lengths: DataFrame) -> DataFrame:
    """(n, space, needs_wall) for each array length: a space's full length before one without medial wall, in the list's order; else native."""
    spark = lengths.sparkSession
    rows = [(i, s, full, False) for i, (s, full, _) in enumerate(SPACES)] + [(100 + i, s, bare, True) for i, (s, full, bare) in enumerate(SPACES) if bare != full]
    known = spark.createDataFrame(rows, "rank int, space string, n long, needs_wall boolean")
    best = known.groupBy("n").agg(F.min_by(F.struct("space", "needs_wall"), "rank").alias("_s"))
    return lengths.select("n").distinct().join(F.broadcast(best), "n", "left").select("n", F.coalesce("_s.space", F.lit("native")).alias("space"), F.coalesce("_s.needs_wall", F.lit(False)).alias("needs_wall"))


def volume_resolution(voxels: DataFrame) -> DataFrame:
    """(resolution): 2 mm where the largest voxel index is 76 or less, 1.6 mm to 95, else 1 mm. voxels: (i, j, k)."""
    top = voxels.agg(F.max(F.greatest("i", "j", "k")).alias("m"))
    return top.select(F.when(F.col("m") <= 76, 2.0).when(F.col("m") <= 95, 1.6).otherwise(1.0).alias("resolution"))


# Grayordinates: one vector of values by position, with an index (pos, structure, vertex, i, j, k) that says where each belongs.


def surface_values(values: DataFrame, index: DataFrame, structure: str, n_vertices: int) -> DataFrame:
    """(vertex, v) of all vertices of one surface: values of its positions, 0 elsewhere (the medial wall)."""
    spark = values.sparkSession
    known = index.where(F.col("structure") == structure).select("pos", "vertex").join(values, "pos")
    return spark.range(n_vertices).select(F.col("id").alias("vertex")).join(known, "vertex", "left").select("vertex", F.coalesce("v", F.lit(0.0)).alias("v"))


def volume_values(values: DataFrame, index: DataFrame) -> DataFrame:
    """(i, j, k, structure, v) of the positions that are voxels."""
    return index.where("i is not null").join(values, "pos").select("i", "j", "k", "structure", "v")


def parcels_by_position(labels: DataFrame, index: DataFrame, cortex: list[str]) -> DataFrame:
    """(pos, label): a position on a surface takes its vertex's label (structure, vertex, label); every other structure one label more than the largest, in the order of its first position."""
    on = index.where(F.col("structure").isin(cortex)).join(labels, ["structure", "vertex"]).select("pos", F.col("label").cast("int").alias("label"))
    rest = index.where(~F.col("structure").isin(cortex))
    order = rest.groupBy("structure").agg(F.min("pos").alias("first"))
    order = order.select("structure", F.row_number().over(Window.orderBy("first")).alias("_n"))
    top = labels.agg(F.max("label").alias("top"))
    other = rest.join(order, "structure").crossJoin(F.broadcast(top)).select("pos", (F.col("top") + F.col("_n")).cast("int").alias("label"))
    return on.unionByName(other)


def resample_surface(values: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], radius: float = 100.0) -> DataFrame:
    """(new, v): values (old, v) of one sphere on another, by adaptive barycentric area weights. old, new: (vertices, triangles)."""
    (ov, ot), (nv, nt) = (change_radius(old[0], radius), old[1]), (change_radius(new[0], radius), new[1])
    forward = nearest_triangle_weights(nv.withColumnRenamed("vertex", "new"), ov, ot)
    back = nearest_triangle_weights(ov.withColumnRenamed("vertex", "new"), nv, nt)
    reverse = back.select(F.col("new").alias("old"), F.col("old").alias("new"), "w")
    weights = adaptive_area_weights(forward, reverse, vertex_areas(ov, ot).withColumnRenamed("vertex", "old"), vertex_areas(nv, nt).withColumnRenamed("vertex", "new"))
    return resample(values, weights)
