"""Small literals: regions, thresholds, permutations, names, special functions, kernels, sources."""

import gzip
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortix import shared
from cohortix.functions import graphs, special, strings
from cohortix.operators import blocks, decomposition, geometry, matrix, mixed, networks, permutation, reliability, roi, stats, tabular
from cohortix.sources import arrays, sinks
from cohortix.streaming import accumulate


def long(spark, values, subject=1):
    return spark.createDataFrame([(subject, i, float(v)) for i, v in enumerate(values)], "subject long, feat int, v double")


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "feat int, label int")


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_regions_and_back(spark):
    l = labels(spark, [1, 1, 2, 2])  # noqa: E741
    r = roi.regions(long(spark, [5, 5, 10, 10]), l)
    assert got(r, "label") == [(1, 1, 5.0), (1, 2, 10.0)]
    assert [x[2] for x in got(roi.to_features(r, l), "feat")] == [5, 5, 10, 10]


def test_background(spark):
    l = labels(spark, [0, 2, 2, 2, 3, 3])  # noqa: E741
    r = roi.regions(long(spark, range(1, 7)), l)
    assert [x[2] for x in got(r, "label")] == [3, 5.5]
    assert [x[2] for x in got(roi.to_features(r, l), "feat")] == [0, 3, 3, 3, 5.5, 5.5]


def test_excluded_and_bad_mask(spark):
    l = labels(spark, [1, 1, 2, 2])  # noqa: E741
    mask = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 0)], "feat int, m int")
    assert [x[2] for x in got(roi.regions(long(spark, [1, 2, 3, 4]), l, exclude=mask), "label")] == [2, 3.5]
    with pytest.raises(ValueError):
        roi.regions(long(spark, [1, 2, 3, 4]), l, exclude=mask.union(mask.limit(1)))


@pytest.mark.parametrize("how,want", [("median", [1.5, 3.5]), ("sum", [3, 7]), ("min", [1, 3]), ("maximum", [2, 4]), ("std", [0.5, 0.5]), ("variance", [0.25, 0.25])])
def test_reducers(spark, how, want):
    assert [x[2] for x in got(roi.regions(long(spark, [1, 2, 3, 4]), labels(spark, [1, 1, 2, 2]), how), "label")] == want


def maps(spark, columns):
    return spark.createDataFrame([(f, m, float(w)) for m, c in enumerate(columns) for f, w in enumerate(c)], "feat int, map int, w double")


def test_soft_maps(spark):
    m = maps(spark, [[0, 0, 1, 1], [1, 2, 0, 0]])
    r = roi.soft_regions(long(spark, [1, 1, 5, 5]), m, "ls")
    assert [round(x[2], 6) for x in got(r, "map")] == [5, 0.6]
    m = maps(spark, [[1, 1, 0, 0], [0, 0, 1, 2]])
    assert [x[2] for x in got(roi.soft_regions(long(spark, [1, 3, 1, 2]), m), "map")] == [2, pytest.approx(5 / 3)]


MATRIX = [[0.1, 0.2, 0.3, -0.5], [0.2, 0, -0.5, 0], [0.3, -0.5, 0, 0], [-0.5, 0, 0, 0]]


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(w)) for i, r in enumerate(m) for j, w in enumerate(r)], "i int, j int, w double")


@pytest.mark.parametrize("kind,cut,n", [("abs", 0.2, 8), ("neg", -0.2, 4), ("pos", 0.2, 4)])
def test_threshold_value(spark, kind, cut, n):
    assert networks.threshold_value(cells(spark, MATRIX), cut, kind).count() == n


def test_threshold_relaxes_to_the_first_edge(spark):
    r = networks.threshold_relaxed(cells(spark, MATRIX), 0.55, 0.01).first()
    assert r["steps"] == 5 and r["threshold"] == pytest.approx(0.5)


def test_permutation_stays_in_blocks(spark):
    s = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "subject long, b int")
    moves = blocks.permute_within(s, blocks.permutations(20, spark), "b")
    assert all(r["src"] == 1 for r in moves.where("dst = 1").collect())
    assert {r["src"] for r in moves.where("dst = 2").collect()} == {2, 3}
    other = blocks.permute_within(s.repartition(3), blocks.permutations(20, spark), "b")
    assert got(moves, "perm", "dst") == got(other.select(moves.columns), "perm", "dst")


def test_nested_permutation():
    b = np.array([[-1, 1], [-1, 1], [-1, 1], [-1, 1], [-2, 1], [-2, 1], [-2, 2], [-2, 1], [-2, 2], [-2, 1], [-3, 1], [-3, 2], [-3, 3]])
    seen = set()
    for p in range(200):
        o = blocks.permute_nested(b, 0, p)
        assert sorted(o) == list(range(13))
        assert set(o[:4]) == {0, 1, 2, 3} and set(o[[4, 5, 7, 9]]) == {4, 5, 7, 9} and set(o[[6, 8]]) == {6, 8} and list(o[10:]) == [10, 11, 12]
        seen.add(int(o[0]))
    assert seen == {0, 1, 2, 3}


def test_nested_variance_groups():
    assert blocks.variance_groups_nested(np.array([1, 1, 2, 2])).tolist() == [0, 0, 1, 1]
    assert len(set(blocks.variance_groups_nested(np.array([1, 1, 2, 2]), within=False).tolist())) == 1
    assert len(set(blocks.variance_groups_nested(np.array([-1, -1, 2, 2, 2]), within=False).tolist())) >= 2


def test_families(spark):
    rows = [(1, 1, "twin", "monozygotic"), (2, 1, "twin", "monozygotic"), (3, 2, "twin", None), (4, 2, "sibling", None), (5, 3, "sibling", "x"), (6, 3, "sibling", "x"), (7, 4, None, "x"), (8, 4, "single", None)]
    df = spark.createDataFrame([(i, i, f, r, z) for i, f, r, z in rows], "subject long, at long, fam int, rel string, zyg string")
    out = {r["subject"]: r["family_type"] for r in blocks.family_blocks(df, "at", "fam", "rel", "zyg").collect()}
    assert out == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 8: 2}
    assert blocks.family_blocks(df, "at", "fam", "rel", "zyg", neg_ones=True).columns[1] == "neg_ones"


def test_v_scores_match_the_general_formula():
    rng = np.random.default_rng(0)
    n, x, z, y = 12, rng.random(12), rng.random((12, 2)), rng.random((12, 3))
    g = np.array([0] * 6 + [1] * 6)
    basis = permutation.thin_basis(np.column_stack([np.ones(n), z]))
    xr = x - basis @ (basis.T @ x)
    d = permutation.Design(np.arange(n), xr, basis, g, g, 1 - (basis**2).sum(1) - xr**2 / (xr @ xr))
    m = np.column_stack([xr, basis])
    r = np.eye(n) - m @ np.linalg.pinv(m)
    psi, e = np.linalg.pinv(m) @ y, r @ y
    want = []
    for k in range(3):
        w = sum(np.diag(r)[g == i].sum() / (e[g == i, k] ** 2).sum() * m[g == i].T @ m[g == i] for i in (0, 1))
        want.append(psi[0, k] / math.sqrt(np.linalg.pinv(w)[0, 0]) if False else psi[0, k] * math.sqrt(sum(np.diag(r)[g == i].sum() / (e[g == i, k] ** 2).sum() * (xr[g == i] ** 2).sum() for i in (0, 1))))
    v, df = permutation.v_scores(y, d)
    assert v == pytest.approx(want) and (df > 0).all()


def test_removing_small_groups_is_dropping_them(spark):
    s = spark.createDataFrame([(i, b) for i, b in enumerate([1, 1, 1, 3, 3, 2])], "subject long, b int")
    assert [r[0] for r in got(blocks.min_group_filter(s, "b", 2).select("subject"), "subject")] == [0, 1, 2, 3, 4]


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((6, 2)), rng.random((6, 3))
    data = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(6) for j in range(3)], "subject long, feat int, v double")
    cov = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1])) for i in range(6)], "subject long, a double, b double")
    m = np.column_stack([np.ones(6), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    want = y - x @ beta[1:]
    for r in stats.residualize(data, cov, ["a", "b"]).collect():
        assert r["v"] == pytest.approx(want[r["subject"], r["feat"]])


def test_residuals_with_missing_values(spark):
    data = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (2, 0, 3.0), (3, 0, 2.0), (0, 1, 5.0), (1, 1, None), (2, 1, None), (3, 1, None)], "subject long, feat int, v double")
    cov = spark.createDataFrame([(i, float(i)) for i in range(4)], "subject long, a double")
    out = {(r["subject"], r["feat"]): r["v"] for r in stats.residualize(data, cov, ["a"]).collect()}
    assert out[1, 0] is None and out[0, 1] is None and out[0, 0] == pytest.approx(1.0)


def test_outliers(spark):
    data = spark.createDataFrame([(1, 0, 1.0), (2, 0, 9.0), (3, 0, None), (4, 0, -5.0)], "subject long, feat int, v double")
    assert [r[0] for r in got(matrix.drop_top_outliers(data, 2), "subject")] == [1, 4]
    assert matrix.drop_top_outliers(data, 0).count() == 4


def test_masks(spark):
    mask = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "feat int, m int")
    kept = matrix.apply_mask(long(spark, [1, 2, 3]), mask)
    assert [x[2] for x in got(matrix.reverse_mask(kept.select("subject", "pos", "v"), mask), "feat")] == [1, 0, 3]
    with pytest.raises(ValueError):
        matrix.check_mask(mask.where("m = 1"))
    with pytest.raises(ValueError):
        matrix.recode(kept, "v", True, True)


def test_alignment(spark):
    s, t = spark.createDataFrame([(1,), (2,)], "subject long"), spark.createDataFrame([(1, 5.0)], "subject long, x double")
    with pytest.raises(KeyError):
        tabular.align(s, t)
    assert tabular.align(s, t, check=False).count() == 1


def test_hemispheres(spark):
    left, right = labels(spark, [0, 1, 2, 3, 4]), labels(spark, [0, 1, 2, 3, 9])
    merged = [x[1] for x in got(tabular.merge_hemispheres(left, right), "feat")]
    assert merged == [0, 1, 2, 3, 4, 0, 5, 6, 7, 8]
    merged = [x[1] for x in got(tabular.merge_hemispheres(left, labels(spark, [0, 7, 8, 9, 9])), "feat")]
    assert merged == [0, 1, 2, 3, 4, 0, 5, 6, 7, 7]


def test_names(spark):
    df = spark.createDataFrame([("14G",), ("10 KB",), ("512",), ("100B",), ("1.5m",)], "s string")
    assert [r[0] for r in df.select(strings.size_to_bytes(F.col("s"))).collect()] == [14 * 2**30, 10240, 512, 100, 1.5 * 2**20]
    assert strings.unique_markers(["lh_area_a", "lh_area_b"]) == ["a", "b"]
    one = spark.createDataFrame([("left area left",)], "s string")
    assert one.select(strings.remove_affix(F.col("s"), "left", "end")).first()[0] == "left area "
    assert one.select(strings.remove_affix(F.col("s"), "left", "start")).first()[0] == " area left"
    df = spark.createDataFrame([(1, 2, 3)], ["area_one", "area_two", "x"])
    assert tabular.rename_columns(df, ["area", "one"], ["a", "b"]).columns == ["area_b", "a_two", "x"]
    r = {x["name"]: x["label"] for x in strings.resolve_names(spark.createDataFrame([("ctx_LH-frontal.superior",), ("zzz",)], "name string"), spark.createDataFrame([("superior frontal",), ("frontal",)], "label string")).collect()}
    assert r == {"ctx_LH-frontal.superior": "frontal", "zzz": None}


def test_special_functions():
    assert special.t_two_sided([2.228138852, 1.959963985], [10, 1e9]) == pytest.approx([0.05, 0.05], rel=1e-6)
    assert special.normal_quantile([0.975, 0.5, 1e-10]) == pytest.approx([1.959963985, 0, -6.361340902], abs=1e-7)
    assert special.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert special.g_to_z([2.228138852, -2.228138852, 3.0], [10, 10, 1e8]) == pytest.approx([1.959963985, -1.959963985, 3.0], abs=1e-6)


def test_graph_kernels():
    path = np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0]], dtype=float)
    assert graphs.betweenness(path) == pytest.approx([0, 2 / 3, 2 / 3, 0])
    assert graphs.average_path(path) == pytest.approx(10 / 6)
    assert graphs.global_efficiency(path) == pytest.approx((3 + 2 / 2 + 1 / 3) / 6)
    assert graphs.pagerank(path).sum() == pytest.approx(1)
    assert graphs.closeness(path) == pytest.approx([3 / 6, 3 / 4, 3 / 4, 3 / 6])
    two = np.kron(np.eye(2), np.ones((4, 4)) - np.eye(4))
    two[0, 4] = two[4, 0] = 1
    assert len(set(graphs.communities(two).tolist())) == 2 and graphs.modularity(two) > 0.3
    r = graphs.rewired(two, 3)
    assert (r.sum(0) == two.sum(0)).all() and (r == r.T).all()


def test_mixed_model_recovers_effects():
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(40), 8)
    x = np.column_stack([np.ones(320), rng.standard_normal(320)])
    y = x @ [1.0, 2.0] + rng.standard_normal(40)[g] + 0.5 * rng.standard_normal(320)
    beta, se, variances, scale = mixed.fit(y, x, g)
    assert beta == pytest.approx([1, 2], abs=4 * se.max()) and variances[0] == pytest.approx(1, abs=0.6) and scale == pytest.approx(0.25, abs=0.06)


def test_decompositions():
    rng = np.random.default_rng(2)
    s = np.sign(rng.standard_normal((3, 2000))) * rng.random((3, 2000)) ** 3
    y = decomposition.fast_ica(rng.standard_normal((3, 3)) @ s, 0)
    c = np.abs(np.corrcoef(np.vstack((s, y)))[:3, 3:])
    assert (c.max(axis=1) > 0.95).all()
    x = (rng.standard_normal((600, 40)) * 0.5 ** np.arange(40)) @ rng.standard_normal((40, 700))
    assert decomposition.fast_svd(x, 5)[1] == pytest.approx(np.linalg.svd(x, compute_uv=False)[:5], rel=1e-6)


def test_mesh(spark):
    v = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, -1.0, 0.0, 0.0), (4, 0.0, -1.0, 0.0), (5, 0.0, 0.0, -1.0)], "vertex long, x double, y double, z double")
    t = spark.createDataFrame([(k, *f) for k, f in enumerate([(0, 1, 2), (1, 3, 2), (3, 4, 2), (4, 0, 2), (1, 0, 5), (3, 1, 5), (4, 3, 5), (0, 4, 5)])], "tri long, a long, b long, c long")
    area = geometry.vertex_areas(v, t)
    assert area.agg(F.sum("area")).first()[0] == pytest.approx(8 * math.sqrt(3) / 2)
    p = spark.createDataFrame([(0, 0.3, 0.3, 0.4), (1, 2.0, 0.0, 0.0), (2, 0.6, -0.5, -0.1)], "new long, x double, y double, z double")
    w = geometry.nearest_triangle_weights(p, v, t)
    assert {r["new"]: round(r["s"], 9) for r in w.groupBy("new").agg(F.sum("w").alias("s")).collect()} == {0: 1, 1: 1, 2: 1}
    assert got(w.where("new = 1"), "old") == [(1, 0, 1.0)]
    same = geometry.resample(spark.createDataFrame([(i, 7.0) for i in range(6)], "old long, v double"), w)
    assert {round(r["v"], 9) for r in same.collect()} == {7.0}


def test_parcellation():
    ring = {i: [(i - 1) % 5, (i + 1) % 5] for i in range(5)}
    a = geometry.grow_parcels(ring, 2, {0}, 1)
    assert a == geometry.grow_parcels(ring, 2, {0}, 1) and a[0] == 0 and set(a.values()) == {0, 1, 2}


def test_parcellation_bad_wall(spark):
    adj = spark.createDataFrame([(0, 1), (1, 0)], "v long, nbr long")
    with pytest.raises(IndexError):
        geometry.random_parcellations(adj, [9], 1, spark.range(1).withColumnRenamed("id", "seed"))


def test_splits(spark):
    s = spark.createDataFrame([(i, g) for i, g in enumerate([1, 1, 2, 2, 3])], "subject long, g int")
    for seed in range(10):
        out = s.join(reliability.split_half(s, seed, group="g"), "subject").groupBy("g").agg(F.count_distinct("half").alias("n"))
        assert {r["n"] for r in out.collect()} == {1}
    t = spark.createDataFrame([(i, i % 2) for i in range(8)], "subject long, k int")
    counts = t.join(reliability.split_half(t, 3, stratify="k"), "subject").groupBy("k", "half").count().collect()
    assert {r["count"] for r in counts} == {2}


def test_similarities(spark):
    rows = [(1, float(v)) for v in (1, 2, 3, 4, 5)] + [(2, float(v)) for v in (1, 2, 3, 4, 5, 7)] + [(3, v) for v in (1, 1, 2, 2, 2, 2, 2, 2, 1, 1.5)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "grp int, v double")
    ks = {(r["a"], r["b"]): r["w"] for r in networks.ks_similarity(df).collect()}
    assert ks[1, 2] == pytest.approx(1 - 1 / 6) and ks[1, 3] == pytest.approx(1 - 0.6)
    assert all(0 <= r["w"] <= 1 for r in networks.jsd_similarity(df).collect())


def nifti(data):
    head = bytearray(352)
    head[:4] = struct.pack("<i", 348)
    head[40:56] = struct.pack("<8h", data.ndim, *data.shape, *[1] * (7 - data.ndim))
    head[70:72] = struct.pack("<h", 64)
    head[108:120] = struct.pack("<3f", 352, 0, 0)
    return bytes(head) + data.astype("<f8").tobytes(order="F")


def test_array_files(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    np.save(tmp_path / "s1.npy", x)
    (tmp_path / "s2.nii").write_bytes(nifti(x))
    (tmp_path / "s3.nii.gz").write_bytes(gzip.compress(nifti(x)))
    (tmp_path / "s4.gii").write_bytes(sinks.gifti(x))
    (tmp_path / "lh.s5.thickness").write_bytes(b"\xff\xff\xff" + struct.pack(">3i", 6, 0, 1) + x.astype(">f4").tobytes())
    rows = arrays.load_arrays(spark, str(tmp_path) + "/*", r"(s[1-9])(?=[.])").collect()
    assert {r["subject"]: r["data"] for r in rows} == {f"s{i}": x.ravel().tolist() for i in range(1, 6)}
    with pytest.raises(RuntimeError):
        arrays.decode("x.what", b"")


def test_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("src_subject_id,eventname,a,b,c\ns1,base,1,x,777\ns2,base,999,y,2\ns1,later,3,,4\n")
    out = arrays.read_csv(spark, str(p), ["a", "C(b)", "c"], "base")
    assert out.columns == ["src_subject_id", "a", "b", "c"]
    assert got(out, "src_subject_id") == [("s1", 1.0, "x", None), ("s2", None, "y", 2.0)]
    assert arrays.read_csv(spark, str(p), ["a"], None).count() == 3
    assert "eventname" in arrays.read_csv(spark, str(p), ["a"], ["base", "later"]).columns


def test_sinks_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "key string, value int")
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert sinks.read_tsv(spark, str(tmp_path / "t"), ["value", "key"]).columns == ["value", "key"]
    sinks.write_mapping(df, str(tmp_path / "m"))
    assert got(arrays.read_mapping(spark, str(tmp_path / "m")), "key") == [("a", "1"), ("b", "2")]
    calls = []
    for cols in (["x", "y"], ["y", "x"]):
        out = sinks.read_through(spark, str(tmp_path / "cache"), {"cols": cols}, lambda: calls.append(1) or df)
        assert out.count() == 2
    assert len(calls) == 1
    e = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "name string, size long, time long")
    assert [r[0] for r in got(sinks.evicted(e, 10), "name")] == ["a"]


def test_accumulation_is_idempotent(spark, tmp_path):
    score = lambda perms: perms.withColumn("vmax", F.col("perm") * 1.0)
    for n in (3, 5, 5):
        out = accumulate.append_maxima(spark, blocks.permutations(n, spark), str(tmp_path / "acc"), score)
    assert got(out, "perm") == [(i, float(i)) for i in range(1, 6)]


def test_callables(spark):
    s = spark.createDataFrame([(1,), (2,)], "subject long")
    paths = s.select(tabular.path_template(F.col("subject"), lambda i, c: f"/{c}/{i:03d}.npy", "rest")).collect()
    assert [r[0] for r in paths] == ["/rest/001.npy", "/rest/002.npy"]
    e, n = spark.createDataFrame([(0, 0, 1)], "graph long, i int, j int"), spark.createDataFrame([(0, i) for i in range(3)], "graph long, node int")
    out = {r["name"]: r["value"] for r in networks.graph_measures(e, n, [("edges", lambda a, seed: a.sum() / 2), ("degree", lambda a, seed: a.sum(0))], each=True).collect()}
    assert out == {"edges": 1.0, "degree_0": 1.0, "degree_1": 1.0, "degree_2": 0.0}


def test_regions_as_series(spark):
    df = spark.createDataFrame([("1", "a", ), ("2", "b")], "x string, n string")
    assert got(tabular.roi_series(df), "name") == [("a", 1.0), ("b", 2.0)]
    df = spark.createDataFrame([(1.0, 2.0, 3), (3.0, 4.0, 5)], "p double, q double, r int")
    assert got(tabular.roi_series(df), "name") == [("p", 2.0), ("q", 3.0), ("r", 4.0)]


def test_names_with_mapping(spark):
    names, labels = spark.createDataFrame([("lh_sfg",), ("unknown_lh",)], "name string"), spark.createDataFrame([("superior frontal",), ("unknown",)], "label string")
    out = strings.resolve_with_mapping(names, labels, [("sfg", "superior frontal")], [("_lh", "end")])
    assert got(out, "name") == [("lh_sfg", "superior frontal"), ("unknown_lh", "unknown")]
    strings.check_one_to_one(out)
    with pytest.raises(ValueError):
        strings.check_one_to_one(out.unionByName(out.withColumn("name", F.lit("x"))))


def test_surfaces(spark, tmp_path):
    xyz, tri = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], dtype=float), np.array([[0, 1, 2]])
    raw = b"\xff\xff\xfecreated by\n\n" + struct.pack(">2i", 3, 1) + xyz.astype(">f4").tobytes() + tri.astype(">i4").tobytes()
    (tmp_path / "lh.white").write_bytes(raw)
    v, t = arrays.load_surface(spark, str(tmp_path / "lh.white"))
    assert geometry.vertex_areas(v, t).agg(F.sum("area")).first()[0] == pytest.approx(0.5) and t.count() == 1


def test_connecting_threshold(spark):
    e = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.5), (2, 3, 0.31), (0, 2, 0.1)], "i int, j int, w double")
    assert networks.connecting_threshold(e, 0.6).first()["steps"] == 29
    assert networks.connecting_threshold(e, 0.6, 0.75).first()["steps"] == 10
    assert networks.connecting_threshold(e, 0.6, 0.5).first()["steps"] == 0


# global orders, missing data, nearest triangles


def test_places_and_kth_largest(spark):
    rng = np.random.default_rng(31)
    v = rng.integers(0, 400, 1000)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, v long").repartition(5)
    out = {r["id"]: r["place"] for r in shared.placed(df, "v", "id").collect()}
    assert out == {int(i): k for k, i in enumerate(np.lexsort((np.arange(1000), v)))}
    ranked = sorted(v.tolist(), reverse=True)
    for k in (0, 1, 499, 999):
        assert shared.kth_largest(df, F.col("v"), k, bins=7, few=10) == ranked[k]
    assert shared.kth_largest(df, F.col("v"), 1000) is None


def test_eviction_keeps_the_newest(spark):
    rows = [(f"t{i}", 10 * (i % 7 + 1), i * 37 % 50) for i in range(50)]
    out = {r["name"] for r in sinks.evicted(spark.createDataFrame(rows, "name string, size long, time long"), 300).collect()}
    total, want = 0, set()
    for name, size, _ in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        total += size
        want |= {name} if total > 300 else set()
    assert out == want


def test_whole_blocks_move_as_the_plan_says(spark):
    subjects = spark.createDataFrame([(i, i // 3 if i < 12 else 10 + i // 4, float(i % 5)) for i in range(28)], "subject long, b long, x double")
    d = permutation.design(subjects, "x", [], None, "b", exchange="whole")
    moves = blocks.permute_whole(subjects.select("subject", "b"), blocks.permutations(3, spark), "b", 6)
    for r in moves.collect():
        assert d.subjects[d.order(r["perm"], 6)[r["dst"]]] == r["src"]
    groups = {r["subject"]: r["vg"] for r in blocks.variance_groups_whole(subjects, "b").collect()}
    codes = dict(zip(d.subjects.tolist(), d.group.tolist()))
    assert len(set(zip(groups.values(), (codes[s] for s in groups)))) == len(set(codes.values())) == len(set(groups.values()))


def test_missing_targets_are_refused(spark):
    long = spark.createDataFrame([(s, f, float(s * f)) for s in range(12) for f in range(3) if (s, f) != (4, 1)], "subject long, feat int, v double")
    subjects = spark.createDataFrame([(s, float(s % 4), 0) for s in range(12)], "subject long, x double, b long")
    assert [tuple(r) for r in permutation.missing_values(long, subjects).collect()] == [(1, 1)]
    with pytest.raises(Exception, match="missing values"):
        permutation.permuted_v(long, subjects, "x", [], None, "b", 2).collect()


def test_two_tested_variables_share_the_model():
    """v of the first of two tested variables, one variance group, is its t with the second as a confound."""
    rng = np.random.default_rng(32)
    x, y = rng.standard_normal((40, 2)), rng.standard_normal((40, 3))
    ones = np.ones((40, 1)) / np.sqrt(40)
    centred = x - x.mean(axis=0)
    both = permutation.thin_basis(centred)
    d = permutation.Design(np.arange(40), centred, ones, np.zeros(40, dtype=int), np.zeros(40, dtype=int), 1 - (ones**2).sum(1) - (both**2).sum(1))
    full = np.column_stack([np.ones(40), x])
    beta, rss = np.linalg.lstsq(full, y, rcond=None)[:2]
    t = beta[1] / np.sqrt(rss / 37 * np.linalg.inv(full.T @ full)[1, 1])
    assert permutation.v_scores(y, d)[0] == pytest.approx(t) and permutation.t_scores(y, d)[0] == pytest.approx(t)


def test_nearest_triangles_are_the_nearest(spark):
    rng = np.random.default_rng(33)
    xyz = rng.random((60, 3)) * [10, 10, 2]
    corners = [tuple(rng.choice(60, 3, replace=False).tolist()) for _ in range(80)]
    points = np.concatenate((rng.random((25, 3)) * [12, 12, 4] - 1, [[500.0, 0.0, 0.0]]))
    frames = [spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"{name} long, x double, y double, z double") for rows, name in ((points, "new"), (xyz, "vertex"))]
    out = geometry.nearest_triangle_weights(frames[0], frames[1], spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "tri long, a long, b long, c long")).collect()
    tri = xyz[np.array(corners)]
    for i, p in enumerate(points):
        at = sum(r["w"] * xyz[r["old"]] for r in out if r["new"] == i)
        assert np.linalg.norm(at - p) == pytest.approx(geometry.barycentric(p, tri)[0].min(), abs=1e-9)


def test_both_cells_of_an_edge_are_equal(spark):
    """Also where the edges' weights come out otherwise each time they are made, as sums do in their last bit when shuffles arrive in another order."""
    other = F.udf(lambda w: w + np.random.default_rng().random(), "double").asNondeterministic()
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(i + 1, 5)], "i int, j int, w double").withColumn("w", other("w"))
    cells = {(r["i"], r["j"]): r["w"] for r in networks.full_matrix(edges).collect()}
    assert len(cells) == 25 and all(cells[i, j] == cells[j, i] for i, j in cells) and all(cells[i, i] == 1.0 for i in range(5))


def test_measures_of_a_graph_without_edges(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in range(4)], "node int"), spark.createDataFrame([], "i int, j int")
    assert [tuple(r) for r in networks.path_measures(networks.shortest_paths(edges, nodes), 4).collect()] == [(None, None, None)]


def test_transitivity_without_wedges(spark):
    """As in SQL, 0 / 0; null without any node, and 0 where wedges are there and none is closed."""
    nodes, measure = spark.createDataFrame([(i,) for i in range(4)], "node int"), lambda e, n: networks.transitivity(networks.triangles(spark.createDataFrame(e, "i int, j int"), n)).first()[0]
    assert math.isnan(measure([], nodes)) and math.isnan(measure([(0, 1)], nodes))
    assert measure([(0, 1), (1, 2)], nodes) == 0.0 and measure([(0, 1), (1, 2), (0, 2)], nodes) == 1.0
    assert measure([], nodes.where("node < 0")) is None


def test_false_discovery_by_group(spark):
    """Ties, null p, null and small groups; without a window that runs to its end, which takes the square of a group's rows."""
    rng = np.random.default_rng(44)
    rows = [(i, "ab"[i % 2] if i % 7 else None, None if i % 11 == 0 else float(rng.integers(1, 60) / 100)) for i in range(400)] + [(400, "c", 0.5), (401, "d", None)]
    df = spark.createDataFrame(rows, "id int, g string, p double")
    for by in ((), ("g",)):
        out = stats.fdr(df, "p", "q", *by)
        assert "currentrow$(), unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        got_q, groups = {r["id"]: r["q"] for r in out.collect()}, {}
        for i, g, p in rows:
            groups.setdefault(g if by else 0, []).append((p, i))
        assert len(got_q) == len(rows)
        for members in groups.values():
            known, least = sorted((p, i) for p, i in members if p is not None), 1.0
            assert all(got_q[i] is None for p, i in members if p is None)
            for k, (p, i) in reversed(list(enumerate(known, 1))):
                least = min(least, p * len(known) / k)
                assert got_q[i] == pytest.approx(least, abs=1e-12)


def orthogonal_case(spark):
    rng = np.random.default_rng(45)
    values = {(s, f): float(v) for s, row in enumerate(rng.standard_normal((40, 6)) @ rng.standard_normal((6, 6))) for f, v in enumerate(row) if (s + f) % 9}
    return values, spark.createDataFrame([(s, f, v) for (s, f), v in values.items()], "subject long, feat int, v double")


def shuffled_joins(spark, make):
    """Joins in shuffles that the plan of make() has where nothing is small enough to be sent by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distances_to_orthogonal_lines(spark):
    """As brute force, for all pairs and for few of them; subjects x pairs meet in no shuffle."""
    values, df = orthogonal_case(spark)
    few = spark.createDataFrame([(4, 1)], "i int, j int")
    for pairs in (networks.feature_pairs(df), few):
        fits = {(r["i"], r["j"]): r for r in stats.orthogonal_fit(df, pairs).collect()}
        assert set(fits) == ({(i, j) for i in range(6) for j in range(i + 1, 6)} if pairs is not few else {(4, 1)})
        out = {(r["subject"], r["i"], r["j"]): r["distance"] for r in stats.orthogonal_distance(df, stats.orthogonal_fit(df, pairs)).collect()}
        mean = [np.mean([v for (_, f), v in values.items() if f == k]) for k in range(6)]
        want = {(s, i, j) for i, j in fits for s in range(40) if (s, i) in values and (s, j) in values}
        assert set(out) == want
        for (i, j), r in fits.items():
            x, y = (np.array([values[s, f] for s in range(40) if (s, i) in values and (s, j) in values]) for f in (i, j))
            c = np.cov(x, y)
            slope = (c[1, 1] - c[0, 0] + np.sqrt((c[1, 1] - c[0, 0]) ** 2 + 4 * c[0, 1] ** 2)) / (2 * c[0, 1])
            assert r["slope"] == pytest.approx(slope) and r["intercept"] == pytest.approx(y.mean() - slope * x.mean())
            for s in range(40):
                if (s, i, j) in want:
                    assert out[s, i, j] == pytest.approx(abs(values[s, j] - mean[j] - slope * (values[s, i] - mean[i])) / np.sqrt(1 + slope**2))
    assert not shuffled_joins(spark, lambda: stats.orthogonal_distance(df, stats.orthogonal_fit(df, networks.feature_pairs(df))))


def test_group_differences_are_not_shuffled_by_pair(spark):
    _, df = orthogonal_case(spark)
    assert not shuffled_joins(spark, lambda: networks.group_difference(df, df.where("subject % 2 = 0").select("subject").distinct()))


def test_significance_is_sent_to_the_distances(spark):
    """p of pairs meets the distances where they are, and masks them."""
    _, df = orthogonal_case(spark)
    group = df.where("subject % 2 = 0").select("subject").distinct()
    make = lambda: networks.significant_distances(networks.group_difference(df, group), df, group, 0.2)
    assert not shuffled_joins(spark, make)
    p = {(r["i"], r["j"]): special.pearson_p(np.array([r["w"]]), np.array([20]))[0] for r in networks.correlation_edges(df.where("subject % 2 = 0")).collect()}
    rows = make().collect()
    assert len(rows) == networks.group_difference(df, group).count() and 0 < sum(r["distance"] is None for r in rows) < len(rows)
    assert all((r["distance"] is None) == (p[r["i"], r["j"]] > 0.2) for r in rows)


def test_orthogonal_fits_are_not_shuffled_by_subject(spark):
    _, df = orthogonal_case(spark)
    assert not shuffled_joins(spark, lambda: stats.orthogonal_fit(df, networks.feature_pairs(df)))


def test_blocks_are_scored_a_part_at_a_time(spark, monkeypatch):
    """Scores are those of the whole matrix, and no more than AT_ONCE values of a block are scored at once."""
    most, plain = permutation.AT_ONCE, permutation.v_scores

    def v_scores(y, d):
        assert y.size <= most
        return plain(y, d)

    monkeypatch.setattr(permutation, "v_scores", v_scores)
    subjects = spark.range(300).select(F.col("id").alias("subject"), (F.col("id") * 37 % 101 / 10).alias("x"), (F.col("id") % 3).alias("b"))
    value = F.pmod(F.xxhash64("subject", "feat"), F.lit(1009)) / 1009 + F.col("subject") % 7
    df = spark.range(300).select(F.col("id").alias("subject")).crossJoin(spark.range(2000).select(F.col("id").cast("int").alias("feat"))).withColumn("v", value)
    d = permutation.design(subjects, "x", [], None, "b")
    assert 300 * 2000 > most
    got_v = {(r["perm"], r["feat"]): r["v"] for r in permutation.scored(df, d, 2, seed=3).collect()}
    rows = df.where("feat in (0, 1, 1023, 1999)").toPandas().pivot(index="subject", columns="feat", values="v")
    y = rows.to_numpy() - rows.to_numpy().mean(axis=0)
    assert len(got_v) == 3 * 2000
    for p in range(3):
        assert [got_v[p, f] for f in rows.columns] == pytest.approx(plain(y[d.order(p, 3)], d)[0].tolist())
