"""Small inputs whose results are known by hand, or by brute force."""

import json
import math

import numpy as np
import pytest

from lithomesh.functions import distributions
from lithomesh.functions.eigen import decompose
from lithomesh.operators import analysis, cut_pursuit, edges, features, geodesic, linkage, neighbours, regions, scoring, voxel_graph, voxels
from lithomesh.operators.components import connected_components
from lithomesh.sources import mesh, scans, tables


def partition(spark, labels):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "scene_id string, pid long, label long")


def chain(spark, n=4, weight=1.0):
    rows = [("s", i, i + 1, weight) for i in range(n - 1)] + [("s", i + 1, i, weight) for i in range(n - 1)]
    return spark.createDataFrame(rows, "scene_id string, src long, dst long, dist double")


def cloud(spark, xyz, scene="s", **more):
    rows = [(scene, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "scene_id string, pid long, x double, y double, z double")


@pytest.mark.parametrize(("truth", "own", "want"), [([1, 1, 1, 2, 2], [0, 0, 1, 1, 1], 0.8), ([1, 1, 2, 2], [0, 1, 2, 3], 1.0)])
def test_object_accuracy(spark, truth, own, want):
    table = scoring.contingency(partition(spark, own), partition(spark, truth))
    assert scoring.object_accuracy(table).first().ooa == pytest.approx(want)


def test_first_order_matches_where_partitions_agree(spark):
    p = partition(spark, [0, 0, 1, 1, 2])
    assert {(r.s, r.o, r["class"]) for r in scoring.classify(p, p).collect()} == {(0, 0, 3), (1, 1, 3), (2, 2, 3)}


def test_without_reverse(spark):
    e = spark.createDataFrame([("s", 0, 1), ("s", 0, 2), ("s", 1, 0), ("s", 2, 1)], "scene_id string, src long, dst long")
    once = edges.without_reverse(e)
    assert {(r.src, r.dst) for r in once.collect()} == {(0, 1), (0, 2), (2, 1)}
    assert {tuple(r) for r in edges.without_reverse(once).collect()} == {tuple(r) for r in once.collect()}


def test_between_components(spark):
    e = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 1)], "scene_id string, src long, dst long")
    assert sorted((r.ls, r.lt) for r in edges.between_components(partition(spark, [0, 0, 1]), e).collect()) == [(0, 1), (1, 0)]


def test_paths_on_a_chain(spark):
    e = chain(spark)
    zero = spark.createDataFrame([("s", 0)], "scene_id string, pid long")
    got = lambda frame: {(r.dst, r.dist) for r in frame.collect()}
    assert got(geodesic.geodesic_radius(e, zero, 2.0, exclude_self=False)) == {(0, 0.0), (1, 1.0)}
    assert got(geodesic.geodesic_radius(e, zero, 2.0)) == {(1, 1.0)}
    assert got(geodesic.geodesic_knn(e, zero, 2)) == {(1, 1.0), (2, 2.0)}
    assert got(geodesic.geodesic_hops(e, zero, 2)) == {(0, 0.0), (1, 1.0), (2, 2.0)}
    assert {(r.root, r.v, r.d) for r in geodesic.all_to_all(e).collect()} == {(i, j, float(abs(i - j))) for i in range(4) for j in range(4)}


def test_paths_against_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 30
    w = np.where(rng.random((n, n)) < 0.12, rng.random((n, n)), np.inf)
    w = np.minimum(w, w.T)
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    rows = [("s", int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.isfinite(w))) if i != j]
    e = spark.createDataFrame(rows, "scene_id string, src long, dst long, dist double")
    every = geodesic.vertices_of(e)
    assert {(r.root, r.v): pytest.approx(r.d) for r in geodesic.one_to_all(e, every).collect()} == {(i, j): d[i, j] for i in range(n) for j in range(n) if np.isfinite(d[i, j]) and any(x[1] == i for x in rows)}
    for r in geodesic.geodesic_knn(e, every, 5).collect():
        assert r.dist == pytest.approx(np.sort(d[r.src][np.isfinite(d[r.src])])[r.rank])


def test_long_paths_take_few_jobs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(geodesic, "materialise", lambda df, tag, f=geodesic.materialise: written.append(tag) or f(df, tag))
    n = 40
    e = spark.createDataFrame([("s", *x, 1.0) for i in range(n - 1) for x in ((i, i + 1), (i + 1, i))], "scene_id string, src long, dst long, dist double")
    ends = spark.createDataFrame([("s", 0, n - 1), ("s", 5, 5), ("s", 99, 3), ("s", 4, None), (None, 1, 2)], "scene_id string, src long, dst long")
    got = {(r.scene_id, r.src, r.dst): r.dist for r in geodesic.path_length(e, ends).collect()}
    assert got == {("s", 0, n - 1): n - 1, ("s", 5, 5): 0, ("s", 99, 3): None, ("s", 4, None): None, (None, 1, 2): None}
    every = {(r.root, r.v): r.d for r in geodesic.all_to_all(e).collect()}
    assert every == {(i, j): abs(i - j) for i in range(n) for j in range(n)}
    assert len(written) <= 6


@pytest.mark.parametrize("held, step, states", [(1 << 20, 1 << 16, 1 << 21), (1 << 20, 3, 40), (60, 5, 100), (0, 1, 1)])
def test_scenes_are_searched_in_tasks_or_rounds(spark, monkeypatch, held, step, states):
    """Scenes of both kinds, directed edges, repeated ones, and ones without ends or a finite length."""
    for name, value in {"HELD": held, "STEP": step, "STEP_EDGES": 2 * step, "STATES": states, "DEALT": 400, "BATCH": 7}.items():
        monkeypatch.setattr(geodesic, name, value)
    rng = np.random.default_rng(3)
    rows, lengths = [], {}
    for scene, n in (("s", 12), ("t", 25)):
        w = np.where(rng.random((n, n)) < 0.13, rng.random((n, n)), np.inf)
        rows += [(scene, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.isfinite(w)))]
        np.fill_diagonal(w, 0)
        for k in range(n):
            w = np.minimum(w, w[:, k : k + 1] + w[k : k + 1])
        lengths[scene] = w
    odd = [("s", 0, None, 1.0), ("s", None, 1, 1.0), ("s", 0, 11, None), ("s", 0, 11, float("inf")), ("s", 0, 11, float("nan")), (None, 0, 11, 0.0)]
    e = spark.createDataFrame(rows + rows[:9] + odd, "scene_id string, src long, dst long, dist double")
    sources = spark.createDataFrame([(s, i) for s in "st" for i in range(0, 12, 2)] + [("s", 0), ("u", 1), ("s", None), (None, 3)], "scene_id string, pid long")
    got = {(r.scene_id, r.root, r.v): pytest.approx(r.d) for r in geodesic.one_to_all(e, sources).collect()}
    want = {(s, i, j): d[i, j] for s, d in lengths.items() for i in range(0, 12, 2) for j in range(len(d)) if np.isfinite(d[i, j])}
    assert got == want | {("u", 1, 1): 0}
    pairs = [(s, i, j) for s, d in lengths.items() for i in range(0, len(d), 3) for j in range(1, len(d), 5)]
    found = {(r.scene_id, r.src, r.dst): r.dist for r in geodesic.path_length(e, spark.createDataFrame(pairs * 2, "scene_id string, src long, dst long")).collect()}
    assert found == {(s, i, j): pytest.approx(lengths[s][i, j]) if np.isfinite(lengths[s][i, j]) else None for s, i, j in pairs}


def test_refine(spark):
    p = partition(spark, [5, -1, -1, 7, -1])
    assert [r.label for r in regions.refine(p, chain(spark)).orderBy("pid").collect()] == [5, 5, 5, 7, 8]
    assert [r.label for r in regions.refine_together(p, chain(spark)).orderBy("pid").collect()] == [5, 5, 7, 7, 8]


def test_voxel_grid(spark):
    frame = cloud(spark, [(0.1, 0, 0), (0.2, 0, 0), (1.3, 0, 0)])
    got = voxels.voxel_grid(frame, 1.0, colours=False).orderBy("ix").collect()
    assert [(r.ix, pytest.approx(r.x), r.n) for r in got] == [(0, 0.15, 2), (1, 1.3, 1)]


def test_outliers(spark):
    frame = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    f = analysis.fences(frame, "v").first()
    assert (f.q1, f.q3, f.low, f.high) == (2, 4, -1, 7)
    assert [r.v for r in analysis.outliers(frame, "v").collect()] == [100]


def test_flat_features(spark):
    grid = [(x, y, 0) for x in range(3) for y in range(3)]
    frame = cloud(spark, grid)
    near = spark.createDataFrame([("s", 4, i) for i in range(9) if i != 4], "scene_id string, src long, dst long")
    r = features.point_features(frame, near).filter("pid = 4").first()
    assert (r.linearity, r.planarity, r.scattering, r.verticality) == (pytest.approx(0, abs=1e-7), pytest.approx(1, abs=1e-7), 0, 0)


def test_eigen():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 3, 3))
    m = a @ a.transpose(0, 2, 1)
    values, vectors = decompose(np.column_stack([m[:, 0, 0], m[:, 0, 1], m[:, 0, 2], m[:, 1, 1], m[:, 1, 2], m[:, 2, 2]]))
    for k in range(3):
        assert np.allclose(np.einsum("nij,nj->ni", m, vectors[:, k]), values[:, k : k + 1] * vectors[:, k], atol=1e-9)
    assert (np.diff(values, axis=1) <= 0).all()


@pytest.mark.parametrize("k", [1, 4, 12, 60])
def test_knn(spark, k):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.normal(size=(40, 3)), 50 + 0.01 * rng.normal(size=(10, 3))])
    frame = cloud(spark, xyz)
    got = {}
    for r in neighbours.knn(frame, frame, k).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    for i in range(len(xyz)):
        want = [j for j in np.lexsort((np.arange(len(xyz)), d[i])) if j != i][:k]
        assert [j for _, j in sorted(got[i])] == want


@pytest.mark.parametrize("few", [0, 50, 1 << 18])
def test_components(spark, monkeypatch, few):
    from lithomesh.operators import components

    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 300, size=(220, 2))
    label = list(range(300))
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = [(int(a), int(b)) for a, b in pairs] + [(400, i) for i in range(401, 900)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert all(got[int(a)] == label[a] and got[int(b)] == label[b] for a, b in pairs)
    assert {got[i] for i in range(400, 900)} == {400} and {got[i] for i in range(1000, 1101)} == {1000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    loops = spark.createDataFrame([(5, 5), (None, 2), (7, 7), (7, 6), (9, 9), (8, 9)], "src long, dst long")
    assert sorted(map(tuple, connected_components(loops).collect())) == [(5, 5), (6, 6), (7, 6), (8, 8), (9, 8)]


def test_regions(spark):
    normals = spark.createDataFrame([("s", i, 0.0, math.sin(a), math.cos(a)) for i, a in enumerate((0, 0.1, 1.5, 0.1))], "scene_id string, pid long, nx double, ny double, nz double")
    seeds = spark.createDataFrame([("s", 0)], "scene_id string, pid long")
    assert {r.pid for r in regions.grow_regions(seeds, chain(spark), normals, 20.0).collect()} == {0, 1}


def test_plane(spark):
    rng = np.random.default_rng(4)
    flat = np.column_stack([rng.random(200), rng.random(200), 0.002 * rng.normal(size=200)])
    frame = cloud(spark, np.concatenate([flat, rng.random((60, 3)) + [0, 0, 0.2]]))
    r = regions.ransac_planes(frame, 0.02, 300).first()
    assert abs(r.c) > 0.99 and r.inliers >= 195


def test_minimum_cut():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 7
        pull = rng.normal(size=n)
        u, v = np.triu_indices(n, 1)
        w = rng.random(len(u)) * (rng.random(len(u)) < 0.5)

        def cost(side):
            return pull[(pull > 0) & side].sum() - pull[(pull < 0) & ~side].sum() + w[side[u] != side[v]].sum()

        best = min(cost(np.array([k >> i & 1 for i in range(n)], bool)) for k in range(2**n))
        assert cost(cut_pursuit.minimum_cut(pull, u, v, w)) == pytest.approx(best)


@pytest.mark.parametrize("kind", [0, 0.1, 1, 2, -1])
@pytest.mark.parametrize("speed", range(5))
def test_pursuit_finds_steps(kind, speed):
    x = np.zeros((60, 2)) + [0.9, 0.1]
    x[20:40] = [0.1, 0.9]
    x += 0.01 * np.random.default_rng(6).random(x.shape)
    u = np.arange(59)
    label = cut_pursuit.Pursuit(x, np.ones(60), u, u + 1, np.ones(59), 0.02, cut_pursuit.SPEEDS[speed], kind).run()
    assert sorted(np.flatnonzero(np.diff(label)).tolist()) == [19, 39]


def test_pursuit_lowers_the_energy(spark):
    x = np.array([[10.0, 20], [0, 1], [0, 0]])
    run = cut_pursuit.Pursuit(x, np.ones(3), [0, 1], [1, 2], [1, 1], 0.01, cut_pursuit.SPEEDS[2])
    label = run.run()
    assert run.energy(label) <= run.energy(np.zeros(3, int))
    assert len(set(label.tolist())) == 3
    nodes = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)] + [("t", 0, [1.0, 1.0])], "scene_id string, pid long, features array<double>")
    graph = spark.createDataFrame([("s", 0, 1, 1.0), ("s", 1, 2, 1.0)], "scene_id string, src long, dst long, weight double")
    assert cut_pursuit.cut_pursuit(nodes, graph, 0.01, speed=2).count() == 4
    merged = cut_pursuit.Pursuit(x, np.ones(3), [0, 1], [1, 2], [1, 1], 0.01, cut_pursuit.SPEEDS[2], cutoff=2).run()
    assert len(set(merged.tolist())) < 3


def test_local_cut():
    w = np.array([[0, 0.95, 0.1], [0.95, 0, 0.1], [0.1, 0.1, 0]])
    assert voxel_graph.cut(w, 0.3).tolist() == [0, 1]


def test_linkage_splits_two_planes(spark):
    rng = np.random.default_rng(7)
    a = np.column_stack([rng.random(150), rng.random(150), 0.001 * rng.normal(size=150)])
    b = np.column_stack([rng.random(150), 3 + 0.001 * rng.normal(size=150), rng.random(150)])
    got = [r.label for r in linkage.pairwise_linkage(cloud(spark, np.concatenate([a, b])), 12, 90, 5, 10).orderBy("pid").collect()]
    first, second = set(got[:150]) - {-1}, set(got[150:]) - {-1}
    assert first and second and not first & second
    assert sum(x == -1 for x in got) < 60


def test_statistics():
    # chi-squared, t and W values from published tables
    assert distributions.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert distributions.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = analysis.shapiro_wilk(weights)
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)
    normal = np.random.default_rng(8).normal(size=300).tolist()
    assert analysis.shapiro_wilk(normal)[1] > 0.05


def test_compare_variants(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=80)
    rows = [(float(x), float(y)) for x, y in zip(a, rng.normal(size=80) + 2)]
    frame = spark.createDataFrame(rows, "OOA_cp_P double, OOA_cp_M double")
    assert analysis.compare_variants(frame, "cp", "OOA")["differs"]
    assert analysis.compare_variants(frame, "cp", "OOA", reference_compat=True)["test"] == "mann-whitney"
    with pytest.raises(ValueError, match="two suffixes"):
        analysis.compare_variants(frame, "cp", "OOA", suffixes=("_P",))


def test_mesh_files(spark, tmp_path):
    head = "element vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\n" + head + "0 0 0 255 0 0\n1 0 0 0 255 0\n1 1 0 0 0 255\n0 1 0 0 0 0\n4 0 1 2 3\n")
    kind = np.dtype([("p", "<f4", 3), ("c", "u1", 3)])
    rows = np.array([((0, 0, 0), (255, 0, 0)), ((1, 0, 0), (0, 255, 0)), ((1, 1, 0), (0, 0, 255)), ((0, 1, 0), (0, 0, 0))], kind)
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\n" + head.encode() + rows.tobytes() + b"\x04" + np.arange(4, dtype="<i4").tobytes())
    points, faces = mesh.read_points(spark, str(tmp_path)), mesh.read_faces(spark, str(tmp_path))
    assert {(r.scene_id, r.a, r.b, r.c) for r in faces.collect()} == {(s, 0, i, i + 1) for s in "ab" for i in (1, 2)}
    assert {(r.scene_id, r.pid, r.x, r.y, r.r, r.nx) for r in points.collect()} == {(s, i, x, y, float(i == 0), None) for s in "ab" for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])}
    assert edges.mesh_edges(points, faces).count() == 2 * 10
    assert {round(r.nz, 6) for r in edges.face_normals(points, faces).collect()} == {1.0}


def test_scans(spark, tmp_path):
    (tmp_path / "scene0000_00.aggregation.json").write_text(json.dumps({"segGroups": [{"segments": [1, 2], "label": "chair"}, {"segments": [2]}]}))
    (tmp_path / "scene0000_00_vh_clean_2.0.010000.segs.json").write_text(json.dumps({"segIndices": [0, 1, 2, 1]}))
    groups, indices = scans.segment_groups(spark, str(tmp_path)), scans.segment_indices(spark, str(tmp_path))
    truth = scans.ground_truth(groups, indices).orderBy("pid").collect()
    assert [(r.scene_id, r.label) for r in truth] == [("scene0000_00", x) for x in (0, 1, 2, 1)]
    assert scans.object_points(groups, indices).count() == 4
    names = spark.createDataFrame([("scene0000_00",), ("scene0000_01",), ("scene0001_00",), ("scene0002_01",)], "name string")
    assert {r.name for r in scans.scenes(names, ["scene0001_00"]).collect()} == {"scene0000_00", "scene0002_01"}
    assert scans.chosen_scenes(names, 2).count() == 2


def test_tables(spark, tmp_path):
    graph = chain(spark).union(chain(spark).selectExpr("'t'", "src", "dst", "dist"))
    tables.write_graph(graph, str(tmp_path / "graph"))
    one = tables.read_graph(spark, str(tmp_path / "graph"), "t")
    assert one.count() == 6 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()
    rows = [(1, "a", 5, "cp", 0.5, 2, 0.1), (1, "a", 5, "vgs", 0.6, 3, 0.2), (2, "b", 7, "cp", 0.7, 4, 0.3)]
    wide = tables.wide_results(spark.createDataFrame(rows, "ID int, Name string, n_points int, algorithm string, ooa double, n_superpoints int, duration double"), ["cp", "vgs"])
    assert wide.columns == tables.result_columns(["cp", "vgs"])
    for k, name in enumerate(("x", "y")):
        tables.write_csv(wide.filter(f"ID = {k + 1}"), str(tmp_path / name))
    assert tables.concat_csv(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).count() == 2
    colours = tables.random_colours(spark, 50)
    assert colours.filter("colour rlike '^#[0-9a-f]{6}$'").count() == 50


def test_latex_rows():
    assert analysis.latex_table([{"a": 1.234, "b": "x"}], ["b", "a"]) == r"x & 1.23 \\"


def test_shared_tables(spark):
    from lithomesh.plans.storage import discard, materialise, sweep

    one, two = materialise(spark.range(5), "t"), materialise(spark.range(7), "t")
    assert (one.count(), two.count()) == (5, 7)
    discard(one)
    with pytest.raises(Exception, match="FAILED_READ_FILE|PATH_NOT_FOUND|does not exist"):
        one.count()
    assert two.count() == 7
    sweep(spark)
    with pytest.raises(Exception, match="FAILED_READ_FILE|PATH_NOT_FOUND|does not exist"):
        two.count()


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from lithomesh.plans import storage

    session = lambda named, master: SimpleNamespace(conf={"spark.checkpoint.dir": named}, sparkContext=SimpleNamespace(master=master))
    assert storage.shared_dir(session("hdfs://h/c/", "yarn")) == "hdfs://h/c"
    assert storage.shared_dir(session(None, "local[2]")).startswith("file://")
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(session(None, "spark://host:7077"))
    assert storage.qualified(spark, f"file:{tmp_path}/x") == f"file://{tmp_path}/x"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "file:///")
    try:
        assert storage.qualified(spark, f"{tmp_path}/x") == f"file://{tmp_path}/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_fused_components(spark):
    from lithomesh.operators.components import fuse_small, random_subgraph

    e = spark.createDataFrame([("s", 2, 3), ("s", 4, 5), ("s", 7, 8)], "scene_id string, src long, dst long")
    # sizes 3, 1, 1, 2, 1: component 3 leads to 0, 4 to 5, 7 and 8 only to each other
    p = partition(spark, [0, 0, 0, 3, 4, 5, 5, 7, 8])
    assert [r.label for r in fuse_small(p, e, 2).orderBy("pid").collect()] == [0, 0, 0, 0, 5, 5, 5, 7, 7]
    sub = random_subgraph(chain(spark, 20).select("scene_id", "src", "dst"), 6)
    ends = {x for r in sub.collect() for x in (r.src, r.dst)}
    assert len(ends) == 6 and max(ends) - min(ends) == 5
    assert random_subgraph(chain(spark, 4).select("scene_id", "src", "dst"), 9).count() == 6
