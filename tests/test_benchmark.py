"""The benchmark driver over all scenes."""

from lithomesh.operators import edges, voxels
from lithomesh.operators.supervoxels import supervoxel_adjacency, supervoxel_centres, supervoxels
from lithomesh.plans import benchmark, catalog

SF = "/root/testdata/sf0.001"


def test_benchmark(spark):
    points = catalog.points(spark, SF).drop("label")
    graph = catalog.graph(spark, SF)
    chosen = {n: f for n, f in benchmark.algorithms().items() if n in ("cp", "vgs")}
    found = benchmark.run_benchmark(points, catalog.objects(spark, SF), graph, chosen | {"left out": None}, exclude=("left out",))
    rows = found.collect()
    assert len(rows) == catalog.SCENES and found.columns[:3] == ["ID", "Name", "|V|"]
    assert all(0 < r["OOA_cp"] <= 1 and 0 < r["OOA_vgs"] <= 1 for r in rows)


def test_supervoxels_along_a_mesh(spark):
    points = catalog.points(spark, SF)
    graph = catalog.graph(spark, SF)
    plain = supervoxels(points, 0.1, 0.4, refinements=0)
    along = supervoxels(points, 0.1, 0.4, refinements=0, lengths=graph)
    for found in (plain, along):
        assert found.count() == points.count() and found.filter("label > 0").count() > 0
    assert supervoxel_centres(points, plain).count() == plain.filter("label > 0").select("scene_id", "label").distinct().count()
    pairs = supervoxel_adjacency(points, plain, 0.1)
    assert pairs.exceptAll(pairs.selectExpr("scene_id", "b AS a", "a AS b", "n")).count() == 0
    assert edges.complete_sources(points, graph, 5).count() == catalog.SCENES
    assert voxels.voxel_centre(points, 0.1).count() > 0


def test_graphs_along_a_mesh(spark):
    from lithomesh.operators.voxel_graph import segment_supervoxels, segment_voxels

    points = catalog.points(spark, SF).drop("label")
    graph = catalog.graph(spark, SF)
    voxel = segment_voxels(points, 0.15, points_min=0, adjacency_min=0, voxels_min=0, edges=graph)
    assert voxel.count() == points.count() and voxel.filter("label < 0").count() == 0
    own = supervoxels(points, 0.1, 0.4, refinements=0, lengths=graph)
    found = segment_supervoxels(points, own, 0.5, edges=graph)
    assert found.join(own, ["scene_id", "pid"]).count() == points.count()
