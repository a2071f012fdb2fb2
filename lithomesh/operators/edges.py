"""Edges between points: from faces, cleaned, weighted, and between components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCENE = "scene_id"


def distance(a: str = "a", b: str = "b"):
    return F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"))


def mesh_edges(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Distinct directed edges of a mesh with their lengths: (scene_id, src, dst, dist)."""
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")]
    sides = F.array(*[F.struct(F.col(u).alias("src"), F.col(v).alias("dst")) for u, v in pairs])
    edges = faces.select(SCENE, F.explode(sides).alias("e")).select(SCENE, "e.src", "e.dst").filter("src <> dst").distinct()
    at = points.select(SCENE, "pid", F.struct("x", "y", "z").alias("p"))
    ends = edges.join(at.select(SCENE, F.col("pid").alias("src"), F.col("p").alias("a")), [SCENE, "src"]).join(at.select(SCENE, F.col("pid").alias("dst"), F.col("p").alias("b")), [SCENE, "dst"])
    return ends.select(SCENE, "src", "dst", distance().alias("dist"))


def face_normals(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normal of each vertex: the sum of its faces' cross products."""
    at = points.select(SCENE, "pid", F.struct("x", "y", "z").alias("p"))
    placed = faces
    for v in "abc":
        placed = placed.join(at.select(SCENE, F.col("pid").alias(v), F.col("p").alias(f"p{v}")), [SCENE, v])
    u = {c: F.col(f"pb.{c}") - F.col(f"pa.{c}") for c in "xyz"}
    v = {c: F.col(f"pc.{c}") - F.col(f"pa.{c}") for c in "xyz"}
    cross = {"nx": u["y"] * v["z"] - u["z"] * v["y"], "ny": u["z"] * v["x"] - u["x"] * v["z"], "nz": u["x"] * v["y"] - u["y"] * v["x"]}
    own = placed.select(SCENE, F.explode(F.array("a", "b", "c")).alias("pid"), *[e.alias(n) for n, e in cross.items()])
    from lithomesh.operators.voxels import mean_normals

    return mean_normals(own, [SCENE, "pid"])


def without_reverse(edges: DataFrame) -> DataFrame:
    """Of (u, v) and (v, u) the one from the smaller end stays; an edge in one direction only stays as it is."""
    back = edges.select(SCENE, F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("both", F.lit(True))
    return edges.join(back, [SCENE, "src", "dst"], "left").filter("not (src > dst and coalesce(both, false))").drop("both")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is there too."""
    back = edges.select(SCENE, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, [SCENE, "src", "dst"], "left_semi")


def between_components(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends have different labels, as labels; repeated ones stay."""
    own = partition.select(SCENE, "pid", "label")
    ends = edges.join(own.select(SCENE, F.col("pid").alias("src"), F.col("label").alias("ls")), [SCENE, "src"]).join(own.select(SCENE, F.col("pid").alias("dst"), F.col("label").alias("lt")), [SCENE, "dst"])
    return ends.filter("ls <> lt").select(SCENE, "ls", "lt")


def border_weights(partition: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Half the weight of all directed edges between each two components."""
    own = partition.select(SCENE, "pid", "label")
    ends = edges.join(own.select(SCENE, F.col("pid").alias("src"), F.col("label").alias("ls")), [SCENE, "src"]).join(own.select(SCENE, F.col("pid").alias("dst"), F.col("label").alias("lt")), [SCENE, "dst"])
    return ends.filter("ls <> lt").groupBy(SCENE, F.least("ls", "lt").alias("c1"), F.greatest("ls", "lt").alias("c2")).agg((F.sum(F.col(weight)) * 0.5).alias("border"))


def edge_weights(edges: DataFrame, strength: float = 1.0) -> DataFrame:
    """weight = 1 / (strength + dist / mean dist of the scene)."""
    mean = edges.groupBy(SCENE).agg(F.avg("dist").alias("_mean"))
    return edges.join(mean, SCENE).withColumn("weight", 1 / (F.lit(strength) + F.col("dist") / F.col("_mean"))).drop("_mean")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest targets of each source, ties by id, with their ``rank`` from 1."""
    order = Window.partitionBy(SCENE, "src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def adjacency(edges: DataFrame) -> DataFrame:
    """Targets of each source by distance, as one array."""
    ordered = F.sort_array(F.collect_list(F.struct("dist", "dst")))
    return edges.groupBy(SCENE, "src").agg(F.transform(ordered, lambda e: e["dst"]).alias("targets"))


def complete_sources(points: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Scenes in which every point is the source of k edges or more."""
    degree = edges.groupBy(SCENE, F.col("src").alias("pid")).agg(F.count(F.lit(1)).alias("d"))
    per = points.select(SCENE, "pid").join(degree, [SCENE, "pid"], "left").groupBy(SCENE).agg(F.min(F.coalesce("d", F.lit(0))).alias("least"))
    return per.filter(F.col("least") >= k).select(SCENE)


def sorted_graph(edges: DataFrame) -> DataFrame:
    """Edges dealt out by source and sorted by (source, target) in each partition."""
    return edges.repartition(SCENE, "src").sortWithinPartitions(SCENE, "src", "dst")
