"""Local geometric features of points and voxels from scatter matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithomesh.functions.eigen import VECTORS, with_eigen
from lithomesh.operators.voxels import scatter

SCENE = "scene_id"


def neighbourhood_scatter(points: DataFrame, neighbours: DataFrame, include_self: bool = True) -> DataFrame:
    """Covariance of each point's neighbours (scene_id, src, dst) and of itself: (scene_id, pid, sxx ... szz, n)."""
    pairs = neighbours.select(SCENE, "src", "dst")
    if include_self:
        pairs = pairs.union(points.select(SCENE, F.col("pid").alias("src"), F.col("pid").alias("dst"))).distinct()
    near = pairs.join(points.select(SCENE, F.col("pid").alias("dst"), "x", "y", "z"), [SCENE, "dst"])
    return scatter(near, [SCENE, "src"], normalised=True, least=1).withColumnRenamed("src", "pid")


def _root(i: int) -> Column:
    return F.sqrt(F.col(f"l{i}"))


def _point_features() -> dict[str, Column]:
    """Features by name; null where all neighbours coincide."""
    total = F.col("l1") + F.col("l2") + F.col("l3")
    unary = {c: sum(F.col(f"l{i}") * F.abs(F.col(f"v{i}{c}")) for i in (1, 2, 3)) for c in "xyz"}
    norm = F.sqrt(sum(u * u for u in unary.values()))
    entropy = -sum(F.when(F.col(f"l{i}") > 0, F.col(f"l{i}") * F.ln(f"l{i}")).otherwise(0.0) for i in (1, 2, 3))
    return {
        "linearity": F.try_divide(_root(1) - _root(2), _root(1)),
        "planarity": F.try_divide(_root(2) - _root(3), _root(1)),
        "scattering": F.try_divide(_root(3), _root(1)),
        "verticality": F.try_divide(unary["z"], norm),
        "omnivariance": F.try_divide(F.col("l3"), total),
        "eigensum": total,
        "anisotropy": F.try_divide(F.col("l1") - F.col("l3"), F.col("l1")),
        "eigenentropy": entropy,
        "curvature": F.try_divide(F.col("l3"), total),
        "nx": F.col("v3x"),
        "ny": F.col("v3y"),
        "nz": F.col("v3z"),
    }


GEOF = ["linearity", "planarity", "scattering", "verticality"]
ALL_GEOF = [*GEOF, "omnivariance", "eigensum", "anisotropy", "eigenentropy", "nx", "ny", "nz"]
CURVATURE = [*GEOF, "curvature", "nx", "ny", "nz"]


def point_features(points: DataFrame, neighbours: DataFrame, names: list[str] = GEOF) -> DataFrame:
    """Features of each point from its neighbours, however many, and itself."""
    eigen = with_eigen(neighbourhood_scatter(points, neighbours))
    known = _point_features()
    return eigen.select(SCENE, "pid", *[known[n].alias(n) for n in names])


def graph_features(features: DataFrame, points: DataFrame) -> DataFrame:
    """Feature vector of a point for graph cuts: shape features, verticality doubled, and colour."""
    return features.join(points.select(SCENE, "pid", "r", "g", "b"), [SCENE, "pid"]).select(SCENE, "pid", F.array("linearity", "planarity", "scattering", F.col("verticality") * 2, "r", "g", "b").alias("features"))


def pca_normals(points: DataFrame, neighbours: DataFrame, normals: DataFrame | None = None) -> DataFrame:
    """Normal (least eigenvector) and ``lambda0``, the least eigenvalue's share, of each point; given normals replace the first."""
    eigen = with_eigen(neighbourhood_scatter(points, neighbours))
    total = F.col("l1") + F.col("l2") + F.col("l3") + 1e-12
    out = eigen.select(SCENE, "pid", *[F.col(f"v3{c}").alias(f"n{c}") for c in "xyz"], (F.col("l3") / total).alias("lambda0"))
    if normals is not None:
        out = out.drop("nx", "ny", "nz").join(normals.select(SCENE, "pid", "nx", "ny", "nz"), [SCENE, "pid"])
    return out


#: Order in which one kind of voxel graph has its features; the other has anisotropy before curvature.
VOXEL_FEATURES = ["linearity", "planarity", "scattering", "curvature", "anisotropy", "entropy", "eigensum", "omnivariance"]
SUPERVOXEL_FEATURES = ["linearity", "planarity", "scattering", "anisotropy", "curvature", "entropy", "eigensum", "omnivariance"]


def voxel_features(scatters: DataFrame, by: list[str], names: list[str] = VOXEL_FEATURES) -> DataFrame:
    """Array ``eigen`` of eight features from eigenvalues over their length; zeros where all are 0. Also the normal, towards z."""
    eigen = with_eigen(scatters)
    length = F.sqrt(F.col("l1") ** 2 + F.col("l2") ** 2 + F.col("l3") ** 2)
    eigen = eigen.withColumn("_len", length)
    for i in (1, 2, 3):
        eigen = eigen.withColumn(f"e{i}", F.coalesce(F.try_divide(F.col(f"l{i}"), F.col("_len")), F.lit(0.0)))
    e1, e2, e3 = F.col("e1"), F.col("e2"), F.col("e3")
    some = F.col("_len") > 0
    known = {
        "linearity": F.when(some, F.try_divide(e1 - e2, e1)),
        "planarity": F.when(some, F.try_divide(e2 - e3, e1)),
        "scattering": F.when(some, F.try_divide(e3, e1)),
        "curvature": F.when(some, F.try_divide(e3, e1 + e2 + e3)),
        "anisotropy": F.when(some & (e2 > 0), F.try_divide(e1 - e3, e1)),
        "entropy": F.when(e1 * e2 * e3 > 0, -(e1 * F.ln(e1) + e2 * F.ln(e2) + e3 * F.ln(e3))),
        "eigensum": F.when(some, e1 + e2 + e3),
        "omnivariance": F.when(some, F.cbrt(e1 * e2 * e3)),
    }
    sign = F.when(F.col("v3z") < 0, -1.0).otherwise(1.0)
    return eigen.select(*by, F.array(*[F.coalesce(known[n], F.lit(0.0)) for n in names]).alias("eigen"), *[(F.when(some, F.col(f"v3{c}") * sign).otherwise(0.0)).alias(f"n{c}") for c in "xyz"])


__all__ = ["ALL_GEOF", "CURVATURE", "GEOF", "VECTORS", "graph_features", "neighbourhood_scatter", "pca_normals", "point_features", "voxel_features"]
