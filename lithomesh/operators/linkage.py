"""Pairwise linkage: points linked to flatter neighbours, grown to planar patches, and patches merged.

The linkage, the thresholds and the patch graph are joins and aggregates. Growth
along the linkage forest depends on each tree's centre, and merging on the order
of the patches, so both run in a task a scene, over ids, normals and small graphs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.operators.edges import mutual
from lithomesh.operators.features import pca_normals
from lithomesh.operators.neighbours import knn
from lithomesh.operators.scoring import partition_from_clusters
from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import materialise

SCENE = "scene_id"
MAD = 1.4826
#: Scaled distance from the median beyond which a point is an outlier of its plane.
OUTLIER = 2.5
LEAST_ANGLE = 10.0


def linkage(shape: DataFrame, neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents (scene_id, pid, parent) and centres (scene_id, pid).

    A point's parent is, of its mutual neighbours with smaller lambda0, the one whose
    normal is nearest (angles folded to 90 degrees, ties to the smaller id). Points
    without one are centres if their lambda0 is below the scene's mean plus its
    population standard deviation.
    """
    own = shape.select(SCENE, "pid", F.struct("nx", "ny", "nz").alias("n"), "lambda0")
    pairs = mutual(neighbours.select(SCENE, "src", "dst")).join(own.select(SCENE, F.col("pid").alias("src"), F.col("n").alias("n1"), F.col("lambda0").alias("f1")), [SCENE, "src"])
    pairs = pairs.join(own.select(SCENE, F.col("pid").alias("dst"), F.col("n").alias("n2"), F.col("lambda0").alias("f2")), [SCENE, "dst"]).filter("f2 < f1")
    dot = sum(F.col(f"n1.n{c}") * F.col(f"n2.n{c}") for c in "xyz")
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    parents = pairs.groupBy(SCENE, F.col("src").alias("pid")).agg(F.min(F.struct(angle.alias("angle"), F.col("dst").alias("parent"))).alias("best")).select(SCENE, "pid", "best.parent")
    limit = shape.groupBy(SCENE).agg((F.avg("lambda0") + F.stddev_pop("lambda0")).alias("limit"))
    centres = own.join(parents, [SCENE, "pid"], "left_anti").join(limit, SCENE).filter("lambda0 < limit").select(SCENE, "pid")
    return parents, centres


def _grow(angle: float, least: int):
    limit = math.cos(math.radians(angle))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        pid = frame["pid"].to_numpy()
        at = {p: i for i, p in enumerate(pid.tolist())}
        normal = frame[["nx", "ny", "nz"]].to_numpy(float)
        children: dict[int, list[int]] = {}
        for i, parent in enumerate(frame["parent"].tolist()):
            if parent >= 0:
                children.setdefault(at[int(parent)], []).append(i)
        centres = np.flatnonzero(frame["centre"].to_numpy()).tolist()
        out_pid, out_cluster, number = [], [], 0
        for centre in centres:  # grows while it is read
            cluster = [centre]
            for seed in cluster:
                for child in children.get(seed, ()):
                    if normal[centre] @ normal[child] > limit:
                        cluster.append(child)
                    else:
                        centres.append(child)
            if len(cluster) >= least:
                out_pid += pid[cluster].tolist()
                out_cluster += [number] * len(cluster)
                number += 1
        return pd.DataFrame({"scene_id": frame["scene_id"].iloc[0], "pid": np.array(out_pid, np.int64), "cluster": np.array(out_cluster, np.int64)})

    return run


def grow_clusters(shape: DataFrame, parents: DataFrame, centres: DataFrame, angle: float, least: int) -> DataFrame:
    """(scene_id, pid, cluster): centres take the points linked below them whose normals are within ``angle`` of theirs; others become centres. Smaller clusters are left out."""
    frame = shape.select(SCENE, "pid", "nx", "ny", "nz").join(parents, [SCENE, "pid"], "left").join(centres.withColumn("centre", F.lit(True)), [SCENE, "pid"], "left")
    frame = frame.select(SCENE, "pid", "nx", "ny", "nz", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), F.coalesce("centre", F.lit(False)).alias("centre"))
    return frame.groupBy(SCENE).applyInPandas(_grow(angle, least), "scene_id string, pid long, cluster long")


def _plane(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    mean = points.mean(0)
    values, vectors = np.linalg.eigh(np.cov(points.T, bias=True) if len(points) > 1 else np.zeros((3, 3)))
    return mean, vectors[:, 0], float(max(values[0], 0.0) / (max(values.sum(), 0.0) + 1e-12))


def inliers_of(points: np.ndarray, mean: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Points whose distance from a plane is not far from the median distance, on the robust scale."""
    distance = np.abs((points - mean) @ normal)
    middle = np.sort(distance)[len(distance) // 2]
    scale = MAD * np.sort(np.abs(distance - middle))[len(distance) // 2]
    return np.abs(distance - middle) / (scale + 1e-6) < OUTLIER


def robust_plane(points: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Mean, normal, lambda0 and inliers of a cluster.

    Of seeded three-point planes the half of the points nearest to each is fitted, the
    flattest fit wins, and its inliers are fitted again.
    """
    n = len(points)
    half = max(3, n // 2)
    tries = int(math.log(1 - 0.9999) / math.log(1 - 0.5**3))
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(tries if n > 3 else 0):
        mean, normal, _ = _plane(points[rng.integers(0, n, 3)])
        near = np.argsort(np.abs((points - mean) @ normal), kind="stable")[:half]
        fit = _plane(points[near])
        if best is None or fit[2] < best[2]:
            best = fit
    mean, normal, _ = best or _plane(points)
    inside = inliers_of(points, mean, normal) if n > 3 else np.ones(n, bool)
    mean, normal, flat = _plane(points[inside] if inside.sum() >= 3 else points)
    return mean, normal, flat, inside


def _patch(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("pid")
    mean, normal, flat, inside = robust_plane(frame[["x", "y", "z"]].to_numpy(float), int(key[1]))
    return pd.DataFrame({"scene_id": [key[0]], "cluster": [key[1]], "nx": [normal[0]], "ny": [normal[1]], "nz": [normal[2]], "lambda0": [flat], "n": [int(inside.sum())], "inside": [frame["pid"].to_numpy()[inside]]})


def patches(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Robust plane of each cluster: normal, lambda0, and its inliers."""
    placed = clusters.join(points.select(SCENE, "pid", "x", "y", "z"), [SCENE, "pid"])
    return placed.groupBy(SCENE, "cluster").applyInPandas(_patch, "scene_id string, cluster long, nx double, ny double, nz double, lambda0 double, n long, inside array<long>")


def patch_graph(found: DataFrame, neighbours: DataFrame, least: int = 3) -> DataFrame:
    """(scene_id, a, b): patches where inliers of a have at least so many different mutual neighbours among b's."""
    owner = found.select(SCENE, "cluster", F.explode("inside").alias("pid")).groupBy(SCENE, "pid").agg(F.max("cluster").alias("cluster"))
    pairs = mutual(neighbours.select(SCENE, "src", "dst")).join(owner.select(SCENE, F.col("pid").alias("src"), F.col("cluster").alias("a")), [SCENE, "src"])
    pairs = pairs.join(owner.select(SCENE, F.col("pid").alias("dst"), F.col("cluster").alias("b")), [SCENE, "dst"]).filter("a <> b")
    return pairs.groupBy(SCENE, "a", "b").agg(F.countDistinct("dst").alias("n")).filter(F.col("n") >= least).select(SCENE, "a", "b")


def _merge(theta: float):
    low, high = math.radians(LEAST_ANGLE), math.radians(theta)

    def run(found: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["n", "cluster"], ascending=[False, True]).reset_index(drop=True)
        flat = found["lambda0"].to_numpy()
        middle = np.sort(flat)[len(flat) // 2]
        spread = MAD * np.sort(np.abs(flat - middle))[len(flat) // 2]
        share = np.clip((flat - middle) / (2.5 * spread), 0, 1) if spread > 0 else (flat > middle).astype(float)
        limit = low + share * (high - low)
        normal = found[["nx", "ny", "nz"]].to_numpy(float)
        at = {c: i for i, c in enumerate(found["cluster"].tolist())}
        near: dict[int, list[int]] = {}
        for a, b in sorted(zip(graph["a"].tolist(), graph["b"].tolist()), key=lambda e: (at[e[0]], at[e[1]])):
            near.setdefault(at[a], []).append(at[b])
        group = np.full(len(found), -1)
        for start in range(len(found)):
            if group[start] >= 0:
                continue
            group[start], queue = start, [start]
            for seed in queue:
                for other in near.get(seed, ()):
                    if group[other] < 0 and math.acos(min(1.0, abs(normal[start] @ normal[other]))) < min(limit[seed], limit[start]):
                        group[other] = start
                        queue.append(other)
        return pd.DataFrame({"scene_id": found["scene_id"], "cluster": found["cluster"], "patch": group.astype(np.int64)})

    return run


def merge_patches(found: DataFrame, graph: DataFrame, theta: float = 90.0) -> DataFrame:
    """(scene_id, cluster, patch): patches merged, the largest first, over adjacent ones with normals within a threshold.

    The threshold rises from 10 degrees for flat patches to ``theta`` for those whose
    lambda0 lies 2.5 robust deviations over the median. Each patch is merged once.
    """
    return found.drop("inside").groupBy(SCENE).cogroup(graph.groupBy(SCENE)).applyInPandas(_merge(theta), "scene_id string, cluster long, patch long")


def pairwise_linkage(points: DataFrame, k: int = 100, angle: float = 90.0, least: int = 10, angle_dev: float = 10.0, neighbours: DataFrame | None = None, normals: DataFrame | None = None) -> DataFrame:
    """(scene_id, pid, label) of planar patches, -1 for points in none; a scene without patches is one cluster.

    ``neighbours`` (scene_id, src, dst) replace the k nearest points, as for a mesh;
    ``normals`` replace those of the neighbourhoods.
    """
    prepare_workers(points.sparkSession)
    near = neighbours if neighbours is not None else knn(points, points, k)
    near = materialise(near.select(SCENE, "src", "dst"), "linkage-neighbours")
    shape = materialise(pca_normals(points, near, normals), "linkage-shape")
    clusters = materialise(grow_clusters(shape, *linkage(shape, near), angle_dev, least), "linkage-clusters")
    found = materialise(patches(points, clusters), "linkage-patches")
    merged = merge_patches(found, patch_graph(found, near), angle)
    members = clusters.join(merged, [SCENE, "cluster"]).groupBy(SCENE, F.col("patch").alias("_patch")).agg(F.collect_list("pid").alias("pids"))
    numbered = members.select(SCENE, (F.row_number().over(Window.partitionBy(SCENE).orderBy("_patch")) - 1).alias("cluster"), "pids")
    empty = points.select(SCENE).distinct().join(found.select(SCENE).distinct(), SCENE, "left_anti")
    out = partition_from_clusters(numbered, points)
    return out.join(empty.withColumn("_all", F.lit(True)), SCENE, "left").select(SCENE, "pid", F.when(F.col("_all"), 0).otherwise(F.col("label")).alias("label"))
