"""Segmentation of voxels or supervoxels by local graph cuts.

Attributes, adjacency, mutual validation and clusters are joins and aggregates;
only the greedy cut, whose result depends on the order of the weights, runs in a
loop over the nodes of a task, on each node's neighbourhood.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.operators.components import connected_components
from lithomesh.operators.features import SUPERVOXEL_FEATURES, VOXEL_FEATURES, voxel_features
from lithomesh.operators.neighbours import nearest_point, radius_join
from lithomesh.operators.voxels import BINS, SCENE, binned, scatter, voxel_centre
from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import materialise

#: Value of a distance whose inputs are missing.
MISSING = 100.0
#: Nodes whose neighbourhoods a task cuts, on average.
NODES = 256


def pair_distances(c1, c2, n1, n2, e1, e2, eigen_from: int = 4, space=None) -> np.ndarray:
    """Five distances of pairs of nodes, as rows: space, normal angle, stair, eigen features, convexity.

    ``eigen_from`` is the first feature that counts; ``space`` replaces the Euclidean
    distance of the centroids.
    """
    offset = c1 - c2
    plain = np.linalg.norm(offset, axis=1)
    s = plain if space is None else space
    safe = np.where(plain > 0, plain, 1.0)
    u = offset / safe[:, None]
    dot = lambda a, b: np.clip((a * b).sum(1), -1.0, 1.0)
    has = (plain > 0) & (np.abs(n1).sum(1) > 0) & (np.abs(n2).sum(1) > 0)
    angle = np.where(has, np.arccos(dot(n1, n2)), MISSING)
    step = lambda n: (n * c2).sum(1) - (n * c1).sum(1)
    stair = np.where(has, np.sqrt(step(n1) ** 2 + step(n2) ** 2), MISSING)
    a, b = e1[:, eigen_from:], e2[:, eigen_from:]
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    eigen = np.where(size > 0, 1 - (a * b).sum(1) / np.where(size > 0, size, 1.0), MISSING)
    a1, a2 = np.arccos(dot(n1, u)), np.arccos(dot(n2, u))
    q = np.arccos(dot(np.cross(c1, c2), u))
    q = np.minimum(q, math.pi - q)
    limit = (math.pi / 2) / (1 + np.exp(-0.5 * (angle - math.pi / 6)))
    convex = np.where(has, np.where(q > limit, np.abs(a1 - a2), math.pi), MISSING)
    return np.column_stack([s, angle, stair, eigen, convex])


def similarity(d: np.ndarray, sigmas: tuple, weight: float, convexity: bool) -> np.ndarray:
    """exp(-total / 2 weight^2) of scaled distances; without convexity squares are over the sigmas themselves."""
    p, n, o, e, c = sigmas
    if convexity:
        total = np.sqrt((d[:, 0] / p) ** 2 + (d[:, 1] / n) ** 2 + (d[:, 2] / o) ** 2 + (d[:, 3] / e) ** 2 + (d[:, 4] / c) ** 2)
    else:
        total = np.sqrt(d[:, 0] ** 2 / p + d[:, 1] ** 2 / n + d[:, 2] ** 2 / o + d[:, 3] ** 2 / e)
    return np.exp(-0.5 * total / weight**2)


def cut(weights: np.ndarray, threshold: float) -> np.ndarray:
    """Nodes that end in the segment of node 0 after merging along falling weights.

    A segment starts with inner weight 1; two merge where their edge weighs more than
    the larger of (inner weight - threshold / size), and take its weight as the new
    inner weight. Equal weights go by position.
    """
    m = len(weights)
    segment, size, inner = np.arange(m), np.ones(m, int), np.ones(m)
    for k in np.argsort(-weights, axis=None, kind="stable"):
        a, b = segment[k // m], segment[k % m]
        if a == b:
            continue
        limit_a, limit_b = inner[a] - threshold / size[a], inner[b] - threshold / size[b]
        keep, gone = (a, b) if limit_a >= limit_b else (b, a)
        w = weights[k // m, k % m]
        if w > max(limit_a, limit_b):
            inner[keep] = w
            segment[segment == gone] = keep
            size[keep] += size[gone]
    return np.flatnonzero(segment == segment[0])


def _arrays(frame: pd.DataFrame, suffix: str = ""):
    c = frame[[f"{x}{suffix}" for x in ("cx", "cy", "cz")]].to_numpy(float)
    n = frame[[f"{x}{suffix}" for x in ("nx", "ny", "nz")]].to_numpy(float)
    return c, n, np.vstack(frame[f"eigen{suffix}"].to_numpy()) if len(frame) else np.zeros((0, 8))


def _cut_nodes(sigmas: tuple, weight: float, threshold: float, eigen_from: int, convexity: bool):
    def one(centre: int, frame: pd.DataFrame, lengths: pd.DataFrame) -> np.ndarray:
        frame = frame.assign(_own=frame["node"] != centre).sort_values(["_own", "node"])
        c, n, e = _arrays(frame)
        m = len(frame)
        i, j = np.divmod(np.arange(m * m), m)
        space = None
        if len(lengths):
            at = {x: k for k, x in enumerate(frame["node"].tolist())}
            space = np.linalg.norm(c[i] - c[j], axis=1)
            a, b = (lengths[x].map(at).to_numpy() for x in ("u", "v"))
            space[a * m + b] = lengths["dist"].to_numpy()
            space[b * m + a] = lengths["dist"].to_numpy()
        weights = similarity(pair_distances(c[i], c[j], n[i], n[j], e[i], e[j], eigen_from, space), sigmas, weight, convexity)
        weights[i == j] = 0.0
        members = frame["node"].to_numpy()[cut(weights.reshape(m, m), threshold)]
        return members[members != centre]

    def run(key: tuple, frames: pd.DataFrame, lengths: pd.DataFrame) -> pd.DataFrame:
        known = dict(list(lengths.groupby("at_centre")))
        found = [(centre, one(centre, frame, known.get(centre, lengths[:0]))) for centre, frame in frames.groupby("centre")]
        u = np.repeat(np.array([c for c, _ in found], np.int64), [len(x) for _, x in found])
        return pd.DataFrame({"scene_id": key[0], "u": u, "v": np.concatenate([x for _, x in found]) if found else u})

    return run


def segment_nodes(nodes: DataFrame, adjacency: DataFrame, sigmas: tuple, weight: float, threshold: float, adjacency_min: int, eigen_from: int, convexity: bool) -> DataFrame:
    """(scene_id, node, cluster) from nodes (scene_id, node, cx, cy, cz, nx, ny, nz, eigen) and pairs (scene_id, u, v, and perhaps dist) with u <> v.

    A cluster is named by its smallest node; node ids must be unique over all scenes.
    Where pairs have a ``dist``, it replaces the distance of the centroids in the cuts.
    """
    prepare_workers(nodes.sparkSession)
    around = adjacency.select(SCENE, F.col("u").alias("centre"), F.col("v").alias("node")).union(nodes.select(SCENE, F.col("node").alias("centre"), "node")).distinct()
    hoods = around.join(nodes, [SCENE, "node"])
    if "dist" in adjacency.columns:
        there = around.select(SCENE, "centre", F.col("node").alias("v"))
        lengths = around.withColumnRenamed("node", "u").join(adjacency.select(SCENE, "u", "v", "dist"), [SCENE, "u"]).join(there, [SCENE, "centre", "v"])
    else:
        lengths = around.limit(0).select(SCENE, "centre", F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("dist"))
    # a task cuts the neighbourhoods of a bounded number of nodes of a scene, one after the other
    parts = nodes.groupBy(SCENE).agg(F.ceil(F.count(F.lit(1)) / NODES).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    lengths = lengths.join(parts, SCENE).select(F.col(SCENE).alias("at_scene"), part("centre").alias("at_part"), F.col("centre").alias("at_centre"), "u", "v", "dist")
    cut_hoods = hoods.join(parts, SCENE).withColumn("part", part("centre")).groupBy(SCENE, "part").cogroup(lengths.groupBy("at_scene", "at_part"))
    linked = materialise(cut_hoods.applyInPandas(_cut_nodes(sigmas, weight, threshold, eigen_from, convexity), "scene_id string, u long, v long"), "voxel-cuts")
    both = linked.join(linked.select(SCENE, F.col("v").alias("u"), F.col("u").alias("v")), [SCENE, "u", "v"], "left_semi")
    # nodes left alone go to the most similar neighbour that is not
    joined = both.select(SCENE, F.col("u").alias("node")).distinct()
    degree = adjacency.groupBy(SCENE, F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    alone = nodes.join(joined, [SCENE, "node"], "left_anti").join(degree.filter(F.col("n") > adjacency_min).drop("n"), [SCENE, "node"], "left_semi")
    fields = ["cx", "cy", "cz", "nx", "ny", "nz", "eigen"]
    second = nodes.join(joined, [SCENE, "node"], "left_semi").select(SCENE, F.col("node").alias("v"), *[F.col(f).alias(f"{f}_2") for f in fields])
    pairs = alone.withColumnRenamed("node", "u").join(adjacency.select(SCENE, "u", "v"), [SCENE, "u"]).join(second, [SCENE, "v"])

    def weigh(frames):
        for frame in frames:
            if len(frame):
                a, b = _arrays(frame), _arrays(frame, "_2")
                w = similarity(pair_distances(a[0], b[0], a[1], b[1], a[2], b[2], eigen_from), sigmas, weight, convexity)
                yield pd.DataFrame({"scene_id": frame["scene_id"], "u": frame["u"], "v": frame["v"], "w": w})

    weighed = pairs.mapInPandas(weigh, "scene_id string, u long, v long, w double")
    best = weighed.groupBy(SCENE, "u").agg(F.max_by("v", F.struct("w", -F.col("v"))).alias("v"))
    edges = materialise(both.select("u", "v").union(best.select("u", "v")), "voxel-connections")
    clusters = connected_components(edges, "u", "v")
    return nodes.select(SCENE, "node").join(clusters.withColumnRenamed("id", "node"), "node", "left").select(SCENE, "node", F.coalesce("component", "node").alias("cluster"))


def mesh_adjacency(centres: DataFrame, points: DataFrame, owner: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, u, v, dist): nodes joined by an edge (scene_id, src, dst, dist) of the point nearest to a node's centre, both ways, at the least length.

    Centres are (scene_id, pid, x, y, z) with the node as ``pid``; ``owner`` is the node of each point.
    """
    known = owner.join(centres.select(SCENE, F.col("pid").alias("node")), [SCENE, "node"], "left_semi")
    near = nearest_point(centres, points.join(known.select(SCENE, "pid"), [SCENE, "pid"], "left_semi"))
    out = near.select(SCENE, F.col("src").alias("u"), F.col("dst").alias("src")).join(edges.select(SCENE, "src", "dst", "dist"), [SCENE, "src"])
    pairs = out.join(known.select(SCENE, F.col("pid").alias("dst"), F.col("node").alias("v")), [SCENE, "dst"]).filter("u <> v").select(SCENE, "u", "v", "dist")
    both = pairs.union(pairs.select(SCENE, F.col("v").alias("u"), F.col("u").alias("v"), "dist"))
    return both.groupBy(SCENE, "u", "v").agg(F.min("dist").alias("dist"))


def voxel_nodes(points: DataFrame, size: float, points_min: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes of a voxel grid with more than ``points_min`` points each, and the node of each point.

    A node's id is the smallest point id in it, joined with the scene by a hash.
    """
    placed = binned(points, size)
    key = [SCENE, *BINS]
    node = F.xxhash64(SCENE, F.min("pid")).alias("node")
    base = placed.groupBy(*key).agg(node, F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    shape = voxel_features(scatter(placed, key), key, VOXEL_FEATURES)
    centres = voxel_centre(points, size).select(*key, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    nodes = base.filter(F.col("n") > points_min).join(shape, key).join(centres, key)
    return nodes, placed.select(SCENE, "pid", *BINS).join(base.select(*key, "node"), key).select(SCENE, "pid", "node")


def labelled(points_to_nodes: DataFrame, clusters: DataFrame, nodes_min: int = 0) -> DataFrame:
    """(scene_id, pid, label): clusters of more than ``nodes_min`` nodes numbered from 0 in each scene, others -1."""
    sizes = clusters.groupBy(SCENE, "cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > nodes_min)
    numbers = sizes.withColumn("label", F.row_number().over(Window.partitionBy(SCENE).orderBy("cluster")) - 1)
    return points_to_nodes.join(clusters, [SCENE, "node"], "left").join(numbers.select(SCENE, "cluster", "label"), [SCENE, "cluster"], "left").select(SCENE, "pid", F.coalesce("label", F.lit(-1)).alias("label"))


def segment_voxels(points: DataFrame, size: float = 0.15, reach: float = 0.5, sigmas: tuple = (0.2,) * 5, weight: float = 2.0, threshold: float = 0.3, points_min: int = 10, adjacency_min: int = 3, voxels_min: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """(scene_id, pid, label) by cuts of the graph of voxels whose centres are within ``reach``.

    With mesh edges (scene_id, src, dst, dist) voxels are adjacent where an edge of the
    point nearest to a voxel's centre joins them, and its length is their distance. Sigmas are those of space, normals, stairs, eigen features and
    convexity.
    """
    nodes, owner = voxel_nodes(points, size, points_min)
    nodes, owner = materialise(nodes, "voxel-nodes"), materialise(owner, "voxel-owners")
    at = nodes.select(SCENE, F.col("node").alias("pid"), "x", "y", "z")
    if edges is None:
        adjacency = radius_join(at, at, reach, include_self=False).select(SCENE, F.col("src").alias("u"), F.col("dst").alias("v"))
    else:
        adjacency = materialise(mesh_adjacency(at, points, owner, edges), "voxel-adjacency")
    clusters = segment_nodes(nodes.drop("x", "y", "z"), adjacency, sigmas, weight, threshold, adjacency_min, 4, True)
    return labelled(owner, clusters, voxels_min)


def segment_supervoxels(points: DataFrame, partition: DataFrame, reach: float = 0.75, sigmas: tuple = (0.2,) * 5, weight: float = 1.0, threshold: float = 0.3, adjacency_min: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """(scene_id, pid, label) by cuts of the graph of supervoxels whose centroids are within ``reach``, or that mesh edges of at most that length join."""
    owner = partition.filter("label > 0").select(SCENE, "pid", F.xxhash64(SCENE, "label").alias("node"))
    placed = points.join(owner, [SCENE, "pid"])
    base = placed.groupBy(SCENE, "node").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    nodes = materialise(base.join(voxel_features(scatter(placed, [SCENE, "node"], normalised=True), [SCENE, "node"], SUPERVOXEL_FEATURES), [SCENE, "node"]), "supervoxel-nodes")
    at = nodes.select(SCENE, F.col("node").alias("pid"), *[F.col(f"c{c}").alias(c) for c in "xyz"])
    if edges is None:
        adjacency = radius_join(at, at, reach, include_self=False).select(SCENE, F.col("src").alias("u"), F.col("dst").alias("v"))
    else:
        adjacency = materialise(mesh_adjacency(at, points, owner, edges.filter(F.col("dist") <= reach)), "supervoxel-adjacency")
    clusters = segment_nodes(nodes, adjacency, sigmas, weight, threshold, adjacency_min, 0, False)
    every = partition.select(SCENE, "pid").join(owner, [SCENE, "pid"], "left")
    return labelled(every, clusters)
