"""Benchmark of the partition algorithms over scenes: accuracy, size and time of each."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.operators.cut_pursuit import partition_points
from lithomesh.operators.linkage import pairwise_linkage
from lithomesh.operators.regions import refine_together
from lithomesh.operators.scoring import SCENE, contingency, object_accuracy
from lithomesh.operators.supervoxels import supervoxels
from lithomesh.operators.voxel_graph import segment_supervoxels, segment_voxels
from lithomesh.plans.storage import materialise
from lithomesh.sources.tables import wide_results


def algorithms(k_linkage: int = 30, lengths: DataFrame | None = None) -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """The benchmark's algorithms with its parameters, as functions of points and edges."""
    return {
        "cp": lambda p, e: partition_points(p, 15, 15, 0.07, speed=2),
        "vccs": lambda p, e: supervoxels(p, 0.05, 0.1, 0.2, 0.2, 0.6, 3, lengths),
        "plink": lambda p, e: refine_together(pairwise_linkage(p, k_linkage, 90, 10, 10), e),
        "vgs": lambda p, e: segment_voxels(p, 0.15, 0.3, (0.2,) * 5, 2.0, 0.3, 0, 0, 0),
        "svgs": lambda p, e: segment_supervoxels(p, supervoxels(p, 0.05, 0.1, 0.0, 0.25, 0.75, 5, lengths), 0.1, (0.2,) * 5, 1.0, 0.3),
    }


def run_benchmark(points: DataFrame, truth: DataFrame, edges: DataFrame, chosen: dict[str, Callable] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row a scene: ID, Name, |V|, and OOA, |S| and Duration of each algorithm.

    All scenes run at once, so an algorithm's duration is that of the whole run, the
    same in each row. ``truth`` is (scene_id, pid, label).
    """
    named = {n: f for n, f in (chosen or algorithms()).items() if n not in exclude}
    sizes = points.groupBy(SCENE).agg(F.count(F.lit(1)).alias("n_points"))
    rows = None
    for name, algorithm in named.items():
        began = time.time()
        partition = materialise(algorithm(points, edges), f"benchmark-{name}")
        took = time.time() - began
        scored = object_accuracy(contingency(partition, truth)).join(sizes, SCENE)
        one = scored.select(F.col(SCENE).alias("Name"), "n_points", F.lit(name).alias("algorithm"), "ooa", "n_superpoints", F.lit(took).alias("duration"))
        rows = one if rows is None else rows.unionByName(one)
    return wide_results(rows.withColumn("ID", F.dense_rank().over(Window.orderBy("Name"))), list(named))
