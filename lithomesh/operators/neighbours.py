"""Euclidean neighbour searches as joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.plans.storage import materialise

SCENE = "scene_id"
_CELL = ["gx", "gy", "gz"]


def _celled(points: DataFrame, size: float, names: list[str] = _CELL) -> DataFrame:
    return points.select("*", *[F.floor(F.col(c) / size).alias(g) for g, c in zip(names, "xyz")])


def radius_join(queries: DataFrame, points: DataFrame, radius: float, include_self: bool = True) -> DataFrame:
    """Pairs with distance at most ``radius``: (scene_id, src, dst, dist), src from ``queries``.

    Cells are as wide as the radius, so the 27 cells around a query hold all its
    partners; the join is on scene and cell, never on the scene alone.
    """
    steps = F.sequence(F.lit(-1), F.lit(1))
    q = _celled(queries.select(SCENE, F.col("pid").alias("src"), *[F.col(c).alias(c) for c in "xyz"]), radius)
    q = q.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("dz", F.explode(steps))
    q = q.select(SCENE, "src", *[F.col(c).alias(f"q{c}") for c in "xyz"], *[(F.col(g) + F.col(d)).alias(g) for g, d in zip(_CELL, ("dx", "dy", "dz"))])
    p = _celled(points.select(SCENE, F.col("pid").alias("dst"), "x", "y", "z"), radius)
    dist = F.sqrt(sum((F.col(f"q{c}") - F.col(c)) ** 2 for c in "xyz"))
    out = q.join(p, [SCENE, *_CELL]).withColumn("dist", dist).filter(F.col("dist") <= radius)
    if not include_self:
        out = out.filter("src <> dst")
    return out.select(SCENE, "src", "dst", "dist")


def _first_radius(points: DataFrame, k: int) -> float:
    """A radius that holds about k points if they filled their bounding boxes evenly."""
    sides = [F.greatest(F.max(c) - F.min(c), F.lit(1e-9)) for c in "xyz"]
    per = points.groupBy(SCENE).agg((sides[0] * sides[1] * sides[2]).alias("v"), F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("side"), F.count(F.lit(1)).alias("n"))
    row = per.agg(F.avg((F.col("v") * (k + 1) / F.col("n") / 4.19) ** (1 / 3)).alias("r"), F.max("side").alias("side")).first()
    if row is None or row["r"] is None:
        return 1.0
    return max(row["r"], (row["side"] or 1.0) / 1000, 1e-9)


def knn(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = True, radius: float | None = None) -> DataFrame:
    """Exact k nearest points of each query: (scene_id, src, dst, dist, rank), ties by id.

    Queries whose radius holds k points are done; the others go on with twice the
    radius, until all have k points or all of their scene. A round's result is
    written to the shared folder.
    """
    radius = radius or _first_radius(points, k)
    sizes = points.groupBy(SCENE).agg((F.count(F.lit(1)) - int(exclude_self)).alias("_all"))
    span = points.agg(F.max(F.greatest(*[F.abs(c) for c in "xyz"])).alias("m")).first()["m"] or 0.0
    left = queries.select(SCENE, "pid", "x", "y", "z")
    done: DataFrame | None = None
    order = Window.partitionBy(SCENE, "src").orderBy("dist", "dst")
    while True:
        found = radius_join(left, points, radius, include_self=not exclude_self)
        ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(SCENE, "src")))
        ranked = ranked.join(sizes, SCENE).filter((F.col("rank") <= k) & (F.col("_n") >= F.least(F.lit(k), F.col("_all")))).drop("_n", "_all")
        now = materialise(ranked, "knn")
        done = now if done is None else done.unionByName(now)
        left = materialise(left.join(now.select(SCENE, F.col("src").alias("pid")).distinct(), [SCENE, "pid"], "left_anti"), "knn-left")
        if radius > 4 * math.sqrt(3) * (span + 1e-9) or not left.limit(1).count():
            return done
        radius *= 2


def nearest_point(queries: DataFrame, points: DataFrame, radius: float | None = None) -> DataFrame:
    """The nearest point of each query, the query's own id allowed: (scene_id, src, dst, dist)."""
    return knn(queries, points, 1, exclude_self=False, radius=radius).drop("rank")
