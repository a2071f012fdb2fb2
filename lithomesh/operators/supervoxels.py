"""Supervoxels by growing seeds over touching voxels.

All voxels of all scenes grow together: a round joins the voxels that supervoxels
own with their neighbours, each voxel goes to the supervoxel that is nearest in
normal, colour and space if that is nearer than its own, and the supervoxels take
the means of their voxels. Simultaneous rounds replace the sequential stealing of
one voxel at a time; ties go to the smallest label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.operators.neighbours import nearest_point, radius_join
from lithomesh.operators.voxels import BINS, SCENE, binned, bounds, last_point, mean_normals, neighbour_voxels, neighbourhood_normals
from lithomesh.plans.storage import discard, materialise

_KEY = [SCENE, *BINS]


def voxels_of(points: DataFrame, resolution: float) -> DataFrame:
    """One row a voxel: position and colour of its last point, mean normal, and ``vid``."""
    cells = last_point(points, resolution)
    normals = mean_normals(binned(points, resolution), _KEY)
    return cells.join(normals, _KEY).withColumnRenamed("pid", "vid").select(*_KEY, "vid", "x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "n")


def voxel_distance(normal: float, colour: float, spatial: float, seed: float, geodesic: Column | None = None) -> Column:
    """(1 - |n.n'|) normal + |rgb| / 255 colour + |xyz| / seed spatial, between columns and their c-prefixed twins.

    A geodesic length replaces the last term's Euclidean one and is not divided.
    """
    dot = sum(F.col(f"n{c}") * F.col(f"cn{c}") for c in "xyz")
    shade = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "rgb"))
    space = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz")) / seed if geodesic is None else geodesic
    return (1 - F.abs(dot)) * normal + shade / 255 * colour + space * spatial


def seed_voxels(voxels: DataFrame, resolution: float, seed: float, lengths: DataFrame | None = None, owner: DataFrame | None = None) -> DataFrame:
    """(scene_id, vid, label): the voxel nearest to each occupied seed cell's centre, if enough voxels lie around it.

    With path lengths those count that hold a point within half a seed cell along
    them; ``owner`` is the voxel (scene_id, pid, vid) of each point.
    """
    as_points = voxels.select(SCENE, F.col("vid").alias("pid"), "x", "y", "z")
    low = bounds(as_points)
    cells = binned(as_points, seed, low).select(*_KEY).distinct().join(low, SCENE)
    number = F.row_number().over(Window.partitionBy(SCENE).orderBy(*BINS))
    centres = cells.select(SCENE, number.cast("long").alias("pid"), *[(F.col(f"min_{c}") + (F.col(b) + 0.5) * seed).alias(c) for b, c in zip(BINS, "xyz")])
    near = nearest_point(centres, as_points, radius=seed).select(SCENE, F.col("dst").alias("pid")).distinct()
    if lengths is not None:
        reached = near.withColumnRenamed("pid", "src").join(lengths.filter(F.col("dist") <= seed / 2), [SCENE, "src"]).join(owner.select(SCENE, F.col("pid").alias("dst"), "vid"), [SCENE, "dst"])
        counted = reached.select(SCENE, F.col("src"), "vid").union(near.select(SCENE, F.col("pid").alias("src"), F.col("pid").alias("vid"))).distinct()
        around = counted.groupBy(SCENE, F.col("src")).agg(F.count(F.lit(1)).alias("around")).withColumnRenamed("src", "vid")
    else:
        around = radius_join(near.join(as_points, [SCENE, "pid"]), as_points, seed / 2).groupBy(SCENE, F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("around"))
    least = 0.05 * math.pi * (seed / 2) ** 2 / resolution**2
    return around.filter(F.col("around") > least).select(SCENE, "vid", F.row_number().over(Window.partitionBy(SCENE).orderBy("vid")).cast("long").alias("label"))


def _centres(state: DataFrame) -> DataFrame:
    owned = state.filter("label > 0")
    means = owned.groupBy(SCENE, "label").agg(*[F.avg(c).alias(f"c{c}") for c in (*"xyz", *"rgb")])
    normals = mean_normals(owned, [SCENE, "label"]).select(SCENE, "label", *[F.col(f"n{c}").alias(f"cn{c}") for c in "xyz"])
    return means.join(normals, [SCENE, "label"])


def _grow(voxels: DataFrame, touching: DataFrame, seeds: DataFrame, rounds: int, weights: tuple, lengths: DataFrame | None) -> DataFrame:
    normal, colour, spatial, seed = weights
    state = materialise(
        voxels.join(seeds, [SCENE, "vid"], "left").select(*voxels.columns, F.coalesce("label", F.lit(0).cast("long")).alias("label"), F.when(F.col("label").isNotNull(), 0.0).otherwise(F.lit(float("inf"))).alias("d")), "supervoxels"
    )
    for _ in range(rounds):
        centres = _centres(state)
        owned = state.filter("label > 0").select(*_KEY, F.col("label").alias("owner"))
        reached = owned.join(touching, _KEY).select(SCENE, *[F.col(o).alias(b) for o, b in zip(("ox", "oy", "oz"), BINS)], "owner")
        reached = reached.union(owned.select(*_KEY, "owner")).distinct()
        # a voxel's own supervoxel offers too, so one aggregate has the best offer and the own one
        offers = reached.join(state, _KEY).join(centres.withColumnRenamed("label", "owner"), [SCENE, "owner"])
        length = None
        if lengths is not None:
            # the voxel of a supervoxel that is nearest to its centre stands for it
            at = state.filter("label > 0").join(centres, [SCENE, "label"])
            home = at.groupBy(SCENE, F.col("label").alias("owner")).agg(F.min_by("vid", F.struct(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz").alias("q"), F.col("vid"))).alias("home"))
            offers = offers.join(home, [SCENE, "owner"]).join(lengths.select(SCENE, F.col("src").alias("home"), F.col("dst").alias("vid"), "dist"), [SCENE, "home", "vid"], "left")
            length = F.when(F.col("home") == F.col("vid"), 0.0).otherwise(F.coalesce("dist", F.lit(1e30)))
        offers = offers.withColumn("offer", voxel_distance(normal, colour, spatial, seed, length))
        best = offers.groupBy(*_KEY).agg(F.min(F.struct("offer", "owner")).alias("best"), F.min(F.when(F.col("owner") == F.col("label"), F.col("offer"))).alias("own"))
        nearer = F.col("best.offer") < F.coalesce("own", F.lit(float("inf")))
        after = state.join(best, _KEY, "left").select(
            *voxels.columns, F.when(nearer, F.col("best.owner")).otherwise(F.col("label")).alias("label"), F.when(nearer, F.col("best.offer")).otherwise(F.coalesce("own", "d")).alias("d")
        )
        after = materialise(after, "supervoxels")
        discard(state)
        state = after
    return state


def refined_normals(state: DataFrame, touching: DataFrame) -> DataFrame:
    """Voxels whose normals are those of their surroundings inside their supervoxel; voxels that none owns keep theirs."""
    around = neighbourhood_normals(state.filter("label > 0"), touching, "label")
    found = state.join(around.select(*_KEY, *[F.col(f"n{c}").alias(f"_n{c}") for c in "xyz"]), _KEY, "left")
    return found.withColumns({f"n{c}": F.coalesce(f"_n{c}", f"n{c}") for c in "xyz"}).drop("_nx", "_ny", "_nz", "label", "d")


def supervoxels(points: DataFrame, resolution: float = 0.008, seed: float = 0.1, colour: float = 0.2, spatial: float = 0.4, normal: float = 1.0, refinements: int = 2, lengths: DataFrame | None = None) -> DataFrame:
    """(scene_id, pid, label): the supervoxel of each point, 0 for points that none owns.

    Points are (scene_id, pid, x, y, z, r, g, b, nx, ny, nz) with colours to 255.
    ``lengths`` (scene_id, src, dst, dist) are path lengths between points, for
    growth along a mesh; pairs without one are far apart. Each refinement takes voxel
    normals from the voxels around in the same supervoxel, and grows from new seeds.
    """
    voxels = materialise(voxels_of(points, resolution), "voxels")
    touching = materialise(neighbour_voxels(voxels), "voxel-neighbours")
    weights = (normal, colour, spatial, seed)
    rounds = max(1, int(1.8 * seed / resolution) - 1)
    placed = binned(points, resolution).select(SCENE, "pid", *BINS)
    owner = placed.join(voxels.select(*_KEY, "vid"), _KEY).select(SCENE, "pid", "vid")
    state = _grow(voxels, touching, seed_voxels(voxels, resolution, seed, lengths, owner), rounds, weights, lengths)
    for _ in range(refinements):
        # normals are refined first, then the supervoxels start anew from the voxels nearest to their centres
        voxels = materialise(refined_normals(state, touching), "voxels")
        state = materialise(state.drop("nx", "ny", "nz").join(voxels.select(*_KEY, "nx", "ny", "nz"), _KEY).select(*voxels.columns, "label", "d"), "supervoxels")
        centres = _centres(state)
        at = state.filter("label > 0").join(centres, [SCENE, "label"])
        again = at.groupBy(SCENE, "label").agg(F.min_by("vid", F.struct(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz").alias("q"), F.col("vid"))).alias("vid"))
        state = _grow(voxels, touching, again, rounds, weights, lengths)
    return placed.join(state.select(*_KEY, "label"), _KEY).select(SCENE, "pid", "label")


def supervoxel_centres(points: DataFrame, partition: DataFrame) -> DataFrame:
    """Mean position, colour and normal of each supervoxel."""
    from lithomesh.operators.voxels import centroids

    return centroids(points.drop("label").join(partition.filter("label > 0"), [SCENE, "pid"]), [SCENE, "label"])


def supervoxel_adjacency(points: DataFrame, partition: DataFrame, resolution: float) -> DataFrame:
    """Pairs of supervoxels with touching voxels and the number of touching pairs: (scene_id, a, b, n)."""
    owned = binned(points.drop("label"), resolution).join(partition.filter("label > 0"), [SCENE, "pid"]).select(*_KEY, "label").distinct()
    there = owned.select(SCENE, *[F.col(b).alias(o) for b, o in zip(BINS, ("ox", "oy", "oz"))], F.col("label").alias("b"))
    pairs = neighbour_voxels(owned.select(*_KEY).distinct()).join(owned.withColumnRenamed("label", "a"), _KEY).join(there, [SCENE, "ox", "oy", "oz"])
    return pairs.filter("a <> b").groupBy(SCENE, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def largest_label(partition: DataFrame) -> DataFrame:
    return partition.groupBy(SCENE).agg(F.max("label").alias("label"))
