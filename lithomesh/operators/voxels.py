"""Voxel grids, per-voxel aggregates and voxel adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.functions.eigen import with_eigen

SCENE = "scene_id"
BINS = ["ix", "iy", "iz"]


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box of each scene."""
    return points.groupBy(SCENE).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def binned(points: DataFrame, size: float, origin: DataFrame | None = None) -> DataFrame:
    """Points with their voxel (ix, iy, iz), counted from the scene's smallest coordinates.

    The minima are one row a scene; where a scene's rows are many the join is on the
    scene alone, so minima are gathered with a combinable aggregate first.
    """
    low = (origin or bounds(points)).select(SCENE, *[F.col(f"min_{c}") for c in "xyz"])
    out = points.join(low, SCENE)
    for b, c in zip(BINS, "xyz"):
        out = out.withColumn(b, F.floor((F.col(c) - F.col(f"min_{c}")) / size))
    return out.drop(*[f"min_{c}" for c in "xyz"])


def voxel_centre(points: DataFrame, size: float) -> DataFrame:
    """Centre of each occupied voxel."""
    low = bounds(points)
    cells = binned(points, size, low).select(SCENE, *BINS).distinct()
    return cells.join(low, SCENE).select(SCENE, *BINS, *[(F.col(f"min_{c}") + (F.col(b) + 0.5) * size).alias(f"c{c}") for b, c in zip(BINS, "xyz")])


def voxel_grid(points: DataFrame, size: float, colours: bool = True) -> DataFrame:
    """One row a voxel: mean position, mean colour cut to whole numbers, and count."""
    means = [F.avg(c).alias(c) for c in "xyz"]
    shades = [F.floor(F.avg(c)).alias(c) for c in "rgb"] if colours else []
    return binned(points, size).groupBy(SCENE, *BINS).agg(*means, *shades, F.count(F.lit(1)).alias("n"))


def label_histogram(points: DataFrame, size: float, label: str = "label") -> DataFrame:
    """Points of each label in each voxel."""
    return binned(points, size).groupBy(SCENE, *BINS, label).agg(F.count(F.lit(1)).alias("n"))


def majority_label(histogram: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent label of each voxel; 0 (unlabelled) only where there is no other; ties go to the smallest."""
    order = Window.partitionBy(SCENE, *BINS).orderBy(F.col(label) == 0, F.desc("n"), F.asc(label))
    return histogram.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(SCENE, *BINS, label)


def scatter(points: DataFrame, by: list[str], normalised: bool = False, least: int = 4) -> DataFrame:
    """Scatter matrix of each group (its six entries); zero for groups of fewer than ``least`` points."""
    n = F.count(F.lit(1))

    def entry(a: str, b: str) -> Column:
        value = F.covar_pop(a, b) * (F.lit(1) if normalised else n)
        return F.when(n >= least, value).otherwise(0.0).alias(f"s{a}{b}")

    return points.groupBy(*by).agg(*[entry(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], n.alias("n"))


def weighted_scatter(points: DataFrame, by: list[str], weight: str, least: int = 4) -> DataFrame:
    """Scatter matrix about the mean with weights, over their sum; zero for small groups."""
    mean = points.join(points.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]), by)
    n = F.count(F.lit(1))
    w = F.col(weight)
    entries = [F.when(n >= least, F.try_divide(F.sum(w * (F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))), F.sum(w))).otherwise(0.0).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return mean.groupBy(*by).agg(*entries, n.alias("n"))


def box_volume(points: DataFrame, by: list[str]) -> DataFrame:
    """Volume of each group's bounding box."""
    side = [F.max(c) - F.min(c) for c in "xyz"]
    return points.groupBy(*by).agg((side[0] * side[1] * side[2]).alias("volume"))


def last_point(points: DataFrame, size: float) -> DataFrame:
    """The point with the largest id of each voxel: later points replace earlier ones."""
    return binned(points, size).groupBy(SCENE, *BINS).agg(F.max_by(F.struct("pid", "x", "y", "z", "r", "g", "b"), "pid").alias("p"), F.count(F.lit(1)).alias("n")).select(SCENE, *BINS, "p.*", "n")


def mean_normals(points: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the normals of each group, scaled to length one; zero sums stay zero."""
    sums = points.groupBy(*by).agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return sums.withColumn("_l", length).select(*by, *[F.when(F.col("_l") > 0, F.col(f"n{c}") / F.col("_l")).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def neighbour_voxels(cells: DataFrame) -> DataFrame:
    """Pairs of occupied voxels that touch (26 neighbours): (scene_id, ix, iy, iz, ox, oy, oz)."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    moved = cells.select(SCENE, *BINS).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("dz", F.explode(steps)).filter("not (dx = 0 and dy = 0 and dz = 0)")
    moved = moved.select(SCENE, *BINS, (F.col("ix") + F.col("dx")).alias("ox"), (F.col("iy") + F.col("dy")).alias("oy"), (F.col("iz") + F.col("dz")).alias("oz"))
    there = cells.select(SCENE, *[F.col(b).alias(o) for b, o in zip(BINS, ("ox", "oy", "oz"))])
    return moved.join(there, [SCENE, "ox", "oy", "oz"])


def neighbourhood_normals(cells: DataFrame, touching: DataFrame, same: str | None = None) -> DataFrame:
    """Normals of voxels (scene_id, ix, iy, iz, x, y, z) from the voxels at most two steps away, towards the origin.

    A voxel that several ways lead to counts once for each, and a voxel itself for each
    way back. With ``same`` only steps between voxels with equal values of that column
    count. Where the entries lie on a line no normal is the least, and there is no row.
    """
    key = [SCENE, *BINS]
    there = {"ix": "ox", "iy": "oy", "iz": "oz"}
    step = touching.select(*key, *there.values())
    if same:
        value = cells.select(*key, F.col(same).alias("_a"))
        step = step.join(value, key).join(value.withColumnsRenamed(there | {"_a": "_b"}), [SCENE, *there.values()]).filter("_a = _b").select(*key, *there.values())
    else:
        step = step.join(cells.select(*key), key)
    second = step.select(SCENE, *[F.col(o).alias(b) for b, o in there.items()], *[F.col(b).alias(f"_{b}") for b in BINS])
    two = second.join(step, key).select(SCENE, *[F.col(f"_{b}").alias(b) for b in BINS], *there.values())
    none = cells.select(*key, *[F.col(b).alias(o) for b, o in there.items()])
    ways = step.unionByName(two).unionByName(none).join(cells.select(SCENE, *[F.col(b).alias(o) for b, o in there.items()], "x", "y", "z"), [SCENE, *there.values()])
    shape = with_eigen(scatter(ways, key, normalised=True, least=3).filter("n >= 3")).filter("l2 - l3 > 1e-9 * (l1 + l2 + l3)")
    near = shape.join(cells.select(*key, "x", "y", "z"), key)
    away = sum(F.col(f"v3{c}") * F.col(c) for c in "xyz") > 0
    return near.select(*key, *[F.when(away, -F.col(f"v3{c}")).otherwise(F.col(f"v3{c}")).alias(f"n{c}") for c in "xyz"])


def centroids(points: DataFrame, by: list[str]) -> DataFrame:
    """Mean position, colour and unit normal of each group."""
    means = points.groupBy(*by).agg(*[F.avg(c).alias(c) for c in (*"xyz", *"rgb")], F.count(F.lit(1)).alias("n"))
    return means.join(mean_normals(points, by), by)


def perspective(points: DataFrame) -> DataFrame:
    """Points with x / z, y / z and ln z as coordinates, for clouds seen from their origin; points not before it are left out."""
    return points.filter("z > 0").withColumns({"x": F.col("x") / F.col("z"), "y": F.col("y") / F.col("z"), "z": F.ln("z")})
