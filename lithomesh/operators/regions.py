"""Label refinement, region growing and plane fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import discard, materialise

SCENE = "scene_id"
#: Points of a block that meets all plane hypotheses at once.
BLOCK = 20_000


def _refine_scene(labels: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    labels = labels.sort_values("pid")
    own = dict(zip(labels["pid"].tolist(), labels["label"].tolist()))
    near: dict[int, list[int]] = {}
    for u, v in zip(edges["src"].tolist(), edges["dst"].tolist()):
        near.setdefault(u, []).append(v)
    changed = True
    while changed:
        changed = False
        for pid in own:
            if own[pid] == -1:
                votes: dict[int, int] = {}
                for v in near.get(pid, ()):
                    label = own.get(v, -1)
                    if label != -1:
                        votes[label] = votes.get(label, 0) + 1
                if votes:
                    own[pid] = min(votes, key=lambda x: (-votes[x], x))
                    changed = True
    rest = max(own.values(), default=-1) + 1
    labels = labels.copy()
    labels["label"] = [rest if x == -1 else x for x in own.values()]
    return labels


def refine(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """Unlabelled points (-1) take the most frequent label around them, in the order of ids and in place, until nothing changes.

    Ties go to the smallest label; points that no label reaches get one new label.
    The rule is sequential, so a scene is one task; ``refine_together`` has no such bound.
    """
    prepare_workers(partition.sparkSession)
    own = partition.select(SCENE, F.col("pid").cast("long").alias("pid"), F.col("label").cast("long").alias("label"))
    return own.groupBy(SCENE).cogroup(edges.select(SCENE, "src", "dst").groupBy(SCENE)).applyInPandas(_refine_scene, "scene_id string, pid long, label long")


def refine_together(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``refine``, but all unlabelled points of a round look at the labels of the round before."""
    now = materialise(partition.select(SCENE, "pid", F.col("label").cast("long").alias("label")), "refine")
    while True:
        known = now.filter("label <> -1").select(SCENE, F.col("pid").alias("dst"), "label")
        open_ = now.filter("label = -1").select(SCENE, F.col("pid").alias("src"))
        votes = edges.select(SCENE, "src", "dst").join(open_, [SCENE, "src"], "left_semi").join(known, [SCENE, "dst"]).groupBy(SCENE, "src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(SCENE, F.col("src").alias("pid")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("found"))
        after = materialise(now.join(best, [SCENE, "pid"], "left").select(SCENE, "pid", F.when(F.col("label") == -1, F.coalesce("found", F.lit(-1))).otherwise(F.col("label")).alias("label")), "refine")
        counts = [x.filter("label = -1").count() for x in (now, after)]
        discard(now)
        now = after
        if counts[0] == counts[1]:
            break
    top = now.groupBy(SCENE).agg((F.max("label") + 1).alias("_rest"))
    return now.join(top, SCENE).select(SCENE, "pid", F.when(F.col("label") == -1, F.col("_rest")).otherwise(F.col("label")).alias("label"))


def grow_regions(seeds: DataFrame, edges: DataFrame, normals: DataFrame, angle: float, reference_compat: bool = False) -> DataFrame:
    """Points reached from each seed (scene_id, pid) over points whose normals are within ``angle`` degrees of the seed's: (scene_id, root, pid).

    ``reference_compat`` compares the dot product of the normals with the angle in
    radians instead. The seed itself always belongs to its region.
    """
    n = normals.select(SCENE, F.col("pid").alias("v"), F.struct("nx", "ny", "nz").alias("n"))
    roots = seeds.select(SCENE, F.col("pid").alias("root")).distinct().join(n.select(SCENE, F.col("v").alias("root"), F.col("n").alias("n0")), [SCENE, "root"])
    dot = sum(F.col(f"n0.n{c}") * F.col(f"n.n{c}") for c in "xyz")
    fits = dot < math.radians(angle) if reference_compat else F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) < math.radians(angle)
    steps = edges.select(SCENE, F.col("src").alias("u"), F.col("dst").alias("v"))
    found = materialise(roots.select(SCENE, "root", F.col("root").alias("v"), "n0", F.lit(True).alias("fresh")), "regions")
    while found.filter("fresh").limit(1).count():
        reached = found.filter("fresh").select(SCENE, "root", F.col("v").alias("u"), "n0").join(steps, [SCENE, "u"]).join(n, [SCENE, "v"]).filter(fits)
        reached = reached.select(SCENE, "root", "v", "n0").dropDuplicates([SCENE, "root", "v"]).join(found.select(SCENE, "root", "v"), [SCENE, "root", "v"], "left_anti")
        after = materialise(found.withColumn("fresh", F.lit(False)).unionByName(reached.withColumn("fresh", F.lit(True))), "regions")
        discard(found)
        found = after
    return found.select(SCENE, "root", F.col("v").alias("pid"))


def _grow_scene(angle: float, distance: float | None, percent: float | None):
    def run(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("pid").reset_index(drop=True)
        at = {p: i for i, p in enumerate(points["pid"].tolist())}
        xyz, normal, flat = points[["x", "y", "z"]].to_numpy(), points[["nx", "ny", "nz"]].to_numpy(), points["lambda0"].to_numpy().round(12)
        near: list[list[int]] = [[] for _ in at]
        for u, v in zip(edges["src"].tolist(), edges["dst"].tolist()):
            if u in at and v in at:
                near[at[u]].append(at[v])
        limit = np.quantile(flat, percent) if percent is not None and len(flat) else np.inf
        label, region = np.full(len(at), -1, np.int64), 0
        for start in np.lexsort((np.arange(len(at)), flat)):
            if label[start] != -1:
                continue
            label[start], queue = region, [start]
            for seed in queue:
                for v in near[seed]:
                    if label[v] != -1 or abs(normal[v] @ normal[seed]) < math.cos(angle):
                        continue
                    if distance is not None and np.linalg.norm(xyz[v] - xyz[seed]) > distance:
                        continue
                    label[v] = region
                    if flat[v] <= limit:
                        queue.append(v)
            region += 1
        return pd.DataFrame({"scene_id": points["scene_id"], "pid": points["pid"], "label": label})

    return run


def grow_scene(points: DataFrame, edges: DataFrame, angle: float, distance: float | None = None, percent: float | None = None) -> DataFrame:
    """Greedy region growing from the flattest points on, by the angle between normals and a distance or a share of flat points.

    Points are (scene_id, pid, x, y, z, nx, ny, nz, lambda0); the order decides, so a
    scene is one task; ties, of lambda0 to twelve digits, go to the smaller id.
    """
    prepare_workers(points.sparkSession)
    own = points.select(SCENE, F.col("pid").cast("long").alias("pid"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz", "lambda0")])
    return own.groupBy(SCENE).cogroup(edges.select(SCENE, "src", "dst").groupBy(SCENE)).applyInPandas(_grow_scene(math.radians(angle), distance, percent), "scene_id string, pid long, label long")


def ransac_planes(points: DataFrame, threshold: float = 0.1, iterations: int = 1000, seed: int = 42, draws: DataFrame | None = None) -> DataFrame:
    """The plane with the most points within ``threshold`` of it, of seeded three-point hypotheses: (scene_id, a, b, c, d, inliers).

    Three-point draws are from a sample of at most four points an iteration, one of
    each bucket of ids; ``draws`` (scene_id, h, j, pid), the points j = 0 to 2 of
    hypothesis h, replace them. A scene's points are dealt out in blocks, each of which meets
    the hypotheses once and returns their counts.
    """
    spark = points.sparkSession
    prepare_workers(spark)
    placed = points.select(SCENE, "pid", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("p"))
    if draws is None:
        mixed = F.xxhash64(F.lit(seed), "pid")
        drawn = placed.groupBy(SCENE, F.pmod(mixed, F.lit(4 * iterations)).alias("bucket")).agg(F.min_by("p", F.struct(mixed, F.col("pid"))).alias("p"))
        numbered = drawn.withColumn("i", F.row_number().over(Window.partitionBy(SCENE).orderBy("bucket")) - 1)
        sizes = numbered.groupBy(SCENE).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
        chosen = sizes.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        chosen = chosen.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), SCENE, "h", "j"), F.col("n")).cast("int")).join(numbered, [SCENE, "i"])
    else:
        chosen = draws.select(SCENE, F.col("h").cast("int").alias("h"), "j", "pid").join(placed, [SCENE, "pid"])
    triples = chosen.groupBy(SCENE, "h").agg(F.sort_array(F.collect_list(F.struct("j", "p"))).alias("t")).filter("size(t) = 3")
    p = [[F.col("t")[j]["p"][c] for c in range(3)] for j in range(3)]
    u, v = ([p[j][c] - p[0][c] for c in range(3)] for j in (1, 2))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(sum(c * c for c in cross))
    planes = triples.select(SCENE, "h", F.array(*cross).alias("n"), size.alias("l"), F.array(*p[0]).alias("p0")).filter("l > 0")
    planes = planes.select(SCENE, "h", F.transform("n", lambda x: x / F.col("l")).alias("n"), "p0")
    planes = materialise(planes.select(SCENE, "h", F.array(*[F.col("n")[c] for c in range(3)], -sum(F.col("n")[c] * F.col("p0")[c] for c in range(3))).alias("plane")), "ransac")
    blocks = materialise(points.groupBy(SCENE).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "ransac")
    dealt = placed.join(blocks, SCENE).select(SCENE, F.pmod(F.xxhash64("pid"), F.col("blocks")).alias("block"), "p")
    sent = planes.join(blocks, SCENE).select(F.col(SCENE).alias("at_scene"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at_block"), "h", "plane")

    def count(key: tuple, block: pd.DataFrame, hypotheses: pd.DataFrame) -> pd.DataFrame:
        xyz, plane = (np.vstack(f[c].to_numpy()) if len(f) else np.zeros((0, n)) for f, c, n in ((block, "p", 3), (hypotheses, "plane", 4)))
        near = np.abs(xyz @ plane[:, :3].T + plane[:, 3]) <= threshold
        return pd.DataFrame({"scene_id": key[0], "h": hypotheses["h"].to_numpy(), "n": near.sum(0)})

    counted = dealt.groupBy(SCENE, "block").cogroup(sent.groupBy("at_scene", "at_block")).applyInPandas(count, "scene_id string, h int, n long")
    best = counted.groupBy(SCENE, "h").agg(F.sum("n").alias("n")).groupBy(SCENE).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("h"), F.max("n").alias("inliers"))
    return best.join(planes, [SCENE, "h"]).select(SCENE, *[F.col("plane")[i].alias(c) for i, c in enumerate("abcd")], "inliers")
