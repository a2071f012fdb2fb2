"""Connected components of an undirected graph by alternating star operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import discard, materialise

#: Edges that one task finishes (16 bytes each).
FEW = 1 << 18


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table of the shared folder, with their number and an order-free checksum, which are equal on two rounds at a fixed point only."""
    seen = Observation()
    checks = [F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(u as decimal(38,0)))").alias("s")]
    table = materialise(edges.observe(seen, *checks), "components")
    return table, tuple(seen.get[c] for c in ("n", "x", "s"))


def _finish(batches):
    """Components of few edges: labels sink to the smallest neighbour's, and along labels, until they stay."""
    parts = [np.column_stack([np.asarray(batch.column(c)) for c in ("u", "v")]) for batch in batches if batch.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for ends_of in (u, v):
            np.minimum.at(new, label[ends_of], low)
            np.minimum.at(new, ends_of, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """id and component (the smallest id that it is connected with) of each endpoint.

    Large-star and small-star rounds run until the edges stay the same, in a number
    of rounds that is logarithmic in practice, or until one task can hold what is left;
    each round's edges are written to the shared folder. Minima are combined before the
    shuffle, and the joins back are on one row a vertex, so a vertex with a great many
    neighbours only makes a partition that adaptive execution can split. Loops and
    repeated edges do no harm; rows with a null endpoint are left out; without edges
    there are no rows.
    """
    prepare_workers(edges.sparkSession)
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).filter("a is not null and b is not null")
    # a loop stays a loop: it is an endpoint with its own id as component
    now, state = _written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0] > FEW:
        apart = now.filter("u <> v")
        loops = now.filter("u = v")
        # large star: every larger neighbour of u moves to the smallest neighbour of u
        both = apart.union(apart.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = apart.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: u's smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after, new = _written(small.union(loops).distinct())
        discard(now)
        now = after
        if new == state:
            roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            members = now.filter("u <> v").select(F.col("u").alias("id"), F.col("v").alias("component"))
            # a vertex with a loop may have other edges
            return members.union(roots.join(members.select("id"), "id", "left_anti"))
        state = new
    return now.coalesce(1).mapInArrow(_finish, "id long, component long")


def fuse_small(partition: DataFrame, edges: DataFrame, cutoff: int) -> DataFrame:
    """(scene_id, pid, label): components of fewer than ``cutoff`` points join the largest component that an edge leads to.

    Sizes are those before fusing and ties go to the smallest label; a chain of small
    components ends where its last one leads, and small components that lead only to
    each other become the one with the smallest label.
    """
    scene = "scene_id"
    sizes = partition.groupBy(scene, "label").agg(F.count(F.lit(1)).alias("n"))
    own = partition.select(scene, "pid", "label")
    ends = edges.join(own.select(scene, F.col("pid").alias("src"), F.col("label").alias("a")), [scene, "src"]).join(own.select(scene, F.col("pid").alias("dst"), F.col("label").alias("b")), [scene, "dst"]).filter("a <> b")
    pairs = ends.select(scene, "a", "b").union(ends.select(scene, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    small = sizes.filter(F.col("n") < cutoff).select(scene, F.col("label").alias("a"))
    larger = pairs.join(small, [scene, "a"], "left_semi").join(sizes.select(scene, F.col("label").alias("b"), "n"), [scene, "b"])
    to = larger.groupBy(scene, "a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    # labels of one scene only meet those of the same scene
    named = own.select(scene, "label").distinct().withColumn("node", F.xxhash64(scene, "label"))
    links = to.join(named.select(scene, F.col("label").alias("a"), F.col("node").alias("u")), [scene, "a"]).join(named.select(scene, F.col("label").alias("b"), F.col("node").alias("v")), [scene, "b"])
    groups = connected_components(links, "u", "v")
    fused = named.join(groups.withColumnRenamed("id", "node"), "node", "left").join(sizes, [scene, "label"])
    group = F.coalesce("component", "node")
    best = fused.groupBy(scene, group.alias("g")).agg(F.max_by("label", F.struct((F.col("n") >= cutoff).alias("large"), F.when(F.col("n") >= cutoff, F.col("n")).otherwise(0).alias("size"), -F.col("label"))).alias("new"))
    target = fused.withColumn("g", group).join(best, [scene, "g"]).select(scene, "label", F.col("new"))
    return own.join(target, [scene, "label"]).select(scene, "pid", F.col("new").alias("label"))


def random_subgraph(edges: DataFrame, size: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Edges among the ``size`` vertices that a breadth-first search from a seeded random vertex reaches first, for each scene.

    Vertices of one distance from the start are taken in the order of their hashes, or
    of ``order``, an expression of ``pid``, which then chooses the start too.
    A scene with fewer vertices keeps all of its edges.
    """
    scene = "scene_id"
    vertices = edges.select(scene, F.col("src").alias("pid")).union(edges.select(scene, F.col("dst").alias("pid"))).distinct()
    mix = F.xxhash64(F.lit(seed), scene, "pid") if order is None else order
    start = vertices.groupBy(scene).agg(F.min_by("pid", F.struct(mix, F.col("pid"))).alias("pid"))
    reached = materialise(start.select(scene, "pid", F.lit(0).alias("depth")), "subgraph")
    step = edges.select(scene, F.col("src").alias("pid"), F.col("dst").alias("next"))
    depth = 0
    while True:
        wanting = reached.groupBy(scene).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < size)
        border = reached.filter(F.col("depth") == depth).join(wanting.select(scene), scene, "left_semi")
        fresh = border.join(step, [scene, "pid"]).select(scene, F.col("next").alias("pid")).distinct().join(reached.select(scene, "pid"), [scene, "pid"], "left_anti")
        new = materialise(fresh.withColumn("depth", F.lit(depth + 1)), "subgraph")
        if not new.limit(1).count():
            break
        reached = materialise(reached.unionByName(new), "subgraph")
        depth += 1
    kept = reached.withColumn("_r", F.row_number().over(Window.partitionBy(scene).orderBy("depth", mix, "pid"))).filter(F.col("_r") <= size).select(scene, "pid")
    whole = vertices.groupBy(scene).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < size).select(scene)
    part = edges.join(whole, scene, "left_anti").join(kept.withColumnRenamed("pid", "src"), [scene, "src"], "left_semi").join(kept.withColumnRenamed("pid", "dst"), [scene, "dst"], "left_semi")
    return part.unionByName(edges.join(whole, scene, "left_semi"))
