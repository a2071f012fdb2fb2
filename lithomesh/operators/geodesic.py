"""Shortest-path searches along edges, for many sources at once.

Near vertices are found in rounds. State is one row for each (scene, root, vertex)
reached. Each round joins the rows that changed in the last one with the edges, takes
minima, prunes, and writes the state to the shared folder; it ends when nothing
changes. Pruning keeps what can still matter: paths to a near vertex lead through
nearer ones.

Whole scenes are searched in tasks, each with the scene's edges and some of its roots,
so that the number of jobs does not follow the length of paths. Scenes with more edges
than a task holds are searched in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import discard, materialise

SCENE = "scene_id"
STATE = [SCENE, "root", "v"]
#: Edges of a scene that one task holds.
HELD = 1 << 20
#: A task's roots times its edges, about; rows of a batch that it returns.
DEALT, BATCH = 1 << 22, 1 << 17
#: Pairs of a root and a vertex that are searched at once, and those that go on in a step, with the edges that they lead to.
STATES, STEP, STEP_EDGES = 1 << 21, 1 << 16, 1 << 20


def _relax(start: DataFrame, edges: DataFrame, prune: Callable[[DataFrame], DataFrame] = lambda x: x, rounds: int | None = None) -> DataFrame:
    """Least path lengths (scene_id, root, v, d) from ``start``, over at most ``rounds`` more edges."""
    steps = edges.select(SCENE, F.col("src").alias("v"), F.col("dst").alias("w"), "dist")
    best = materialise(start.select(*STATE, "d", F.lit(True).alias("changed")), "geodesic")
    done = 0
    while (rounds is None or done < rounds) and best.filter("changed").limit(1).count():
        reached = best.filter("changed").join(steps, [SCENE, "v"]).select(SCENE, "root", F.col("w").alias("v"), (F.col("d") + F.col("dist")).alias("d"))
        both = best.select(*STATE, "d", F.col("d").alias("old")).union(reached.select(*STATE, "d", F.lit(None).cast("double")))
        least = both.groupBy(*STATE).agg(F.min("d").alias("d"), F.min("old").alias("old"))
        after = materialise(prune(least).select(*STATE, "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("changed")), "geodesic")
        discard(best)
        best = after
        done += 1
    return best.drop("changed")


def _roots(vertices: DataFrame) -> DataFrame:
    return vertices.select(SCENE, F.col("pid").alias("root"), F.col("pid").alias("v"), F.lit(0.0).alias("d")).distinct()


def vertices_of(edges: DataFrame) -> DataFrame:
    """(scene_id, pid) of all ends of edges."""
    return edges.select(SCENE, F.col("src").alias("pid")).union(edges.select(SCENE, F.col("dst").alias("pid"))).distinct()


def _lengths(first: np.ndarray, to: np.ndarray, length: np.ndarray, roots: np.ndarray, of: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Path lengths (root, vertex), infinite without a path; the edges of a vertex are those from ``first`` of it to ``first`` of the next.

    Pairs of a root and a vertex go on from where they are nearest. With ``targets`` of
    the roots ``of``, in that order, a root's search goes on only over paths shorter than
    the longest to its targets, once all have one, and other lengths may be too long.
    """
    n = len(first) - 1
    d = np.full(len(roots) * n, np.inf)
    open_ = np.zeros(len(d), bool)
    start = np.arange(len(roots)) * n + roots
    d[start] = 0
    open_[start] = True
    groups = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
    limit = np.full(len(roots), np.inf)
    while True:
        at = np.flatnonzero(open_)
        if len(of):
            limit[of[groups]] = np.maximum.reduceat(d[of * n + targets], groups)
            done = d[at] >= limit[at // n]
            open_[at[done]] = False
            at = at[~done]
        if not len(at):
            return d.reshape(len(roots), n)
        if len(at) > STEP:
            at = at[np.argpartition(d[at], STEP)[:STEP]]
        v = at % n
        degree = first[v + 1] - first[v]
        ends = np.cumsum(degree)
        if ends[-1] > STEP_EDGES:
            kept = max(1, int(np.searchsorted(ends, STEP_EDGES)))
            at, v, degree, ends = at[:kept], v[:kept], degree[:kept], ends[:kept]
        open_[at] = False
        edge = np.arange(ends[-1]) + np.repeat(first[v] - ends + degree, degree)
        goal = np.repeat(at - v, degree) + to[edge]
        reached = np.repeat(d[at], degree) + length[edge]
        shorter = reached < d[goal]
        goal, reached = goal[shorter], reached[shorter]
        np.minimum.at(d, goal, reached)
        open_[goal] = True


def _search(all_pairs: bool):
    """Path lengths in one scene: of rows without a length, ``a`` is a root and ``b`` a target of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).combine_chunks()
        a, b, dist = (held.column(c).combine_chunks() for c in ("a", "b", "dist"))
        named = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
        ids = named.dictionary
        a, b = np.split(np.asarray(named.indices.fill_null(-1)).astype(np.int64), 2)
        n = len(ids)
        edge = np.asarray(dist.is_valid())
        order = np.flatnonzero(edge)[np.argsort(a[edge], kind="stable")]
        first = np.searchsorted(a[order], np.arange(n + 1))
        to, length = b[order], np.asarray(dist.fill_null(0))[order]
        a, b = a[~edge], b[~edge]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        roots = np.unique(a)
        scene = held.column(SCENE)[0]
        size = max(1, STATES // n)
        for k in range(0, len(roots), size):
            own = roots[k : k + size]
            lo, hi = np.searchsorted(a, [own[0], own[-1] + 1])
            of, targets = (np.zeros(0, np.int64),) * 2 if all_pairs else (np.searchsorted(own, a[lo:hi]), b[lo:hi])
            d = _lengths(first, to, length, own, of, targets)
            r, v = np.nonzero(np.isfinite(d)) if all_pairs else (x[np.isfinite(d[of, targets])] for x in (of, targets))
            for i in range(0, len(r), BATCH):
                x, y = r[i : i + BATCH], v[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([pa.repeat(scene, len(x)), ids.take(pa.array(own[x])), ids.take(pa.array(y)), pa.array(d[x, y])], names=[*STATE, "d"])

    return run


def _whole(edges: DataFrame, pairs: DataFrame, all_pairs: bool, prune: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Path lengths (scene_id, root, v, d) of ``pairs`` (scene_id, root, v), or from their roots to all they reach; ``prune`` is for rounds."""
    spark = edges.sparkSession
    prepare_workers(spark, BATCH)
    edges = materialise(edges.select(SCENE, "src", "dst", F.col("dist").cast("double").alias("dist")).dropna().filter("dist < double('infinity')"), "geodesic-edges")
    sizes = materialise(edges.groupBy(SCENE).agg(F.count(F.lit(1)).alias("edges")), "geodesic-sizes")
    large = sizes.filter(F.col("edges") > HELD).select(SCENE)
    roots = pairs.dropna(subset=[SCENE, "root"]).join(large, SCENE, "left_anti")
    # Roots are dealt out, as many to a task as its edges allow; a scene is sent once for each of its tasks that has roots.
    counts = roots.groupBy(SCENE).agg(F.count_distinct("root").alias("roots")).join(sizes, SCENE, "left")
    parts = counts.select(SCENE, F.ceil(F.col("roots") * F.coalesce("edges", F.lit(0)) / DEALT + 0.5).alias("parts"))
    dealt = roots.join(parts, SCENE).select(SCENE, F.pmod(F.xxhash64("root"), "parts").alias("part"), F.col("root").alias("a"), F.col("v").alias("b"))
    own = F.lit(None).cast("double").alias("dist")
    places = dealt.select(SCENE, "part").distinct()
    sent = edges.join(places, SCENE).select(SCENE, "part", F.col("src").alias("a"), F.col("dst").alias("b"), "dist").unionByName(dealt.select("*", own))
    kinds = {f.name: f.dataType for f in sent.schema.fields}
    schema = T.StructType([T.StructField(SCENE, kinds[SCENE]), T.StructField("root", kinds["a"]), T.StructField("v", kinds["a"]), T.StructField("d", T.DoubleType())])
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = sent.repartition(partitions, SCENE, "part").groupBy(SCENE, "part").applyInArrow(_search(all_pairs), schema)
    if not large.limit(1).count():
        return found
    rest = pairs.dropna(subset=[SCENE, "root"]).join(large, SCENE, "left_semi")
    return found.unionByName(_relax(rest.select(SCENE, "root", F.col("root").alias("v"), F.lit(0.0).alias("d")).distinct(), edges.join(large, SCENE, "left_semi"), prune))


def one_to_all(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Path lengths from each source (scene_id, pid) to all vertices it reaches; others have no row.

    A source without edges reaches itself. Edges without ends or a finite length, and
    sources without an id or a scene, are left out; repeated ones do no harm. Lengths
    are not negative.
    """
    return _whole(edges, _roots(sources).select(*STATE), all_pairs=True)


def all_to_all(edges: DataFrame) -> DataFrame:
    """Path lengths between all pairs that are connected. The result is quadratic by definition."""
    return one_to_all(edges, vertices_of(edges))


def path_length(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Length of the shortest path of each pair (scene_id, src, dst), null without one; 0 from a vertex to itself.

    A search goes on only over paths that are shorter than the longest one found so
    far to a root's targets, once all of these have one. Pairs without an end or a
    scene stay, with null; edges are taken as by ``one_to_all``.
    """
    wanted = materialise(pairs.select(SCENE, F.col("src").alias("root"), F.col("dst").alias("v")).distinct(), "geodesic-pairs")

    def prune(state: DataFrame) -> DataFrame:
        reached = wanted.join(state.select(*STATE, "d"), STATE, "left")
        limit = reached.groupBy(SCENE, "root").agg(F.when(F.count("d") == F.count(F.lit(1)), F.max("d")).alias("limit"))
        return state.join(limit, [SCENE, "root"]).filter(F.col("limit").isNull() | (F.col("d") <= F.col("limit"))).drop("limit")

    found = _whole(edges, wanted.dropna(), all_pairs=False, prune=prune)
    lengths = wanted.join(found, STATE, "left")
    return lengths.select(SCENE, F.col("root").alias("src"), F.col("v").alias("dst"), F.col("d").alias("dist"))


def geodesic_knn(edges: DataFrame, sources: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """The k nearest vertices along edges: (scene_id, src, dst, dist, rank), ties by id.

    With ``exclude_self`` the source itself is left out; else it is the first of the
    k. Sources that reach fewer vertices have fewer rows.
    """
    keep = k + int(exclude_self)
    near = Window.partitionBy(SCENE, "root").orderBy("d", "v")
    state = _relax(_roots(sources), edges, lambda s: s.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= keep))
    out = state.filter("v <> root") if exclude_self else state
    return out.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select(SCENE, F.col("root").alias("src"), F.col("v").alias("dst"), F.col("d").alias("dist"), "rank")


def geodesic_radius(edges: DataFrame, sources: DataFrame, radius: float, exclude_self: bool = True) -> DataFrame:
    """Vertices whose path is shorter than ``radius`` (not as long): (scene_id, src, dst, dist)."""
    state = _relax(_roots(sources), edges, lambda s: s.filter(F.col("d") < radius))
    out = state.filter("v <> root") if exclude_self else state
    return out.select(SCENE, F.col("root").alias("src"), F.col("v").alias("dst"), F.col("d").alias("dist"))


def geodesic_hops(edges: DataFrame, sources: DataFrame, depth: int, exclude_self: bool = False) -> DataFrame:
    """Vertices within ``depth`` edges and the shortest path of at most that many: (scene_id, src, dst, dist)."""
    state = _relax(_roots(sources), edges, rounds=depth)
    out = state.filter("v <> root") if exclude_self else state
    return out.select(SCENE, F.col("root").alias("src"), F.col("v").alias("dst"), F.col("d").alias("dist"))


def least_distances(edges: DataFrame, k: int) -> DataFrame:
    """The k smallest path lengths of each vertex, its own 0 included, as one array."""
    near = geodesic_knn(edges, vertices_of(edges), k, exclude_self=False)
    return near.groupBy(SCENE, "src").agg(F.sort_array(F.collect_list("dist")).alias("dists"))
