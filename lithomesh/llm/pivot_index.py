"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest pivots in the order of their
nearness. Pivots are vectors of a bounded sample that are far from each other, so
a dense group has few of them however many vectors it has, and its members agree
on them. The inverted list of a pivot holds the vectors it comes first for, which
are at home there, and those it comes later for, which visit. Two at home, or one
at home and a visitor, are candidates if they share at least ``SHARED`` pivots;
candidates are verified by their cosine in double precision. So a pair is found if
the first pivot of one is among the pivots of the other and enough others are; where
the former holds both ways, the list of the smaller pivot has the pair. Vectors of
each length have pivots of their own; lengths with few vectors have one, whose list
compares all. Equal vectors are one entry. A long list is dealt out in pairs of
blocks, so a pivot near a third of all vectors makes many small tasks, and tasks
return counts and spanning forests, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.operators.components import connected_components
from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import materialise

PREFIX = 20
#: Entries of a block of a list.
BLOCK = 2048
#: Pivots that a pair has to share to be verified.
SHARED = 3
#: Pivots of a length: the power of two next to the square root of the number of its vectors, and not fewer than this.
LEAST_PIVOTS = 64
#: Lengths of fewer vectors than this have one pivot.
FEW = 512
#: Vectors of the sample for each pivot, and the angle between pivots as a multiple of the threshold's.
SAMPLE, APART = 2, 1.5
#: Rows of a block that are compared at once.
ROWS = 256


def _vectors(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def pivots_of(count: int) -> int:
    """How many pivots the vectors of one length have."""
    return 1 if count < FEW else max(LEAST_PIVOTS, 1 << round(math.log2(count) / 2))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge components do not under- or overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _far_apart(sample: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """The first k rows, of unit length, that are ``APART`` times the threshold's angle from those taken before."""
    limit = math.cos(min(math.pi, APART * math.acos(max(-1.0, min(1.0, threshold)))))
    taken, free = [], np.ones(len(sample), bool)
    while free.any() and len(taken) < k:
        i = int(free.argmax())
        taken.append(i)
        free &= sample @ sample[i] < limit
        free[i] = False
    return sample[taken]


def _describe(pivots: dict[int, tuple[int, np.ndarray]]):
    """Adds the numbers of each vector's nearest pivots, nearest first; ``pivots`` has the first number and the pivots of each length."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.asarray(batch.column("vec").value_lengths())
            for d in np.unique(lengths).tolist():
                rows = batch if lengths.min() == lengths.max() else batch.take(pa.array(np.flatnonzero(lengths == d)))
                base, own = pivots[d]
                far = -(_unit(_vectors(rows.column("vec"))) @ own.T)
                prefix = min(PREFIX, len(own))
                first = np.argpartition(far, prefix - 1, axis=1)[:, :prefix]
                first = base + np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, 1), axis=1, kind="stable"), 1)
                ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * prefix)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(ends, pa.array(first.ravel().astype(np.int32)))], names=[*rows.schema.names, "pivots"])

    return run


class Forest:
    """Components of some vertices, merged by batches of edges; remembers the edges that merged."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        pairs = np.column_stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]])
        pairs, at = np.unique(pairs, axis=0, return_index=True)
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for (x, y), k in zip(pairs.tolist(), at.tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                self.edges.append((int(i[k]), int(j[k])))
        if root:
            table = np.arange(len(self.label))
            for x in list(root):
                table[x] = find(x)
            self.label = table[self.label]


def _cell(threshold: float):
    """Links of one pair of blocks of a list: counts for each entry, and a forest of ids."""

    def run(key, table):
        pivot, low, high = (int(x.as_py()) for x in key)
        table = table.combine_chunks()
        gid, node, copies, block, home = (np.asarray(table.column(x).combine_chunks()) for x in ("gid", "node", "copies", "block", "home"))
        unit = _unit(_vectors(table.column("vec").combine_chunks()))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        described = np.asarray(table.column("pivots").combine_chunks().flatten()).reshape(len(gid), -1)
        first = described[left]
        # the inverted lists' counts: how many pivots two descriptions share
        number, place = np.unique(described, return_inverse=True)
        mark = np.zeros((len(gid), len(number)), np.float32)
        np.put_along_axis(mark, place.reshape(described.shape), 1, axis=1)
        least = min(SHARED, described.shape[1])
        links = np.zeros(len(gid), np.int64)
        forest = Forest(len(gid))
        for at in range(0, len(left), ROWS):
            candidates = mark[left[at : at + ROWS]] @ mark[right].T >= least
            # Products of matrices differ in the last digits by their shapes; the sums below decide.
            i, j = np.nonzero(candidates & (unit[left[at : at + ROWS]] @ unit[right].T >= threshold - 1e-9))
            i += at
            if low == high:
                i, j = i[j > i], j[j > i]
            for k in range(0, len(i), 1 << 17):
                row, a, b = i[k : k + (1 << 17)], left[i[k : k + (1 << 17)]], right[j[k : k + (1 << 17)]]
                other = home[b]
                own = (other >= pivot) | (first[row] != other[:, None]).all(1)
                own &= np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[own], b[own]
                if not len(a):
                    continue
                links += np.bincount(a, weights=copies[b], minlength=len(gid)).astype(np.int64)
                links += np.bincount(b, weights=copies[a], minlength=len(gid)).astype(np.int64)
                forest.add(a, b)
        some = np.flatnonzero(links)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "gid": pa.concat_arrays([pa.array(gid[some]), pa.nulls(len(edges), pa.int64())]),
                "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(edges), pa.int64())]),
                "a": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[edges[:, 0]])]),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[edges[:, 1]])]),
            }
        )

    return run


def _samples(entries: DataFrame, sizes: dict[int, int], wanted: dict[int, int]):
    """Pairs of a length and the vectors of that length with the smallest hashes, as many as wanted."""
    if not wanted:
        return
    # the hash that about twice as many vectors have is a filter; the exact choice is made on what passes it
    limits = entries.sparkSession.createDataFrame([(d, k, (2.0 * k + 64) / sizes[d]) for d, k in wanted.items()], "d int, most int, share double")
    ranked = entries.select("vec", F.size("vec").alias("d"), F.xxhash64("node").alias("h"), "gid")
    few = ranked.join(F.broadcast(limits), "d").filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    best = few.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("h", "gid"))).filter("k <= most")
    rows = best.orderBy("d", "k").select("d", "vec").toArrow()
    lengths = np.asarray(rows.column("d"))
    vectors = rows.column("vec").combine_chunks()
    for d in np.unique(lengths).tolist():
        own = vectors.take(pa.array(np.flatnonzero(lengths == d)))
        yield d, _vectors(own)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """id, ``n_links``, ``component_id`` and ``kept`` of each row.

    Vectors that are null, empty or zero, that hold null or non-finite components,
    or whose id is null link with nothing: no links, their own id as component, kept.
    Vectors of different lengths do not link. Equal vectors link with each other, and
    rows that repeat an id are kept alike. Vectors may be as long as a value can be. An empty table gives an
    empty result; other columns are ignored. The result is approximate: links are
    never wrong; the README has the share of pairs that is found.
    """
    spark = vectors.sparkSession
    prepare_workers(spark, 4096)
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    usable = F.expr("id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    flagged = named.withColumn("ok", F.coalesce(usable, F.lit(False)))
    entries = materialise(
        flagged.filter("ok").groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("gid", F.monotonically_increasing_id()), "pivot-entries"
    )
    # A length of d has vectors of d components, so n components in all have at most sqrt(2 n) lengths.
    sizes = {r["d"]: r["n"] for r in entries.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    base = 0
    for d, own in _samples(entries, sizes, {d: SAMPLE * pivots_of(n) if n >= FEW else 1 for d, n in sizes.items()}):
        pivots[d] = base, _far_apart(_unit(own), pivots_of(sizes[d]), threshold)
        base += len(pivots[d][1])
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in entries.schema.fields)}, pivots array<int>"
    described = materialise(entries.mapInArrow(_describe(pivots), schema), "pivot-index")
    listed = described.select("*", F.posexplode("pivots").alias("rank", "pivot"), F.col("pivots")[0].alias("home"))
    blocks = lambda kind: F.ceil(F.count(F.when(kind, 1)) / BLOCK).cast("int")
    lengths = listed.groupBy("pivot").agg(blocks(F.col("rank") == 0).alias("homes"), blocks(F.col("rank") > 0).alias("visits")).filter("homes > 0")
    at_home = F.col("rank") == 0
    # Blocks of a list: those at home, then the visitors, who meet those at home only.
    cells = (
        listed.join(F.broadcast(lengths), "pivot")  # one row a pivot: about the square root of the vectors
        .withColumn("block", F.when(at_home, F.pmod(F.xxhash64("gid"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("gid"), F.col("visits"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") + F.when(at_home, F.col("visits")).otherwise(0) - 1)))
        .select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "gid", "node", "copies", "block", "vec", "home", "pivots")
    )
    found = materialise(cells.groupBy("pivot", "low", "high").applyInArrow(_cell(threshold), "gid long, links long, a long, b long"), "pivot-links")
    links = found.filter("gid is not null").groupBy("gid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("gid is null"), "a", "b").select(F.col("id").alias("node"), "component")
    known = entries.join(links, "gid", "left").join(comps, "node", "left").select("vec", F.col("node").alias("_node"), "copies", "links", "component")
    out = flagged.filter("ok").join(known, "vec").select(
        "id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "_node").alias("component_id"),
    )
    alone = flagged.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_pivot_index(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; the index finds all where a length has few vectors, as in tables up to 511 rows.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM v JOIN (SELECT id, min(root) AS root FROM c GROUP BY id) ON id = vec_id LEFT JOIN n ON x = vec_id
"""
