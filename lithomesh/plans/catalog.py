"""Named queries over the test tables, and the SQL that states their results.

The table of embeddings stands in for a point cloud: position, colour and normal
are taken from its first nine components, the label is the object, and ids modulo
``SCENES`` are scenes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithomesh.operators import analysis, components, cut_pursuit, edges, features, geodesic, linkage, neighbours, regions, scoring, supervoxels, voxel_graph, voxels
from lithomesh.operators.components import connected_components
from lithomesh.plans import benchmark
from lithomesh.plans.storage import fresh_path, materialise
from lithomesh.sources import scans, tables

SCENES = 5
CELL = 0.15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(9)]
    length = F.sqrt(e[6] * e[6] + e[7] * e[7] + e[8] * e[8])
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), (F.col("vec_id") % SCENES).cast("string")).alias("scene_id"),
        F.col("vec_id").alias("pid"),
        *[e[i].alias(c) for i, c in enumerate("xyz")],
        *[F.floor((e[3 + i] + 1) * 127).cast("double").alias(c) for i, c in enumerate("rgb")],
        *[(e[6 + i] / length).alias(f"n{c}") for i, c in enumerate("xyz")],
        F.col("label").cast("long").alias("label"),
    )


POINTS = f"""
p AS (SELECT 's' || (vec_id % {SCENES}) AS scene_id, vec_id AS pid, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z,
  floor((embedding[4]::double + 1) * 127) AS r, floor((embedding[5]::double + 1) * 127) AS g, floor((embedding[6]::double + 1) * 127) AS b,
  embedding[7]::double / sqrt(embedding[7]::double * embedding[7]::double + embedding[8]::double * embedding[8]::double + embedding[9]::double * embedding[9]::double) AS nx,
  embedding[8]::double / sqrt(embedding[7]::double * embedding[7]::double + embedding[8]::double * embedding[8]::double + embedding[9]::double * embedding[9]::double) AS ny,
  embedding[9]::double / sqrt(embedding[7]::double * embedding[7]::double + embedding[8]::double * embedding[8]::double + embedding[9]::double * embedding[9]::double) AS nz,
  label::bigint AS label FROM embeddings)"""


def superpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition into columns of cells."""
    s = F.floor((F.col("x") + 1) / CELL) * 100 + F.floor((F.col("y") + 1) / CELL)
    return points(spark, sf_dir).select("scene_id", "pid", s.alias("label"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("scene_id", "pid", "label")


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.contingency(superpoints(spark, sf_dir), objects(spark, sf_dir))


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.count_density(_table(spark, sf_dir))


_CELL = f"(floor((x + 1) / {CELL}) * 100 + floor((y + 1) / {CELL}))::bigint"
TABLE = f"""{POINTS},
t AS (SELECT scene_id, {_CELL} AS s, label AS o, count(*) AS n, count(*)::double AS density FROM p GROUP BY ALL),
al AS (SELECT scene_id, s, o AS alpha FROM t QUALIFY row_number() OVER (PARTITION BY scene_id, s ORDER BY density DESC, o) = 1),
be AS (SELECT scene_id, o, s AS beta FROM t QUALIFY row_number() OVER (PARTITION BY scene_id, o ORDER BY density DESC, s) = 1),
ab AS (SELECT scene_id, s, o AS alpha_beta, density AS density_ab FROM t JOIN be USING (scene_id, o) WHERE beta = s
  QUALIFY row_number() OVER (PARTITION BY scene_id, s ORDER BY density DESC, o) = 1),
ga AS (SELECT t.scene_id, t.o, t.s AS gamma FROM t LEFT JOIN be ON be.scene_id = t.scene_id AND be.o = t.o LEFT JOIN ab ON ab.scene_id = t.scene_id AND ab.s = t.s
  WHERE t.s IS DISTINCT FROM beta AND density > coalesce(density_ab, 0) QUALIFY row_number() OVER (PARTITION BY t.scene_id, t.o ORDER BY density DESC, t.s) = 1),
td AS (SELECT t.scene_id, t.s, t.o, t.n, t.density FROM t JOIN be USING (scene_id, o) JOIN al ON al.scene_id = t.scene_id AND al.s = be.beta
  JOIN ga ON ga.scene_id = t.scene_id AND ga.o = t.o WHERE al.alpha <> t.o AND ga.gamma = t.s),
bb AS (SELECT scene_id, o, s AS b FROM td QUALIFY row_number() OVER (PARTITION BY scene_id, o ORDER BY density DESC, s) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id, s ORDER BY density DESC, o DESC) AS rank FROM td),
de AS (SELECT rk.scene_id, rk.s, rk.o AS a, rk.density AS force3 FROM rk JOIN bb ON bb.scene_id = rk.scene_id AND bb.o = rk.o WHERE bb.b = rk.s
  QUALIFY row_number() OVER (PARTITION BY rk.scene_id, rk.s ORDER BY rank) = 1),
fo AS (SELECT u.scene_id, u.s, alpha_beta, a, coalesce(density_ab, 0) AS force2, coalesce(force3, 0) AS force3
  FROM (SELECT DISTINCT scene_id, s FROM t) u LEFT JOIN ab ON ab.scene_id = u.scene_id AND ab.s = u.s LEFT JOIN de ON de.scene_id = u.scene_id AND de.s = u.s),
cl AS (SELECT t.scene_id, t.s, t.o, t.n, CASE
    WHEN t.s IS NOT DISTINCT FROM be.beta AND t.o = al.alpha THEN 3
    WHEN t.s IS NOT DISTINCT FROM be.beta AND t.s IS DISTINCT FROM ao.beta AND t.o IS NOT DISTINCT FROM fo.alpha_beta AND fo.force3 <= fo.force2 THEN 2
    WHEN fo.force3 > fo.force2 AND t.o IS NOT DISTINCT FROM fo.a AND NOT coalesce(fb.force3 <= fb.force2 AND t.o IS NOT DISTINCT FROM fb.alpha_beta, false) THEN 1
    ELSE 0 END AS class
  FROM t JOIN fo ON fo.scene_id = t.scene_id AND fo.s = t.s JOIN al ON al.scene_id = t.scene_id AND al.s = t.s
  LEFT JOIN be ao ON ao.scene_id = t.scene_id AND ao.o = al.alpha LEFT JOIN be ON be.scene_id = t.scene_id AND be.o = t.o
  LEFT JOIN fo fb ON fb.scene_id = t.scene_id AND fb.s = be.beta)"""


def ooa_of_voxel_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of points in the best-matching object of each voxel column."""
    return scoring.object_accuracy(_table(spark, sf_dir)).select("scene_id", F.round("ooa", 9).alias("ooa"), "n_superpoints")


def ooa_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the size of the line items: suppliers as superpoints, parts' last digits as objects."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("scene_id"), F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 10).alias("o"))
    return scoring.object_accuracy(rows.groupBy("scene_id", "s", "o").agg(F.count(F.lit(1)).alias("n"))).select("scene_id", F.round("ooa", 9).alias("ooa"), "n_superpoints")


def _rounded(frame: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return frame.select(*[(F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in frame.columns])


def _sql(select: str, ctes: str = POINTS) -> str:
    return f"WITH {ctes}\n{select}"


GRID = f"{POINTS},\nlo AS (SELECT scene_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM p GROUP BY scene_id),\nv AS (SELECT p.*, floor((x - mx) / {CELL})::bigint AS ix, floor((y - my) / {CELL})::bigint AS iy, floor((z - mz) / {CELL})::bigint AS iz FROM p JOIN lo USING (scene_id))"
REACH = 0.12
PAIRS = f"{POINTS},\nd AS (SELECT a.scene_id, a.pid AS src, b.pid AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM p a JOIN p b ON a.scene_id = b.scene_id)"
NEAR = 5
KNN = f"{PAIRS},\nk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, src ORDER BY dist, dst)::int AS rank FROM d WHERE src <> dst) WHERE rank <= {NEAR})"
GRAPH = f"{KNN},\ne AS (SELECT DISTINCT scene_id, src, dst, dist FROM (SELECT scene_id, src, dst, dist FROM k UNION ALL SELECT scene_id, dst, src, dist FROM k))"
FACES = f"{POINTS},\nf AS (SELECT a.scene_id, a.pid AS a, b.pid AS b, c.pid AS c FROM p a JOIN p b ON b.pid = a.pid + {SCENES} JOIN p c ON c.pid = a.pid + {2 * SCENES})"


def knn(spark: SparkSession, sf_dir: str, k: int = NEAR) -> DataFrame:
    p = points(spark, sf_dir)
    return neighbours.knn(p, p, k)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-neighbour graph in both directions."""
    near = materialise(knn(spark, sf_dir).select("scene_id", "src", "dst", "dist"), "graph")
    return near.union(near.select("scene_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("scene_id", "pid")
    b = p.select((F.col("pid") - SCENES).alias("a"), F.col("pid").alias("b"))
    c = p.select((F.col("pid") - 2 * SCENES).alias("a"), F.col("pid").alias("c"))
    return p.withColumnRenamed("pid", "a").join(b, "a").join(c, "a").select("scene_id", "a", "b", "c")


def _results(spark: SparkSession, sf_dir: str, flag: str, suffix: str = "") -> DataFrame:
    """A result table: a row a supplier, with figures of its items of one kind."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return rows.groupBy(F.col("l_suppkey").alias("Name")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 9).alias(f"OOA_cp{suffix}"), F.count(F.lit(1)).alias(f"Size_cp{suffix}"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.join_results(_results(spark, sf_dir, "A"), _results(spark, sf_dir, "R"))


_RESULT = "SELECT l_suppkey AS Name, round(avg(l_discount::double), 9) AS ooa, count(*) AS size FROM lineitem WHERE l_returnflag = '{}' GROUP BY l_suppkey"
BOTH = f"ra AS ({_RESULT.format('A')}), rr AS ({_RESULT.format('R')}),\nj AS (SELECT ra.Name, ra.ooa AS a, rr.ooa AS b, ra.size AS sa, rr.size AS sb FROM ra JOIN rr USING (Name))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"))


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a figure that has outliers."""
    return _orders(spark, sf_dir).withColumn("price", F.pow(F.col("price") / 1000, F.lit(4.0)))


ORDERS = "o AS (SELECT o_orderkey, o_orderpriority, o_totalprice::double AS price FROM orders),\nq AS (SELECT o_orderpriority, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM o GROUP BY 1),\nl AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("scene_id", "pid").filter("pid % 20 = 0")


def _sparse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("scene_id", "pid", F.when(F.col("pid") % 7 == 0, F.col("label")).otherwise(F.lit(-1)).alias("label"))


_E6 = ["sxx", "sxy", "sxz", "syy", "syz", "szz"]
_COV = ", ".join(f"round(CASE WHEN count(*) >= {{least}} THEN covar_pop({a}, {b}){{times}} ELSE 0 END, 6) + 0.0 AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


def _weighted(s: SparkSession, d: str) -> DataFrame:
    cells = voxels.binned(points(s, d), CELL).withColumn("w", F.col("r") + 1)
    return _rounded(voxels.weighted_scatter(cells, ["scene_id", *voxels.BINS], "w"), _E6)


def _eigen_features(s: SparkSession, d: str) -> DataFrame:
    names = ["linearity", "planarity", "scattering", "omnivariance", "eigensum", "anisotropy", "eigenentropy"]
    return _rounded(features.point_features(points(s, d), knn(s, d), names), names, 5)


def _oriented(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Normals rounded, upwards."""
    up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    return frame.withColumns({c: F.round(F.col(c) * up, digits) + 0.0 for c in ("nx", "ny", "nz")})


def _voxel_features(s: SparkSession, d: str) -> DataFrame:
    by = ["scene_id", *voxels.BINS]
    found = features.voxel_features(voxels.scatter(voxels.binned(points(s, d), CELL), by), by)
    return _oriented(found.select(*by, *[(F.round(F.col("eigen")[i], 4) + 0.0).alias(n) for i, n in enumerate(features.VOXEL_FEATURES)], "nx", "ny", "nz"))


def _draws(s: SparkSession, d: str) -> DataFrame:
    """Points of 200 plane hypotheses, by their ranks in a scene."""
    own = Window.partitionBy("scene_id")
    ranked = points(s, d).select("scene_id", "pid", (F.row_number().over(own.orderBy("pid")) - 1).alias("i"))
    sizes = ranked.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return chosen.withColumn("i", ((F.col("h") * 37 + F.col("j") * (F.col("h") + 11)) % F.col("n")).cast("int")).join(ranked, ["scene_id", "i"])


def _mesh_adjacency(s: SparkSession, d: str) -> DataFrame:
    """Labels as nodes, joined by the edges of the points nearest to their centroids."""
    p = points(s, d)
    node = F.substring("scene_id", 2, 9).cast("long") * 100 + F.col("label")
    owner = p.select("scene_id", "pid", node.alias("node"))
    centres = voxels.centroids(p, ["scene_id", "label"]).select("scene_id", node.alias("pid"), "x", "y", "z")
    return voxel_graph.mesh_adjacency(centres, p, owner, graph(s, d))


def _stored_graph(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "stored-graph")
    tables.write_graph(knn(s, d), path)
    return tables.read_graph(s, path, "s1")


def _csv(s: SparkSession, frame: DataFrame) -> str:
    path = fresh_path(s, "results")
    tables.write_csv(frame, path)
    return path


def _concatenated(s: SparkSession, d: str) -> DataFrame:
    one, two = (_results(s, d, flag) for flag in "AR")
    return tables.concat_csv(s, [_csv(s, one), _csv(s, two.withColumn("Kind", F.lit("R")))]).selectExpr("cast(Name as bigint) Name", "OOA_cp", "cast(Size_cp as bigint) Size_cp", "Kind")


def _listed_scenes(s: SparkSession, d: str) -> DataFrame:
    path = _csv(s, table(s, d, "customer").select(F.col("c_name").alias("scenes")))
    return scans.scenes(scans.chosen_scenes(scans.scenes_from_csv(s, path), None), ["Customer#000000001"], prefix=16)


def _benchmark(s: SparkSession, d: str) -> DataFrame:
    """The benchmark over two partitions that SQL can state: columns of cells, and refined labels."""
    chosen = {"cells": lambda p, e: superpoints(s, d), "refined": lambda p, e: regions.refine_together(_sparse_labels(s, d), e), "left out": None}
    found = benchmark.run_benchmark(points(s, d).drop("label"), objects(s, d), graph(s, d), chosen, exclude=("left out",))
    return _rounded(found.drop("Duration_cells", "Duration_refined"), ["OOA_cells", "OOA_refined"], 9)


def _fused(s: SparkSession, d: str) -> DataFrame:
    graph_ = knn(s, d, 2)
    found = connected_components(edges.mutual(graph_), "src", "dst")
    labels = points(s, d).select("scene_id", "pid").join(found.withColumnRenamed("id", "pid"), "pid", "left").select("scene_id", "pid", F.coalesce("component", "pid").alias("label"))
    return components.fuse_small(labels, knn(s, d).select("scene_id", "src", "dst"), 5)


def _indices(s: SparkSession, d: str) -> DataFrame:
    """Line items as vertices, the last digits of their parts as over-segments."""
    return table(s, d, "lineitem").select(F.lit("all").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), (F.col("l_partkey") % 97).alias("segment"))


def _groups(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations as groups of over-segments."""
    return table(s, d, "supplier").select(F.lit("all").alias("scene_id"), (F.col("s_nationkey") + 1).cast("int").alias("ordinal"), (F.col("s_suppkey") % 97).alias("segment"))


def _wide(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("ID"), F.col("l_returnflag").alias("algorithm")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 9).alias("ooa"), F.count(F.lit(1)).alias("n_superpoints"), F.max("l_linenumber").cast("double").alias("duration"))
    names = rows.withColumn("Name", F.concat(F.lit("s"), F.col("ID").cast("string"))).withColumn("n_points", F.lit(1))
    return tables.wide_results(names, ["A", "N", "R"])


QUERIES = {
    # match orders and accuracy
    "ooa_of_voxel_partition": ooa_of_voxel_partition,
    "ooa_of_suppliers": ooa_of_suppliers,
    "contingency": _table,
    "object_share": lambda s, d: _rounded(scoring.object_share_density(_table(s, d)), ["density"]),
    "best_objects": lambda s, d: scoring.alpha(_density(s, d)),
    "best_superpoints": lambda s, d: scoring.beta(_density(s, d)),
    "best_owned_objects": lambda s, d: scoring.alpha_beta(_density(s, d)),
    "second_superpoints": lambda s, d: scoring.gamma(_density(s, d)),
    "matched_objects": lambda s, d: scoring.matched_objects(_density(s, d)),
    "third_order_pairs": lambda s, d: scoring.third_order_pairs(_density(s, d)),
    "match_forces": lambda s, d: scoring.forces(_density(s, d)),
    "match_classes": lambda s, d: scoring.classify(superpoints(s, d), objects(s, d)),
    "relative_matches": lambda s, d: _rounded(scoring.relative_matches(scoring.classify(superpoints(s, d), objects(s, d)), 3), ["share"]),
    "precision_feedback": lambda s, d: scoring.precision_feedback(_density(s, d), edges.between_components(superpoints(s, d), knn(s, d)).select("scene_id", F.col("ls").alias("s_i"), F.col("lt").alias("s_j")).distinct()),
    "match_counts": lambda s, d: scoring.match_counts(_table(s, d)),
    "label_runs": lambda s, d: scoring.runs(superpoints(s, d)),
    "label_index": lambda s, d: scoring.label_index(superpoints(s, d)),
    "clusters_to_labels": lambda s, d: scoring.partition_from_clusters(scoring.clusters_from_partition(superpoints(s, d)).withColumnRenamed("label", "cluster").filter("cluster % 3 <> 0"), points(s, d)),
    "remaining_points": lambda s, d: scoring.remaining_points(points(s, d).select("scene_id", "pid"), scoring.segment_points(objects(s, d), 1)),
    # voxels
    "bounds": lambda s, d: _rounded(voxels.bounds(points(s, d)), [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]),
    "voxel_grid": lambda s, d: _rounded(voxels.voxel_grid(points(s, d), CELL), ["x", "y", "z"]),
    "voxel_grid_of_items": lambda s, d: _rounded(
        voxels.voxel_grid(table(s, d, "lineitem").select(F.lit("all").alias("scene_id"), *[F.col(f"l_{n}").cast("double").alias(c) for n, c in (("quantity", "x"), ("extendedprice", "y"), ("discount", "z"))]), 10.0, colours=False), ["x", "y", "z"], 4
    ),
    "voxel_histogram": lambda s, d: voxels.label_histogram(points(s, d), CELL),
    "voxel_labels": lambda s, d: voxels.majority_label(voxels.label_histogram(points(s, d), CELL)),
    "voxel_centres": lambda s, d: _rounded(voxels.voxel_centre(points(s, d), CELL), ["cx", "cy", "cz"]),
    "voxel_scatter": lambda s, d: _rounded(voxels.scatter(voxels.binned(points(s, d), CELL), ["scene_id", *voxels.BINS]), _E6),
    "voxel_weighted_scatter": _weighted,
    "voxel_volumes": lambda s, d: _rounded(voxels.box_volume(voxels.binned(points(s, d), CELL), ["scene_id", *voxels.BINS]), ["volume"], 9),
    "voxel_last_points": lambda s, d: voxels.last_point(points(s, d), CELL).select("scene_id", *voxels.BINS, "pid", "n"),
    "voxel_normals": lambda s, d: _rounded(voxels.mean_normals(voxels.binned(points(s, d), CELL), ["scene_id", *voxels.BINS]), ["nx", "ny", "nz"]),
    "voxel_neighbours": lambda s, d: voxels.neighbour_voxels(voxels.binned(points(s, d), CELL).select("scene_id", *voxels.BINS).distinct()),
    "label_centroids": lambda s, d: _rounded(voxels.centroids(points(s, d), ["scene_id", "label"]), ["x", "y", "z", "r", "g", "b", "nx", "ny", "nz"]),
    # neighbours and edges
    "knn": lambda s, d: _rounded(knn(s, d), ["dist"]),
    "radius_neighbours": lambda s, d: _rounded(neighbours.radius_join(points(s, d), points(s, d), REACH), ["dist"]),
    "nearest_of_label": lambda s, d: _rounded(neighbours.nearest_point(points(s, d).filter("label = 0"), points(s, d).filter("label = 1")), ["dist"]),
    "mesh_edges": lambda s, d: _rounded(edges.mesh_edges(points(s, d), faces(s, d)), ["dist"]),
    "mesh_normals": lambda s, d: _rounded(edges.face_normals(points(s, d), faces(s, d)), ["nx", "ny", "nz"], 5),
    "unidirectional": lambda s, d: _rounded(edges.without_reverse(knn(s, d)), ["dist"]),
    "mutual_neighbours": lambda s, d: edges.mutual(knn(s, d)).select("scene_id", "src", "dst"),
    "component_edges": lambda s, d: edges.between_components(superpoints(s, d), knn(s, d)),
    "border_weights": lambda s, d: _rounded(edges.border_weights(superpoints(s, d), edges.edge_weights(graph(s, d))), ["border"]),
    "edge_weights": lambda s, d: _rounded(edges.edge_weights(knn(s, d)).select("scene_id", "src", "dst", "weight"), ["weight"]),
    "fewer_neighbours": lambda s, d: edges.nearest(knn(s, d).drop("rank"), 3).select("scene_id", "src", "dst", "rank"),
    "adjacency_arrays": lambda s, d: edges.adjacency(knn(s, d)).select("scene_id", "src", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets")),
    "mesh_adjacency": lambda s, d: _rounded(_mesh_adjacency(s, d), ["dist"]),
    "cell_adjacency": lambda s, d: supervoxels.supervoxel_adjacency(points(s, d), superpoints(s, d), CELL),
    "complete_scenes": lambda s, d: edges.complete_sources(points(s, d), knn(s, d), NEAR),
    # paths and components
    "geodesic_hops": lambda s, d: _rounded(geodesic.geodesic_hops(graph(s, d), _seeds(s, d), 2), ["dist"]),
    "geodesic_radius": lambda s, d: _rounded(geodesic.geodesic_radius(graph(s, d), _seeds(s, d), REACH), ["dist"]),
    "geodesic_knn": lambda s, d: _rounded(geodesic.geodesic_knn(graph(s, d), _seeds(s, d), 4), ["dist"]),
    "shortest_paths": lambda s, d: _rounded(geodesic.one_to_all(graph(s, d), _seeds(s, d)), ["d"]),
    "least_distances": lambda s, d: _rounded(geodesic.least_distances(graph(s, d), 3).select("scene_id", "src", F.posexplode("dists").alias("rank", "dist")), ["dist"]),
    "path_lengths": lambda s, d: _rounded(geodesic.path_length(graph(s, d), _seeds(s, d).select("scene_id", F.col("pid").alias("src"), (F.col("pid") + SCENES).alias("dst"))), ["dist"]),
    "components": lambda s, d: connected_components(edges.mutual(knn(s, d, 2)), "src", "dst"),
    "fused_components": _fused,
    "random_subgraph": lambda s, d: components.random_subgraph(graph(s, d).select("scene_id", "src", "dst"), 40, order=F.col("pid")),
    # features
    "neighbour_scatter": lambda s, d: _rounded(features.neighbourhood_scatter(points(s, d), knn(s, d)), _E6),
    "point_features": lambda s, d: _rounded(features.point_features(points(s, d), knn(s, d), features.GEOF), features.GEOF, 5),
    "eigen_features": _eigen_features,
    "all_point_features": lambda s, d: _oriented(_rounded(features.point_features(points(s, d), knn(s, d), features.ALL_GEOF), features.ALL_GEOF[:8], 5)),
    "curvature_normals": lambda s, d: _oriented(_rounded(features.point_features(points(s, d), knn(s, d), features.CURVATURE), features.CURVATURE[:5], 5)),
    "pca_normals": lambda s, d: _oriented(_rounded(features.pca_normals(points(s, d), knn(s, d)), ["lambda0"], 5)),
    "voxel_features": _voxel_features,
    "perspective": lambda s, d: _rounded(voxels.perspective(points(s, d)).select("scene_id", "pid", "x", "y", "z"), ["x", "y", "z"]),
    # scans and results
    "ground_truth": lambda s, d: scans.ground_truth(_groups(s, d), _indices(s, d)),
    "object_points": lambda s, d: scans.object_points(_groups(s, d), _indices(s, d)),
    "scenes": lambda s, d: scans.scenes(table(s, d, "customer").select(F.col("c_name").alias("name")), ["Customer#000000001"], prefix=16),
    "small_scenes": lambda s, d: scans.small_scenes(table(s, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("pid")), 3),
    "wide_results": _wide,
    "stored_graph": lambda s, d: _rounded(_stored_graph(s, d), ["dist"]),
    "stored_results": lambda s, d: tables.read_csv(s, _csv(s, _results(s, d, "A")), "Name bigint, OOA_cp double, Size_cp bigint"),
    "concatenated_results": _concatenated,
    "listed_scenes": _listed_scenes,
    "ramp": lambda s, d: _rounded(points(s, d).select("scene_id", "pid", *tables.ramp((F.col("x") + 1) / 2)), ["r", "g", "b"]),
    "benchmark": _benchmark,
    # comparison of results
    "robust_scale": lambda s, d: _rounded(analysis.robust_scale(_orders(s, d), "price", ["o_orderpriority"]), ["median", "scale"], 4),
    "robust_inliers": lambda s, d: analysis.robust_inliers(_orders(s, d), "price", ["o_orderpriority"], 1.0).select("o_orderkey", "o_orderpriority"),
    "joined_results": _both,
    "renamed_results": lambda s, d: analysis.rename_columns(analysis.drop_columns(_results(s, d, "A"), ["cp"], ["Size"]), {"cp": "pursuit"}, ["OOA"]),
    "common_scenes": lambda s, d: analysis.common_scenes(table(s, d, "orders").select(F.col("o_custkey").alias("Name"), F.col("o_orderkey").alias("ID")), table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("Name"))),
    "outlier_fences": lambda s, d: _rounded(analysis.fences(_orders(s, d), "price", ["o_orderpriority"]), ["q1", "q3", "low", "high"], 4),
    "outliers": lambda s, d: analysis.outliers(_skewed(s, d), "price", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority"),
    "without_outliers": lambda s, d: analysis.without_outliers(_both(s, d), ["OOA_cp_P", "OOA_cp_M"]).select("Name"),
    "summary": lambda s, d: _rounded(analysis.describe(_orders(s, d), "price", ["o_orderpriority"]), ["mean", "std", "q25", "q50", "q75"], 3),
    "box_statistics": lambda s, d: _rounded(analysis.box(_orders(s, d), "price", ["o_orderpriority"]), ["q1", "q3", "median", "whisker_low", "whisker_high"], 4),
    "pooled_t": lambda s, d: _rounded(analysis.pooled_t(_both(s, d), "OOA_cp_P", "OOA_cp_M"), ["t"]),
    "bartlett": lambda s, d: _rounded(analysis.bartlett(_both(s, d), "OOA_cp_P", "OOA_cp_M"), ["statistic"]),
    "mann_whitney": lambda s, d: _rounded(analysis.mann_whitney(_both(s, d), "OOA_cp_P", "OOA_cp_M"), ["z"], 5),
    # partitions
    "refined_labels": lambda s, d: regions.refine(_sparse_labels(s, d), graph(s, d)),
    "refined_labels_together": lambda s, d: regions.refine_together(_sparse_labels(s, d), graph(s, d)),
    "grown_regions": lambda s, d: regions.grow_regions(_seeds(s, d), graph(s, d), points(s, d).select("scene_id", "pid", "nx", "ny", "nz"), 60.0),
    "grown_scene": lambda s, d: regions.grow_scene(points(s, d).select("scene_id", "pid", "x", "y", "z").join(features.pca_normals(points(s, d), knn(s, d)), ["scene_id", "pid"]), graph(s, d), 15.0, percent=0.5),
    "ransac_planes": lambda s, d: _rounded(regions.ransac_planes(points(s, d), 0.05, draws=_draws(s, d)), ["a", "b", "c", "d"]),
    "supervoxels": lambda s, d: supervoxels.supervoxels(points(s, d), 0.05, 0.2, 0.2, 0.2, 0.6, 1),
    "voxel_graph": lambda s, d: voxel_graph.segment_voxels(points(s, d), CELL, 0.3, points_min=0, adjacency_min=0, voxels_min=0),
    "supervoxel_graph": lambda s, d: voxel_graph.segment_supervoxels(points(s, d), supervoxels.supervoxels(points(s, d), 0.05, 0.2, 0.2, 0.2, 0.6, 0), 0.3),
    "pairwise_linkage": lambda s, d: linkage.pairwise_linkage(points(s, d), 10, 90, 3, 30),
    "cut_pursuit": lambda s, d: cut_pursuit.partition_points(points(s, d), 5, 10, 0.07),
}

_GROUP = "scene_id, ix, iy, iz"
#: Least path lengths from every twentieth point, by a keyed recursion.
PATHS = f"""RECURSIVE {GRAPH},
w(scene_id, root, v, d) USING KEY (root, v) AS (SELECT scene_id, pid, pid, 0.0::double FROM p WHERE pid % 20 = 0
  UNION SELECT w.scene_id, w.root, e.dst, min(w.d + e.dist) FROM w JOIN e ON e.src = w.v LEFT JOIN recurring.w o ON o.root = w.root AND o.v = e.dst
  WHERE w.d + e.dist < coalesce(o.d, 1e300) GROUP BY 1, 2, 3)"""
#: Eigenvalues of symmetric matrices by the trigonometric formula, and the projections on eigenvectors: pab of the last, hia the sizes of all components.
_SPECTRUM = """
c2 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c),
c3 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS t FROM c2),
c4 AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * t * t * t)))) / 3 AS phi FROM c3),
ev AS (SELECT *, q + 2 * t * cos(phi) AS l1, greatest(0, 3 * q - (q + 2 * t * cos(phi)) - (q + 2 * t * cos(phi + 2 * pi() / 3))) AS l2, greatest(0, q + 2 * t * cos(phi + 2 * pi() / 3)) AS l3 FROM c4),
sq AS (SELECT *, xx * xx + xy * xy + xz * xz AS mxx, xy * xy + yy * yy + yz * yz AS myy, xz * xz + yz * yz + zz * zz AS mzz, xx * xz + xy * yz + xz * zz AS mxz, xy * xz + yy * yz + yz * zz AS myz FROM ev),
pr AS (SELECT *, """ + ", ".join(f"sqrt(greatest(0, (m{c}{c} - (l{j} + l{k}) * {c}{c} + l{j} * l{k}) / ((l{i} - l{j}) * (l{i} - l{k})))) AS h{i}{c}" for i, j, k in ((1, 2, 3), (2, 1, 3), (3, 1, 2)) for c in "xyz") + """,
  (mxz - (l1 + l2) * xz) / ((l3 - l1) * (l3 - l2)) AS pxz, (myz - (l1 + l2) * yz) / ((l3 - l1) * (l3 - l2)) AS pyz FROM sq),
un AS (SELECT *, """ + ", ".join(f"l1 * h1{c} + l2 * h2{c} + l3 * h3{c} AS u{c}" for c in "xyz") + """, pxz / h3z AS nx, pyz / h3z AS ny, h3z AS nz, l1 + l2 + l3 AS total FROM pr)"""
EIGEN = f"""{KNN},
c AS (SELECT scene_id, src AS pid, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz
  FROM (SELECT k.scene_id, src, x, y, z FROM k JOIN p ON pid = dst UNION ALL SELECT scene_id, pid, x, y, z FROM p) GROUP BY ALL),{_SPECTRUM}"""
_SHAPE = {
    "linearity": "(sqrt(l1) - sqrt(l2)) / sqrt(l1)", "planarity": "(sqrt(l2) - sqrt(l3)) / sqrt(l1)", "scattering": "sqrt(l3) / sqrt(l1)", "verticality": "uz / sqrt(ux * ux + uy * uy + uz * uz)",
    "omnivariance": "l3 / total", "eigensum": "total", "anisotropy": "(l1 - l3) / l1", "eigenentropy": "-(l1 * ln(l1) + l2 * ln(l2) + l3 * ln(l3))", "curvature": "l3 / total", "lambda0": "l3 / (total + 1e-12)",
}
_NORMAL = ", ".join(f"round(n{c}, 4) + 0.0 AS n{c}" for c in "xyz")


def _shape(names: list[str]) -> str:
    return ", ".join(f"round({_SHAPE[n]}, 5) + 0.0 AS {n}" for n in names)


_GRID_C = f"{GRID},\nc AS (SELECT {_GROUP}, " + ", ".join(f"covar_pop({a}, {b}) * count(*) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + f" FROM v GROUP BY {_GROUP} HAVING count(*) >= 4),{_SPECTRUM},\nes AS (SELECT *, l1 / sqrt(l1 * l1 + l2 * l2 + l3 * l3) AS e1, l2 / sqrt(l1 * l1 + l2 * l2 + l3 * l3) AS e2, l3 / sqrt(l1 * l1 + l2 * l2 + l3 * l3) AS e3 FROM un)"
_VOXEL_SHAPE = {
    "linearity": "(e1 - e2) / e1", "planarity": "(e2 - e3) / e1", "scattering": "e3 / e1", "curvature": "e3 / (e1 + e2 + e3)", "anisotropy": "(e1 - e3) / e1", "entropy": "-(e1 * ln(e1) + e2 * ln(e2) + e3 * ln(e3))", "eigensum": "e1 + e2 + e3", "omnivariance": "cbrt(e1 * e2 * e3)",
}
#: Components of mutual nearest neighbours, the small ones led to the largest one near.
FUSED = f"""RECURSIVE {KNN},
m AS (SELECT src, dst FROM k WHERE rank <= 2 AND EXISTS (SELECT 1 FROM k o WHERE o.rank <= 2 AND o.src = k.dst AND o.dst = k.src)),
w AS (SELECT src AS id, src AS component FROM m UNION SELECT m.dst, w.component FROM w JOIN m ON m.src = w.id),
c AS (SELECT p.scene_id, p.pid, coalesce(f.component, p.pid) AS label FROM p LEFT JOIN (SELECT id, min(component) AS component FROM w GROUP BY id) f ON f.id = p.pid),
z AS (SELECT scene_id, label, count(*) AS n FROM c GROUP BY ALL),
h AS (SELECT DISTINCT a.scene_id, a.label AS a, b.label AS b FROM k JOIN c a ON a.pid = src JOIN c b ON b.pid = dst WHERE a.label <> b.label),
hh AS (SELECT scene_id, a, b FROM h UNION SELECT scene_id, b, a FROM h),
t AS (SELECT hh.scene_id, a, b FROM hh JOIN z s ON s.label = a AND s.n < 5 JOIN z l ON l.label = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY l.n DESC, b) = 1),
tt AS (SELECT a, b FROM t UNION SELECT b, a FROM t),
g AS (SELECT a AS id, a AS root FROM tt UNION SELECT tt.b, g.root FROM g JOIN tt ON tt.a = g.id),
q AS (SELECT z.label, z.n, coalesce(y.root, z.label) AS g FROM z LEFT JOIN (SELECT id, min(root) AS root FROM g GROUP BY id) y ON y.id = z.label),
best AS (SELECT g, label AS new FROM q QUALIFY row_number() OVER (PARTITION BY g ORDER BY n >= 5 DESC, CASE WHEN n >= 5 THEN n ELSE 0 END DESC, label) = 1)"""
#: Labels spread from the labelled points, a step of edges at a time.
REFINED = f"""RECURSIVE {GRAPH},
u(v, d) USING KEY (v) AS (SELECT pid, 0 FROM p WHERE pid % 7 = 0 UNION SELECT e.dst, min(u.d + 1) FROM u JOIN e ON e.src = u.v LEFT JOIN recurring.u o ON o.v = e.dst WHERE o.v IS NULL GROUP BY 1),
w(scene_id, pid, label, d) AS (SELECT scene_id, pid, label, 0 FROM p WHERE pid % 7 = 0 UNION ALL
  SELECT scene_id, pid, label, d FROM (SELECT e.scene_id, e.src AS pid, w.label, w.d + 1 AS d, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, w.label) AS r
    FROM w JOIN e ON e.dst = w.pid JOIN u ON u.v = e.src AND u.d = w.d + 1 GROUP BY e.scene_id, e.src, w.label, w.d) WHERE r = 1),
f AS (SELECT p.scene_id, p.pid, coalesce(w.label, top + 1) AS label FROM p LEFT JOIN w ON w.pid = p.pid JOIN (SELECT scene_id, max(label) AS top FROM w GROUP BY scene_id) b ON b.scene_id = p.scene_id)"""

SQL = {
    "ooa_of_voxel_partition": _sql("SELECT scene_id, round(sum(m) / sum(a), 9) AS ooa, count(*) AS n_superpoints FROM (SELECT scene_id, s, max(n) AS m, sum(n) AS a FROM t GROUP BY ALL) GROUP BY scene_id", TABLE),
    "ooa_of_suppliers": "WITH c AS (SELECT l_suppkey AS s, l_partkey % 10 AS o, count(*) AS n FROM lineitem GROUP BY ALL)\nSELECT 'all' AS scene_id, round(sum(m) / sum(a), 9) AS ooa, count(*) AS n_superpoints FROM (SELECT s, max(n) AS m, sum(n) AS a FROM c GROUP BY s)",
    "contingency": _sql("SELECT scene_id, s, o, n FROM t", TABLE),
    "object_share": _sql("SELECT scene_id, s, o, n, round(n / sum(n) OVER (PARTITION BY scene_id, o), 6) AS density FROM t", TABLE),
    "best_objects": _sql("SELECT * FROM al", TABLE),
    "best_superpoints": _sql("SELECT * FROM be", TABLE),
    "best_owned_objects": _sql("SELECT * FROM ab", TABLE),
    "second_superpoints": _sql("SELECT * FROM ga", TABLE),
    "matched_objects": _sql("SELECT scene_id, beta AS s, count(*) AS m FROM be GROUP BY ALL", TABLE),
    "third_order_pairs": _sql("SELECT * FROM td", TABLE),
    "match_forces": _sql("SELECT * FROM fo", TABLE),
    "match_classes": _sql("SELECT * FROM cl", TABLE),
    "relative_matches": _sql("SELECT scene_id, round(count(*) FILTER (class = 3) / count(DISTINCT o), 6) AS share FROM cl GROUP BY scene_id", TABLE),
    "match_counts": _sql("SELECT scene_id, s, o, n AS inliers, (sum(n) OVER (PARTITION BY scene_id, s) - n)::bigint AS outliers, (sum(n) OVER (PARTITION BY scene_id, o) - n)::bigint AS remaining FROM t QUALIFY row_number() OVER (PARTITION BY scene_id, s ORDER BY n DESC, o) = 1", TABLE),
    "label_runs": _sql(f"SELECT scene_id, label, (stop - n)::bigint AS start, stop::bigint AS stop, n FROM (SELECT *, sum(n) OVER (PARTITION BY scene_id ORDER BY label) AS stop FROM (SELECT scene_id, {_CELL} AS label, count(*) AS n FROM p GROUP BY ALL))"),
    "label_index": _sql(f"SELECT scene_id, label, (dense_rank() OVER (PARTITION BY scene_id ORDER BY label) - 1)::int AS index FROM (SELECT DISTINCT scene_id, {_CELL} AS label FROM p)"),
    "clusters_to_labels": _sql(f"SELECT scene_id, pid, CASE WHEN {_CELL} % 3 <> 0 THEN {_CELL} ELSE -1 END AS label FROM p"),
    "remaining_points": _sql("SELECT scene_id, pid FROM p WHERE label <> 1"),
    "bounds": _sql("SELECT scene_id, " + ", ".join(f"round({n}({c}), 6) + 0.0 AS {n}_{c}" for c in "xyz" for n in ("min", "max")) + " FROM p GROUP BY scene_id"),
    "voxel_grid": _sql("SELECT scene_id, ix, iy, iz, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, floor(avg(r))::bigint AS r, floor(avg(g))::bigint AS g, floor(avg(b))::bigint AS b, count(*) AS n FROM v GROUP BY " + _GROUP, GRID),
    "voxel_grid_of_items": "WITH p AS (SELECT l_quantity::double AS x, l_extendedprice::double AS y, l_discount::double AS z FROM lineitem), lo AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM p)\nSELECT 'all' AS scene_id, floor((x - mx) / 10.0)::bigint AS ix, floor((y - my) / 10.0)::bigint AS iy, floor((z - mz) / 10.0)::bigint AS iz, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, count(*) AS n FROM p, lo GROUP BY 2, 3, 4",
    "voxel_histogram": _sql(f"SELECT {_GROUP}, label, count(*) AS n FROM v GROUP BY ALL", GRID),
    "voxel_labels": _sql(f"SELECT {_GROUP}, label FROM (SELECT {_GROUP}, label, count(*) AS n FROM v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_GROUP} ORDER BY label = 0, n DESC, label) = 1", GRID),
    "voxel_centres": _sql(f"SELECT DISTINCT {_GROUP}, round(mx + (ix + 0.5) * {CELL}, 6) + 0.0 AS cx, round(my + (iy + 0.5) * {CELL}, 6) + 0.0 AS cy, round(mz + (iz + 0.5) * {CELL}, 6) + 0.0 AS cz FROM v JOIN lo USING (scene_id)", GRID),
    "voxel_scatter": _sql(f"SELECT {_GROUP}, {_COV.format(least=4, times=' * count(*)')}, count(*) AS n FROM v GROUP BY {_GROUP}", GRID),
    "voxel_weighted_scatter": _sql(
        f"SELECT {_GROUP}, " + ", ".join(f"round(CASE WHEN count(*) >= 4 THEN sum((r + 1) * ({a} - m{a}{a}) * ({b} - m{b}{b})) / sum(r + 1) ELSE 0 END, 6) + 0.0 AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
        + f", count(*) AS n FROM (SELECT *, avg(x) OVER w AS mxx, avg(y) OVER w AS myy, avg(z) OVER w AS mzz FROM v WINDOW w AS (PARTITION BY {_GROUP})) GROUP BY {_GROUP}", GRID),
    "voxel_volumes": _sql(f"SELECT {_GROUP}, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 9) + 0.0 AS volume FROM v GROUP BY {_GROUP}", GRID),
    "voxel_last_points": _sql(f"SELECT {_GROUP}, max(pid) AS pid, count(*) AS n FROM v GROUP BY {_GROUP}", GRID),
    "voxel_normals": _sql(f"SELECT {_GROUP}, " + ", ".join(f"round(n{c} / l, 6) + 0.0 AS n{c}" for c in "xyz") + f" FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM (SELECT {_GROUP}, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM v GROUP BY {_GROUP}))", GRID),
    "voxel_neighbours": _sql("SELECT a.scene_id, a.ix, a.iy, a.iz, b.ix AS ox, b.iy AS oy, b.iz AS oz FROM c a JOIN c b ON a.scene_id = b.scene_id AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND (a.ix, a.iy, a.iz) <> (b.ix, b.iy, b.iz)", f"{GRID},\nc AS (SELECT DISTINCT {_GROUP} FROM v)"),
    "label_centroids": _sql("SELECT scene_id, label, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in "xyzrgb") + ", n, " + ", ".join(f"round(s{c} / sqrt(sx * sx + sy * sy + sz * sz), 6) + 0.0 AS n{c}" for c in "xyz") + " FROM (SELECT scene_id, label, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS n, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM p GROUP BY ALL)"),
    "knn": _sql("SELECT scene_id, src, dst, round(dist, 6) + 0.0 AS dist, rank FROM k", KNN),
    "radius_neighbours": _sql(f"SELECT scene_id, src, dst, round(dist, 6) + 0.0 AS dist FROM d WHERE dist <= {REACH}", PAIRS),
    "nearest_of_label": _sql("SELECT scene_id, src, dst, round(dist, 6) + 0.0 AS dist FROM d JOIN p a ON a.pid = src JOIN p b ON b.pid = dst WHERE a.label = 0 AND b.label = 1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY d.dist, dst) = 1".replace("SELECT scene_id", "SELECT d.scene_id"), PAIRS),
    "mesh_edges": _sql("SELECT DISTINCT d.scene_id, src, dst, round(dist, 6) + 0.0 AS dist FROM (SELECT a AS u, b AS w FROM f UNION ALL SELECT b, a FROM f UNION ALL SELECT a, c FROM f UNION ALL SELECT c, a FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, b FROM f) JOIN d ON src = u AND dst = w", f"{FACES},{PAIRS[len(POINTS) + 1:]}"),
    "mesh_normals": _sql(
        "SELECT scene_id, pid, " + ", ".join(f"round(n{c} / sqrt(nx * nx + ny * ny + nz * nz), 5) + 0.0 AS n{c}" for c in "xyz")
        + " FROM (SELECT scene_id, pid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT scene_id, unnest([a, b, c]) AS pid, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM w) GROUP BY ALL)",
        f"{FACES},\nw AS (SELECT f.scene_id, f.a, f.b, f.c, q.x - o.x AS ux, q.y - o.y AS uy, q.z - o.z AS uz, r.x - o.x AS vx, r.y - o.y AS vy, r.z - o.z AS vz FROM f JOIN p o ON o.pid = a JOIN p q ON q.pid = f.b JOIN p r ON r.pid = f.c)"),
    "unidirectional": _sql("SELECT scene_id, src, dst, round(dist, 6) + 0.0 AS dist, rank FROM k WHERE src < dst OR NOT EXISTS (SELECT 1 FROM k o WHERE o.scene_id = k.scene_id AND o.src = k.dst AND o.dst = k.src)", KNN),
    "mutual_neighbours": _sql("SELECT scene_id, src, dst FROM k WHERE EXISTS (SELECT 1 FROM k o WHERE o.scene_id = k.scene_id AND o.src = k.dst AND o.dst = k.src)", KNN),
    "component_edges": _sql("SELECT k.scene_id, a.label AS ls, b.label AS lt FROM k JOIN c a ON a.pid = src JOIN c b ON b.pid = dst WHERE a.label <> b.label", f"{KNN},\nc AS (SELECT scene_id, pid, {_CELL} AS label FROM p)"),
    "precision_feedback": _sql("SELECT x.scene_id, s_i, s_j, CASE WHEN a.alpha = b.alpha THEN 1.0::double ELSE 0.0::double END AS feedback FROM x JOIN al a ON a.scene_id = x.scene_id AND a.s = s_i JOIN al b ON b.scene_id = x.scene_id AND b.s = s_j",
        f"{TABLE},{KNN[len(POINTS) + 1:]},\nc AS (SELECT scene_id, pid, {_CELL} AS label FROM p),\nx AS (SELECT DISTINCT k.scene_id, a.label AS s_i, b.label AS s_j FROM k JOIN c a ON a.pid = src JOIN c b ON b.pid = dst WHERE a.label <> b.label)"),
    "border_weights": _sql("SELECT e.scene_id, least(a.label, b.label) AS c1, greatest(a.label, b.label) AS c2, round(sum(0.5 / (1 + dist / m)), 6) + 0.0 AS border FROM e JOIN (SELECT scene_id, avg(dist) AS m FROM e GROUP BY 1) g ON g.scene_id = e.scene_id JOIN c a ON a.pid = src JOIN c b ON b.pid = dst WHERE a.label <> b.label GROUP BY 1, 2, 3", f"{GRAPH},\nc AS (SELECT scene_id, pid, {_CELL} AS label FROM p)"),
    "edge_weights": _sql("SELECT scene_id, src, dst, round(1 / (1 + dist / avg(dist) OVER (PARTITION BY scene_id)), 6) + 0.0 AS weight FROM k", KNN),
    "fewer_neighbours": _sql("SELECT scene_id, src, dst, rank FROM k WHERE rank <= 3", KNN),
    "adjacency_arrays": _sql("SELECT scene_id, src, string_agg(dst::varchar, ',' ORDER BY dist, dst) AS targets FROM k GROUP BY scene_id, src", KNN),
    "complete_scenes": _sql(f"SELECT scene_id FROM (SELECT p.scene_id, p.pid, count(k.dst) AS n FROM p LEFT JOIN k ON k.src = p.pid GROUP BY ALL) GROUP BY scene_id HAVING min(n) >= {NEAR}", KNN),
    "geodesic_hops": _sql("SELECT scene_id, src, dst, round(min(dist), 6) + 0.0 AS dist FROM (SELECT scene_id, pid AS src, pid AS dst, 0.0::double AS dist FROM p WHERE pid % 20 = 0 UNION ALL SELECT scene_id, src, dst, dist FROM e WHERE src % 20 = 0 UNION ALL SELECT a.scene_id, a.src, b.dst, a.dist + b.dist FROM e a JOIN e b ON a.scene_id = b.scene_id AND a.dst = b.src WHERE a.src % 20 = 0) GROUP BY ALL", GRAPH),
    "geodesic_radius": _sql(f"SELECT scene_id, src, dst, round(min(dist), 6) + 0.0 AS dist FROM w WHERE src <> dst GROUP BY scene_id, src, dst", f"RECURSIVE {GRAPH},\nw AS (SELECT scene_id, pid AS src, pid AS dst, 0.0::double AS dist FROM p WHERE pid % 20 = 0 UNION SELECT w.scene_id, w.src, e.dst, w.dist + e.dist FROM w JOIN e ON e.scene_id = w.scene_id AND e.src = w.dst WHERE w.dist + e.dist < {REACH} AND e.dist > 0)"),
    "shortest_paths": _sql("SELECT scene_id, root, v, round(d, 6) + 0.0 AS d FROM w", PATHS),
    "geodesic_knn": _sql("SELECT * FROM (SELECT scene_id, root AS src, v AS dst, round(d, 6) + 0.0 AS dist, row_number() OVER (PARTITION BY root ORDER BY d, v)::int AS rank FROM w WHERE root <> v) WHERE rank <= 4", PATHS),
    "path_lengths": _sql(f"SELECT p.scene_id, p.pid AS src, p.pid + {SCENES} AS dst, round(d, 6) + 0.0 AS dist FROM p LEFT JOIN w ON w.root = p.pid AND w.v = p.pid + {SCENES} WHERE p.pid % 20 = 0", PATHS),
    "grown_regions": _sql("SELECT scene_id, root, v AS pid FROM w", f"RECURSIVE {GRAPH},\nw AS (SELECT scene_id, pid AS root, pid AS v FROM p WHERE pid % 20 = 0 UNION SELECT w.scene_id, w.root, e.dst FROM w JOIN e ON e.scene_id = w.scene_id AND e.src = w.v JOIN p a ON a.pid = w.root JOIN p b ON b.pid = e.dst WHERE acos(least(greatest(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz, -1), 1)) < radians(60))"),
    "eigen_features": _sql("SELECT scene_id, pid, round((sqrt(l1) - sqrt(l2)) / sqrt(l1), 5) + 0.0 AS linearity, round((sqrt(l2) - sqrt(l3)) / sqrt(l1), 5) + 0.0 AS planarity, round(sqrt(l3) / sqrt(l1), 5) + 0.0 AS scattering, round(l3 / (l1 + l2 + l3), 5) + 0.0 AS omnivariance, round(l1 + l2 + l3, 5) + 0.0 AS eigensum, round((l1 - l3) / l1, 5) + 0.0 AS anisotropy, round(-(l1 * ln(l1) + l2 * ln(l2) + l3 * ln(l3)), 5) + 0.0 AS eigenentropy FROM ev", EIGEN),
    "point_features": _sql(f"SELECT scene_id, pid, {_shape(features.GEOF)} FROM un", EIGEN),
    "all_point_features": _sql(f"SELECT scene_id, pid, {_shape(features.ALL_GEOF[:8])}, {_NORMAL} FROM un", EIGEN),
    "curvature_normals": _sql(f"SELECT scene_id, pid, {_shape(features.CURVATURE[:5])}, {_NORMAL} FROM un", EIGEN),
    "pca_normals": _sql(f"SELECT scene_id, pid, {_shape(['lambda0'])}, {_NORMAL} FROM un", EIGEN),
    "voxel_features": _sql(f"SELECT o.scene_id, o.ix, o.iy, o.iz, " + ", ".join(f"coalesce(round({e}, 4) + 0.0, 0.0) AS {n}" for n, e in _VOXEL_SHAPE.items()) + ", " + ", ".join(f"coalesce(round(n{c}, 4) + 0.0, 0.0) AS n{c}" for c in "xyz") + f" FROM (SELECT DISTINCT {_GROUP} FROM v) o LEFT JOIN es ON es.scene_id = o.scene_id AND es.ix = o.ix AND es.iy = o.iy AND es.iz = o.iz", _GRID_C),
    "least_distances": _sql("SELECT scene_id, src, rank, round(d, 6) + 0.0 AS dist FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY d, dst) - 1)::int AS rank FROM m) WHERE rank < 3",
        f"{GRAPH},\nm AS (SELECT scene_id, src, dst, min(dist) AS d FROM (SELECT scene_id, pid AS src, pid AS dst, 0.0::double AS dist FROM p UNION ALL SELECT scene_id, src, dst, dist FROM e UNION ALL SELECT a.scene_id, a.src, b.dst, a.dist + b.dist FROM e a JOIN e b ON a.dst = b.src) GROUP BY ALL)"),
    "random_subgraph": _sql("SELECT e.scene_id, src, dst FROM e JOIN kept a ON a.v = src JOIN kept b ON b.v = dst",
        f"RECURSIVE {GRAPH},\nw(scene_id, v, d) USING KEY (v) AS (SELECT scene_id, min(pid), 0 FROM p GROUP BY scene_id UNION SELECT w.scene_id, e.dst, min(w.d + 1) FROM w JOIN e ON e.src = w.v LEFT JOIN recurring.w o ON o.v = e.dst WHERE o.v IS NULL GROUP BY 1, 2),\nkept AS (SELECT scene_id, v FROM w QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY d, v) <= 40)"),
    "fused_components": _sql("SELECT c.scene_id, c.pid, best.new AS label FROM c JOIN q ON q.label = c.label JOIN best ON best.g = q.g", FUSED),
    "refined_labels_together": _sql("SELECT scene_id, pid, label FROM f", REFINED),
    "ransac_planes": _sql(
        "SELECT scene_id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(d, 6) + 0.0 AS d, inliers FROM (SELECT n.scene_id, n.h, n.a, n.b, n.c, n.d, count(*) FILTER (abs(n.a * x + n.b * y + n.c * z + n.d) <= 0.05) AS inliers FROM n JOIN p ON p.scene_id = n.scene_id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY inliers DESC, h) = 1",
        f"{POINTS},\nr AS (SELECT scene_id, x, y, z, row_number() OVER (PARTITION BY scene_id ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM p),\nt AS (SELECT o.scene_id, g.h, o.x, o.y, o.z, q.x - o.x AS ux, q.y - o.y AS uy, q.z - o.z AS uz, s.x - o.x AS vx, s.y - o.y AS vy, s.z - o.z AS vz FROM range(200) g(h) JOIN r o ON o.i = (h * 37) % o.n JOIN r q ON q.scene_id = o.scene_id AND q.i = (h * 37 + h + 11) % o.n JOIN r s ON s.scene_id = o.scene_id AND s.i = (h * 37 + 2 * (h + 11)) % o.n),\nx AS (SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM t),\nl AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM x),\nn AS (SELECT scene_id, h, cx / l AS a, cy / l AS b, cz / l AS c, -(cx / l * x + cy / l * y + cz / l * z) AS d FROM l WHERE l > 0)"),
    "mesh_adjacency": _sql(
        "SELECT scene_id, u, v, round(min(dist), 6) + 0.0 AS dist FROM (SELECT scene_id, u, v, dist FROM j UNION ALL SELECT scene_id, v, u, dist FROM j) GROUP BY scene_id, u, v",
        f"{GRAPH},\no AS (SELECT scene_id, pid, substr(scene_id, 2)::bigint * 100 + label AS node, x, y, z FROM p),\nce AS (SELECT scene_id, node, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM o GROUP BY ALL),\nne AS (SELECT ce.scene_id, ce.node AS u, o.pid FROM ce JOIN o ON o.scene_id = ce.scene_id QUALIFY row_number() OVER (PARTITION BY ce.scene_id, ce.node ORDER BY sqrt((o.x - ce.x) * (o.x - ce.x) + (o.y - ce.y) * (o.y - ce.y) + (o.z - ce.z) * (o.z - ce.z)), o.pid) = 1),\nj AS (SELECT ne.scene_id, ne.u, o.node AS v, e.dist FROM ne JOIN e ON e.scene_id = ne.scene_id AND e.src = ne.pid JOIN o ON o.pid = e.dst WHERE ne.u <> o.node)"),
    "cell_adjacency": _sql("SELECT x.scene_id, x.label AS a, y.label AS b, count(*) AS n FROM s x JOIN s y ON x.scene_id = y.scene_id AND abs(x.ix - y.ix) <= 1 AND abs(x.iy - y.iy) <= 1 AND abs(x.iz - y.iz) <= 1 AND (x.ix, x.iy, x.iz) <> (y.ix, y.iy, y.iz) AND x.label <> y.label GROUP BY ALL", f"{GRID},\ns AS (SELECT DISTINCT {_GROUP}, {_CELL} AS label FROM v)"),
    "stored_graph": _sql("SELECT scene_id, src, dst, round(dist, 6) + 0.0 AS dist, rank FROM k WHERE scene_id = 's1'", KNN),
    "stored_results": f"WITH {BOTH}\nSELECT Name, ooa AS OOA_cp, size AS Size_cp FROM ra",
    "concatenated_results": f"WITH {BOTH}\nSELECT Name, ooa AS OOA_cp, size AS Size_cp, NULL AS Kind FROM ra UNION ALL SELECT Name, ooa, size, 'R' FROM rr",
    "listed_scenes": "SELECT name FROM (SELECT c_name AS name, row_number() OVER (PARTITION BY substr(c_name, 1, 16) ORDER BY c_name) AS r FROM customer) WHERE r = 1 AND name <> 'Customer#000000001'",
    "ramp": _sql("SELECT scene_id, pid, round(least(greatest((x + 1) / 2, 0), 1), 6) + 0.0 AS r, 0.0::double AS g, round(1 - least(greatest((x + 1) / 2, 0), 1), 6) + 0.0 AS b FROM p"),
    "benchmark": _sql(
        "SELECT dense_rank() OVER (ORDER BY a.scene_id)::int AS ID, a.scene_id AS Name, a.n AS \"|V|\", round(a.ooa, 9) AS OOA_cells, a.k AS \"|S|_cells\", round(b.ooa, 9) AS OOA_refined, b.k AS \"|S|_refined\" FROM a JOIN b ON b.scene_id = a.scene_id",
        REFINED + "".join(f",\n{name} AS (SELECT scene_id, sum(m) / sum(n) AS ooa, count(*) AS k, sum(n)::bigint AS n FROM (SELECT scene_id, s, max(n) AS m, sum(n) AS n FROM (SELECT p.scene_id, {s} AS s, p.label AS o, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY scene_id, s) GROUP BY scene_id)" for name, s, source in (("a", _CELL, "p"), ("b", "f.label", "p JOIN f ON f.pid = p.pid")))),
    "components": _sql("SELECT id, min(component) AS component FROM w GROUP BY id", f"RECURSIVE {KNN.replace(f'rank <= {NEAR}', 'rank <= 2')},\nm AS (SELECT src, dst FROM k WHERE EXISTS (SELECT 1 FROM k o WHERE o.src = k.dst AND o.dst = k.src)),\nw AS (SELECT src AS id, src AS component FROM m UNION SELECT m.dst, w.component FROM w JOIN m ON m.src = w.id)"),
    "neighbour_scatter": _sql(f"SELECT scene_id, src AS pid, {_COV.format(least=1, times='')}, count(*) AS n FROM (SELECT k.scene_id, src, x, y, z FROM k JOIN p ON pid = dst UNION ALL SELECT scene_id, pid, x, y, z FROM p) GROUP BY scene_id, src", KNN),
    "perspective": _sql("SELECT scene_id, pid, round(x / z, 6) + 0.0 AS x, round(y / z, 6) + 0.0 AS y, round(ln(z), 6) + 0.0 AS z FROM p WHERE z > 0"),
    "ground_truth": "SELECT 'all' AS scene_id, l_orderkey * 10 + l_linenumber AS pid, coalesce(o, 0) AS label FROM lineitem LEFT JOIN (SELECT s_suppkey % 97 AS g, max(s_nationkey + 1) AS o FROM supplier GROUP BY 1) ON g = l_partkey % 97",
    "object_points": "SELECT 'all' AS scene_id, o AS ordinal, l_orderkey * 10 + l_linenumber AS pid FROM lineitem JOIN (SELECT DISTINCT s_suppkey % 97 AS g, s_nationkey + 1 AS o FROM supplier) ON g = l_partkey % 97",
    "scenes": "SELECT name FROM (SELECT c_name AS name, row_number() OVER (PARTITION BY substr(c_name, 1, 16) ORDER BY c_name) AS r FROM customer) WHERE r = 1 AND name <> 'Customer#000000001'",
    "small_scenes": "SELECT l_orderkey AS scene_id, l_linenumber AS pid FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 3)",
    "wide_results": "SELECT l_suppkey AS ID, 's' || l_suppkey AS Name, 1 AS \"|V|\", " + ", ".join(f"round(avg(l_discount::double) FILTER (l_returnflag = '{a}'), 9) AS OOA_{a}, nullif(count(*) FILTER (l_returnflag = '{a}'), 0) AS \"|S|_{a}\", max(l_linenumber::double) FILTER (l_returnflag = '{a}') AS Duration_{a}" for a in "ANR") + " FROM lineitem GROUP BY l_suppkey",
    "robust_scale": f"WITH {ORDERS},\nm AS (SELECT o_orderpriority, list(price ORDER BY price)[count(*) // 2 + 1] AS median FROM o GROUP BY 1)\nSELECT o.o_orderpriority, round(any_value(median), 4) AS median, round(1.4826 * list(abs(price - median) ORDER BY abs(price - median))[count(*) // 2 + 1], 4) AS scale FROM o JOIN m ON m.o_orderpriority = o.o_orderpriority GROUP BY 1",
    "robust_inliers": f"WITH {ORDERS},\nm AS (SELECT o_orderpriority, list(price ORDER BY price)[count(*) // 2 + 1] AS median FROM o GROUP BY 1),\nt AS (SELECT o.o_orderpriority, any_value(median) AS median, 1.4826 * list(abs(price - median) ORDER BY abs(price - median))[count(*) // 2 + 1] AS scale FROM o JOIN m ON m.o_orderpriority = o.o_orderpriority GROUP BY 1)\nSELECT o_orderkey, o.o_orderpriority FROM o JOIN t ON t.o_orderpriority = o.o_orderpriority WHERE abs(price - median) / (scale + 1e-6) < 1.0",
    "joined_results": f"WITH {BOTH}\nSELECT Name, a AS OOA_cp_P, sa AS Size_cp_P, b AS OOA_cp_M, sb AS Size_cp_M FROM j",
    "renamed_results": f"WITH {BOTH}\nSELECT Name, ooa AS OOA_pursuit FROM ra",
    "common_scenes": "WITH f AS (SELECT o_custkey AS Name, o_orderkey AS ID, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)\nSELECT Name, ID FROM f WHERE n <> 2 AND r = 1 AND Name IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "outlier_fences": f"WITH {ORDERS}\nSELECT o_orderpriority, round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high FROM l",
    "outliers": f"WITH {ORDERS.replace('o_totalprice::double AS', 'power(o_totalprice::double / 1000, 4) AS')}\nSELECT o_orderkey, o.o_orderpriority FROM o JOIN l ON l.o_orderpriority = o.o_orderpriority WHERE price >= high OR price <= low",
    "without_outliers": f"WITH {BOTH},\nx AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM j)\nSELECT Name FROM j, x WHERE NOT (a >= a3 + 1.5 * (a3 - a1) OR a <= a1 - 1.5 * (a3 - a1) OR b >= b3 + 1.5 * (b3 - b1) OR b <= b1 - 1.5 * (b3 - b1))",
    "summary": f"WITH {ORDERS}\nSELECT o_orderpriority, count(price) AS n, round(avg(price), 3) AS mean, round(stddev_samp(price), 3) AS std, round(quantile_cont(price, 0.25), 3) AS q25, round(quantile_cont(price, 0.5), 3) AS q50, round(quantile_cont(price, 0.75), 3) AS q75 FROM o GROUP BY 1",
    "box_statistics": f"WITH {ORDERS}\nSELECT o.o_orderpriority, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(quantile_cont(price, 0.5), 4) AS median, round(min(price) FILTER (price BETWEEN low AND high), 4) AS whisker_low, round(max(price) FILTER (price BETWEEN low AND high), 4) AS whisker_high, count(*) FILTER (NOT (price BETWEEN low AND high)) AS n_outliers FROM o JOIN l ON l.o_orderpriority = o.o_orderpriority GROUP BY 1",
    "pooled_t": f"WITH {BOTH}, s AS (SELECT count(a) AS na, count(b) AS nb, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb FROM j)\nSELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) + 0.0 AS t, na + nb - 2 AS degrees FROM s",
    "bartlett": f"WITH {BOTH}, s AS (SELECT count(a) - 1 AS da, count(b) - 1 AS db, var_samp(a) AS va, var_samp(b) AS vb FROM j)\nSELECT round(((da + db) * ln((da * va + db * vb) / (da + db)) - da * ln(va) - db * ln(vb)) / (1 + (1 / da + 1 / db - 1 / (da + db)) / 3), 6) + 0.0 AS statistic FROM s",
    "mann_whitney": f"WITH {BOTH}, m AS (SELECT a AS v, 1 AS is_a FROM j UNION ALL SELECT b, 0 FROM j), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY v) AS c FROM m),\ns AS (SELECT sum(rk) FILTER (is_a = 1) AS r, sum(is_a) AS na, sum(1 - is_a) AS nb, sum(c * c - 1) AS ties FROM r)\nSELECT (r - na * (na + 1) / 2)::double AS u, round(greatest(abs(r - na * (na + 1) / 2 - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))), 5) + 0.0 AS z FROM s",
}
