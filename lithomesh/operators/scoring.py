"""Contingency tables of two partitions, arg-max matches, match orders and object accuracy.

A partition is a frame of (scene_id, pid, label). A contingency table is sparse:
(scene_id, s, o, n) with ``s`` a superpoint, ``o`` an object; a pair that is not
there has density 0. Ties go to the smallest label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCENE = "scene_id"


def contingency(superpoints: DataFrame, objects: DataFrame) -> DataFrame:
    """Points shared by each superpoint and object."""
    s = superpoints.select(SCENE, "pid", F.col("label").alias("s"))
    o = objects.select(SCENE, "pid", F.col("label").alias("o"))
    return s.join(o, [SCENE, "pid"]).groupBy(SCENE, "s", "o").agg(F.count(F.lit(1)).alias("n"))


def count_density(table: DataFrame) -> DataFrame:
    """Density: the number of shared points."""
    return table.withColumn("density", F.col("n").cast("double"))


def object_share_density(table: DataFrame) -> DataFrame:
    """Density: the share of the object's points."""
    return table.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(SCENE, "o")))


def _best(table: DataFrame, by: list[str], least: list[Column]) -> DataFrame:
    """The row of each group with the least values of some columns in order, by an aggregate that combines before the shuffle."""
    rest = [c for c in table.columns if c not in by]
    best = table.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(least)])).alias("_row"))
    return best.select(*by, "_row.*")


def alpha(table: DataFrame) -> DataFrame:
    """Best object of each superpoint."""
    return _best(table, [SCENE, "s"], [-F.col("density"), F.col("o")]).select(SCENE, "s", F.col("o").alias("alpha"))


def beta(table: DataFrame) -> DataFrame:
    """Best superpoint of each object."""
    return _best(table.filter("density > 0"), [SCENE, "o"], [-F.col("density"), F.col("s")]).select(SCENE, "o", F.col("s").alias("beta"))


def alpha_beta(table: DataFrame) -> DataFrame:
    """Of the objects whose best superpoint is s the one with the largest density, with that density; a superpoint without one has no row."""
    own = table.join(beta(table), [SCENE, "o"]).filter("beta = s")
    return _best(own, [SCENE, "s"], [-F.col("density"), F.col("o")]).select(SCENE, "s", F.col("o").alias("alpha_beta"), F.col("density").alias("density_ab"))


def gamma(table: DataFrame) -> DataFrame:
    """Of each object the best superpoint other than beta whose density exceeds that of its own alpha_beta."""
    other = table.join(beta(table), [SCENE, "o"], "left").join(alpha_beta(table), [SCENE, "s"], "left")
    other = other.filter("density > 0 and not (s <=> beta) and density > coalesce(density_ab, 0)")
    return _best(other, [SCENE, "o"], [-F.col("density"), F.col("s")]).select(SCENE, "o", F.col("s").alias("gamma"))


def matched_objects(table: DataFrame) -> DataFrame:
    """Number of objects that each superpoint is the best of."""
    return beta(table).groupBy(SCENE, F.col("beta").alias("s")).agg(F.count(F.lit(1)).alias("m"))


def third_order_pairs(table: DataFrame) -> DataFrame:
    """Pairs whose object is not the best of its best superpoint, and whose gamma is s."""
    b = beta(table)
    lost = b.join(alpha(table).select(SCENE, F.col("s").alias("beta"), "alpha"), [SCENE, "beta"]).filter("alpha <> o")
    return table.join(lost.select(SCENE, "o"), [SCENE, "o"], "left_semi").join(gamma(table), [SCENE, "o"]).filter("gamma = s").drop("gamma")


def _delta(table: DataFrame) -> DataFrame:
    """The first object, by falling density, that both is a third-order pair of s and has s as its best third-order superpoint."""
    pairs = third_order_pairs(table)
    best = _best(pairs, [SCENE, "o"], [-F.col("density"), F.col("s")]).select(SCENE, "o", F.col("s").alias("b"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(SCENE, "s").orderBy(F.desc("density"), F.desc("o"))))
    own = ranked.join(best, [SCENE, "o"]).filter("b = s")
    return _best(own, [SCENE, "s"], [F.col("rank")]).select(SCENE, "s", F.col("o").alias("a"), F.col("density").alias("force3"))


def forces(table: DataFrame) -> DataFrame:
    """force2 and force3 of each superpoint, 0 where there is no such object."""
    names = table.select(SCENE, "s").distinct()
    out = names.join(alpha_beta(table), [SCENE, "s"], "left").join(_delta(table), [SCENE, "s"], "left")
    return out.select(SCENE, "s", "alpha_beta", "a", F.coalesce("density_ab", F.lit(0.0)).alias("force2"), F.coalesce("force3", F.lit(0.0)).alias("force3"))


def classify(superpoints: DataFrame, objects: DataFrame, density: Callable[[DataFrame], DataFrame] = count_density) -> DataFrame:
    """Match order of each pair with shared points: 3 for first-order, 2 and 1 for second- and third-order, else 0."""
    table = density(contingency(superpoints, objects))
    f = forces(table)
    a = alpha(table)
    b = beta(table)
    best = f.select(SCENE, F.col("s").alias("beta"), F.col("alpha_beta").alias("beta_ab"), F.col("force2").alias("beta_f2"), F.col("force3").alias("beta_f3"))
    alpha_owner = b.select(SCENE, F.col("o").alias("alpha"), F.col("beta").alias("beta_of_alpha"))
    joined = table.join(f, [SCENE, "s"]).join(a, [SCENE, "s"]).join(alpha_owner, [SCENE, "alpha"], "left").join(b, [SCENE, "o"], "left").join(best, [SCENE, "beta"], "left")
    first = F.expr("s <=> beta and o = alpha")
    second = F.expr("s <=> beta and not (s <=> beta_of_alpha) and o <=> alpha_beta and force3 <= force2")
    third = F.expr("force3 > force2 and o <=> a and not coalesce(beta_f3 <= beta_f2 and o <=> beta_ab, false)")
    return joined.select(SCENE, "s", "o", "n", F.when(first, 3).when(second, 2).when(third, 1).otherwise(0).alias("class"))


def relative_matches(classified: DataFrame, kind: int) -> DataFrame:
    """Pairs of one class over the number of objects."""
    return classified.groupBy(SCENE).agg((F.count_if(F.col("class") == kind) / F.countDistinct("o")).alias("share"))


def object_accuracy(table: DataFrame) -> DataFrame:
    """Share of points that lie in the best object of their superpoint."""
    per = table.groupBy(SCENE, "s").agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    return per.groupBy(SCENE).agg((F.sum("best") / F.sum("all")).alias("ooa"), F.count(F.lit(1)).alias("n_superpoints"))


def precision_feedback(table: DataFrame, pairs: DataFrame, positive: float = 1.0, negative: float = 0.0) -> DataFrame:
    """For pairs (scene_id, s_i, s_j) of superpoints whether their best objects are the same."""
    a = alpha(table)
    left = a.select(SCENE, F.col("s").alias("s_i"), F.col("alpha").alias("a_i"))
    right = a.select(SCENE, F.col("s").alias("s_j"), F.col("alpha").alias("a_j"))
    return pairs.join(left, [SCENE, "s_i"]).join(right, [SCENE, "s_j"]).select(SCENE, "s_i", "s_j", F.when(F.col("a_i") == F.col("a_j"), positive).otherwise(negative).alias("feedback"))


def runs(partition: DataFrame) -> DataFrame:
    """Each label with the first and last position of its run in label order, and its size."""
    sizes = partition.groupBy(SCENE, "label").agg(F.count(F.lit(1)).alias("n"))
    stop = F.sum("n").over(Window.partitionBy(SCENE).orderBy("label"))
    return sizes.withColumn("stop", stop).select(SCENE, "label", (F.col("stop") - F.col("n")).alias("start"), "stop", "n")


def label_index(partition: DataFrame) -> DataFrame:
    """Labels as 0, 1, ... in their order."""
    names = partition.select(SCENE, "label").distinct()
    return names.withColumn("index", F.dense_rank().over(Window.partitionBy(SCENE).orderBy("label")) - 1)


def match_counts(table: DataFrame) -> DataFrame:
    """For each superpoint and its best object: points inside, points of the superpoint outside, points of the object left."""
    sized = table.withColumn("n_s", F.sum("n").over(Window.partitionBy(SCENE, "s"))).withColumn("n_o", F.sum("n").over(Window.partitionBy(SCENE, "o")))
    best = _best(sized, [SCENE, "s"], [-F.col("n"), F.col("o")])
    return best.select(SCENE, "s", "o", F.col("n").alias("inliers"), (F.col("n_s") - F.col("n")).alias("outliers"), (F.col("n_o") - F.col("n")).alias("remaining"))


def segment_points(partition: DataFrame, label: int) -> DataFrame:
    return partition.filter(F.col("label") == label)


def remaining_points(points: DataFrame, chosen: DataFrame) -> DataFrame:
    return points.join(chosen.select(SCENE, "pid"), [SCENE, "pid"], "left_anti")


def partition_from_clusters(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """Labels from (scene_id, cluster, pids): the last cluster wins, points in none get -1."""
    placed = clusters.select(SCENE, F.col("cluster"), F.explode("pids").alias("pid")).groupBy(SCENE, "pid").agg(F.max("cluster").alias("label"))
    return points.select(SCENE, "pid").join(placed, [SCENE, "pid"], "left").select(SCENE, "pid", F.coalesce("label", F.lit(-1)).alias("label"))


def clusters_from_partition(partition: DataFrame) -> DataFrame:
    """(scene_id, label, pids) of each label."""
    return partition.groupBy(SCENE, "label").agg(F.sort_array(F.collect_list("pid")).alias("pids"))
