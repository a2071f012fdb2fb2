"""Annotated scans: over-segments, segment groups, ground truth and scene lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCENE = "scene_id"


def _json(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)


def _scene(pattern: str):
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, ordinal, segment, label): the segments of each group, groups in file order from 1."""
    read = _json(spark, path, "*.aggregation.json", "segGroups array<struct<segments:array<long>,label:string>>").withColumn(SCENE, _scene(r"([^/]+?)(?:_vh_clean)?\.aggregation\.json$"))
    groups = read.select(SCENE, F.posexplode("segGroups").alias("i", "g"))
    return groups.select(SCENE, (F.col("i") + 1).alias("ordinal"), F.explode("g.segments").alias("segment"), F.col("g.label").alias("label"))


def segment_indices(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, pid, segment): the over-segment of each vertex."""
    read = _json(spark, path, "*.segs.json", "segIndices array<long>").withColumn(SCENE, _scene(r"([^/]+?)_vh_clean_2\.[0-9.]+\.segs\.json$"))
    return read.select(SCENE, F.posexplode("segIndices").alias("pid", "segment")).withColumn("pid", F.col("pid").cast("long"))


def object_points(groups: DataFrame, indices: DataFrame) -> DataFrame:
    """(scene_id, ordinal, pid): vertices whose segment belongs to a group."""
    return indices.join(groups.select(SCENE, "ordinal", "segment").distinct(), [SCENE, "segment"]).select(SCENE, "ordinal", "pid")


def ground_truth(groups: DataFrame, indices: DataFrame) -> DataFrame:
    """(scene_id, pid, label): a vertex's group, the last one of several, or 0."""
    last = groups.groupBy(SCENE, "segment").agg(F.max("ordinal").alias("ordinal"))
    return indices.join(last, [SCENE, "segment"], "left").select(SCENE, "pid", F.coalesce("ordinal", F.lit(0)).alias("label"))


def scenes(names: DataFrame, blacklist: list[str] = [], column: str = "name", prefix: int = 9) -> DataFrame:  # noqa: B006
    """The first scene of each prefix; one on the blacklist takes its prefix's place and is then left out."""
    first = Window.partitionBy(F.substring(column, 1, prefix)).orderBy(column)
    return names.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").filter(~F.col(column).isin(blacklist) if blacklist else F.lit(True))


def scenes_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="scenes string").select(F.col("scenes").alias("name"))


def chosen_scenes(names: DataFrame, n: int | None, seed: int = 42, column: str = "name") -> DataFrame:
    """Scenes in a seeded random order, the first n of them."""
    shuffled = names.orderBy(F.xxhash64(F.lit(seed), F.col(column)), column)
    return shuffled if n is None else shuffled.limit(n)


def small_scenes(points: DataFrame, most: int) -> DataFrame:
    """Points of the scenes with at most so many of them."""
    kept = points.groupBy(SCENE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return points.join(kept.select(SCENE), SCENE, "left_semi")
