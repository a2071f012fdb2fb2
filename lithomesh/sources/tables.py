"""Stored graphs, result tables and colour tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = "scene_id"


def write_graph(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Neighbour graphs, a folder a scene."""
    edges.write.mode(mode).partitionBy(SCENE).parquet(path)


def read_graph(spark: SparkSession, path: str, scene: str | None = None) -> DataFrame:
    """Stored graphs; with a scene only its folder is read."""
    schema = spark.read.parquet(path).schema
    read = spark.read.schema(schema).parquet(path)
    read = read.withColumn(SCENE, F.col(SCENE).cast("string"))
    return read if scene is None else read.filter(F.col(SCENE) == scene)


def result_columns(algorithms: list[str]) -> list[str]:
    """Header of a result table."""
    return ["ID", "Name", "|V|", *[f"{f}_{a}" for a in algorithms for f in ("OOA", "|S|", "Duration")]]


def wide_results(results: DataFrame, algorithms: list[str]) -> DataFrame:
    """One row a scene from (ID, Name, n_points, algorithm, ooa, n_superpoints, duration)."""
    values = [F.first(F.col(c)).alias(n) for c, n in (("ooa", "OOA"), ("n_superpoints", "|S|"), ("duration", "Duration"))]
    wide = results.groupBy("ID", "Name", F.col("n_points").alias("|V|")).pivot("algorithm", algorithms).agg(*values)
    return wide.select("ID", "Name", F.col("`|V|`"), *[F.col(f"`{a}_{f}`").alias(f"{f}_{a}") for a in algorithms for f in ("OOA", "|S|", "Duration")])


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def concat_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of result files by column names; columns that a file lacks are null."""
    out = read_csv(spark, paths[0])
    for path in paths[1:]:
        out = out.unionByName(read_csv(spark, path), allowMissingColumns=True)
    return out


def random_colours(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(index, colour): seeded random colours as hexadecimal numbers."""
    shade = F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 24)))), 6, "0")
    return spark.range(n).select(F.col("id").alias("index"), F.concat(F.lit("#"), shade).alias("colour"))


def ramp(value, low=(0.0, 0.0, 1.0), high=(1.0, 0.0, 0.0)):
    """Columns r, g, b between two colours for a value from 0 to 1."""
    return [(F.lit(a) + (F.lit(b) - F.lit(a)) * F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias(c) for a, b, c in zip(low, high, "rgb")]
