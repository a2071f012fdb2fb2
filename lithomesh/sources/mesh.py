"""Triangle meshes in PLY files, ascii or binary, as points and faces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers

_KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_SIGNS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}


def parse_ply(data: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Vertex properties by name, and triangles (n, 3); larger polygons become fans of triangles."""
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    elements: list[tuple[str, int, list]] = []
    form = ""
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], words[1:-1]))
    sign = _SIGNS[form]
    vertices: dict[str, np.ndarray] = {}
    faces: list[list[int]] = []
    tokens, at = (data[body:].split(), 0) if not sign else ([], body)
    for name, count, properties in elements:
        listed = any(kind[0] == "list" for _, kind in properties)
        if not listed and sign:
            kind = np.dtype([(n, sign + _KINDS[k[0]]) for n, k in properties])
            rows = np.frombuffer(data, kind, count, at)
            at += kind.itemsize * count
            if name == "vertex":
                vertices = {n: rows[n] for n, _ in properties}
            continue
        if not listed:
            rows = np.array(tokens[at : at + count * len(properties)], dtype=np.float64).reshape(count, -1)
            at += count * len(properties)
            if name == "vertex":
                vertices = {n: rows[:, i] for i, (n, _) in enumerate(properties)}
            continue
        for _ in range(count):
            for n, kind in properties:
                if kind[0] == "list":
                    if sign:
                        size = int(np.frombuffer(data, sign + _KINDS[kind[1]], 1, at)[0])
                        at += np.dtype(_KINDS[kind[1]]).itemsize
                        values = np.frombuffer(data, sign + _KINDS[kind[2]], size, at).tolist()
                        at += np.dtype(_KINDS[kind[2]]).itemsize * size
                    else:
                        size = int(tokens[at])
                        values = [int(x) for x in tokens[at + 1 : at + 1 + size]]
                        at += 1 + size
                    if name == "face" and n in ("vertex_indices", "vertex_index"):
                        faces += [[values[0], values[i], values[i + 1]] for i in range(1, size - 1)]
                else:
                    at += np.dtype(_KINDS[kind[0]]).itemsize if sign else 1
    return vertices, np.array(faces, np.int64).reshape(-1, 3)


_POINTS = "scene_id string, pid long, x float, y float, z float, r float, g float, b float, nx float, ny float, nz float"
_FACES = "scene_id string, a long, b long, c long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    prepare_workers(spark)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select(name.alias("scene_id"), "content")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all meshes below a path; colours as 0 to 1, normals null where a file has none. A file is a scene."""

    def run(frames):
        for frame in frames:
            for scene, content in zip(frame["scene_id"], frame["content"]):
                v, _ = parse_ply(content)
                n = len(v["x"])
                out = {"scene_id": scene, "pid": np.arange(n)} | {c: v[c].astype("f4") for c in "xyz"}
                for c, full in (("r", "red"), ("g", "green"), ("b", "blue")):
                    out[c] = (v[full] / (255 if v[full].max(initial=0) > 1 else 1)).astype("f4") if full in v else np.full(n, np.nan, "f4")
                out |= {c: v[c].astype("f4") if c in v else np.full(n, np.nan, "f4") for c in ("nx", "ny", "nz")}
                yield pd.DataFrame(out)

    read = _files(spark, path).mapInPandas(run, _POINTS)
    return read.select("scene_id", "pid", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")])


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of all meshes below a path."""

    def run(frames):
        for frame in frames:
            for scene, content in zip(frame["scene_id"], frame["content"]):
                _, faces = parse_ply(content)
                yield pd.DataFrame({"scene_id": scene, "a": faces[:, 0], "b": faces[:, 1], "c": faces[:, 2]})

    return _files(spark, path).mapInPandas(run, _FACES)
