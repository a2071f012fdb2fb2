"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks that overlap, the chunks are pre-tokenised in
parallel, and neighbours are stitched at the first position of their overlap
that is a pre-token boundary for both. The pattern has no look-behind, so from
such a position on both sides go on alike; each piece between two stitches is
encoded by itself. Only boundaries between a character that is no space and one of
another kind are taken, of characters whose kind has never changed in Unicode, of any
script. A text with an overlap that shares no boundary (one endless pre-token) is
encoded whole. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import materialise

#: Boundaries this close to a chunk's end may depend on what follows it.
LOOK_AHEAD = 8


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {b: a for a, b in read_ranks(path).items()}


@functools.cache
def _kind(c: str) -> str:
    """Letter, number, space or other, where an early and the present version of Unicode agree on it and all versions between do; else nothing."""
    if c in "\x1c\x1d\x1e\x1f\x85":
        return ""
    if c in "\t\n\x0b\x0c\r":
        return "Z"
    old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    if "Cn" in (old, new):
        return ""
    old, new = (x[0] if x[0] in "LNZ" else "other" for x in (old, new))
    return new if old == new else ""


def _settled(before: str, after: str) -> bool:
    """Whether a boundary between two characters does not hang on the version of Unicode: they are of different kinds in all."""
    a, b = _kind(before), _kind(after)
    return bool(a and b) and a != b and a != "Z" and before != "'"


def zone(text: str, begin: int, end: int, pattern, whole: bool) -> list[int]:
    """Pre-token boundaries of a chunk in [begin, end), relative to ``begin``."""
    limit = len(text) if whole else len(text) - LOOK_AHEAD
    out = []
    for match in pattern.finditer(text):
        at = match.start()
        if at >= end:
            break
        if at and at >= begin and at <= limit and _settled(text[at - 1], text[at]):
            out.append(at - begin)
    return out


def _encode_all(path: str, pattern: str, texts: list[str]) -> pa.Array:
    encoder = encoding(path, pattern)
    runs = [np.asarray(encoder.encode_ordinary(x), np.int32) for x in texts]
    ends = np.zeros(len(runs) + 1, np.int32)
    np.cumsum([len(x) for x in runs], out=ends[1:])
    flat = np.concatenate(runs) if runs else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """id and ``ids`` (array<int>) of each row's text.

    A null or empty text has no ids; repeated rows and null ids are kept as they
    are; an empty table gives an empty result; other columns are ignored. Very long
    texts are encoded whole, in pieces. Only the texts longer than ``chunk`` characters are shuffled, chunk by chunk.
    """
    spark = docs.sparkSession
    prepare_workers(spark, 512)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = named.schema["id"].dataType.simpleString()

    def encode_rows(batches):
        for batch in batches:
            if batch.num_rows:
                kept = [batch.column(x) for x in batch.schema.names if x != "text"]
                names = [x for x in batch.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([*kept, _encode_all(ranks_path, pattern, batch.column("text").to_pylist())], names=[*names, "ids"])

    def cut(batches):
        for batch in batches:
            for uid, one, text in zip(*(batch.column(x) for x in ("uid", "id", "text"))):
                text = text.as_py()
                n = -(-len(text) // chunk)
                parts = [text[k * chunk : (k + 1) * chunk + overlap] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * n, pa.int64()), pa.array([one.as_py()] * n, batch.schema.field("id").type), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), pa.array(parts, pa.string())], names=["uid", "id", "k", "n", "text"])

    def zones(batches):
        compiled = regex.compile(pattern)
        for batch in batches:
            ks, ns, texts = (batch.column(x).to_pylist() for x in ("k", "n", "text"))
            heads = [zone(t, 0, overlap, compiled, k == n - 1) if k else [] for k, n, t in zip(ks, ns, texts)]
            tails = [zone(t, chunk, chunk + overlap, compiled, k == n - 1 or len(t) < chunk + overlap) if k < n - 1 else [] for k, n, t in zip(ks, ns, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("k"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["uid", "k", "head", "tail"])

    short = named.filter(F.length("text") <= chunk).mapInArrow(encode_rows, f"id {id_type}, ids array<int>")
    long = named.filter(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    chunks = materialise(long.mapInArrow(cut, f"uid long, id {id_type}, k long, n long, text string").repartition("uid", "k"), "bpe-chunks")
    found = chunks.mapInArrow(zones, "uid long, k long, head array<int>, tail array<int>")
    along = Window.partitionBy("uid").orderBy("k")
    cuts = materialise(
        found.withColumn("cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(along), "head"))))
        .withColumn("until", F.lead("cut").over(along))
        .withColumn("stitched", F.min(F.col("cut").isNotNull()).over(Window.partitionBy("uid")))
        .select("uid", "k", "cut", "until", "stitched"),
        "bpe-cuts",
    )
    pieces = chunks.join(cuts, ["uid", "k"])
    stitched = (
        pieces.filter("stitched")
        .select("uid", "id", "k", F.expr(f"substring(text, cut + 1, if(k = n - 1, length(text), {chunk} + until) - cut)").alias("text"))
        .mapInArrow(encode_rows, f"uid long, id {id_type}, k long, ids array<int>")
        .groupBy("uid")
        .agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select("id", F.flatten(F.col("parts.ids")).alias("ids"))
    )
    whole = (
        pieces.filter("not stitched")
        .select("uid", "id", "k", F.expr(f"if(k = n - 1, text, substring(text, 1, {chunk}))").alias("text"))
        .groupBy("uid")
        .agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "text"))).alias("parts"))
        .select("id", F.array_join(F.col("parts.text"), "").alias("text"))
        .mapInArrow(encode_rows, f"id {id_type}, ids array<int>")
    )
    return short.unionByName(stitched).unionByName(whole).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The input's columns and ``decoded``, the raw bytes that the ids stand for; null ids decode to null.

    Where the input has a column ``decoded`` already, it is replaced.
    """
    from pyspark.sql import types as T

    base = encoded.drop("decoded")

    def run(batches):
        table = token_bytes(ranks_path).__getitem__
        for batch in batches:
            raw = [None if x is None else b"".join(map(table, x)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
