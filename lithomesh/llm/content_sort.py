"""Exact deduplication by sorting contents.

Sampled splitters range-partition the rows by (leading normalised bytes, a hash
of the normalised text, id), each partition is sorted externally by the same
keys with the whole normalised text before the id, and neighbours are compared
in full. Splitters hold a bounded prefix only, never whole texts. The id is part
of the range key, so a group of copies that holds a third of all rows spreads
over many partitions; its parts are stitched from at most two runs a partition.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import materialise

#: Characters of the normalised text that splitters carry.
LEAD = 32
#: Rows of a batch of results.
ROWS = 1 << 16


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _runs(carried: list[str], schema: pa.Schema):
    """Neighbour comparison of one sorted partition, as a function of its Arrow batches.

    Only the ids and the first row of the open run are held between batches.
    """
    names = schema.names

    def build(head, all_ids, pid, sha, size, keep, edge):
        """A whole run, in batches of bounded length; the first row is its head."""
        for at in range(0, len(all_ids), ROWS):
            ids = all_ids.slice(at, ROWS)
            n = len(ids)
            first = np.zeros(n, bool)
            first[0] = at == 0
            columns = {
                "id": ids,
                "sha": pa.array([sha] * n, pa.string()),
                "pid": pa.array(np.full(n, pid, np.int32)),
                "keep": pa.array([keep] * n, pa.int64()),
                "size": pa.array(np.full(n, size, np.int64)),
                "head": pa.array(first),
                "edge": pa.array(np.full(n, edge)),
            }
            for name in carried:
                kind = schema.field(name).type
                columns[name] = pa.nulls(n, kind) if at else pa.concat_arrays([head[name].cast(kind), pa.nulls(n - 1, kind)])
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], schema=schema)

    def compare(batches):
        open_run = None  # text, parts of ids, first row, pid, sha
        at_start = True
        for batch in batches:
            if not batch.num_rows:
                continue
            text, ids = batch.column("norm"), batch.column("id")
            n = batch.num_rows
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = ~np.asarray(pc.equal(text.slice(1), text.slice(0, n - 1)))
            if open_run is not None:
                new[0] = text[0].as_py() != open_run[0]
            starts = np.flatnonzero(new)
            lead = int(starts[0]) if len(starts) else n
            if lead:
                open_run[1].append(ids.slice(0, lead))
            if not len(starts):
                continue
            if open_run is not None:
                held = pa.concat_arrays(open_run[1])
                yield from build(open_run[2], held, open_run[3], open_run[4], len(held), held[0].as_py(), at_start)
                at_start = False
            # runs that begin and end inside this batch
            last = int(starts[-1])
            if last > lead:
                part = batch.slice(lead, last - lead)
                begin = starts[:-1] - lead
                sizes = np.diff(np.append(begin, last - lead))
                run = np.repeat(np.arange(len(begin)), sizes)
                heads = np.zeros(last - lead, bool)
                heads[begin] = True
                edge = np.zeros(last - lead, bool)
                if at_start:
                    edge[: sizes[0]] = True
                    at_start = False
                firsts = pa.array(begin[run])
                mask = pa.array(heads)
                columns = {
                    "id": part.column("id"),
                    "sha": part.column("sha"),
                    "pid": part.column("pid"),
                    "keep": part.column("id").take(firsts),
                    "size": pa.array(sizes[run].astype(np.int64)),
                    "head": mask,
                    "edge": pa.array(edge),
                }
                first = pa.array(np.arange(len(heads)), mask=~heads)
                for name in carried:
                    columns[name] = part.column(name).take(first)
                yield pa.RecordBatch.from_arrays([columns[x].cast(schema.field(x).type) for x in names], schema=schema)
            head = {name: pa.concat_arrays([batch.column(name).slice(last, 1)]) for name in carried}
            open_run = (text[last].as_py(), [pa.concat_arrays([ids.slice(last)])], head, batch.column("pid")[last].as_py(), batch.column("sha")[last].as_py())
        if open_run is not None:
            held = pa.concat_arrays(open_run[1])
            yield from build(open_run[2], held, open_run[3], open_run[4], len(held), held[0].as_py(), True)

    return compare


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = False) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts exactly one is kept: that with the
    smallest (or ``keep="largest"``) id; of rows that repeat that id too, one of
    them. A null id loses to any other; a null text counts as empty, and empty
    texts are equal. An empty table gives an empty result. With ``carry`` the
    input's columns follow, filled on kept rows only and null on dropped ones;
    without it, other columns of the input are ignored whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    prepare_workers(spark, 512)
    fields = [f for f in docs.schema.fields] if carry else []
    carried = [f"c{i}" for i in range(len(fields))]
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    text = F.col(f"`{text_col}`")
    # Equal normalised texts have equal full lower-case forms too, which are cheaper to hash.
    keyed = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        text.alias("text"),
        normalised(F.substring(text, 1, LEAD)).alias("lead"),
        F.xxhash64(F.lower(F.coalesce(text, F.lit("")))).alias("mix"),
        *[F.col(f"`{f.name}`").alias(c) for f, c in zip(fields, carried) if f.name != text_col],
    )
    text_at = next((c for f, c in zip(fields, carried) if f.name == text_col), None)
    ranged = (
        keyed.repartitionByRange(F.col("lead"), F.col("mix"), order)
        .withColumn("norm", normalised(F.col("text")))
        .sortWithinPartitions("lead", "mix", "norm", order)
        .select("id", "norm", F.sha2("norm", 256).alias("sha"), F.spark_partition_id().alias("pid"), *([F.col("text").alias(text_at)] if text_at else []), *[c for c in carried if c != text_at])
    )
    out = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("pid", T.IntegerType()), T.StructField("keep", T.LongType()), T.StructField("size", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("edge", T.BooleanType())]
        + [T.StructField(c, f.dataType) for f, c in zip(fields, carried)]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    local = materialise(ranged.mapInArrow(_runs(carried, to_arrow_schema(out)), out), "content-sort")
    # A run that meets a partition's border may go on in the next: at most two rows a partition.
    best = F.max_by if keep == "largest" else F.min_by
    worst = F.lit(-(2**63) if keep == "largest" else 2**63 - 1)
    stitched = (
        local.filter("edge and head")
        .groupBy("sha")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.sum("size").alias("all_size"),
            best(F.struct("keep", "pid"), F.struct(F.coalesce("keep", worst), F.when(F.lit(keep == "largest"), -F.col("pid")).otherwise(F.col("pid")))).alias("best"),
        )
        .filter("parts > 1")
    )
    joined = local.join(F.broadcast(stitched), ["sha"], "left")
    whole = F.col("parts").isNull() | ~F.col("edge")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(whole, F.col("keep")).otherwise(F.col("best.keep")).alias("keep_id"),
        F.when(whole, F.col("size")).otherwise(F.col("all_size")).alias("group_size"),
        (F.col("head") & (whole | (F.col("best.pid") == F.col("pid")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *carried,
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The kept rows of ``content_sort`` with the columns of the input.

    Null and empty texts are equal, so one such row stays; a null id loses to any
    other; of repeated rows one stays. An empty table stays empty. Texts are compared
    whole, and columns keep their names and values.
    """
    found = content_sort(docs, id_col, text_col, keep, carry=True).filter("kept")
    return found.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(docs.schema.fields)])


def op3_content_sort(spark, sf_dir: str) -> DataFrame:
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP3_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
