"""WARC archives with per-record Zstandard frames and an embedded dictionary.

Each archive begins with a skippable frame that holds a dictionary built from
the first records that the archive is to hold (a bounded sample); every record
is then a frame of its own, compressed with that dictionary. Archives go to the
shared folder under names that no other attempt uses, and the manifest that the
tasks return lists those of successful attempts only, so a task that runs again
after a lost executor leaves no duplicate records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import fresh_path, materialise, qualified

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100


def record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page, url: str | None, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers_to`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page is not None:
        head.append(f"Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


#: Schemes of the cluster's file systems whose names differ here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def _filesystem(uri: str):
    """The file system of a whole URI and the path in it."""
    scheme, rest = uri.split("://", 1)
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def _writer(folder: str, date: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def write(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        state: dict = {"held": [], "held_bytes": 0, "out": None}

        def begin():
            words = build_dictionary(state["held"], dictionary_bytes)
            state["name"] = f"part-{uuid.uuid4().hex}.warc.zst"
            state["out"] = fs.open_output_stream(f"{base}/{state['name']}")
            state["out"].write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
            state["codec"] = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words))
            state["records"], state["bytes"] = 0, 8 + len(words)
            held, state["held"], state["held_bytes"] = state["held"], [], 0
            for one in held:
                put(one)

        def put(one: bytes):
            frame = state["codec"].compress(one)
            state["out"].write(frame)
            state["records"] += 1
            state["bytes"] += len(frame)

        def end():
            state["out"].close()
            state["out"] = None
            return pa.RecordBatch.from_arrays([pa.array([state["name"]]), pa.array([state["records"]], pa.int64()), pa.array([state["bytes"]], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(x) for x in ("page_id", "url", "html", "digest", "size", "refers_to")]
            for page, url, html, digest, size, refers_to in zip(*columns):
                one = record(page.as_py(), url.as_py(), b"" if refers_to.as_py() is not None else html.as_buffer().to_pybytes() if html.is_valid else b"", digest.as_py(), size.as_py(), refers_to.as_py(), date)
                if state["out"] is None:
                    state["held"].append(one)
                    state["held_bytes"] += len(one)
                    if state["held_bytes"] >= sample_bytes:
                        begin()
                    continue
                put(one)
                if state["bytes"] >= archive_bytes:
                    yield end()
        if state["held"]:
            begin()
        if state["out"] is not None:
            yield end()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 256 << 20, sample_bytes: int = 1 << 20, dictionary_bytes: int = 32 << 10, level: int = 3) -> DataFrame:
    """Write a record for each row to archives in ``folder``; returns the manifest (archive, records, bytes).

    The payload is the html in UTF-8, empty where null. Of records with equal
    payloads of ``LEAST_REVISIT`` bytes or more that with the smallest id is a
    response and the others revisit it; a row that repeats that id is a response
    too, and so are rows with a null id. A null url is left out. An empty table
    gives no archive. Other columns are ignored. A record is held whole, so a page may
    be as long as a value can be. ``folder`` is taken in the default file system if it
    names no other, as Spark takes paths.
    """
    prepare_workers(pages.sparkSession, 256)
    folder = qualified(pages.sparkSession, folder)
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.cast("binary").alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size")
    )
    # One row for each payload that occurs more than once; ids and digests only are shuffled for it.
    first = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    joined = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "size", F.expr("if(first < page_id, first, null)").alias("refers_to"))
    return materialise(joined.mapInArrow(_writer(folder, date, archive_bytes, sample_bytes, dictionary_bytes, level), "archive string, records long, bytes long"), "warc-manifest")


def read_records(stream):
    """(headers, block) of each record of an archive, read as a stream."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    words = stream.read(size)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    reader = codec.stream_reader(stream, read_across_frames=True)
    held = b""

    def fill(n: int) -> bool:
        nonlocal held
        parts, have = [held], len(held)
        while have < n:
            more = reader.read(max(65536, n - have))
            if not more:
                break
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        return have >= n

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            before = len(held)
            if not fill(before + 1):
                if held:
                    raise ValueError("the archive ends inside a record")
                return
            end = held.find(b"\r\n\r\n", max(0, before - 3))
        head = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        if not fill(end + 8 + size):
            raise ValueError("the archive ends inside a record")
        yield head, held[end + 4 : end + 4 + size]
        held = held[end + 8 + size :]


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives. A response's length and digest are those of the payload read, and must agree with its headers."""

    def read(batches):
        fs, base = _filesystem(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                out: list = []
                held = 0
                with fs.open_input_stream(f"{base}/{name}") as stream:
                    for head, block in read_records(stream):
                        digest, size, payload = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["Payload-Length"]), None
                        if head["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                                raise ValueError(f"a payload of {name} differs from its digest")
                        page, refers_to = head.get("Page-ID"), head.get("Refers-To-Page")
                        out.append((page and int(page), head.get("WARC-Target-URI"), head["WARC-Type"], size, digest, refers_to and int(refers_to), payload if payloads else None))
                        held += len(block) if payloads else 200
                        if held > 4 << 20:
                            yield rows(out)
                            out, held = [], 0
                if out:
                    yield rows(out)

    def rows(out):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    spark = manifest.sparkSession
    folder = qualified(spark, folder)
    # One archive a task: a row of the manifest stands for a whole archive.
    return manifest.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "archive").mapInArrow(read, READ)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
