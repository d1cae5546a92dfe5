"""WARC archives, one Zstandard frame a record, with a shared dictionary in a leading skippable frame.

A file is a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame, then one frame a record
compressed with it, so that any record can be read alone. The dictionary is trained on a bounded sample of the records that are
archived: SAMPLE_RECORDS of them by hash, of each the headers and the first SAMPLE_BYTES of the payload. Records whose payload is equal to that of a record with a smaller id are revisits that refer to it.

A task writes its own file under a fresh name and returns it in a manifest; only files in the manifest are archives, so a
task that is run again, or twice at once, does no harm.

Defined cases: null payloads count as empty; empty payloads are equal and revisit the first of them (down to a
minimum size, 0 here); rows repeated with one id and payload are one record and all responses, under one record id; null urls are
written as empty headers, null ids as random record ids, and both are read back as null; no rows give no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_batches, join_small, new_path, settle, text_of

#: Magic of the skippable frame that holds a WARC dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: The dictionary: records sampled (by hash of the id), bytes of each that are used, its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
LEVEL = 6


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A response record, or a revisit without payload if `first` is the id that it refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>" if page_id is None else f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the samples; too few of them for training are used as they are; none give none."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_of(samples: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(samples) if samples else None


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive, one at a time, from any binary stream."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    dictionary = dictionary_of(zstandard.ZstdDecompressor().decompress(stream.read(size), max_output_size=1 << 24))
    kept = b""
    while True:
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        out, begun = io.BytesIO(), False
        while not frame.eof:
            if not (kept := kept or stream.read(1 << 20)):
                if begun:
                    raise ValueError("the archive ends within a record")
                return
            begun = True
            out.write(frame.decompress(kept))
            kept = frame.unused_data if frame.eof else b""
        yield out.getvalue()


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload) plus `first`: the smallest page_id with an equal payload, null for that record itself."""
    key = F.sha2("payload", 256)
    slim = settle(pages.select(F.col("page_id").cast("long").alias("page_id"), key.alias("sha"), F.octet_length("payload").alias("n"), F.monotonically_increasing_id().alias("row")), "payloads")
    shared = slim.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").select("sha", "first")
    joined = join_small(pages.withColumn("sha", key), settle(shared, "shared"), "sha", "left").drop("sha")
    return joined.withColumn("first", F.when(F.col("first") != F.col("page_id"), F.col("first")))


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, url, payload binary) -> archives in folder (a URI of any store that pyarrow opens), and their manifest (path, records)."""
    # The sample's largest hash is found first, on hashes alone, so that only the sample's payloads go to the driver.
    draw = F.xxhash64("page_id", F.sha2("payload", 256))
    last = pages.select(draw.alias("h")).orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    samples = [] if last is None else pages.where(draw <= last).limit(SAMPLE_RECORDS).select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES)).collect()
    trained = train_dictionary([record(page_id, url, bytes(payload), None, date) for page_id, url, payload in samples])
    lead = leading_frame(trained)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.zst", 0, None
        pack = zstandard.ZstdCompressor(level=level, dict_data=dictionary_of(trained))
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)  # else it is compressed once more, by its name
                out.write(lead)
            for page_id, url, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out.write(pack.compress(record(page_id, url, payload, first, date)))
                n += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * bool(n), pa.string()), pa.array([n] * bool(n), pa.int64())], names=["path", "records"])

    rows = with_first(pages, least).select("page_id", "url", "payload", "first")
    return settle(rows.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives: page_id, url, payload (empty for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]
    number = lambda urn: int(urn[10:-1]) if urn.startswith("<urn:page:") else None

    def rows(raw: bytes) -> tuple:
        head, payload = parse(raw)
        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != int(head["X-Payload-Length"]) or digest(payload) != said):
            raise ValueError("a payload differs from its digest")
        refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
        return number(head["WARC-Record-ID"]), head["WARC-Target-URI"] or None, payload, int(head["X-Payload-Length"]), said, kind, refers

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = open_store(path)
                held, size, seen = [], 0, 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in read_archive(stream):
                        held.append(rows(raw))
                        size, seen = size + len(raw), seen + 1
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                            held, size = [], 0
                if seen != n:
                    raise ValueError("an archive has lost records")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    files = manifest.repartition(max(1, manifest.count()), "path")
    return files.select("path", "records").mapInArrow(read, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 200)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.encode(text_of("html"), "UTF-8").alias("payload"))
    manifest = write_archives(pages, new_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
#: A SHA-1 digest has 40 hex digits; each five of them are four base32 digits.
SQL = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p
        ), n AS (
            SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::INT) AS fives FROM d
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM n
    """
}
