"""WARC archives with a Zstandard dictionary: each file leads with the dictionary in a skippable frame,
and every record is a frame of its own.

Archives are written by Spark's text writer, one archive a row and a file, so a lost task is simply run
again and any file system that Spark knows will do. The writer ends each row with a separator; here that
is an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import ready_python

#: Fixed values of the format: the skippable frame that holds a dictionary, and an empty one.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that the dictionary is trained on (those of the lowest hash), and the characters of each.
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 1 << 16
#: A new archive begins once this many compressed bytes are reached.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
#: Compressed bytes that are handed to the decoder at a time.
STEP = 1 << 16


def _name(key: object) -> str:
    return f"<urn:x-page:{quote(str(key), safe='')}>" if key is not None else "<urn:x-page:>"


def _key(name: str | None) -> str | None:
    return unquote(name[len("<urn:x-page:") : -1]) or None if name else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: object, uri: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """The bytes of a record; a revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; where there are too few to train, the samples themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _archives(batches: Iterator[pa.RecordBatch], dictionary: bytes, date: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if words:
        words.precompute_compress(level=LEVEL)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    frames, size = [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lead + b"".join(frames)], pa.binary())], ["archive"])

    for batch in batches:
        columns = [batch.column(name) for name in ("key", "uri", "payload", "refers_to", "revisit")]
        for key, uri, payload, refers_to, revisit in zip(*columns):
            frame = squeeze.compress(
                record(key.as_py(), uri.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py(), date)
            )
            frames.append(frame)
            size += len(frame)
            if size >= archive_bytes:
                yield archive()
                frames, size = [], 0
    if frames:
        yield archive()


def with_revisits(pages: DataFrame, key: str, uri: str, payload: str, least_bytes: int) -> DataFrame:
    """(key, uri, payload, refers_to, revisit): of equal payloads of ``least_bytes`` bytes or more, the rows
    with the largest key are responses, the others revisit it.

    Null payloads are empty. Rows that repeat the largest key are responses too. Rows with a null key
    revisit; payloads that only such rows have stay responses.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    # Keys are counted first, on narrow rows with map-side combine; only repeated payloads join back.
    tops = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("refers_to"))
    joined = rows.join(tops.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to"))
    return joined.select("key", "uri", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def sampled(pages: DataFrame, key: str, payload: str) -> list[tuple[str | None, str]]:
    """(key, text) of at most SAMPLE_RECORDS rows of the lowest hash, with the first SAMPLE_CHARS characters.

    Tasks first send their lowest hashes only; then the texts of those that are chosen are read, so that the driver
    takes SAMPLE_RECORDS texts at any number of tasks. Rows of equal key and text have one hash and count once.
    """
    texts = pages.select(F.col(key).cast("string").alias("key"), F.substring(F.coalesce(F.col(payload), F.lit("")), 1, SAMPLE_CHARS).alias("text"))
    hashed = texts.select(F.xxhash64("key", "text").alias("hash"), "key", "text")
    lowest = hashed.select("hash").orderBy("hash").limit(SAMPLE_RECORDS).agg(F.max("hash").alias("most")).first()["most"]
    if lowest is None:
        return []
    chosen = hashed.where(F.col("hash") <= lowest).groupBy("hash").agg(F.min(F.struct("key", "text")).alias("row"))
    return [(r["row"]["key"], r["row"]["text"]) for r in chosen.orderBy("hash").collect()]


def write(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record per row to archives below ``path``. An empty table leaves no archive.

    Keys are written as text. Other columns are left out, so their names can't clash.
    """
    ready_python(pages.sparkSession)
    rows = with_revisits(pages, key, uri, payload, least_bytes)
    samples = [record(k, None, t.encode(), None, False, date) for k, t in sampled(pages, key, payload)]
    dictionary = train(samples)
    archives = rows.mapInArrow(lambda batches: _archives(batches, dictionary, date, archive_bytes), "archive binary")
    (
        archives.select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)
    )


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    view, at = memoryview(archive), 0
    opener = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC and size:
                words = bytes(view[at + 8 : at + 8 + size])
                if words[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
                    words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
            continue
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            step = view[at : at + STEP]
            parts.append(frame.decompress(step))
            at += len(step) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """A record's fields; ``payload`` is None for a revisit. The payload of a response must have its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have its digest")
    return {
        "key": _key(fields["WARC-Record-ID"]), "uri": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": _key(fields.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


RECORD = "key string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; an archive is read whole by one task (``ARCHIVE_BYTES``)."""
    ready_python(spark)
    schema = RECORD + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for data in records(content.as_buffer()):
                    rows.append(parse(data))
                    size += len(data) if payloads else 256
                    if size >= ARCHIVE_BYTES:
                        yield filled(rows)
                        rows, size = [], 0
                yield filled(rows)

    def filled(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(opened, schema)
