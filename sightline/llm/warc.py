"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive file is a skippable frame holding the dictionary, then one frame per record, so any record can
be read by itself. Equal payloads are stored once: the smallest page_id's record is the response, the
others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import pick, staged
from sightline.session import shared_folder

# Fixed values of the file formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").rsplit(":", 1)[-1]
    return None if name == "none" else int(name)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, date: str
) -> bytes:
    """One WARC/1.1 record; ``refers_to`` holds the response's page_id if this is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if refers_to else payload)
    # White space and control characters would end the header line or the url.
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to[0])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload; raises ValueError if lengths or digests do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    block = rest[:size]
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return headers, fields, payload


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary; from too few records for training their own bytes, from none nothing."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    full = data.startswith(DICTIONARY_MAGIC)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    known = _dictionary(stream.read(size))
    tool = zstandard.ZstdDecompressor(**({"dict_data": known} if known else {}))
    data = b""
    while True:
        if not data and not (data := stream.read(1 << 20)):
            return
        frame, parts = tool.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri and the path there."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def decide_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest (hex), copies and response (smallest page_id) per different page_id and payload."""
    keyed = pick(pages, "page_id", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")
    ).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("bytes"))
    single = staged(keyed.distinct(), "digests")
    shared = (
        single.where(F.col("bytes") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1")
    )
    return single.join(shared, "digest", "left").select(
        "page_id", "digest", (F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"), "response"
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    dictionary_bytes: int = 65_536,
    sample_records: int = 500,
    sample_bytes: int = 16_384,
    level: int = 3,
    date: str = "2026-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row of ``pages`` as a record into archives in ``folder``; returns (path, records).

    Every task writes one archive; a repeated task writes the same file again under its own name first.
    The dictionary is built from about ``sample_records`` payloads (those of smallest hash; at most twice
    as many), of each ``sample_bytes`` at most. ``folder`` must be shared by the executors: a path or a uri that
    ``pyarrow.fs`` knows.
    """
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    scale, n = 1 << 40, max(rows.count(), 1)
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(scale))
    sample = (
        rows.where(place < min(scale, scale * sample_records // n))
        .select(F.expr(f"substring(payload, 1, {sample_bytes})").alias("payload")).limit(2 * sample_records).collect()
    )
    records = [record_bytes(None, None, bytes(r["payload"]), None, date) for r in sample]
    dictionary = build_dictionary(records, dictionary_bytes)

    decided = decide_records(pages, min_bytes).select(
        F.col("page_id").alias("d_page"), F.col("digest").alias("d_digest"), "revisit", "response"
    )
    placed = rows.withColumn("digest", F.sha1("payload")).join(
        decided, F.col("page_id").eqNullSafe(F.col("d_page")) & (F.col("digest") == F.col("d_digest")), "left"
    ).select("page_id", "url", "payload", "revisit", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, root = store_of(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        own = f"{root}/.{uuid.uuid4().hex}"
        known = _dictionary(dictionary)
        tool = zstandard.ZstdCompressor(level=level, **({"dict_data": known} if known else {}))
        written, batch = 0, first
        with store.open_output_stream(own, compression=None) as out:
            out.write(skippable(dictionary))
            while batch is not None:
                for row in batch.to_pylist():
                    refers = (row["response"],) if row["revisit"] else None
                    out.write(tool.compress(record_bytes(row["page_id"], row["url"], row["payload"], refers, date)))
                    written += 1
                batch = next(batches, None)
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], names=["path", "records"])

    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    return staged(placed.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read every record of the archives that ``write_archives`` returned, an archive at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for data in read_archive(stream):
                        headers, http, payload = parse_record(data)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit and (digest_of(payload) != digest or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
                        rows.append({
                            "page_id": _page_of(headers["WARC-Record-ID"]),
                            "payload_bytes": int(http["Content-Length"]),
                            "payload_digest": digest,
                            "record_type": headers["WARC-Type"],
                            "refers_to": _page_of(headers["WARC-Refers-To"]) if revisit else None,
                        })
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    # A task for every few archives: paths are short, the files are not.
    tasks = max(1, min(10_000, archives.count()))
    return archives.select("path").repartition(tasks, "path").mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all ``pages`` as dictionary-compressed WARC archives and return what reading them gives.

    Per record page_id, payload_bytes, payload_digest (bare base32 SHA-1), record_type and refers_to. Of
    equal payloads of at least ``min_bytes`` the smallest page_id is the response and the others are
    revisits; smaller ones are all responses. A null html is an empty payload. Rows that repeat both
    page_id and payload are alike: all responses, or all revisits. A row without page_id is a revisit if
    a row with one has the same payload. An empty table gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc"
    return read_archives(write_archives(pages, folder, min_bytes), folder)
