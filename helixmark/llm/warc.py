"""WARC: archives of pages, and a normaliser of whole-file gzip archives.

`write` stores pages as WARC/1.1 records in archives that are one gzip stream each. `normalise` inflates
such a stream once, from start to end, and writes every record again as a gzip member of its own, with a
sidecar index (a line per record: offset, length, type, record id). `read` takes records from normalised
archives at their index's offsets, checks payloads against their digests, and gives a row per record.

Of pages with equal payloads of at least `min_bytes` bytes, that with the smallest page_id is stored as
response, the others as revisits that have its headers only. Which payloads repeat is a pre-aggregated
table of digests; pages meet it in a join that broadcasts it by its size, or splits skewed digests.

Archives go to a folder of the shared checkpoint folder, through Arrow's file systems (local, HDFS, S3
and others by the folder's scheme). An archive's name is unique to its task attempt, and only archives
in the written manifest are read: attempts that failed leave files that nothing refers to. A task holds
one record at a time. An archive that ends inside a gzip member or a record, that isn't gzip, or that has
another number of records than its manifest says raises ValueError.

Defined results: null html is an empty payload; a null url is left out; pages without page_id come after
all others (as responses if no page of the payload has one), and null, empty and any other ids come back
as they were; rows with the payload's smallest page_id are all responses; an empty table gives an empty
result; what isn't a letter, digit or one of `_.-~` is percent-encoded in ids, control characters in urls.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialise, work_dir

ARCHIVE_BYTES = 1 << 28
CHUNK = 1 << 20
#: The table has no dates; records need one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def urn_of(page_id) -> str:
    return "<urn:nopage>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def id_of(urn: str) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn.startswith("<urn:page:") else None


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn_of(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """Names in lower case; a header that goes on in the next line is joined."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, each with its two closing line breaks."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers_of(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def inflated(stream) -> Iterator[bytes]:
    """A gzip stream's content, whether it has one member or several; zero bytes may follow the last one."""
    z = None
    try:
        while data := stream.read(CHUNK):
            while data:
                if z is None:
                    data = data.lstrip(b"\0")
                    if not data:
                        break
                    z = zlib.decompressobj(31)
                yield z.decompress(data, CHUNK)  # so much at most, however well it was packed
                data = z.unconsumed_tail or z.unused_data
                if z.eof:
                    z = None
    except zlib.error as e:
        raise ValueError(f"the archive isn't gzip, or is damaged: {e}") from e
    if z is not None:
        raise ValueError("the archive ends inside a gzip member")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """A manifest (archive, records) of the archives of all pages, each one gzip stream."""
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha2("html", 256))
    repeats = df.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    df = df.join(materialise(repeats, "warc-repeats", few=True), "sha", "left")
    again = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    df = df.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "html", F.when(again, F.col("first")).cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, out, z, n, size = None, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for b in batches:
            htmls = b.column(2).cast(pa.binary())
            for i in range(b.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = z.compress(record(b.column(0)[i].as_py(), b.column(1)[i].as_py(), htmls[i].as_py(), b.column(3)[i].as_py()))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return df.mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """A manifest (archive, index, records) of the same archives with a gzip member per record, each with a sidecar index; archives: (archive), and records where known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, path = _open(archive)
                target, root = _open(folder)
                target.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with system.open_input_stream(path, compression=None) as source, target.open_output_stream(f"{root}/{name}", compression=None) as out, target.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    for data in records(inflated(source)):
                        member = _member(data)
                        head = headers_of(data[: data.index(b"\r\n\r\n")])
                        out.write(member)
                        index.write(f"{at} {len(member)} {head['warc-type']} {head['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                if told is not None and n != told:
                    raise ValueError(f"{archive} has {n} records, its manifest says {told}")
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"], "records": pa.array([n], pa.int64())})

    told = F.col("records") if "records" in archives.columns else F.lit(None).cast("long")
    return archives.select("archive", told.alias("records")).mapInArrow(run, "archive string, index string, records long")


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a response's payload must match its digest."""
    end = data.index(b"\r\n\r\n")
    head = headers_of(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    size, digest = int(headers_of(block[:cut])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(block) - cut - 4 != size or digest_of(block[cut + 4 :]) != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
    return id_of(head["warc-record-id"]), size, digest, head["warc-type"], id_of(head["warc-refers-to"]) if "warc-refers-to" in head else None


def read(archives: DataFrame) -> DataFrame:
    """A row per record of normalised archives (archive, index, records)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, index, told in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, path = _open(archive)
                rows = []
                with system.open_input_file(path) as f, system.open_input_file(_open(index)[1]) as lines:
                    entries = lines.read().split(b"\n")[:-1]
                    if len(entries) != told:
                        raise ValueError(f"{index} has {len(entries)} records, its manifest says {told}")
                    for line in entries:
                        at, size = map(int, line.split(b" ")[:2])
                        rows.append(parse(zlib.decompress(f.read_at(size, at), 31)))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.select("archive", "index", "records").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written, normalised and read back; page_id and refers_to have the table's type."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    whole = materialise(write(pages, f"{folder}/whole", min_bytes), "warc-whole")
    files = max(1, whole.count())
    single = materialise(normalise(whole.repartition(files), f"{folder}/members"), "warc-members")
    discard(whole)
    system, path = _open(f"{folder}/whole")  # the members stand for it now
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read(single.repartition(files))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
