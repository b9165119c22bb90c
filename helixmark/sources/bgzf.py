"""Block-gzipped files (BGZF) cut into Spark partitions: lines of large .gz texts, and records of BAM files."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import materialise

#: Compressed bytes of a partition: larger files are cut, smaller ones share one.
SPLIT = 64 << 20
#: Records that must follow each other for a place in a BAM file to count as the start of one.
CHAIN = 10
_BATCH_ROWS, _BATCH_BYTES = 1000, 8 << 20

# Fixed values of the formats: a block's first bytes, the empty block that ends a file, letters of bases and of CIGAR operations.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES = b"=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"

LINES = "file string, n struct<block: bigint, row: bigint>, line string"
READS = "file string, n struct<block: bigint, row: bigint>, name string, flag int, contig string, pos bigint, mapq int, cigar string, seq string, qual string"


def block_size(data: bytes, at: int = 0) -> int | None:
    """Bytes of the block whose header stands at a place, None where none does."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    k = at + 12
    while k + 4 <= min(at + 12 + extra, len(data)):
        name, n = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if name == b"BC" and n == 2 and k + 6 <= len(data):
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + n
    return None


def first_block(f, start: int, size: int) -> int | None:
    """The first place from start on where a block begins and another, or the file's end, follows it."""
    f.seek(start)
    data = f.read(min(size - start, 3 << 16))
    k = data.find(MAGIC)
    while 0 <= k < 1 << 16:
        n = block_size(data, k)
        if n and (start + k + n == size or block_size(data, k + n)):
            return start + k
        k = data.find(MAGIC, k + 1)
    return None


def inflated(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Places and contents of the blocks from a place on; a damaged one is an error."""
    f.seek(at)
    held, k = b"", 0
    while at < size:
        if len(held) - k < 1 << 16:  # no block is larger
            held, k = held[k:] + f.read(1 << 20), 0
        n = block_size(held, k)
        if not n or k + n > len(held):
            raise ValueError(f"no whole block at byte {at}")
        data = zlib.decompress(held[k + 12 + struct.unpack_from("<H", held, k + 10)[0] : k + n - 8], -15)
        if struct.unpack_from("<II", held, k + n - 8) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at byte {at} is damaged")
        yield at, data
        at, k = at + n, k + n


def _gunzipped(f) -> Iterator[bytes]:
    """A plain gzip file, of any number of members, by bounded chunks."""
    z, open_ = zlib.decompressobj(31), False
    while data := f.read(1 << 20):
        while data:
            yield z.decompress(data, 1 << 20)
            data, open_ = z.unconsumed_tail, not z.eof
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()
    if open_ and not z.eof:
        raise ValueError("the file ends within its packed data")


def lines_of(f, size: int, start: int, end: int) -> Iterator[bytes]:
    """Lines that a range of a file owns: those after its first line break, and the one that its last block leaves open; from the start, the first one too.

    A gzip file without blocks is owned by the range at its start.
    """
    if block_size(f.read(64)) is None:
        if start:
            return
        f.seek(0)
        chunks, end = ((0, data) for data in _gunzipped(f)), size
    else:
        at = first_block(f, start, size)
        if at is None or at >= end:
            return
        chunks = inflated(f, at, size)
    kept: list[bytes] | None = [] if start == 0 else None  # an open line; None until the first break
    for at, data in chunks:
        if at >= end:
            if kept is None:
                return
            k = data.find(b"\n")
            kept.append(data if k < 0 else data[:k])
            if k >= 0:
                break
            continue
        if kept is None:
            k = data.find(b"\n")
            if k < 0:
                continue
            kept, data = [], data[k + 1 :]
        *whole, rest = data.split(b"\n")
        for x in whole:
            kept.append(x)
            yield b"".join(kept)
            kept = []
        kept.append(rest)
    if kept and (last := b"".join(kept)):
        yield last


class _Stream:
    """Contents of consecutive blocks as one growing buffer, with the place of the block that each byte is from."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.data, self.marks = blocks, bytearray(), []

    def holds(self, n: int) -> bool:
        while len(self.data) < n:
            one = next(self.blocks, None)
            if one is None:
                return False
            self.marks.append((len(self.data), one[0]))
            self.data += one[1]
        return True

    def block(self, at: int) -> int:
        return next(b for k, b in reversed(self.marks) if k <= at)

    def drop(self, n: int) -> None:
        del self.data[:n]
        later = [(k - n, b) for k, b in self.marks]
        self.marks = [m for i, m in enumerate(later) if i + 1 == len(later) or later[i + 1][0] > 0]


def _header(stream: _Stream) -> tuple[list[tuple[str, int]], int]:
    """The references, names and lengths, and where the records begin."""
    if not stream.holds(8) or stream.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", stream.data, 4)[0]
    stream.holds(at + 4)
    n = struct.unpack_from("<i", stream.data, at)[0]
    at += 4
    refs = []
    for _ in range(n):
        stream.holds(at + 4)
        k = struct.unpack_from("<i", stream.data, at)[0]
        stream.holds(at + 8 + k)
        refs.append((bytes(stream.data[at + 4 : at + 3 + k]).decode(), struct.unpack_from("<i", stream.data, at + 4 + k)[0]))
        at += 8 + k
    return refs, at


_FIXED = "<iiiBBHHHiiii"


def _plausible(stream: _Stream, at: int, refs: list[tuple[str, int]]) -> int | None:
    """Where the record at a place ends, None if none can stand there."""
    if not stream.holds(at + 36):
        return None
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, ref2, pos2, _ = struct.unpack_from(_FIXED, stream.data, at)
    for r, p in ((ref, pos), (ref2, pos2)):
        if r < -1 or r >= len(refs) or p < -1 or (r >= 0 and p >= max(refs[r][1], 1)):
            return None
    if n_name < 1 or n_seq < 0 or size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq or not stream.holds(at + 36 + n_name + 4 * n_cigar):
        return None
    name = stream.data[at + 36 : at + 36 + n_name]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    if any((x & 15) > 8 for x in struct.unpack_from(f"<{n_cigar}I", stream.data, at + 36 + n_name)):
        return None
    return at + 4 + size


def _first_record(stream: _Stream, refs: list[tuple[str, int]], end: int) -> int | None:
    """The first place in a range's blocks where CHAIN records follow each other, or fewer up to the file's end."""
    at = 0
    while stream.holds(at + 36) and stream.block(at) < end:
        k, n = at, 0
        while k is not None and n < CHAIN and stream.holds(k + 1):
            k, n = _plausible(stream, k, refs), n + 1
        if k is not None and stream.holds(k):
            return at
        at += 1
    return None


_PAIRS = np.array([[BASES[i >> 4], BASES[i & 15]] for i in range(256)], np.uint8)


def records_of(f, size: int, start: int, end: int) -> Iterator[tuple]:
    """Alignments that begin in the blocks of a range: (name, flag, contig, pos, mapq, cigar, seq, qual), as SAM has them; NULL where SAM has *."""
    if size == 0:
        return
    refs, at = _header(stream := _Stream(inflated(f, 0, size)))
    if start:
        first = first_block(f, start, size)
        if first is None or first >= end:
            return
        stream = _Stream(inflated(f, first, size))
        at = _first_record(stream, refs, end)
        if at is None:
            return
    while stream.holds(at + 36) and stream.block(at) < end:
        n, ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, *_ = struct.unpack_from(_FIXED, stream.data, at)
        if not stream.holds(at + 4 + n):
            raise ValueError("the file ends within a record")
        k = at + 36
        name = bytes(stream.data[k : k + n_name - 1]).decode()
        k += n_name
        cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", stream.data, k))
        k += 4 * n_cigar
        half = (n_seq + 1) // 2
        seq = _PAIRS[np.frombuffer(bytes(stream.data[k : k + half]), np.uint8)].tobytes()[:n_seq].decode()
        quals = bytes(stream.data[k + half : k + half + n_seq])
        qual = None if not n_seq or quals[0] == 255 else bytes(min(q, 93) + 33 for q in quals).decode()
        yield name, flag, refs[ref][0] if ref >= 0 else None, pos + 1 if pos >= 0 else None, mapq, cigar or None, seq or None, qual
        at += 4 + n
        if at > 1 << 20:
            stream.drop(at)
            at = 0


def _opened(path: str):
    """The Arrow file system and inner path of a path that Spark knows."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^(file:)?/+", "file:///", path))
    return fs.FileSystem.from_uri(quote(uri, safe="/:@"))


class _Part(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.split, self.kind = json.loads(options["files"]), int(options["split"]), options["kind"]

    def partitions(self) -> list[_Part]:
        """Ranges of the files that are larger than a split; whole files, several in a partition, of the others."""
        parts, open_, room = [], [], self.split
        for path, size in self.files:
            if size > self.split:
                parts += [_Part([(path, size, s, min(s + self.split, size))]) for s in range(0, size, self.split)]
                continue
            if open_ and size > room:
                parts.append(_Part(open_))
                open_, room = [], self.split
            open_.append((path, size, 0, size))
            room -= size
        return parts + ([_Part(open_)] if open_ else [])

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        bam = self.kind == "bam"
        kinds = [("name", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string())] if bam else [("line", pa.string())]

        def batch(path: str, start: int, first: int, rows: list[tuple]) -> pa.RecordBatch:
            n = pa.StructArray.from_arrays([pa.array([start] * len(rows), pa.int64()), pa.array(range(first, first + len(rows)), pa.int64())], ["block", "row"])
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), n, *columns], ["file", "n", *[k for k, _ in kinds]])

        for path, size, start, end in part.ranges:
            system, inner = _opened(path)
            with system.open_input_file(inner) as f:
                found = records_of(f, size, start, end) if bam else ((x.removesuffix(b"\r").decode("utf-8", "replace"),) for x in lines_of(f, size, start, end))
                rows, held, first = [], 0, 0
                for row in found:
                    rows.append(row)
                    held += sum(len(x) for x in row if isinstance(x, str))
                    if len(rows) == _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield batch(path, start, first, rows)
                        rows, held, first = [], 0, first + len(rows)
                if rows:
                    yield batch(path, start, first, rows)


class BlockGzip(DataSource):
    """Spark data source `blockgzip`: options files (JSON of paths and sizes), split (bytes), kind (lines or bam)."""

    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def schema(self) -> str:
        return READS if self.options["kind"] == "bam" else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, files: list[tuple[str, int]], kind: str, split: int) -> DataFrame:
    spark.dataSource.register(BlockGzip)
    return spark.read.format("blockgzip").option("files", json.dumps(files)).option("split", split).option("kind", kind).load()


def text_lines(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """(file, n, line) of .gz files (path, size), blank lines left out: as readers.text_lines, but block-gzipped files are read by many tasks. Plain gzip files are read by one."""
    return _load(spark, files, "lines", split).where("line <> ''")


def reads(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files (path, size), columns as in SAM; n orders a file's records.

    A range begins at the first place where a chain of records stands; a CIGAR that is kept in a tag for its length stays the placeholder it has.
    """
    return _load(spark, files, "bam", split)


def packed(data: bytes) -> bytes:
    """data as blocks of at most 65,280 bytes, without the empty one at the end."""
    out = []
    for i in range(0, len(data), 65280):
        part = data[i : i + 65280]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(MAGIC + bytes.fromhex("0000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def write_lines(lines: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write lines (value), a block-gzipped file for each partition, into a folder, and return (path, size) of each.

    A task writes under a hidden name and moves the file to its own, so a task that is run again replaces its file.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.gz"
        hidden, size, left = f"{base}/.{name}-{uuid.uuid4().hex}", 0, b""
        with system.open_output_stream(hidden, compression=None) as out:
            for b in batches:
                left += b"".join(x.encode() + b"\n" for x in b.column(0).to_pylist() if x is not None)
                whole = len(left) // 65280 * 65280
                size += out.write(packed(left[:whole])) if whole else 0
                left = left[whole:]
            size += out.write(packed(left) + END)
        system.move(hidden, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "size"])

    done = materialise(lines.select("value").mapInArrow(run, "path string, size long"), "bgzf-files")
    return [(r["path"], r["size"]) for r in done.orderBy("path").collect()]  # a row per file
