"""TIFF: a reader that gives one row per page, and a writer to store payloads.

The reader walks the chain of image directories of either byte order, gathers strips or tiles, inflates
PackBits, LZW or deflate (or takes them as they are), undoes horizontal differencing, and puts tiles
into place. It reads pages of 8-bit samples, any number per pixel, chunky or planar.

The writer cuts a payload of n blocks of 576 bytes into up to three pages of like size, of rows of 576
samples: PackBits strips, deflated tiles after differencing, LZW strips; a payload of one block is one
page of 24 x 24 samples in PackBits strips. Equal payloads have equal files.

Defined results: a null file has no pages; a file that is cut off, has a loop of directories or an
unsupported kind of page raises ValueError in `pages`, and gives one row with the error in `decode`;
repeated rows are read each. Codes that the LZW table doesn't have, and text that ends before its strip
is full, are damage.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

BLOCK = 576
SIDE = 24
#: Bytes of files and pages that a batch of pages holds, about; a file's pages may be more.
PART = 1 << 21
#: Tags, field types' sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 317, 322, 323, 324, 325
TYPE_FORMAT = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more equal bytes as a count and the byte, what lies between as it is."""
    x = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(x)))
    out, at = bytearray(), 0

    def plain(end: int) -> None:
        for k in range(at, end, 128):
            piece = data[k : min(k + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        plain(start)
        for k in range(0, size, 128):
            n = min(128, size - k)
            out.extend((257 - n, data[start]) if n > 1 else (0, data[start]))
        at = start + size
    plain(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early, as the format has it."""
    bits, filled, out = LZW_CLEAR, 9, bytearray()
    table: dict[int, int] = {}  # code before << 8 | byte, to code
    width, following, held = 9, 258, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        code = table.get(key)
        if code is not None:
            held = code
            continue
        bits = bits << width | held
        filled += width
        if filled >= 4096:
            keep = filled & 7
            out += (bits >> keep).to_bytes(filled >> 3, "big")
            bits, filled = bits & (1 << keep) - 1, keep
        table[key] = following
        following += 1
        if following > 4093:
            bits, filled = bits << width | LZW_CLEAR, filled + width
            table, width, following = {}, 9, 258
        elif following >= 1 << width:
            width += 1
        held = byte
    if held >= 0:
        bits, filled = bits << width | held, filled + width
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    bits, filled = bits << width | LZW_END, filled + width
    rest = -filled % 8
    return bytes(out) + (bits << rest).to_bytes(filled + rest >> 3, "big")


_FRESH = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    table = _FRESH.copy()
    width, bits, filled, before, size, at = 9, 0, 0, None, 258, 0
    while True:
        if filled < width:
            chunk = data[at : at + 256]
            if not chunk:
                return b"".join(out)
            at += len(chunk)
            bits, filled = bits << 8 * len(chunk) | int.from_bytes(chunk, "big"), filled + 8 * len(chunk)
            continue
        filled -= width
        code = bits >> filled
        bits &= (1 << filled) - 1
        if code == LZW_CLEAR:
            table, width, before, size = _FRESH.copy(), 9, None, 258
            continue
        if code == LZW_END:
            return b"".join(out)
        if before is None:
            if code > 255:
                raise ValueError(f"LZW code {code} is not in the table")
            before = table[code]
        else:
            if code < size:
                entry = table[code]
            elif code == size:
                entry = before + before[:1]
            else:
                raise ValueError(f"LZW code {code} is not in the table")
            if size < 4096:
                table.append(before + entry[:1])
                size += 1
            before = entry
        out.append(before)
        if size >= (1 << width) - 1 and width < 12:
            width += 1


_PACK = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        got = data
    elif kind == LZW:
        got = lzw_decode(data)
    elif kind in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompress(data)
    elif kind == PACKBITS:
        got = unpack_bits(data, size)
    else:
        raise ValueError(f"compression {kind} isn't supported")
    if len(got) < size:
        raise ValueError(f"a strip or tile has {len(got)} bytes of {size}")
    return got[:size]


def _differences(x: np.ndarray) -> np.ndarray:
    """Along rows, per sample; x: rows, pixels, samples."""
    out = x.copy()
    out[:, 1:] -= x[:, :-1]
    return out


@dataclass
class Page:
    """One image to write: samples as rows, pixels, samples per pixel; tile: width and height, or strips of so many rows."""

    samples: np.ndarray
    compression: int = NONE
    predictor: bool = False
    strip_rows: int | None = None
    tile: tuple[int, int] | None = None


def write(pages: list[Page], order: str = "<") -> bytes:
    """A file of all pages, little-endian ("<") or big-endian (">")."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w, s = page.samples.shape
        x = page.samples
        if page.tile:
            tw, th = page.tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            padded[:h, :w] = x
            pieces = [padded[r : r + th, c : c + tw] for r in range(0, h, th) for c in range(0, w, tw)]
        else:
            rows = page.strip_rows or h
            pieces = [x[r : r + rows] for r in range(0, h, rows)]
        at, sizes = [], []
        for piece in pieces:
            data = _PACK[page.compression]((_differences(piece) if page.predictor else piece).tobytes())
            at.append(len(out))
            sizes.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, [w]), (HEIGHT, [h]), (BITS, [8] * s), (COMPRESSION, [page.compression]), (PHOTOMETRIC, [1]), (SAMPLES, [s])]
        fields += [(TILE_WIDTH, [page.tile[0]]), (TILE_HEIGHT, [page.tile[1]]), (TILE_AT, at), (TILE_SIZE, sizes)] if page.tile else [(STRIP_AT, at), (STRIP_ROWS, [page.strip_rows or h]), (STRIP_SIZE, sizes)]
        if page.predictor:
            fields.append((PREDICTOR, [2]))
        entries = bytearray()
        for tag, values in sorted(fields):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR) else 4
            data = struct.pack(f"{order}{len(values)}{TYPE_FORMAT[kind]}", *values)
            if len(data) > 4:
                place = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Each page's tags and its samples (rows, pixels, samples per pixel), in the order of the directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    try:
        while at:
            if at in seen:
                raise ValueError("its directories form a loop")
            seen.add(at)
            n = struct.unpack_from(order + "H", data, at)[0]
            tags = {}
            for e in range(at + 2, at + 2 + 12 * n, 12):
                tag, kind, count = struct.unpack_from(order + "HHI", data, e)
                if kind not in TYPE_FORMAT:
                    continue
                form = f"{order}{count}{TYPE_FORMAT[kind]}"
                place = e + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
                tags[tag] = list(struct.unpack_from(form, data, place))
            yield tags, _samples(data, tags)
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except (struct.error, KeyError, IndexError, zlib.error) as e:
        raise ValueError(f"the file is damaged: {e}") from e


def _samples(data: bytes, tags: dict) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h, s = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    if set(tags.get(BITS, [1])) != {8}:
        raise ValueError("samples aren't of 8 bits")
    kind, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't supported")
    tiled = TILE_WIDTH in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(one(STRIP_ROWS, h), h))
    at, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    planes, each = (s, 1) if planar else (1, s)
    across, down = -(-w // tw), -(-h // th)
    out = np.zeros((h, w, s), np.uint8)
    for k in range(planes * across * down):
        plane, rest = divmod(k, across * down)
        r, c = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, h - r)
        if at[k] + sizes[k] > len(data):
            raise ValueError("a strip or tile lies outside the file")
        x = np.frombuffer(_unpack(kind, data[at[k] : at[k] + sizes[k]], rows * tw * each), np.uint8).reshape(rows, tw, each)
        if predictor == 2:
            x = np.cumsum(x, axis=1, dtype=np.uint8)
        part = x[: h - r, : w - c]
        out[r : r + part.shape[0], c : c + part.shape[1], plane if planar else 0 : plane + 1 if planar else s] = part
    return out


def payload_of(text: str | bytes | None) -> bytes:
    """A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of BLOCK."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def store(payload: bytes) -> bytes:
    """The file of a payload whose length is a positive multiple of BLOCK."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK, 1)
    n = len(rows)
    if n == 1:
        return write([Page(rows.reshape(SIDE, SIDE, 1), PACKBITS, strip_rows=8)])
    first, second = -(-n // 3), -(-2 * n // 3)
    kinds = [Page(rows[:first], PACKBITS, strip_rows=16), Page(rows[first:second], DEFLATE, predictor=True, tile=(BLOCK, 64)), Page(rows[second:], LZW, strip_rows=16)]
    return write([p for p in kinds if len(p.samples)])


def feature(samples: np.ndarray) -> str:
    """Of a payload's samples: mean and deviation in hundredths, entropy in thousandths of a bit, and 64 bits that say which of 64 equal runs are brighter than all."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    value = np.arange(256)
    mean = float(counts @ value) / n
    deviation = max(0.0, float(counts @ (value * value)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    runs = samples.reshape(64, -1).mean(axis=1) > mean
    return f"{round(mean * 100)}:{round(deviation * 100)}:{round(entropy * 1000)}:{np.packbits(runs).tobytes().hex()}"


def encode(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text's payload, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([store(payload_of(t)) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def decode(files: DataFrame, keep: bool = False) -> DataFrame:
    """One row per page of each file (doc_id, media): page, width, height, samples per pixel, samples, and the error of a file that can't be read (to its end).

    keep: with n_bytes, and the file itself in the row of its first page.
    """

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    names = ["doc_id", "page", "width", "height", "samples_per_pixel", "compression", "samples", "error", *(["n_bytes", "media"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, files_, size = [], [], [], 0  # rows' places in b, what they hold, and the file in a first row

            def made() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                if keep:
                    columns += [b.column(2).take(pa.array(at, pa.int32())), pa.array(files_, pa.binary())]  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *columns], names)  # noqa: B023

            for i in range(b.num_rows):
                media, n, error = b.column(1)[i].as_py(), 0, None
                try:
                    for tags, x in pages(media) if media is not None else ():
                        rows.append((n, x.shape[1], x.shape[0], x.shape[2], tags.get(COMPRESSION, [NONE])[0], x.tobytes(), None))
                        n += 1
                except ValueError as e:
                    error = str(e)
                if error:
                    rows.append((n, None, None, None, None, None, error))
                    n += 1
                at += [i] * n
                files_ += [media if k == 0 else None for k in range(n)]
                size += 2 * len(media or b"")
                if size > PART:
                    yield made()
                    at, rows, files_, size = [], [], [], 0
            if rows:
                yield made()

    kind = files.schema["doc_id"].dataType.simpleString()
    given = ["doc_id", "media", "n_bytes"] if keep else ["doc_id", "media"]
    return files.select(*given).mapInArrow(run, f"doc_id {kind}, page int, width int, height int, samples_per_pixel int, compression int, samples binary, error string" + (", n_bytes long, media binary" if keep else ""))


def folded(rows: DataFrame, digest) -> DataFrame:
    """Rows (doc_id, n_bytes) and digest's columns, of decode()'s rows as they come: digest gets each file and its pages' samples, joined.

    A file's pages follow one another in the partition that decoded it, so nothing is shuffled; a file that
    couldn't be read raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # doc_id, n_bytes, file, pages
        done: list = []
        types = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], ["doc_id", "n_bytes", *digest.columns])

        def end() -> None:
            got = digest(held[2], b"".join(held[3]))
            done.append((held[0], held[1], *[got[k] for k in digest.columns]))

        for b in batches:
            types = [b.schema.field(0).type, pa.int64(), *digest.columns.values()]
            idents, pages_, samples, errors, sizes, files = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "page", "samples", "error", "n_bytes", "media"))
            for i in range(b.num_rows):
                if errors[i].as_py() is not None:
                    raise ValueError(errors[i].as_py())
                if pages_[i].as_py() == 0:
                    if held is not None:
                        end()
                    held = [idents[i].as_py(), sizes[i].as_py(), files[i].as_py(), []]
                held[3].append(samples[i].as_py())
            if len(done) >= 256:
                yield made()
                done.clear()
        if held is not None:
            end()
        if done:
            yield made()

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = {pa.int64(): "long", pa.string(): "string"}
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, " + ", ".join(f"{k} {names[t]}" for k, t in digest.columns.items()))


def read_back(files: DataFrame, digest) -> DataFrame:
    """Each file (doc_id, n_bytes, media) decoded to its pages, and these folded to digest's columns."""
    return folded(decode(files, keep=True), digest)
