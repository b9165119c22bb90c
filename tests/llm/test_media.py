import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from helixmark.llm import queries, tiff, warc


def test_codecs_round_trip():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 127, 128, 129, 130, 576, 5000, 40000]:
        for alphabet in ([0], [0, 1], [0, 1, 255], range(256)):
            x = bytes(rng.choice(alphabet) for _ in range(n))
            assert tiff.unpack_bits(tiff.pack_bits(x), n) == x
            assert tiff.lzw_decode(tiff.lzw_encode(x)) == x


def test_known_streams():
    """The PackBits example of the format's description, and a stream of 9-bit LZW codes written out by hand."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6])


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages_of_every_layout(order, kind):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (37, 23, 1), (20, 33, 3))]
    layouts = [{}, {"strip_rows": 8}, {"predictor": True}, {"tile": (16, 16)}, {"tile": (16, 16), "predictor": True}]
    wanted = [tiff.Page(x, kind, **how) for x in images for how in layouts]
    got = [x for _, x in tiff.pages(tiff.write(wanted, order))]
    assert len(got) == len(wanted) and all(np.array_equal(g, w.samples) for g, w in zip(got, wanted))


def test_damaged_files(spark):
    good = tiff.store(tiff.payload_of("abc" * 900))
    loop = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = at.to_bytes(4, "little")
    for bad in (b"", b"II*\0", good[:200], bytes(loop), b"not a tiff file"):
        with pytest.raises(ValueError):
            list(tiff.pages(bad))
    rows = tiff.decode(spark.createDataFrame([(1, good), (2, good[:200]), (3, None)], "doc_id long, media binary")).toPandas()
    assert rows[rows.doc_id == 1].page.tolist() == [0, 1, 2] and rows[rows.doc_id == 1].error.isna().all()
    assert rows[rows.doc_id == 2].error.notna().any() and not len(rows[rows.doc_id == 3])


def test_payloads_of_edge_cases(edge, nothing):
    out = tiff.read_back(tiff.encode(edge), queries._stored).toPandas()
    texts = {r["doc_id"]: r["text"] for r in edge.select("doc_id", "text").where("doc_id IS NOT NULL").collect()}
    assert len(out) == edge.count()
    for r in out[out.doc_id.notna()].itertuples():
        p = tiff.payload_of(texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and r.n_bytes == len((texts[r.doc_id] or "").encode())
    assert tiff.read_back(tiff.encode(nothing), queries._stored).count() == 0


def test_warc_against_brute_force(spark):
    rows = [(5, "http://a/\r\nb", ""), (3, None, None), (4, "u", "same"), (9, "u", "same"), (9, "u", "same"), (2, "u", "é" * 50000), (None, "u", "same"), (7, "q", "x\r\n\r\nWARC/1.1\r\n\r\ny"), (None, None, "alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    wanted = []
    for i, _, html in rows:
        p = (html or "").encode()
        to = first.get(html or "")
        to = None if to == i else to
        wanted.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(pages, min_bytes=10).where("record_type = 'revisit'").count() == 0


def test_normaliser_writes_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    whole = warc.write(pages, f"file://{tmp_path}/whole").collect()
    assert [r["records"] for r in whole] == [20]
    raw = open(whole[0]["archive"].removeprefix("file://"), "rb").read()
    z = zlib.decompressobj(31)
    assert z.decompress(raw).count(b"WARC/1.1\r\n") == 20 and z.eof and not z.unused_data  # one stream
    single = warc.normalise(spark.createDataFrame(whole), f"file://{tmp_path}/single").collect()[0]
    data = open(single["archive"].removeprefix("file://"), "rb").read()
    end = 0
    for line in open(single["index"].removeprefix("file://")):
        at, size = map(int, line.split()[:2])
        assert at == end and zlib.decompress(data[at : at + size], 31).startswith(b"WARC/1.1\r\n")
        end = at + size
    assert end == len(data)


def test_damaged_archives():
    with pytest.raises(ValueError):
        list(warc.records(iter([warc.record(1, "u", b"abc", None)[:-10]])))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None).replace(b"abc", b"abd"))


def test_lzw_codes_beyond_the_table():
    def stream(codes):
        bits = "".join(f"{c:09b}" for c in codes)
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    assert tiff.lzw_decode(stream([256, 65, 258, 257])) == b"AAA"
    for codes in ([256, 65, 300, 257], [256, 300, 257], [256, 65, 66, 260, 257]):
        with pytest.raises(ValueError):
            tiff.lzw_decode(stream(codes))


def test_like_shares_by_codec():
    for n in (1, 2, 3, 4, 7, 30):
        payload = bytes(i * 7 % 251 for i in range(576 * n))
        found = [(t[tiff.COMPRESSION][0], x.size) for t, x in tiff.pages(tiff.store(payload))]
        assert sum(k for _, k in found) == len(payload) and len(found) == min(n, 3)
        assert max(k for _, k in found) - min(k for _, k in found) <= 576
        assert b"".join(x.tobytes() for _, x in tiff.pages(tiff.store(payload))) == payload


def test_pages_are_folded_by_file(spark):
    """Repeated and null ids stay apart; a damaged file raises."""
    docs = spark.createDataFrame([(1, "a" * 3000), (1, "a" * 3000), (None, "b"), (1, "c" * 700), (None, None)], "doc_id long, text string").coalesce(1)
    out = tiff.read_back(tiff.encode(docs), queries._stored).collect()
    assert [(r["doc_id"], r["n_bytes"]) for r in out] == [(1, 3000), (1, 3000), (None, 1), (1, 700), (None, 0)]
    bad = spark.createDataFrame([(1, 5, tiff.store(tiff.payload_of("abc" * 900))[:200])], "doc_id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="damaged|outside"):
        tiff.read_back(bad, queries._stored).collect()


def test_cut_and_padded_streams():
    whole = b"".join(warc.record(i, "u", b"x" * 500, None) for i in range(6))
    one = gzip.compress(whole)
    cut = zlib.compressobj(6, zlib.DEFLATED, 31)
    at_border = cut.compress(whole[: len(whole) // 2]) + cut.flush(zlib.Z_SYNC_FLUSH)  # no end of the member
    assert b"".join(warc.inflated(io.BytesIO(one))) == whole
    assert b"".join(warc.inflated(io.BytesIO(one + b"\0" * 700 + one + b"\0" * 3))) == whole * 2
    assert b"".join(warc.inflated(io.BytesIO(b""))) == b""
    for bad in (at_border, one[:-1], one[:40], one + b"junk after", b"no gzip at all"):
        with pytest.raises(ValueError):
            b"".join(warc.inflated(io.BytesIO(bad)))


def test_records_are_counted(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(8)], "page_id long, url string, html string").coalesce(1)
    whole = warc.write(pages, f"file://{tmp_path}/whole").collect()[0]
    told = spark.createDataFrame([(whole["archive"], 9)], "archive string, records long")
    with pytest.raises(Exception, match="its manifest says 9"):
        warc.normalise(told, f"file://{tmp_path}/single").collect()
    single = warc.normalise(told.select("archive"), f"file://{tmp_path}/single").collect()[0]
    less = spark.createDataFrame([(single["archive"], single["index"], 7)], "archive string, index string, records long")
    with pytest.raises(Exception, match="its manifest says 7"):
        warc.read(less).collect()


def test_any_page_id_comes_back(spark):
    ids = ["", "a b", "x\r\ny: z", "<urn:page:q>", "é日", "%41", None]
    pages = spark.createDataFrame([(i, "http://h/\x01", f"page {i}") for i in ids] + [("", "u", "two"), ("b", "u", "two")], "page_id string, url string, html string")
    out = warc.round_trip(pages).collect()
    assert sorted(map(str, (r["page_id"] for r in out))) == sorted(map(str, [*ids, "", "b"]))
    assert [r["refers_to"] for r in out if r["page_id"] == "b"] == [""]


def test_inflating_is_bounded_however_well_a_stream_is_packed():
    import gzip
    import io

    plain = b"a" * 40_000_000 + bytes(range(256)) * 3
    packed = gzip.compress(plain) + gzip.compress(b"tail") + b"\0" * 9
    chunks = list(warc.inflated(io.BytesIO(packed)))
    assert max(map(len, chunks)) <= warc.CHUNK and b"".join(chunks) == plain + b"tail"
    for cut in (len(packed) - 30, 100):
        with pytest.raises(ValueError, match="inside a gzip member"):
            list(warc.inflated(io.BytesIO(packed[:cut])))
