import gzip
import io
import random
import struct

import pytest

from helixmark.operators import pileup
from helixmark.sources import bgzf, readers

CODES = {c: i for i, c in enumerate(bgzf.BASES.decode())}


def blocks(data: bytes, size: int) -> bytes:
    return b"".join(bgzf.packed(data[i : i + size]) for i in range(0, len(data), size)) + bgzf.END


def bam_record(name, flag, ref, pos, mapq, cigar, seq, quals) -> bytes:
    ops = [(int(n), bgzf.OPERATIONS.index(o)) for n, o in cigar]
    codes = [CODES[c] for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += (bytes(quals) if quals else b"\xff" * len(seq)) + b"NMC\x01"
    return struct.pack("<i", len(body)) + body


def random_reads(rng, n):
    shapes = [[(30, "M")], [(5, "S"), (20, "M"), (2, "I"), (8, "M")], [(10, "M"), (3, "D"), (15, "=")], [(2, "H"), (12, "X"), (40, "N"), (12, "M"), (4, "S")]]
    for i in range(n):
        cigar = rng.choice(shapes)
        length = sum(k for k, o in cigar if o in "MIS=X")
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        quals = [rng.randrange(10, 40) for _ in seq] if rng.random() < 0.9 else None
        yield f"r{i}", rng.choice([0, 0, 16, 4, 1024, 1, 3]), rng.randrange(2), rng.randrange(1, 60), rng.choice([5, 20, 60]), cigar, seq, quals


def bam_bytes(reads):
    head = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 2)
    for name in (b"c1", b"c2"):
        out += struct.pack("<i", len(name) + 1) + name + b"\0" + struct.pack("<i", 10_000)
    return out + b"".join(bam_record(*r) for r in reads)


@pytest.mark.parametrize("size", [100, 137, 700, 65280])
def test_lines_of_all_ranges(size):
    """Each line once, wherever blocks and ranges end; lines longer than blocks and ranges; no last break."""
    rng = random.Random(size)
    lines = [b"x" * rng.choice([0, 1, 20, 99, 100, 101, 900]) + b"%d" % i for i in range(300)]
    for text in (b"\n".join(lines), b"\n".join(lines) + b"\n", b"", b"\n\n"):
        data = blocks(text, size)
        for step in (60, 333, 5000, len(data)):
            got = [x for s in range(0, len(data), step) for x in bgzf.lines_of(io.BytesIO(data), len(data), s, min(s + step, len(data)))]
            assert [x for x in got if x] == [x for x in text.split(b"\n") if x]
    plain = gzip.compress(b"a\nb") + gzip.compress(b"c\nd\n" * 9)
    assert [list(bgzf.lines_of(io.BytesIO(plain), len(plain), s, s + 20)) for s in (0, 20)] == [[b"a", b"bc"] + [b"d", b"c"] * 8 + [b"d"], []]
    with pytest.raises(ValueError, match="ends within"):
        list(bgzf.lines_of(io.BytesIO(plain[:-12]), len(plain) - 12, 0, 20))
    bad = bytearray(blocks(b"a\n" * 500, 300))
    bad[-40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(bgzf.lines_of(io.BytesIO(bytes(bad)), len(bad), 0, len(bad)))


@pytest.mark.parametrize("size", [90, 501, 65280])
def test_records_of_all_ranges(size):
    """Records that begin anywhere in a block, with no ranges' borders among them."""
    reads = list(random_reads(random.Random(size), 400))
    data = blocks(bam_bytes(reads), size)
    want = [(n, f, f"c{r + 1}", p, q, "".join(f"{k}{o}" for k, o in c), s, None if b is None else "".join(chr(x + 33) for x in b)) for n, f, r, p, q, c, s, b in reads]
    for step in (97, 2000, len(data)):
        assert [x for s in range(0, len(data), step) for x in bgzf.records_of(io.BytesIO(data), len(data), s, min(s + step, len(data)))] == want
    with pytest.raises(ValueError):
        list(bgzf.records_of(io.BytesIO(bgzf.packed(b"SAM?SAM?") + bgzf.END), 50, 0, 50))


def test_vcf_by_blocks(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    body = "".join(f"c\t{i}\t.\tA\tC\t50\tPASS\tDP=20;MQ=60\tGT\t1/1\n" for i in range(1, 3001))
    (tmp_path / "a.vcf.gz").write_bytes(blocks((head + "ERR1\n" + body).encode(), 4000))
    (tmp_path / "b.vcf.gz").write_bytes(gzip.compress((head + "ERR2\n" + body[:50000]).encode()))
    (tmp_path / "c d.vcf").write_text(head + "ERR3\n" + body[:40000])
    for f in ("a.vcf.gz", "b.vcf.gz", "c d.vcf"):
        name = str(tmp_path / f)
        packed, plain = readers.packed_lines(spark, name, 3000), readers.text_lines(spark, name)
        assert packed.orderBy("n").select("file", "line").collect() == plain.orderBy("n").select("file", "line").collect()
        assert packed.rdd.getNumPartitions() > 1 or f != "a.vcf.gz"
    rows = readers.vcf(spark, str(tmp_path), 3000)
    n = {r["sample"]: r["count"] for r in rows.groupBy("sample").count().collect()}
    assert n["ERR1"] == 3000 and set(n) == {"ERR1", "ERR2", "ERR3"}


def test_lines_are_written_in_blocks(spark, tmp_path):
    lines = spark.range(20_000).selectExpr("concat('line ', id, repeat(' x', 20)) AS value").repartition(3)
    files = bgzf.write_lines(lines, f"file://{tmp_path}/out")
    assert len(files) == 3 and all(gzip.open(p[7:]).read().count(b"\n") for p, _ in files)
    assert {p: n for p, n in files} == {f"file://{x}": x.stat().st_size for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")}
    got = bgzf.text_lines(spark, files, 20_000)
    assert got.rdd.getNumPartitions() > 5 and sorted(r["line"] for r in got.collect()) == sorted(r["value"] for r in lines.collect())


def test_panel_calls_of_bam(spark, tmp_path):
    """Every site's letters as a walk over each alignment finds them."""
    reads = list(random_reads(random.Random(8), 500))
    (tmp_path / "ERR9.bam").write_bytes(blocks(bam_bytes(reads), 900))
    sites = [(c, p, random.Random(p).choice("ACGT")) for c in ("c1", "c2") for p in (1, 7, 20, 31, 33, 60, 90, 5000)]
    df = readers.bam(spark, str(tmp_path), 5000)
    assert df.rdd.getNumPartitions() > 2 and df.count() == 500
    seen: dict = {}
    for _, flag, ref, pos, mapq, cigar, seq, quals in reads:
        if flag in (4, 1024, 1) or mapq < 20:
            continue
        at, k = pos, 0
        for n, o in cigar:
            if o in "M=X":
                for i in range(n):
                    if seq[k + i] != "N" and (quals is None or quals[k + i] >= 20):
                        seen.setdefault((f"c{ref + 1}", at + i), []).append(seq[k + i])
            at += n if o in "M=XDN" else 0
            k += n if o in "M=XIS" else 0
    got = {(r["contig"], r["pos"]): r for r in pileup.panel_calls(df, spark.createDataFrame(sites, "contig string, pos int, ref string"), min_depth=5, min_fraction=0.3).collect()}
    assert set(got) == {s[:2] for s in sites} and {r["sample"] for r in got.values()} == {"ERR9"}
    states = set()
    for c, p, ref in sites:
        r, x = got[c, p], seen.get((c, p), [])
        best = max(x, key=lambda b: (x.count(b), -x.index(b))) if x else None
        share = x.count(best) / len(x) if x else 0.0
        state = "no_coverage" if not x else "low_depth" if len(x) < 5 else "ambiguous" if share < 0.3 else "called_ref" if best == ref else "called_alt"
        assert (r["allele"], r["depth"], r["state"]) == (best, len(x), state) and r["fraction"] == pytest.approx(share)
        states.add(state)
    assert len(states) >= 4


def test_reader_travels_by_value():
    from pyspark import cloudpickle

    import helixmark

    cloudpickle.register_pickle_by_value(helixmark)
    try:
        assert cloudpickle.loads(cloudpickle.dumps(bgzf.BlockGzip)).name() == "blockgzip"
    finally:
        cloudpickle.unregister_pickle_by_value(helixmark)
