"""Sequence search against plain loops: exact hits at any pattern length, ends, free letters; alignments with gaps; long sequences."""

import random
import time

import numpy as np
import pytest

from helixmark.operators import joins, lookup, search

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x[::-1].translate(COMPLEMENT)


def letters(rng, n, alphabet="ACGT"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def mutated(rng, x, n):
    x = list(x)
    for k in rng.sample(range(len(x)), min(n, len(x))):
        x[k] = rng.choice("ACGT")
    return "".join(x)


def table(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def brute_context_hits(seqs, contexts, mismatches, coverage):
    out = set()
    for n, c, centre in contexts:
        for strand, text, mid in (("plus", c, centre), ("minus", rc(c), len(c) - 1 - centre)):
            for i, seq in seqs.items():
                for start in range(-len(c), len(seq)):
                    lo, hi = max(0, -start), min(len(c), len(seq) - start)
                    if hi - lo >= coverage * len(c) and lo <= mid < hi:
                        m = sum(a != b for a, b in zip(text[lo:hi], seq[start + lo : start + hi]))
                        if m <= mismatches:
                            base = seq[start + mid]
                            out.add((n, i, start + mid + 1, strand, rc(base) if strand == "minus" else base, m, hi - lo))
    return out


@pytest.mark.parametrize("step", [64, 2048])
def test_patterns_of_any_length(spark, monkeypatch, step):
    monkeypatch.setattr(search, "STEP", step)
    monkeypatch.setattr(search, "LONG", 600)
    rng = random.Random(step)
    subjects = [(i, letters(rng, n)) for i, n in enumerate((0, 1, 5, 90, 700, 1500))] + [(9, None), (10, "A" * 300), (11, "ACACACAC" * 40), (12, "é日\U0001f600x" * 60)]
    texts = dict(subjects)
    patterns = {(k, mutated(rng, texts[5][at : at + k], k // 20)) for k in (1, 2, 3, 4, 9, 14, 16, 23, 33, 50, 97, 130) for at in (0, 640, 1500 - k)}
    patterns |= {(0, ""), (900, "AAAAAA"), (901, "CACACACACACACACA"), (902, "日\U0001f600xé日\U0001f600x"), (903, "A" * 120)}
    given = table(spark, subjects, "subject_id long, seq string"), table(spark, patterns, "pattern_id long, pattern string")
    for mismatches in (0, 2):
        want = sorted((p, s, a, m) for p, t in patterns if t for s, x in subjects if x for a in range(len(x) - len(t) + 1) if (m := sum(u != v for u, v in zip(t, x[a:]))) <= mismatches)
        assert sorted(map(tuple, joins.seeded_search(*given, mismatches).collect())) == want


@pytest.mark.parametrize("size,mismatches,coverage", [(3, 0, 0.8), (9, 1, 0.8), (11, 2, 0.8), (21, 2, 0.8), (41, 6, 0.8), (81, 6, 0.7), (60, 0, 0.5)])
def test_contexts_of_any_length_at_ends(spark, size, mismatches, coverage):
    rng = random.Random(size)
    seqs = {i: letters(rng, n) for i, n in enumerate((30, 200, 500))}
    contexts = []
    for n, (i, at) in enumerate([(2, 100), (1, -size // 8), (2, 500 - size + size // 8), (0, 0), (1, 50)]):
        piece = mutated(rng, (letters(rng, size) + seqs[i] + letters(rng, size))[size + at : size + at + size], n % (mismatches + 1))
        contexts.append((n, rc(piece) if n % 2 else piece, (size - 1) * n // 4))
    hits = lookup.context_hits(table(spark, seqs.items(), "subject_id long, seq string"), table(spark, contexts, "context_id long, context string, centre int"), mismatches, coverage)
    got = [tuple(r)[:-1] for r in hits.collect()]
    assert set(got) == brute_context_hits(seqs, contexts, mismatches, coverage) and len(got) == len(set(got)) >= 3


def test_flanks_may_be_empty(spark):
    rng = random.Random(8)
    seqs = {0: letters(rng, 120), 1: "AC"}
    contexts = [(0, "", "ACG"), (1, "GT", ""), (2, "", ""), (3, seqs[0][20:60], seqs[0][61:90]), (4, "A", "C")]
    want = set()
    for k, left, right in contexts:
        for strand, (x, y) in (("+", (left, right)), ("-", (rc(right), rc(left)))):
            for i, seq in seqs.items():
                for a in range(len(x), len(seq) - len(y)):
                    if seq[a - len(x) : a] == x and seq[a + 1 : a + 1 + len(y)] == y:
                        want.add((k, i, a, strand, rc(seq[a]) if strand == "-" else seq[a]))
    got = joins.flank_search(table(spark, seqs.items(), "subject_id long, seq string"), table(spark, contexts, "context_id long, left string, right string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_minimizers_of_a_part_stand_in_every_sequence_that_holds_it():
    rng = random.Random(3)
    for k, w in ((16, 17), (12, 5), (5, 1)):
        for _ in range(50):
            part = letters(rng, k + w - 1, rng.choice(["ACGT", "AC", "A"]))
            seq = letters(rng, rng.randint(0, 40)) + part + letters(rng, rng.randint(0, 40))
            at = int(search.hashes(search.codes(part), k).argmin())
            h = search.hashes(search.codes(seq), k)
            assert seq.index(part) + at in search.minimal(h, w).tolist()


def plain_alignment(a, b):
    """Best score of a local alignment with affine gaps, by the full table."""
    low = -(10**6)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] + search.OPEN + search.EXTEND, e[i - 1][j] + search.EXTEND)
            f[i][j] = max(h[i][j - 1] + search.OPEN + search.EXTEND, f[i][j - 1] + search.EXTEND)
            h[i][j] = max(0, h[i - 1][j - 1] + (search.AGREE if a[i - 1] == b[j - 1] else search.DIFFER), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def edited(rng, x, n):
    x = list(x)
    for _ in range(n):
        k = rng.randrange(len(x))
        x[k : k + 1] = rng.choice([[], [rng.choice("ACGT")], [x[k], rng.choice("ACGT")], [x[k], *letters(rng, 2)]])
    return "".join(x)


def test_scores_equal_a_plain_dynamic_program():
    rng = random.Random(12)
    size, shift = 36, 40  # so wide a band holds every path
    pairs = []
    for _ in range(1000):
        a = letters(rng, size)
        inner = edited(rng, a, rng.randint(0, 5))[: size + 2 * shift]
        left = rng.randint(0, size + 2 * shift - len(inner))
        pairs.append((a, (letters(rng, left) + inner + letters(rng, size + 2 * shift))[: size + 2 * shift]))
    found = search.local_alignments(np.stack([search.codes(a) for a, _ in pairs]), np.stack([search.codes(b) for _, b in pairs]), shift)
    assert (found["score"] == search.best_scores(np.stack([search.codes(a) for a, _ in pairs]), np.stack([search.codes(b) for _, b in pairs]), shift)).all()
    for n, (a, b) in enumerate(pairs):
        r = {k: int(v[n]) for k, v in found.items()}
        # row i of the band meets i to i + 2 * shift; what lies outside of it can't be reached
        assert r["score"] <= plain_alignment(a, b)
        if r["score"] < plain_alignment(a, b):
            continue
        unpaired = 2 * r["aligned"] - (r["a_to"] - r["a_from"]) - (r["b_to"] - r["b_from"])
        same = r["aligned"] - unpaired - r["mismatches"]
        assert r["score"] == same * search.AGREE + r["mismatches"] * search.DIFFER + r["gaps"] * search.OPEN + unpaired * search.EXTEND
    equal = sum(int(found["score"][n]) == plain_alignment(a, b) for n, (a, b) in enumerate(pairs))
    assert equal >= 970  # the others' best path starts or ends outside the band


def test_gapped_contexts(spark):
    rng = random.Random(20)
    genome = letters(rng, 3000)
    contexts, want = [], {}
    for n in range(12):
        at = 150 + 220 * n
        piece = genome[at : at + 81]
        kind = n % 4
        if kind == 1:
            piece = piece[:20] + piece[21:]  # a letter left out
        elif kind == 2:
            piece = piece[:60] + "AC" + piece[60:]  # two put in
        elif kind == 3:
            piece = piece[:30] + piece[32:50] + letters(rng, 1) + piece[50:]
        reverse = n % 3 == 2
        contexts.append((n, rc(piece) if reverse else piece, 40))
        want[n] = (reverse, kind, at)
    hits = lookup.gapped_context_hits(table(spark, [(1, genome), (2, genome[:100])], "subject_id long, seq string"), table(spark, contexts, "context_id long, context string, centre int"), 4, 0.8)
    best = {r["context_id"]: r for r in lookup.best_context_hits(hits, ["context_id"]).collect()}
    for n, (reverse, kind, at) in want.items():
        r = best[n]
        assert (r["strand"] == "minus") == reverse and r["subject_id"] == 1 and r["status"] == "mapped_unique_context"
        assert abs(r["at"] - 1 - (at + 40)) <= 3
        assert r["observed"] == (rc(genome[r["at"] - 1]) if reverse else genome[r["at"] - 1])
    rows = {(r["context_id"], r["subject_id"]): r for r in hits.collect()}
    assert rows[0, 1]["score"] == 81 and rows[0, 1]["gaps"] == 0 and rows[0, 1]["identity"] == 1
    assert rows[1, 1]["score"] == 80 - 7 and rows[1, 1]["gaps"] == 1 and rows[1, 1]["aligned"] == 81
    assert len(rows) == hits.count()
    with pytest.raises(ValueError, match="too few letters"):
        lookup.gapped_context_hits(table(spark, [(1, genome)], "subject_id long, seq string"), table(spark, [(1, "ACGT", 1)], "context_id long, context string, centre int"))


def test_time_grows_in_proportion_to_length(spark):
    rng = np.random.default_rng(1)
    took = []
    genome = "".join(np.array(list("ACGT"))[rng.integers(0, 4, 4_000_000)])
    for n in (1_000_000, 2_000_000, 4_000_000):
        seqs = table(spark, [(1, genome[:n])], "subject_id long, seq string")
        contexts = table(spark, [(k, genome[9_000 * k : 9_000 * k + 81], 40) for k in range(1, 101)] + [(0, genome[77:86], 4)], "context_id long, context string, centre int")
        start = time.time()
        found = lookup.context_hits(seqs, contexts, 2).select("context_id").distinct().count()
        took.append(time.time() - start)
        assert found == 101
    assert took[2] < 60 and took[2] < 6 * took[0] + 10
    t = search.tiled(seqs, 81)
    assert t.rows.selectExpr("max(length(seq))").first()[0] <= search.STEP + 2 * 81


def test_tiles_of_pieces(spark):
    """The same tiles and hits from pieces of any length as from whole sequences."""
    import random

    from helixmark.operators import search

    rng = random.Random(12)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate((1, 99, 100, 101, 260, 3000, 7777))}
    pieces = []
    for k, seq in seqs.items():
        at = 0
        while at < len(seq):
            n = rng.choice([1, 40, 100, 900])
            pieces.append((k, at, seq[at : at + n]))
            at += n
    whole = spark.createDataFrame(list(seqs.items()), "subject_id int, seq string")
    for longest, step in ((40, 100), (100, 100), (33, None)):
        a, b = search.tiled(whole, longest, step), search.from_pieces(spark.createDataFrame(pieces, "subject_id int, start long, seq string"), longest, step)
        assert (a.step, a.margin) == (b.step, b.margin)
        assert sorted(map(tuple, a.rows.collect())) == sorted(map(tuple, b.rows.collect()))
    patterns = spark.createDataFrame([(k, seqs[6][a : a + 33], 16) for k, a in enumerate(range(0, 7700, 331))], "id int, letters string, centre int")
    assert sorted(map(tuple, search.search(None, patterns, 2, tiles=b).collect())) == sorted(map(tuple, search.search(whole, patterns, 2).collect()))


def test_what_a_task_makes_is_bounded_and_sieved(spark):
    """Minimizers leave a task in batches of few rows, and those that no pattern has stay in it."""
    rng = random.Random(4)
    subjects = table(spark, [(i, letters(rng, 3000)) for i in range(400)], "subject_id long, seq string")
    t = search.tiled(subjects, 33)
    seeds = search.part_seeds(table(spark, [(0, t.rows.where("tile = 0").first()["seq"][:33])], "key long, letters string"), 3, search.CLASSES)
    k, w = seeds.select("k", "w").first()
    only = search.sieve(seeds)
    assert len(only) == search.SIEVE
    every, few = search.minimizers(t, k, w), search.minimizers(t, k, w, only=only)
    assert few.count() < every.count() / 1000
    for m in (every, few):
        assert m.join(seeds, "seed").count() == every.join(seeds, "seed").count() >= 3

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert t.rows.select("subject_id").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= 1000


def test_patterns_alike_are_searched_once(spark, monkeypatch):
    """Work follows the distinct patterns; each of those that are alike has its hits."""
    seen = []
    compared = search._compared
    monkeypatch.setattr(search, "_compared", lambda t, p, *rest: seen.append(p.count()) or compared(t, p, *rest))
    subjects = table(spark, [(i, f"ACGTTAC{i:03d}GATTACA") for i in range(50)], "subject_id long, seq string")
    contexts = table(spark, [(i, "GTTA", "TTAC"[: 1 + i % 2]) for i in range(200)], "context_id long, left string, right string")
    hits = joins.flank_search(subjects, contexts)
    assert seen == [4]
    assert hits.where("context_id = 0 AND strand = '+'").count() == hits.where("context_id = 198 AND strand = '+'").count()
    want = sorted((c, i, p, f"ACGTTAC{i:03d}GATTACA"[p]) for c in (0, 1) for i in range(50) for p in range(4, 14) if f"ACGTTAC{i:03d}GATTACA"[p - 4 : p] == "GTTA" and f"ACGTTAC{i:03d}GATTACA"[p + 1 :].startswith("TTAC"[: 1 + c]))
    assert sorted(tuple(r) for r in hits.where("context_id < 2 AND strand = '+'").select("context_id", "subject_id", "at", "centre").collect()) == want


def test_contexts_and_sequences_alike_are_searched_once(spark, monkeypatch):
    """The best hits and their numbers are those of all contexts in all subjects; what is searched is what differs."""
    seen = []
    plain = lookup.context_hits
    monkeypatch.setattr(lookup, "context_hits", lambda s, c, *rest: seen.append((s.count(), c.count())) or plain(s, c, *rest))
    rng = random.Random(8)
    texts = [letters(rng, 60) for _ in range(4)]
    subjects = table(spark, [(i, texts[i % 4].lower() if i % 3 else texts[i % 4]) for i in range(40)] + [(99, None)], "subject_id long, seq string")
    contexts = table(spark, [(i, texts[i % 2][10:31], 10 + i // 6) for i in range(12)], "context_id long, context string, centre int")
    got = lookup.best_contexts(subjects, contexts, 2, 0.8)
    assert seen == [(4, 4)]
    want = lookup.best_context_hits(plain(subjects, contexts, 2, 0.8), ["context_id"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.first()["n_context_hits"] >= 10


def test_lookup_reads_its_calls_once(spark):
    """Calls and blocks that several steps read are written first; tables that have been are taken as they are."""
    from helixmark import storage
    from helixmark.operators import lookup

    calls = spark.createDataFrame([("s", "1", 5, "CALLED_REFERENCE", "A")], "sample string, chrom string, pos long, state string, allele string")
    blocks = spark.createDataFrame([("s", "1", 7, 9, 1, "C")], "sample string, chrom string, start long, end long, ord int, ref string")
    aliases = spark.createDataFrame([("chr1", "1")], "source string, target string")
    asked = spark.createDataFrame([("s", "chr1", 5), ("s", "1", 8), ("s", "chr1", 8), ("s", "2", 1)], "sample string, chrom string, pos long")
    with storage.Scope() as scope:
        got = {(r["chrom"], r["pos"]): (r["allele"], r["match"]) for r in lookup.call_lookup(asked, calls, blocks, aliases, width=16).collect()}
    assert got == {("chr1", 5): ("A", "contig_alias"), ("1", 8): ("C", "gvcf_ref_block"), ("chr1", 8): ("C", "gvcf_ref_block_contig_alias"), ("2", 1): (None, "absent")}
    assert len([t for t in scope.tables if "lookup-calls" in t._helixmark_path or "lookup-blocks" in t._helixmark_path]) == 2
    known = storage.materialise(calls, "known")
    assert storage.written(known, "again") is known
