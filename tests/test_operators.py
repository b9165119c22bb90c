import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmark.operators import cohort, hierarchy, joins, pairs, pileup, selection, stats


def test_range_join_with_long_blocks(spark):
    rng = random.Random(1)
    blocks = [(k % 3, s := rng.randrange(100_000), s + rng.choice([-5, 0, 3, 500, 40_000]), k) for k in range(200)]
    points = [(k % 3, rng.randrange(100_000), k) for k in range(300)]
    b, p = spark.createDataFrame(blocks, "k long, start long, end long, ord long"), spark.createDataFrame(points, "k long, pos long, id long")
    want = sorted((i, o) for k, x, i in points for kb, s, e, o in blocks if k == kb and s <= x <= e)
    got = joins.range_join(p, b, ["k"], "pos", "start", "end", 10, long_bins=4)
    assert sorted((r["id"], r["ord"]) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    first = {r["id"]: r["ord"] for r in joins.first_covering(p, b, ["k"], "pos", "start", "end", "ord", 10).collect()}
    assert first == {i: min((o for j, o in want if j == i), default=None) for _, _, i in points}


def test_nearest(spark):
    b = spark.createDataFrame([("c", 10, 20, 0), ("c", 15, 30, 1), ("c", 50, 60, 2)], "k string, start long, end long, ord long")
    p = spark.createDataFrame([("c", x, x) for x in (1, 12, 18, 35, 40, 45, 55, 99)] + [("d", 5, 5)], "k string, pos long, id long")
    got = {r["id"] if r["k"] == "c" else "d": (r["ord"], r["distance"]) for r in joins.nearest(p, b, ["k"], "pos", "start", "end", "ord").collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 9, 12: 0, 18: 0, 35: 5, 40: 10, 45: 5, 55: 0, 99: 39, "d": None}
    assert got[40][0] == 1 and got[35][0] == 1 and got[45][0] == 2


def test_mismatches_against_brute_force(spark):
    rng = random.Random(2)
    subjects = [(i, "".join(rng.choice("ACGT") for _ in range(120))) for i in range(6)]
    patterns = [(i, s[a : a + 12]) for i, (_, s) in enumerate(subjects) for a in (5,)] + [(99, "AAAAAA")]
    want = sorted((p, s, a, m) for p, t in patterns for s, x in subjects for a in range(len(x) - len(t) + 1) if (m := sum(u != v for u, v in zip(t, x[a:]))) <= 2)
    got = joins.seeded_search(spark.createDataFrame(subjects, "subject_id long, seq string"), spark.createDataFrame(patterns, "pattern_id long, pattern string"), 2)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_flanks_overlap_and_palindromes(spark):
    s = spark.createDataFrame([(0, "ACGTTACGTAACGTTAACG")], "subject_id long, seq string")
    c = spark.createDataFrame([(0, "ACG", "TAC"), (1, "AC", "GT")], "context_id long, left string, right string")
    got = {tuple(r)[0::2] for r in joins.flank_search(s, c).select("context_id", "subject_id", "at", "strand").collect()}
    seq, want = "ACGTTACGTAACGTTAACG", set()
    comp = str.maketrans("ACGT", "TGCA")
    for k, (l, r) in enumerate((("ACG", "TAC"), ("AC", "GT"))):
        for strand, (x, y) in (("+", (l, r)), ("-", (r.translate(comp)[::-1], l.translate(comp)[::-1]))):
            for a in range(len(seq)):
                if seq[a:].startswith(x) and seq[a + len(x) + 1 :].startswith(y) and a + len(x) < len(seq):
                    want.add((k, a + len(x)))
    assert {(k, a) for k, a in got} == want


def test_even_picks(spark):
    def picks(n, k):
        rows = spark.range(n).where(cohort.even_picks(F.col("id"), F.lit(n), k)).collect()
        return [r["id"] for r in rows]

    assert picks(7, 0) == picks(7, 9) == list(range(7))
    assert picks(7, 1) == [3] and picks(6, 1) == [3]
    for n in range(2, 12):
        for k in range(2, n):
            assert picks(n, k) == sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def test_three_valued_filters(spark):
    m = spark.createDataFrame([("a", "f", 0.0), ("b", "f", None), ("a", "g", 1.0), ("b", "g", 1.0), ("a", "h", None), ("b", "h", None)], "sample string, feature string, value double")
    assert {r["feature"] for r in cohort.variant_features(m).collect()} == {"f"}
    assert {r["feature"]: r["fill"] for r in cohort.fills(m, "mode").collect()} == {"f": 0.0, "g": 1.0, "h": 0.0}
    assert {(r["sample"], r["feature"]) for r in cohort.retained(m, 0.5, 0.5).collect()} == {("a", "f"), ("a", "g"), ("b", "f"), ("b", "g")}


def test_complete_linkage():
    x = np.array([0.0, 0.1, 0.25, 1.0, 1.05])
    d = abs(x[:, None] - x[None])
    c = selection.complete_linkage(d, 0.2)
    assert c[0] == c[1] != c[2] and c[3] == c[4] != c[2]
    assert len(set(selection.complete_linkage(d, 0.0))) == 5 and len(set(selection.complete_linkage(d, 2.0))) == 1


def _linked(x, threshold):
    """Complete linkage by definition: the nearest two clusters, the first of equal ones, merge."""
    d = (x[:, None] != x[None]).mean(axis=2)
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > 1:
        far, i, j = min((d[np.ix_(a, b)].max(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if far > threshold:
            break
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("threshold", [0.0, 0.15, 0.3, 0.4])
def test_redundancy_over_the_whole_list(spark, monkeypatch, threshold):
    """As by definition over all features, which meet in many blocks; equal ones far apart in the list are together."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    rng = np.random.default_rng(7)
    kinds = rng.integers(0, 3, (9, 20))
    x = kinds[rng.integers(0, 9, 90)]
    x = np.where(rng.random(x.shape) < 0.12, rng.integers(0, 3, x.shape), x)
    x[64] = x[63]
    rows = [(0, k + 1, k + 1, "".join("01?"[v] for v in r)) for k, r in enumerate(x)]
    got = selection.redundancy(spark.createDataFrame(rows, "group long, feature long, rank long, states string"), threshold, 2).toPandas()
    assert {frozenset(g.feature - 1) for _, g in got.groupby("cluster")} == _linked(x, threshold)
    assert got.set_index("feature").cluster[64] == got.set_index("feature").cluster[65]
    for c, g in got.groupby("cluster"):
        assert c == g.feature.min() and set(g[g.kept].feature) == set(sorted(g.feature)[:2])


def test_permanova_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((12, 20)) < 0.4).astype(int)
    x[:6, :5] = 1
    g = [0] * 6 + [1] * 6
    v = spark.createDataFrame([(i, r.tolist(), g[i]) for i, r in enumerate(x)], "id long, bits array<int>, label int")
    d = stats.jaccard(stats.ones(v))
    full = np.array([[1 - (a & b).sum() / (a | b).sum() if (a | b).any() else 0 for b in x] for a in x])
    got = stats.permanova(d, v.select("id", "label")).first()
    n, total = 12, (np.triu(full) ** 2).sum() / 12
    within = sum((np.triu(full[np.ix_(i, i)]) ** 2).sum() / 6 for i in (range(6), range(6, 12)))
    assert got["f"] == pytest.approx((total - within) / (within / (n - 2)))
    values = stats.permuted_f(d, v.select("id", "label"), 49, 1)
    assert values.where("replicate = 0").first()["f"] == pytest.approx(got["f"]) and values.count() == 50
    assert 0 < stats.permutation_p(values, "f").first()["p"] <= 0.1


def test_distances_of_sparse_vectors(spark, monkeypatch):
    """All pairs, with those that share no set bit; permanova, mantel and neighbours as over full matrices."""
    monkeypatch.setattr(pairs, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = (rng.random((40, 64)) < 0.04).astype(int)
    x[:3] = 0
    x[3:6] = np.eye(64, dtype=int)[:3]
    g = [k % 3 for k in range(40)]
    v = spark.createDataFrame([(k, r.tolist(), g[k]) for k, r in enumerate(x)], "id long, bits array<int>, label int")
    labels = v.select("id", "label")
    jac = np.array([[1 - (a & b).sum() / (a | b).sum() if (a | b).any() else 0 for b in x] for a in x])
    ham = (x[:, None] != x[None]).mean(axis=2)
    for got, want in ((stats.jaccard(stats.ones(v)), jac), (stats.hamming(v), ham)):
        rows = {(r["i"], r["j"]): r["d"] for r in got.collect()}
        assert len(rows) == got.count() == 40 * 39 // 2
        assert all(rows[i, j] == pytest.approx(want[i, j]) for i in range(40) for j in range(i + 1, 40))
    assert stats.hamming(v, 0.02).count() == (ham[np.triu_indices(40, 1)] <= 0.02).sum()
    d = stats.jaccard(stats.ones(v))
    got = stats.permanova(d, labels).first()
    assert got["ss_total"] == pytest.approx((np.triu(jac) ** 2).sum() / 40)
    assert got["ss_within"] == pytest.approx(sum((np.triu(jac[np.ix_(m, m)]) ** 2).sum() / len(m) for m in ([k for k in range(40) if g[k] == t] for t in range(3))))
    upper = np.triu_indices(40, 1)
    assert stats.mantel(d, labels).first()["r"] == pytest.approx(np.corrcoef(jac[upper], [g[i] != g[j] for i, j in zip(*upper)])[0, 1])
    near = {r["id"]: r["predicted"] for r in stats.knn(stats.hamming(v), labels, 1).collect()}
    assert near == {k: g[min((ham[k, o], o) for o in range(40) if o != k)[1]] for k in range(40)}


def test_pileup():
    assert pileup.bases_of(".,$^I.+2ACg-1t*T", "a") == "AAAG*T"
    assert pileup.bases_of(None, "A") == ""


def test_pileup_calls(spark):
    rows = spark.createDataFrame([(0, ""), (1, "AAA"), (2, "AACCAACCAACC"), (3, "CCCCCCCCCCAA"), (4, "CACACACACACA")], "pos long, observed string")
    got = {r["pos"]: (r["allele"], r["state"]) for r in pileup.majority(rows, ["pos"]).collect()}
    assert got == {0: (None, "no_coverage"), 1: ("A", "low_depth"), 2: ("A", "ambiguous"), 3: ("C", "called"), 4: ("C", "ambiguous")}


def test_branches(spark):
    edges = {"": [("A", 0.9), ("B", 0.6), ("C", 0.2)], "A": [("A|1", 0.7), ("A|2", 0.3)], "B": [(hierarchy.TERMINAL, 0.55)]}
    rows = [(n, c, s) for n, cs in edges.items() for c, s in cs]
    t = spark.createDataFrame(rows, "node string, child string, score double")
    out = hierarchy.branch(spark.createDataFrame([("s",)], "sample string"), lambda f: f.join(t, "node"), 3, 0.3, 0.5)
    assert {(r["path"], r["score"], r["terminal"]) for r in out.collect()} == {("A|1", 0.7, True), ("B", 0.55, True)}
    none = hierarchy.branch(spark.createDataFrame([("s",)], "sample string"), lambda f: f.join(t.where("node = ''"), "node"), 1, 0.3, 0.95)
    assert none.count() == 0


def test_model_or_profile(spark):
    s = spark.createDataFrame([("s", "", "A", 0.6, 9, 10), ("s", "", "B", 0.5, 9, 10), ("t", "", "A", 0.6, 1, 10), ("t", "", "B", 0.5, 1, 10), ("u", "x", "y", 0.1, 1, 1)], "sample string, node string, child string, score double, n long, asked long")
    m = spark.createDataFrame([("s", "", "A", 0.1), ("s", "", "B", 0.9), ("t", "", "A", 0.1), ("t", "", "B", 0.9)], "sample string, node string, child string, p double")
    got = {(r["sample"], r["child"]): (r["score"], r["source"]) for r in hierarchy.choose_scores(s, m).collect()}
    assert got == {("s", "A"): (0.1, "model"), ("s", "B"): (0.9, "model"), ("t", "A"): (0.6, "profile_missing"), ("t", "B"): (0.5, "profile_missing"), ("u", "y"): (1.0, "single")}


def test_guard_and_review(spark):
    steps = spark.createDataFrame([(x, "drug", *r) for x, *r in (("a", "susceptible", 0.9, 9, "resolved_marker_evidence_present"), ("b", "Susceptible", 0.01, 1, "low_resolved_marker_evidence"), ("c", "resistant", 0.0, 0, "x"), ("d", "susceptible", 0.0, 0, "x"))], "sample string, label_column string, label string, resolved double, n_resolved long, status string")
    shown = lambda df: {r["sample"]: (r["reported"], r["routing"], r["guard"]) for r in df.collect()}
    plain = {"a": ("susceptible", "susceptible", "none"), "c": ("resistant", "resistant", "none")}
    assert shown(hierarchy.guarded(steps, ("Drug",))) == plain | {"b": ("Susceptible", "Susceptible", hierarchy.WARNED), "d": ("susceptible", "susceptible", hierarchy.WARNED)}
    terminal = spark.createDataFrame([("b", "Resistant", 0.5, "global"), ("d", "resistant", 0.4, "global"), ("a", "resistant", 1.0, "global")], "sample string, prediction string, resistant_probability double, source string")
    assert shown(hierarchy.guarded(steps, ("drug",), terminal, "block")) == plain | {"b": ("Resistant", "Resistant", hierarchy.ESCALATED), "d": (hierarchy.BLOCKED, "susceptible", hierarchy.BLOCKED)}
    assert all(x[2] == "none" for x in shown(hierarchy.guarded(steps, ("other",))).values())
    labels = spark.createDataFrame([("amr", "resistant")] * 20 + [("amr", "susceptible")] * 3 + [("amr", "nan"), ("amr", None)], "label_column string, label string")
    policy = hierarchy.support_policy(labels, 2, 10)
    assert {r["class"]: (r["n"], r["excluded"], r["review"]) for r in policy.collect()} == {"resistant": (20, False, False), "susceptible": (3, False, True)}
    assert hierarchy.policy_lists(policy).first()["review"] == "susceptible"


def test_trees_as_text(spark):
    e = hierarchy.prefixes(spark.createDataFrame([(["A", "1"],), (["A", "2"],), (["B", "1"],)], "labels array<string>"))
    assert hierarchy.newick(e) == "((1,2)A,(1)B);" and hierarchy.outline(e) == "A\n  1\n  2\nB\n  1"


def test_nearest_against_brute_force(spark):
    import random

    from helixmark.operators import joins

    rng = random.Random(3)
    blocks = [(k, s, s + rng.randrange(0, 30), i) for i, (k, s) in enumerate((rng.choice("ab"), rng.randrange(0, 2000)) for _ in range(60))]
    points = [(i, rng.choice("abc"), rng.randrange(-50, 2100)) for i in range(300)]
    b = spark.createDataFrame(blocks, "k string, start long, end long, ord long")
    p = spark.createDataFrame(points, "id long, k string, pos long")
    for width in (7, 100, 10**6):
        got = {r["id"]: (r["ord"], r["distance"]) for r in joins.nearest(p, b, ["k"], "pos", "start", "end", "ord", width).collect()}
        for i, k, x in points:
            near = [(max(s - x, x - e, 0), o) for kk, s, e, o in blocks if kk == k]
            assert got[i] == (min(near)[::-1] if near else (None, None))


def test_call_lookup(spark):
    from helixmark.operators import lookup

    calls = spark.createDataFrame([("s", "c", 5, "CALLED_ALTERNATE", "G"), ("s", "d", 9, "CALLED_REFERENCE", "A"), ("s", "e", 9, "CALLED_ALTERNATE", "T")], "sample string, chrom string, pos long, state string, allele string")
    blocks = spark.createDataFrame([("s", "c", 4, 8, 2, "T"), ("s", "c", 6, 9, 1, "C"), ("s", "d", 20, 30, 1, "G")], "sample string, chrom string, start long, end long, ord long, ref string")
    aliases = spark.createDataFrame([("x", "d"), ("y", "d"), ("e", "x")], "source string, target string")
    req = spark.createDataFrame([("s", c, p) for c, p in (("c", 5), ("c", 6), ("c", 4), ("c", 10), ("y", 9), ("x", 9), ("y", 25), ("z", 1), ("z", 5), ("z", 9))], "sample string, chrom string, pos long")
    got = {(r["chrom"], r["pos"]): (r["state"], r["allele"], r["from_block"], r["match"]) for r in lookup.call_lookup(req, calls, blocks, aliases, True, 4).collect()}
    none = (None, None, False)
    assert got == {
        ("c", 5): ("CALLED_ALTERNATE", "G", False, lookup.EXACT),
        ("c", 6): ("CALLED_REFERENCE", "C", True, lookup.BLOCK),
        ("c", 4): ("CALLED_REFERENCE", "T", True, lookup.BLOCK),
        ("c", 10): (*none, lookup.ABSENT),
        ("y", 9): ("CALLED_REFERENCE", "A", False, lookup.ALIAS),
        ("x", 9): (*none, lookup.AMBIGUOUS),
        ("y", 25): ("CALLED_REFERENCE", "G", True, lookup.ALIAS_BLOCK),
        ("z", 1): (*none, lookup.ABSENT),
        ("z", 5): ("CALLED_ALTERNATE", "G", False, lookup.ANYWHERE),
        ("z", 9): (*none, lookup.AMBIGUOUS_ANYWHERE),
    }
    for bad in ([("x", " ")], [("x", "d"), ("x", "e")]):
        with pytest.raises(Exception, match="alias"):
            lookup.contig_candidates(spark.createDataFrame(bad, "source string, target string")).collect()


def test_context_hits_against_brute_force(spark):
    import random

    from helixmark.operators import lookup

    rng = random.Random(4)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(400)) for i in range(3)}
    rc = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contexts = []
    for n, (i, at) in enumerate([(0, 50), (1, 0), (2, 379), (0, 200), (1, 383), (2, 100)]):
        piece = (seqs[i] + "ACGT" * 6)[at : at + 21]
        letters = list(piece)
        for k in rng.sample(range(21), n % 3):
            letters[k] = rng.choice("ACGT")
        piece = "".join(letters)
        contexts.append((n, rc(piece) if n % 2 else piece, 10))
    want = set()
    for n, c, centre in contexts:
        for strand, text, mid in (("plus", c, centre), ("minus", rc(c), 20 - centre)):
            for i, seq in seqs.items():
                for start in range(-20, len(seq)):
                    lo, hi = max(0, -start), min(21, len(seq) - start)
                    if hi - lo >= 0.8 * 21 and lo <= mid < hi:
                        m = sum(a != b for a, b in zip(text[lo:hi], seq[start + lo : start + hi]))
                        if m <= 2:
                            base = seq[start + mid]
                            want.add((n, i, start + mid + 1, strand, rc(base) if strand == "minus" else base, m, hi - lo))
    hits = lookup.context_hits(spark.createDataFrame(list(seqs.items()), "subject_id long, seq string"), spark.createDataFrame(contexts, "context_id long, context string, centre int"), 2)
    assert {tuple(r)[:-1] for r in hits.collect()} == want and len(want) >= 6
    best = {r["context_id"]: r["status"] for r in lookup.best_context_hits(hits, ["context_id"]).collect()}
    assert best[0] == "mapped_unique_context"


def test_statistics_of_disjoint_and_empty_vectors(spark):
    import numpy as np

    from helixmark.operators import stats

    rng = np.random.default_rng(5)
    x = (rng.random((14, 9)) < 0.25).astype(int)
    x[:3] = 0
    x[3] = [1] * 4 + [0] * 5
    x[4] = [0] * 4 + [1] * 5
    v = spark.createDataFrame([(i, [int(b) for b in r], "ab"[i % 2]) for i, r in enumerate(x)], "id long, bits array<int>, label string")
    inter = x @ x.T
    union = x.sum(1)[:, None] + x.sum(1)[None] - inter
    jac = np.where(union > 0, 1 - inter / np.maximum(union, 1), 0.0)
    ham = (x[:, None] != x[None]).mean(-1)
    for f, want in ((stats.jaccard(stats.ones(v)), jac), (stats.hamming(v), ham)):
        got = {(r["i"], r["j"]): r["d"] for r in f.collect()}
        assert len(got) == 91 and all(abs(d - want[k]) < 1e-12 for k, d in got.items())
    labels = v.select("id", "label")
    y = np.arange(14) % 2
    total = (jac**2).sum() / 28
    within = sum((jac[np.ix_(y == g, y == g)] ** 2).sum() / (2 * (y == g).sum()) for g in (0, 1))
    f = stats.permanova(stats.jaccard(stats.ones(v)), labels).first()
    assert abs(f["f"] - (total - within) / (within / 12)) < 1e-9
    iu = np.triu_indices(14, 1)
    r = np.corrcoef(jac[iu], (y[:, None] != y[None])[iu])[0, 1]
    values = stats.permuted_r(stats.jaccard(stats.ones(v)), labels, 7, 2)
    rows = {z["replicate"]: z["r"] for z in values.collect()}
    assert abs(rows[0] - r) < 1e-9 and len(rows) == 8
    p = stats.permutation_p(values, "r", two_sided=True).first()["p"]
    assert abs(p - (sum(abs(rows[k]) >= abs(rows[0]) for k in range(1, 8)) + 1) / 8) < 1e-12
    fs = {z["replicate"]: z["f"] for z in stats.permuted_f(stats.jaccard(stats.ones(v)), labels, 5, 2).collect()}
    assert abs(fs[0] - f["f"]) < 1e-9
    apart = spark.createDataFrame([(0, [1, 0], "a"), (1, [1, 0], "a"), (2, [0, 1], "b"), (3, [0, 1], "b")], "id long, bits array<int>, label string")
    assert stats.permanova(stats.jaccard(stats.ones(apart)), apart.select("id", "label")).first()["f"] == float("inf")


def test_small_table_operators(spark):
    from helixmark.operators import ordering, tables

    t = spark.createDataFrame([(i, f"x{i % 5}", i % 3) for i in range(40)], "id long, k string, v long")
    got = {r["id"]: r["n"] for r in ordering.numbered(t, ["v", "id"], "n").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(40), key=lambda i: (i % 3, i)), 1)}
    sums = {r["id"]: r["s"] for r in ordering.running(t, ["id"], {"s": F.col("v")}).collect()}
    assert sums == {i: sum(k % 3 for k in range(i)) for i in range(40)}
    with pytest.raises(Exception, match="duplicate id"):
        tables.assert_unique(t, "k").collect()
    assert tables.assert_unique(t, "id").count() == 40
    with pytest.raises(Exception, match="missing state"):
        tables.encoded(spark.createDataFrame([("s", "f", "nan")], "sample string, feature string, state string")).collect()
    labels = lambda rows: [r["label"] for r in tables.evaluation_labels(spark.createDataFrame([(x,) for x in rows], "f string"), "f").collect()]
    assert labels(["-1|a|b|s", "3|c|d|t"]) == ["a|b", "c|d"] and labels(["1|a|b|s", "c|d|t"]) == ["1|a|b", "c|d"] and labels(["q"]) == ["q"]
    with pytest.raises(Exception, match="empty part"):
        labels(["a||s"])


def test_tiles_of_contigs(spark):
    from helixmark.operators import annotation

    g = spark.createDataFrame([("a", "ACGTTGCAAC" * 7 + "GG"), ("b", "ACG"), ("c", "")], "contig string, seq string")
    seqs = {r["contig"]: r["seq"] for r in g.collect()}
    for flank, width in ((4, 10), (0, 7), (5, 100), (9, 8)):
        sites = [(c, p) for c in seqs for p in range(0, len(seqs[c]) + 2)]
        got = {(r["contig"], r["pos"]): r["context"] for r in annotation.contexts(spark.createDataFrame(sites, "contig string, pos long"), g, flank, width).collect()}
        assert got == {(c, p): "".join(s[(p - 1 + k) % len(s)] for k in range(-flank, flank + 1)) for c, s in seqs.items() for p in range(1, len(s) + 1)}
    parts = annotation.coding_parts(spark.createDataFrame([("a", 0, 0, 3, 60, 1), ("a", 1, 0, 2, 9, -1), ("a", 1, 1, 15, 40, -1)], "contig string, feature_order int, part_order int, start long, end long, strand int"))
    found = {r["feature_order"]: r["coding"] for r in annotation.coding_sequences(parts, g, 10).collect()}
    rc = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a = seqs["a"]
    assert found == {0: a[2:60], 1: rc(a[14:40]) + rc(a[1:9])}


def test_neighbourhoods_of_one_list(spark):
    """The whole list in one order, however many ranges it is sorted into."""
    import random

    from helixmark.operators import selection

    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 4000) if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, pos long").repartition(5)
    want, chain = {}, []
    for i, p in sorted(((i, p) for i, p in rows if p is not None), key=lambda x: (x[1], x[0])) + [(None, 10**9)]:
        if chain and p - chain[-1][1] > 6:
            for k, _ in chain:
                want[k] = frozenset(c for c, _ in chain) if len(chain) > 1 else None
            chain = []
        chain.append((i, p))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["group"] for r in selection.neighbourhoods(df, 6).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    members: dict = {}
    for i, g in got.items():
        members.setdefault(g, set()).add(i)
    assert len(got) == 500 and all((frozenset(members[got[i]]) if got[i] is not None else None) == want.get(i) for i, _ in rows)


def test_crossing_by_several_chunks(spark):
    samples = spark.createDataFrame([("a",), ("b",), (None,), ("d",)], "sample string")
    listed = spark.createDataFrame([(i, None if i % 4 else f"x{i}") for i in range(11)], "feature long, name string")
    for chunk in (3, 100):
        df = cohort.crossed(samples, listed, chunk)
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
        got = sorted(map(str, df.collect()))
        assert got == sorted(map(str, samples.crossJoin(listed).collect()))


def test_covering_blocks_of_any_level(spark):
    rng = random.Random(31)
    points = [(i, rng.choice("ab"), rng.randint(0, 5000)) for i in range(60)]
    for longest in (5, 300, 5000):
        blocks = [(rng.choice("ab"), s, s + rng.randint(-1, longest), o) for o, s in enumerate(rng.randint(0, 4000) for _ in range(80))]
        p = spark.createDataFrame(points, "id long, k string, pos long")
        b = spark.createDataFrame(blocks, "k string, start long, end long, ord long")
        got = {r["id"]: r["ord"] for r in joins.first_covering(p, b, ["k"], "pos", "start", "end", "ord", 10, 4).collect()}
        assert got == {i: min((o for kb, s, e, o in blocks if kb == k and s <= x <= e), default=None) for i, k, x in points}
    assert joins.first_covering(p, b.limit(0), ["k"], "pos", "start", "end", "ord", 10).where("ord IS NOT NULL").count() == 0


def test_tables_of_places_are_not_broadcast(spark):
    """Their files are small where their rows are many, so a broadcast would follow from the wrong size."""
    from helixmark.operators.lookup import call_lookup
    from helixmark.storage import materialise

    calls = materialise(spark.range(1000).selectExpr("id % 10 AS sample", "'F' AS chrom", "id AS pos", "'CALLED_REFERENCE' AS state", "'A' AS allele"), "test-calls")
    blocks = materialise(calls.selectExpr("sample", "chrom", "pos + 1 AS start", "pos + 3 AS end", "pos AS ord", "'C' AS ref"), "test-blocks")
    df = call_lookup(calls.selectExpr("sample", "chrom", "pos + 2 AS pos"), calls, blocks)
    assert df.where("match = 'gvcf_ref_block'").count() == 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_profile_scores_shuffle_a_sample_s_own_cells(spark):
    """A row that is shuffled is a cell of the matrix or a child's sum, never a cell of each child; features without a cell are asked for all the same."""
    cells = [("a", 1, 1.0), ("a", 2, None), ("a", 9, 1.0), ("b", 3, 0.0), ("c", 1, None)]
    m = spark.createDataFrame(cells, "sample string, feature int, value double")
    prof = spark.createDataFrame([("", c, f, x) for f in (1, 2, 3, 4) for c, x in (("p", 0.25), ("q", 1.0))] + [("p", "p|r", 1, 0.5)], "node string, child string, feature int, mean double")
    frontier = spark.createDataFrame([("a", ""), ("a", "p"), ("b", ""), ("c", ""), ("d", "")], "sample string, node string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = hierarchy.profile_scores(frontier, m, prof)
        got = {(r["sample"], r["node"], r["child"]): (r["score"], r["n"], r["asked"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    zero = {(s, "", c): (0.0, 0, 4) for s in "cd" for c in "pq"}
    assert got == zero | {("a", "", "p"): (0.25, 1, 4), ("a", "", "q"): (1.0, 1, 4), ("a", "p", "p|r"): (0.5, 1, 1), ("b", "", "p"): (0.75, 1, 4), ("b", "", "q"): (0.0, 1, 4)}
    assert not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("sample#") and ", feature#" in x.split(")")[0]]


def test_alias_lookup_shuffles_by_place(spark):
    """Calls have few contigs: no shuffle is keyed by the contig alone."""
    from helixmark.plans import extended

    out = extended.alias_lookup(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.split("hashpartitioning(")[1:]] and not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("chrom#") and "," not in x.split(", 6")[0]]


def test_tiers_take_one_aggregate(spark):
    """The first tier with a hit decides, with one shuffle of the hits; NULL is a value like any other."""
    req = spark.createDataFrame([(k,) for k in "abcdef"], "k string")
    one = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("e", None), ("f", None), ("f", "x")], "k string, v string")
    two = spark.createDataFrame([("a", "z"), ("c", "p"), ("c", "q"), ("b", "w")], "k string, v string")
    out = joins.tiered_lookup(req, [("one", one, True), ("two", two, False)], ["k"], ["v"])
    assert {r["k"]: (r["v"], r["match"]) for r in out.collect()} == {"a": ("x", "one"), "b": (None, "ambiguous_one"), "c": ("p", "two"), "d": (None, "absent"), "e": (None, "one"), "f": (None, "ambiguous_one")}
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
