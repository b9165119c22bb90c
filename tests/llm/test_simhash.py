import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helixmark.llm import simhash as S


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, fps, distance=4):
    u = sorted(set(fps))
    up = {x: x for x in u}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(u, 2):
        if (a ^ b).bit_count() <= distance:
            up[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for f in fps]


def test_fingerprints_and_components(documents):
    out = S.near_duplicates(documents).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = [int(x) & (1 << 64) - 1 for x in out.fp]
    assert fps == [plain(texts[i]) for i in out.doc_id]
    assert out.component_id.tolist() == roots(out.doc_id.tolist(), fps)


def test_links_equal_brute_force_with_heavy_keys(spark):
    """Clusters of fingerprints around centres: chains of links, and keys that many share."""
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 100)}
    for c in list(fps)[:3]:
        for _ in range(250):
            fps.add(c ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    for masks in ([(0xFFFFF, 1), (0xFFFFF << 20, 0), (0xFFFFFF << 40, 1)], [(0xFFFF << 16 * k, 1 if k == 3 else 0) for k in range(4)]):
        for light, block, pivots in ((64, 2048, 16), (4, 16, 16), (4, 16, 1), (30, 50, 3), (100000, 10, 16)):
            found = S.links(nodes, masks, 4, light, block, pivots).collect()
            up = {f: f for f in fps}

            def find(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in found:
                a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
                assert (a ^ b).bit_count() <= 4
                up[find(a)] = find(b)
            got = {}
            for f in fps:
                got.setdefault(find(f), set()).add(f)
            want = {}
            for f, r in zip(fps, roots(range(len(fps)), fps)):
                want.setdefault(r, set()).add(f)
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_large_group_sends_no_more_probes(spark, monkeypatch):
    """Neither does a group of alike nodes make the design send all nodes' probes further, nor are they sent again for its heavy keys."""
    rng = np.random.default_rng(1)
    single = rng.integers(0, 1 << 63, 42000).astype(np.uint64)
    flipped = rng.integers(0, 64, (16000, 8))
    group = np.unique(single[0] ^ np.bitwise_or.reduce(np.uint64(1) << flipped.astype(np.uint64), axis=1))[:8000]
    sent = []
    for fps in (single, np.concatenate([single, group])):
        parts = S.design(list(range(64)), rng.permutation(fps)[: S.SAMPLE], len(fps))
        sent.append(sum(len(S.flips(m, t)) for m, t in parts))
    assert sent == [5, 5]
    plans = []
    plain_materialise = S.materialise

    def seen(df, name, few=False):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return plain_materialise(df, name, few)

    monkeypatch.setattr(S, "materialise", seen)
    nodes = spark.createDataFrame([(S.signed(int(f)),) for f in group[:300]], "fp long")
    S.links(nodes, [(0xFFFF << 16 * k, 1 if k == 3 else 0) for k in range(4)], light=30)
    assert "simhash-reached" in [name for name, _ in plans] and not [name for name, plan in plans if "flatten" in plan]


def test_thresholds_are_optimal_and_enough():
    rng = np.random.default_rng(6)
    cost = [[0.0, *np.cumsum(rng.random(5)).tolist()] for _ in range(4)]
    total, ts = S.allocate(cost)
    assert sum(t + 1 for t in ts) == 5
    from itertools import product

    assert abs(total - min(sum(c[k] for c, k in zip(cost, ks)) for ks in product(range(6), repeat=4) if sum(ks) == 5)) < 1e-12
    parts = S.design(list(range(64)), rng.integers(0, 1 << 63, 500).astype(np.uint64), 10**6)
    assert sum(t + 1 for _, t in parts) == 5
    for a, b in combinations([m for m, _ in parts], 2):
        assert a & b == 0


def test_components_of_a_path(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in S.components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert S.components(e.limit(0)).count() == 0


def test_edge_cases(edge, nothing):
    out = S.near_duplicates(edge).toPandas()
    assert len(out) == edge.count()
    assert out[out.doc_id.isin([1, 2, 3])].component_id.tolist() == [1, 1, 1]
    assert set(out[out.doc_id.isin([5, 6])].component_id) == {5} and set(out[out.doc_id.isna()].component_id) == {1, 5}
    kept = S.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 4, 5, 7, 8]
    assert S.near_duplicates(nothing).count() == 0 and S.deduplicate(nothing).count() == 0


def test_deduplication_by_row(spark):
    """Clashing doc_ids over different texts, repeated rows, nulls: one row of each component stays, whatever its id."""
    text = {k: " ".join(f"{k}{i * 7 % 31}x{i}" for i in range(600)) for k in "ABCDE"}
    near = text["A"] + " more"
    rows = [(3, "A", "en"), (5, "A", "en"), (5, "B", "en"), (7, "B", "en"), (8, "D", "en"), (8, "E", "en"), (8, "E", "de"), (8, "E", "de"), (None, "C", "en"), (None, "C", "en"), (None, "A", "en"), (9, None, "en"), (None, "", "fr")]
    docs = spark.createDataFrame([(i, text.get(t, t), x) for i, t, x in rows] + [(2, near, "en")], "doc_id long, text string, lang string")
    out = S.deduplicate(docs).collect()
    shown = sorted(str((r["doc_id"], r["text"])) for r in out)
    first = 2 if (S.fingerprint(near.encode()) ^ S.fingerprint(text["A"].encode())).bit_count() <= 4 else 3
    assert first == 2
    assert shown == sorted(map(str, [(2, near), (5, text["B"]), (8, text["D"]), (8, text["E"]), (None, text["C"]), (9, None)]))
    again = S.deduplicate(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    found = S.near_duplicates(docs).toPandas()
    assert len(found) == len(rows) + 1 and found.component_id.isna().sum() == 2
