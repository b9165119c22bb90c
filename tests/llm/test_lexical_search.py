import math
import random
import re
from collections import Counter

import numpy as np

from helixmark.llm import lexical_search as ls

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(t):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(TERM, t or "")]


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, t in items:
        scores = []
        for d, c in counted:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(t) if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, block_docs=ls.BLOCK_DOCS, block_words=ls.BLOCK_WORDS, **options):
    i = ls.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block_docs, block_words)
    return sorted(map(tuple, ls.search(i, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "é", "Straße", "日本", "a1", "B", *[f"w{k}" for k in range(60)]]
    text = lambda most: "".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.randint(0, most)))
    docs = [(k, text(rng.choice([5, 50, 400]))) for k in range(n)]
    docs += [(1000 + k, docs[0][1] + " w7 w8") for k in range(25)] + [(7, docs[7][1])] * 3  # ties, repeated rows
    return docs + [(None, docs[0][1]), (None, None), (2000, None), (2001, ""), (2002, " . ")], [(k, text(30)) for k in range(20)] + [(50, None), (51, ""), (52, "absent"), (3, "w7 w7 w8"), (53, docs[0][1] + " w7 w8")]


def test_against_brute_force(spark):
    docs, items = corpus(3, 300)
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, terms_per_pass=30) == want  # several passes
    assert got(spark, docs, items, k=3) == brute(docs, items, 3)


def test_small_blocks_change_nothing(spark):
    docs, items = corpus(4, 120)
    assert got(spark, docs, items, block_docs=7, block_words=300) == brute(docs, items)


def test_bytes_bound_impacts():
    x = np.arange(ls.TOP, dtype=np.int64)
    b = ls.to_bytes(x)
    assert (ls.UPPER[b] >= x).all() and (ls.LOWER[b] <= x).all() and b.max() == ls.STEPS


def test_bounds_leave_few_documents_to_rescore():
    rng = random.Random(6)
    block = ls._Block()
    for k in range(2000):
        block.add(k, [f"w{min(int(rng.expovariate(0.02)), 400)}".encode() for _ in range(rng.randint(20, 300))])
    import pyarrow as pa

    row = dict(zip(("docs", "m", "terms", "offsets", "doc", "bytes", "tf"), block.row(2000, sum(block.sizes))))
    row |= {"docs": pa.array(row["docs"]), "terms": pa.array(row["terms"], pa.binary())}
    names = sorted(block.vocabulary)
    best = ls.Best(ls.Queries(names, [([3, 50, 90, 200], [4000, 2000, 3000, 900])]), 10)
    best.add(row)
    assert len(best.found[0]) == 10 and best.rescored < 100


def test_edge_cases(spark, edge, nothing):
    items = spark.createDataFrame([(1, "alpha beta word1x1", "x"), (None, "delta", "y"), (2, None, "z")], "item_id long, text string, score string")
    out = ls.search(ls.index(edge), items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert {(r["item_id"], r["rank"], r["doc_id"]) for r in out.collect()} >= {(None, 1, 4)}
    assert ls.search(ls.index(nothing), items).count() == 0
    assert ls.search(ls.index(edge), items.limit(0)).count() == 0
