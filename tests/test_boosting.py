"""Boosting against a single-process version with the same bins."""

import numpy as np

from helixmark.operators import boosting as b


def single(x, y, k, rounds, depth, rate, l2, least_child):
    """(margins, trees) by loops over a matrix with nan for missing; every value is a cut."""
    n, m = x.shape
    f = np.zeros((n, k))
    trees = []
    for _ in range(rounds):
        e = np.exp(f - f.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        g = np.round((p - np.eye(k)[y]) * b.SCALE)
        h = np.round(np.maximum(2 * p * (1 - p), 1e-16) * b.SCALE)
        add = np.zeros((n, k))
        for c in range(k):
            node = np.zeros(n, int)
            splits = {}
            for level in range(depth):
                for at in sorted(set(node[node >= 2**level - 1])):
                    rows = np.flatnonzero(node == at)
                    G, H = g[rows, c].sum(), h[rows, c].sum()
                    part = lambda s, t: (s / b.SCALE) ** 2 / (t / b.SCALE + l2)
                    best = None
                    for j in range(m):
                        v = x[rows, j]
                        for cut in np.unique(v[~np.isnan(v)]):
                            for left in (True, False):
                                goes = np.where(np.isnan(v), left, v <= cut)
                                gl, hl = g[rows[goes], c].sum(), h[rows[goes], c].sum()
                                if hl < least_child * b.SCALE or H - hl < least_child * b.SCALE:
                                    continue
                                gain = part(gl, hl) + part(G - gl, H - hl) - part(G, H)
                                if gain > b.LEAST_GAIN and (best is None or (-gain, j, cut, not left) < best[0]):
                                    best = (-gain, j, cut, not left), goes
                    if best:
                        splits[at] = best[0][1:]
                        node[rows] = np.where(best[1], 2 * at + 1, 2 * at + 2)
            for at in set(node):
                rows = np.flatnonzero(node == at)
                add[rows, c] = -rate * (g[rows, c].sum() / b.SCALE) / (h[rows, c].sum() / b.SCALE + l2)
            trees.append(splits)
        f += add
    return f, trees


def data(seed, n=60, m=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.integers(0, 2, (n, m)).astype(float)
    x[:, 0] = np.where(rng.random(n) < 0.8, y == 0, x[:, 0])
    x[:, 1] = np.where(rng.random(n) < 0.7, y, rng.integers(0, 3, n))
    x[rng.random((n, m)) < 0.15] = np.nan
    x[3] = np.nan
    return x, y


def test_equals_a_single_process_version(spark):
    x, y = data(1)
    rows = [(i, f"f{j}", None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    matrix = spark.createDataFrame(rows, "sample long, feature string, value double").repartition(5)
    labels = spark.createDataFrame([(i, "abc"[c]) for i, c in enumerate(y)] + [(999, None)], "sample long, label string")
    model = b.fit(matrix, labels, rounds=3, depth=2, rate=0.3)
    want, trees = single(x, y, 3, 3, 2, 0.3, 1.0, 1.0)
    got = {}
    for r in model.trees.where("feature IS NOT NULL").collect():
        got.setdefault((r["round"], r["class"]), {})[r["node"]] = (int(r["feature"][1:]), r["threshold"], not r["missing_left"])
    assert [got.get((t // 3, t % 3), {}) for t in range(9)] == trees and sum(map(len, trees)) > 12
    # a sample without any value has no row to score
    found = {r["sample"]: r["margins"] for r in b.margins(matrix, model.trees, 3, 3, 2).collect()}
    assert set(found) == set(range(60)) - {3} and max(abs(np.array(found[i]) - want[i]).max() for i in found) < 1e-12
    p = {r["sample"]: r for r in b.predict(matrix, model).collect()}
    assert np.mean(["abc".index(p[i]["predicted"]) == y[i] for i in p]) > 0.75
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["support"] == max(r["probabilities"]) for r in p.values())
    assert {r["feature"] for r in b.importances(model).collect()} >= {"f0", "f1"}


def test_cuts(spark):
    rows = [(i, "many", float(i)) for i in range(1000)] + [(i, "few", float(i % 3)) for i in range(10)] + [(1, "none", None)]
    c = {r["feature"]: r["cuts"] for r in b.cuts(spark.createDataFrame(rows, "sample long, feature string, value double"), 16).collect()}
    assert c["few"] == [0.0, 1.0, 2.0] and len(c["many"]) == 16 and c["many"][-1] == 999.0 and "none" not in c


def test_trees_in_a_task_are_those_of_spark(spark):
    """Without a share of the rows, margins of 0/1 features are those of Spark's boosted trees, for rows that weren't fitted too."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    x = (rng.random((160, 7)) < 0.5).astype(np.uint8)
    y = np.where((x[:, 0] + x[:, 1] + 0.5 * x[:, 2] + rng.random(160)) > 1.8, 1.0, -1.0)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t > 0)) for i, (r, t) in enumerate(zip(x, y))], "i int, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=4, maxDepth=2, stepSize=0.05, seed=1).fit(df.where("i < 120"))
    want = [r["m"] for r in model.transform(df).orderBy("i").select(vector_to_array("rawPrediction")[1].alias("m")).collect()]
    got = b.two_classes(x, y, np.arange(120), 4, 2, 0.05, 1.0)
    assert np.allclose(got, want, atol=1e-6)


def test_recommendation_runs_every_candidate(spark, monkeypatch):
    from helixmark.operators import models
    from helixmark.plans import catalogue

    asked = []
    monkeypatch.setattr(models, "search", lambda wide, labels, features, names=None, *more: asked.append(names) or [("x", 0.5)])
    assert catalogue.QUERIES["model_recommendation"](spark, "/root/testdata/sf0.001").count() == 2 and asked == [None, None]


def test_boosted_candidate_learns(spark):
    from pyspark.sql import functions as F

    from helixmark.operators import models

    ids = spark.range(90)
    wide = ids.select(F.col("id").alias("sample"), *[((F.col("id") % 3 == k) if k < 3 else (F.xxhash64("id") % 2 == 0)).cast("double").alias(f"f_{k}") for k in range(4)])
    labels = ids.select(F.col("id").alias("sample"), F.element_at(F.array(*[F.lit(c) for c in "abc"]), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    assert models.search(wide, labels, [0, 1, 2, 3], ["boosted_trees"]) == [("boosted_trees", 1.0)]
