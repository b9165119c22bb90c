import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixmark.llm import quality_classifier as C
from helixmark.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(df):
    for r in df.select("text", *[f"__hx_{c}" for c in R.COUNTS[:5]]).collect():
        assert tuple(r)[1:] == counts(r["text"])


def test_counts_equal_brute_force(documents):
    check(R.counted(documents))


def test_counts_of_edge_cases(edge, nothing):
    check(R.counted(edge))
    out = R.quality_report(edge)
    assert out.count() == edge.count() and "text" not in out.columns
    assert out.where("doc_id = 2").first()["base_failed"] is True
    assert len(set(out.columns)) == len(out.columns) and dict(out.dtypes)["n_words"] == "bigint"
    assert R.quality_report(nothing).count() == 0
    assert R.apply_rules(edge).where("kept").select("text").count() <= edge.count()


def test_buckets_are_ordered_and_near(spark):
    rows = spark.range(0, 200_000, 7).select("id", F.expr(R.bucket_sql("id")).alias("b"))
    rows = rows.select("id", "b", F.expr(R.value_sql("b")).alias("v")).toPandas()
    assert rows.b.is_monotonic_increasing
    assert ((rows.v <= rows.id) & (rows.id - rows.v <= rows.id / 32)).all()


def test_sketches_merge(documents):
    """The sketch of all is the sum of the sketches of parts."""
    f = R.counted(documents)
    whole = R.sketches(f)
    parts = R.sketches(f.where("doc_id % 2 = 0")).unionByName(R.sketches(f.where("doc_id % 2 = 1"))).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_outliers_of_their_group_go(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a") for i in range(300)]
    bad = [(1000, " ".join(f"w{j}###" for j in range(60)), "en", "a")]
    out = R.apply_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).toPandas()
    assert out[out.doc_id < 1000].kept.all()
    assert out[out.doc_id == 1000].rule.tolist() == ["symbols_pm"]


def test_groups_decide_by_their_size(spark):
    """A group's own quantiles count the more the larger it is; there is no size where the rule changes."""
    groups = (("big", 40, 5000), ("small", 40, 10), ("smaller", 40, 5), ("rest", 8, 50000))
    rows = [("en", src, m, 200 if m in R.DENOMINATORS else b, n) for src, b, n in groups for m in (*R.MEASURES, *R.DENOMINATORS)]
    got = {r["source"]: r["hi_symbols_pm"] for r in R.thresholds(spark.createDataFrame(rows, "lang string, source string, measure string, bucket long, n long")).collect()}
    assert got["rest"] < got["smaller"] < got["small"] < got["big"]


def test_classifier_finds_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = C.fit(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    got = C.score(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert ((got.score >= 0.3).astype(int) == got.quality).mean() > 0.95
    again = C.fit(docs.repartition(5), labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_classifier_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(5, 1), (5, 0), (2, 1), (None, 1), (4, None)], "doc_id long, label int")
    model = C.fit(edge, labels)
    out = C.score(edge, model).toPandas()
    assert len(out) == edge.count() and out.score.between(0, 1).all()
    assert C.score(nothing, model).count() == 0
    none = C.fit(edge, labels.limit(0))
    assert set(C.score(edge, none).toPandas().score) == {0.5}


def test_shapes_of_words():
    import random

    rng = random.Random(8)
    letters = "abzÀÉéßǅ日本ªⅣ٣19_-.,!#$%&\x01\x02ΑαЖж\u0301"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(20_000)]
    assert all(C.shape(w) == C._slow_shape(w) for w in words)


def test_ftrl_against_a_plain_loop():
    rows = [("good fine text here", 1), ("bad ### junk", 0), ("good words", 1), ("### ###", 0)]
    model = C.train(rows, passes=2)
    z, n, zb, nb, h = {}, {}, 0.0, 0.0, C.Hashes()
    weight = lambda zi, ni: 0.0 if abs(zi) <= C.L1 else -(zi - np.sign(zi) * C.L1) / ((C.BETA + ni**0.5) / C.ALPHA + C.L2)
    for _ in range(2):
        for text, y in rows:
            index = C.features(text, h).tolist()
            x = {i: float(np.float32(c / len(index))) for i, c in Counter(index).items()}
            w = {i: weight(z.get(i, 0.0), n.get(i, 0.0)) for i in x}
            b = -zb / ((C.BETA + nb**0.5) / C.ALPHA + C.L2)
            e = 1 / (1 + np.exp(-(sum(w[i] * x[i] for i in x) + b))) - y
            for i in x:
                g = e * x[i]
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / C.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
            s = ((nb + e * e) ** 0.5 - nb**0.5) / C.ALPHA
            zb, nb = zb + e - s * b, nb + e * e
    for i in z:
        assert abs(model.weights[i] - weight(z[i], n[i])) < 1e-5
