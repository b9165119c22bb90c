import pytest
from pyspark.sql import functions as F

from helixmark.operators import annotation, models, traverse
from helixmark.sources import bundle, genbank


@pytest.fixture(scope="module")
def training(spark):
    rows = [(i, f, float((i % 2 == 0) if f == 1 else (i * f) % 3 == 0)) for i in range(40) for f in (1, 2, 3)]
    m = spark.createDataFrame(rows, "sample long, feature long, value double")
    labels = spark.range(40).select(F.col("id").alias("sample"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    return models.table(m, [1, 2, 3]), labels


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "logistic_regression", "naive_bayes", "linear_svc"])
def test_models_learn(training, name):
    wide, labels = training
    model = models.train(wide, labels, [1, 2, 3], models.ESTIMATORS[name]())
    scored = models.predict(model, wide).join(labels, "sample")
    assert models.balanced_accuracy(scored) > 0.9
    if name in ("random_forest", "decision_tree", "logistic_regression"):
        assert models.importances(model, [1, 2, 3])[0][0] == "1"


def test_gate_folds_and_sizes(training):
    wide, labels = training
    verdicts = wide.select("sample", F.when(F.col("sample") < 5, "abstain").otherwise("predict").alias("verdict"))
    model = models.train(wide, labels, [1, 2, 3], models.ESTIMATORS["decision_tree"]())
    assert models.predict(model, wide, verdicts).where("predicted IS NULL").count() == 5
    assert {r["count"] for r in models.folds(labels, 4).groupBy("label", "fold").count().collect()} == {5}
    assert models.accuracy_by_size(wide, labels, [1, 2, 3], [1, 9], models.ESTIMATORS["decision_tree"], 2) == [(1, 1.0)]


def test_one_hot(spark):
    s = spark.createDataFrame([("a", "m", "A"), ("a", "n", None)], "sample string, marker string, state string")
    assert [tuple(r) for r in models.one_hot(s).collect()] == [("a", "m=A", 1.0)]


def test_bundle(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    bundle.save(spark, str(tmp_path), {"t": t}, {"k": 1})
    tables, settings = bundle.load(spark, str(tmp_path))
    assert settings == {"k": 1} and tables["t"].count() == 2
    assert bundle.content_hash(t) == bundle.content_hash(t.orderBy(F.desc("x"))) != bundle.content_hash(t.limit(1))
    t.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/tables/t")
    with pytest.raises(ValueError):
        bundle.load(spark, str(tmp_path))


def test_stage_checkpoint(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert bundle.staged(spark, str(tmp_path), "s", key, build).count() == 3
    assert len(made) == 2


def test_registry_as_rows():
    tree = {"label_column": "L1", "features": ["f"], "children": {"B": {"status": "constant", "constant": "x"}, "A": {"label_column": "L2", "children": {"C": {}}}}}
    assert [(n, s, c) for n, _, s, c, _ in bundle.flattened(tree)] == [("", "success", None), ("A", "success", None), ("A|C", "success", None), ("B", "constant", "x")]


GB = """LOCUS       X1   30 bp
DEFINITION  a test
            record.
VERSION     X1.1
FEATURES             Location/Qualifiers
     gene            1..9
     CDS             join(1..3,7..9)
                     /gene="g1"
     CDS             complement(10..15)
                     /locus_tag="t2"
ORIGIN
        1 atgaaataac ccgggtttac gtacgtacgt
//
"""


def test_genbank_and_annotation(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GB)
    seq, parts = genbank.sequences(spark, str(tmp_path)), genbank.coding_parts(spark, str(tmp_path))
    r = seq.first()
    assert (r["contig"], r["description"], len(r["seq"])) == ("X1.1", "a test record.", 30)
    assert [tuple(x)[1:] for x in parts.orderBy("feature_order", "part_order").collect()] == [(0, 0, 1, 3, 1, "g1"), (0, 1, 7, 9, 1, "g1"), (1, 0, 10, 15, -1, "t2")]
    snps = spark.createDataFrame([("X1.1", 8, "A", "G"), ("X1.1", 5, "A", "C"), ("X1.1", 5, "G", "C"), ("X1.1", 99, "A", "C"), ("X1.1", 15, "G", "A")], "contig string, pos long, ref string, alt string")
    got = {(r["pos"], r["ref"]): (r["region"], r["codon"], r["alt_codon"], r["effect"]) for r in annotation.annotate(snps, parts, seq.select("contig", "seq"), 5).collect()}
    assert got[8, "A"] == ("coding", "TAA", "TGA", "synonymous")
    assert got[5, "A"][0] == "non_coding" and got[5, "G"][0] == "ref_mismatch" and got[99, "A"][0] == "out_of_range"
    assert got[15, "G"] == ("coding", "CCC", "TCC", "missense")


def test_two_level_routing(spark):
    s = spark.createDataFrame([("a", "x"), ("b", "y")], "sample string, level1 string")
    g = spark.createDataFrame([("x", "g")], "level1 string, grp string")
    m = spark.createDataFrame([("group", "g", "own"), ("binary", None, "bin")], "kind string, grp string, model string")
    assert {r["sample"]: (r["model"], r["tier"]) for r in traverse.tiered_payload(s, g, m).collect()} == {"a": ("own", "group"), "b": ("bin", "binary")}


def test_search_and_gain(training):
    """Candidates of one problem: scored by folds, in order; nearest neighbours against brute force; the fallback without folds."""
    wide, labels = training
    got = models.search(wide, labels, [1, 2, 3], ["naive_bayes", "decision_tree", "nearest_neighbours"], 4)
    assert [n for n, _ in got][0] in ("decision_tree", "naive_bayes") and all(s is not None and s >= 0.9 for n, s in got if n != "nearest_neighbours")
    rows = {r["sample"]: [int(r[f"f_{k}"]) for k in (1, 2, 3)] for r in wide.collect()}
    fold = {r["sample"]: (r["fold"], r["label"]) for r in models.folds(labels, 4).collect()}
    of = models.neighbours(40)
    per: dict = {}
    for i, x in rows.items():
        others = sorted((sum(a != b for a, b in zip(x, y)) / 3, j) for j, y in rows.items() if fold[j][0] != fold[i][0])[:of]
        votes: dict = {}
        for d, j in others:
            votes[fold[j][1]] = votes.get(fold[j][1], 0) + 1 / (d + 1e-9)
        best = min(votes, key=lambda k: (-round(votes[k], 6), k))
        per.setdefault(fold[i], []).append(best == fold[i][1])
    recall = {k: sum(v) / len(v) for k, v in per.items()}
    want = sum(sum(r for (f, _), r in recall.items() if f == k) / 2 for k in range(4)) / 4
    assert dict(got)["nearest_neighbours"] == pytest.approx(want)
    assert models.nonlinear_gain([("decision_tree", 0.9), ("naive_bayes", 0.7), ("logistic_regression", None)]) == pytest.approx(0.2)
    alone = labels.withColumn("label", F.when(F.col("sample") == 0, "x").otherwise("y"))
    assert models.search(wide, alone, [1, 2, 3]) == [("naive_bayes", None)]
    with pytest.raises(ValueError):
        models.search(wide, labels, [1, 2, 3], ["magic"])
    assert set(models.candidates(models.context_of(labels, 3))) == {"logistic_regression", "linear_svc", "random_forest", "decision_tree", "perceptron", "nearest_neighbours", "naive_bayes", "boosted_trees"}


def test_tree_paths(training):
    """Each sample's path holds for it, and its leaf says what the model predicts."""
    wide, labels = training
    model = models.train(wide, labels, [1, 2, 3], models.ESTIMATORS["decision_tree"]())
    said = {r["sample"]: r["predicted"] for r in models.predict(model, wide).collect()}
    values = {r["sample"]: r.asDict() for r in wide.collect()}
    out = models.tree_paths(model, wide, [1, 2, 3]).collect()
    assert len(out) == 40
    for r in out:
        assert r["predicted"] == said[r["sample"]]
        for c in filter(None, r["path"].split("; ")):
            f, sign, t = c.split(" ")
            assert (values[r["sample"]][f"f_{f}"] <= float(t)) == (sign == "<=")


def test_stored_models(spark):
    symbols = spark.createDataFrame([("a", "f", "X"), ("a", "g", "nd"), ("a", "h", None), ("b", "f", "1"), ("b", "g", "Q")], "sample string, feature string, state string")
    markers = spark.createDataFrame([("f", "c", ["1", "2"]), ("g", "t", ["T"]), ("h", "", None)], "feature string, common string, known array<string>")
    shown = lambda kind: {(r["sample"], r["feature"]): r["state"] for r in models.imputed_symbols(symbols, markers, kind).collect()}
    assert shown("character") == {("a", "f"): "1", ("a", "g"): "T", ("a", "h"): "N", ("b", "f"): "1", ("b", "g"): "T", ("b", "h"): "N"}
    assert shown("binary")["a", "h"] == "1" and shown("binary")["a", "g"] == "T"


def test_models_of_the_queries(spark):
    """Fitted models have no SQL: every sample is predicted, better than by its largest class, and reruns agree."""
    from helixmark.plans import extended

    d = "/root/testdata/sf0.01"
    labels = {r["sample"]: r["label"] for r in extended._training(spark, d)[1].collect()}
    chance = max(list(labels.values()).count(x) for x in set(labels.values())) / len(labels)
    for name in ("random_forest", "logistic_regression", "decision_tree_gated"):
        out = getattr(extended, name)(spark, d).collect()
        given = [r for r in out if r["predicted"] is not None]
        assert len(out) == len(labels) and len(given) == (len(out) if name != "decision_tree_gated" else sum(k % 3 != 0 for k in labels))
        assert sum(r["predicted"] == labels[r["sample"]] for r in given) / len(given) > 1.5 * chance
        assert sorted(map(str, out)) == sorted(map(str, getattr(extended, name)(spark, d).collect()))


def test_recommendation_over_all_levels(spark, monkeypatch):
    from helixmark.plans import extended

    seen = []
    monkeypatch.setattr(models, "search", lambda wide, labels, features, names=None, k=3: seen.append((labels.select("label").distinct().count(), names, k)) or [("naive_bayes", 0.5)])
    out = extended.model_recommendation(spark, "/root/testdata/sf0.01").collect()
    assert [(r["level"], r["model"]) for r in out] == [("region", "naive_bayes"), ("nation", "naive_bayes")]
    assert seen[0][0] == 5 and seen[1][0] > 5 and {x[2] for x in seen} == {3}


def test_fits_read_one_partition_a_core(spark):
    """A fit is a job an iteration: its partitions follow the cores and the size of the table, not the shuffle partitions."""
    from pyspark.ml.classification import NaiveBayes

    seen = []

    class Watched(NaiveBayes):
        def fit(self, data):
            seen.append((data.rdd.getNumPartitions(), [c for c in data.columns if c.startswith("f_")]))
            return super().fit(data)

    wide = spark.createDataFrame([(i, float(i % 2), float(i % 3 == 0)) for i in range(60)], "sample int, f_1 double, f_2 double").repartition(30)
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "sample int, label string")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        score = models.cross_validate(wide, labels, [1, 2], lambda: Watched(modelType="bernoulli"), 3)
        found = models.search(wide, labels, [1, 2], ["naive_bayes", "nearest_neighbours"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert score == 1.0 and dict(found)["naive_bayes"] == 1.0
    assert seen == [(spark.sparkContext.defaultParallelism, [])] * 3


def test_variants_of_a_long_contig(spark, monkeypatch):
    """Places don't carry their contig: work grows with the letters, not with their square."""
    import threading

    from helixmark.plans import extended

    n = 1_200_000
    one = spark.range(1).select(F.lit("c").alias("contig"), F.expr(f"substring(repeat('ACGTTGCA', {n // 8}), 1, {n})").alias("seq"))
    monkeypatch.setattr(extended, "_genome", lambda s, d: one)
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        snps = extended._snps(spark, "")[1]
        got = snps.agg(F.count("*"), F.sum("pos"), F.min("pos"), F.max("pos"), F.sum(F.when(F.col("ref") == "N", 1))).first()
    finally:
        late.cancel()
    want = [k * 3 - 2 + k % 3 for k in range(1, n // 3 + 1)]
    assert tuple(got) == (len(want), sum(want), want[0], want[-1], len(want) // 20)


def test_query_walk_writes_sums_not_cells(spark, monkeypatch):
    """Cells are samples times nodes times features; only what they add up to is written, and the levels."""
    from helixmark.operators import evidence
    from helixmark.plans import wider

    seen = []
    for module in (traverse, evidence):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, few=False, real=real: seen.append(name) or real(df, name, few))
    wider.query_walk(spark, "/root/testdata/sf0.001")
    assert seen == ["walk-evidence", "walk-level"]
