"""The kernel map against the exact kernel, and a machine on rings that no line parts."""

import numpy as np
from pyspark.sql import functions as F

from helixmark.operators import kernels


def rows(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample long, x array<double>")


def test_map_approximates_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    df = rows(spark, x)
    assert abs(kernels.gamma_of(df) - 1 / (4 * x.var())) < 1e-9
    errors = []
    for most in (20, 80, 200):
        m = kernels.fit(df, most=most)
        assert len(m.landmarks) == most
        z = np.array([r["z"] for r in kernels.mapped(df, m).orderBy("sample").collect()])
        errors.append(abs(z @ z.T - kernels.rbf(x, x, m.gamma)).mean())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.02 and errors[2] < 1e-6
    assert (kernels.fit(df.repartition(5), most=20).landmarks == kernels.fit(df, most=20).landmarks).all()


def test_odd_rows(spark):
    same = rows(spark, np.ones((5, 3)))
    m = kernels.fit(same)
    assert len(m.landmarks) == 1 and m.gamma == 1.0
    assert kernels.mapped(same.limit(0), m).count() == 0


def test_held_out_accuracy_beside_the_exact_kernel(spark):
    rng = np.random.default_rng(7)
    n = 200
    y = np.arange(n) % 2
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1.0 + y + rng.normal(0, 0.12, n)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    wide = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "sample long, f_a double, f_b double").coalesce(1)
    labels = spark.createDataFrame([(i, "pq"[c]) for i, c in enumerate(y)], "sample long, label string")
    learned = labels.where("sample < 160")
    machine = kernels.train(wide, learned, ["a", "b"], c=10.0, most=40, iterations=25)
    got = {r["sample"]: r["predicted"] for r in kernels.predict(machine, wide, ["a", "b"]).collect()}
    right = np.mean([got[i] == "pq"[y[i]] for i in range(160, n)])
    # the exact kernel, by ridge regression on the classes
    k = kernels.rbf(x[:160], x[:160], machine.map.gamma)
    a = np.linalg.solve(k + 0.1 * np.eye(160), np.eye(2)[y[:160]])
    exact = np.mean((kernels.rbf(x[160:], x[:160], machine.map.gamma) @ a).argmax(1) == y[160:])
    assert right > 0.9 and right > exact - 0.05


def test_rows_and_labels_are_not_broadcast(spark, tmp_path):
    """Files of copies are small, so their size would have Spark broadcast all labels, at each of the jobs."""
    wide = spark.range(400).select(F.col("id").alias("sample"), (F.col("id") % 7).cast("double").alias("f_a"), (F.col("id") % 2).cast("double").alias("f_b"))
    wide.write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    before = max(executions(), default=-1)
    machine = kernels.train(wide, wide.select("sample", F.when(F.col("f_b") == 1, "p").otherwise("q").alias("label")), ["a", "b"], most=8, iterations=2)
    plans = [plan for k, plan in executions().items() if k > before]
    assert machine.classes == ["p", "q"]
    assert sum("Join" in plan for plan in plans) == 1 and not [plan for plan in plans if "BroadcastExchange" in plan]


def test_query_leaves_landmarks_and_iterations_to_the_operator(spark, monkeypatch):
    from helixmark.plans import catalogue

    given = []
    monkeypatch.setattr(kernels, "train", lambda wide, labels, features, **more: given.append(more))
    monkeypatch.setattr(kernels, "predict", lambda machine, wide, features: wide.select("sample"))
    catalogue.QUERIES["kernel_machine"](spark, "/root/testdata/sf0.001")
    assert given == [{}]


def test_classes_of_few_rows_are_fitted_side_by_side(spark, monkeypatch):
    """The steps of a fit are jobs over no more partitions than the numbers fill."""
    seen, fit = [], kernels.C.OneVsRest.fit
    monkeypatch.setattr(kernels.C.OneVsRest, "fit", lambda self, data: seen.append((data.rdd.getNumPartitions(), self.getParallelism())) or fit(self, data))
    df = rows(spark, np.arange(40.0).reshape(20, 2)).repartition(4)
    wide = df.select("sample", F.col("x")[0].alias("f_0"), F.col("x")[1].alias("f_1"))
    kernels.train(wide, wide.select("sample", (F.col("sample") % 2).cast("string").alias("label")), [0, 1], iterations=2)
    assert seen == [(1, 8)]
