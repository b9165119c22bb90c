"""Models fitted with Spark ML to long matrices: scores, importances, cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting, cohort, ordering, stats

#: Estimators by name; kernels.py and boosting.py have machines of their own.
ESTIMATORS = {
    "random_forest": lambda: C.RandomForestClassifier(numTrees=50, seed=1),
    "decision_tree": lambda: C.DecisionTreeClassifier(seed=1),
    "logistic_regression": lambda: C.LogisticRegression(family="multinomial", regParam=0.01, maxIter=50),
    "naive_bayes": lambda: C.NaiveBayes(modelType="bernoulli", smoothing=1.0),
    "linear_svc": lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=30, regParam=0.01)),
    "boosted_trees": lambda: C.OneVsRest(classifier=C.GBTClassifier(maxIter=10, seed=1)),
    "factorisation_machine": lambda: C.OneVsRest(classifier=C.FMClassifier(maxIter=30, seed=1)),
}
#: Candidates of a model search whose decision is linear in the features.
LINEAR = ("logistic_regression", "linear_svc", "naive_bayes")
#: Numbers in a partition of the table that a cross-validation reads.
PART_CELLS = 8_000_000
#: Numbers in a partition that the fits of a search read, as each step of a fit is a job over all of them.
STEP_CELLS = 2_000_000
#: 0/1 numbers, a byte each, that a task may hold: up to here each fold and class is boosted in a task of its own, beyond by Spark's distributed trees.
TASK_CELLS = 100_000_000


@dataclass(frozen=True)
class Context:
    """What the parameters of a candidate depend on."""

    n_samples: int
    n_features: int
    n_classes: int
    imbalance: float
    data_type: str = "binary"


def context_of(labels: DataFrame, n_features: int, data_type: str = "binary") -> Context:
    n = labels.groupBy("label").count().agg(F.sum("count"), F.count("*"), F.max("count"), F.min("count")).first()
    return Context(int(n[0] or 0), n_features, int(n[1]), float(n[2] / max(1, n[3])) if n[1] else float("nan"), data_type)


def neighbours(n_samples: int) -> int:
    """An odd number near the root of the samples, from 3 to 15."""
    k = min(15, max(3, round(n_samples**0.5)))
    return k if k % 2 else k - 1


def boosting_size(c: Context) -> tuple[int, int]:
    """Rounds and levels of boosted trees."""
    return (200, 3) if c.n_samples < 100 else (400, 4) if c.n_samples < 1000 else (600, 6)


def candidates(c: Context) -> dict:
    """Eight candidates, as a function that makes an estimator from the numbers of features and classes (None: nearest neighbours, which aren't fitted), with parameters by the size of the problem."""
    trees, (rounds, deep) = 500 if c.n_samples >= 500 else 300, boosting_size(c)
    depth = max(3, min(20, math.ceil(math.log2(max(2, c.n_samples))) + math.ceil(math.log2(max(2, c.n_classes)))))
    hidden = (64, 32) if c.n_samples >= 200 and c.n_features >= 64 else (64,)
    return {
        "logistic_regression": lambda f, k: C.LogisticRegression(family="multinomial", regParam=1.0 / max(1, c.n_samples), maxIter=1500),
        "linear_svc": lambda f, k: C.OneVsRest(classifier=C.LinearSVC(maxIter=100, regParam=1.0 / max(1, c.n_samples)), parallelism=4),
        "random_forest": lambda f, k: C.RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=1),
        "decision_tree": lambda f, k: C.DecisionTreeClassifier(maxDepth=depth, seed=1),
        "perceptron": lambda f, k: C.MultilayerPerceptronClassifier(layers=[f, *hidden, k], seed=1, maxIter=1000),
        "nearest_neighbours": None,
        "naive_bayes": lambda f, k: C.NaiveBayes(modelType="bernoulli" if c.data_type == "binary" else "multinomial", smoothing=1.0),
        "boosted_trees": lambda f, k: C.OneVsRest(classifier=C.GBTClassifier(maxIter=rounds, maxDepth=deep, stepSize=0.05, subsamplingRate=0.9, seed=1)),
    }


def fallback(c: Context) -> str:
    """What is recommended where no level can be cross-validated."""
    return "naive_bayes" if c.n_samples < 50 else "random_forest"


def perceptron(n_features: int, n_classes: int, hidden: tuple[int, ...] = (16,)):
    return C.MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], seed=1, maxIter=60)


def table(matrix: DataFrame, features: list, fill: float = 0.0) -> DataFrame:
    """Wide rows (sample, f_<feature>...) of a long matrix for a given list of features; NULL is filled."""
    names = [f"f_{f}" for f in features]
    wide = cohort.wide(matrix.withColumn("feature", F.concat(F.lit("f_"), "feature")), names)
    return wide.fillna(fill, names)


def one_hot(symbols: DataFrame) -> DataFrame:
    """(sample, feature, value) with a feature `marker=state` for each state of rows (sample, marker, state)."""
    return symbols.where("state IS NOT NULL").select("sample", F.concat_ws("=", "marker", "state").alias("feature"), F.lit(1.0).alias("value"))


def train(wide: DataFrame, labels: DataFrame, features: list, estimator) -> PipelineModel:
    """A pipeline from wide rows to the predicted label's name; labels: (sample, label)."""
    data = wide.join(labels, "sample")
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(data)
    assemble = VectorAssembler(inputCols=[f"f_{f}" for f in features], outputCol="__x")
    model = estimator.setLabelCol("__y").setFeaturesCol("__x")
    return Pipeline(stages=[index, assemble, model, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]).fit(data)


def predict(model: PipelineModel, wide: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(sample, predicted, support); samples whose verdict (sample, verdict) is abstain have NULL for both."""
    stages = model.stages[1:]
    df = wide
    for s in stages:
        df = s.transform(df)
    support = F.array_max(vector_to_array("probability")) if "probability" in df.columns else F.lit(None).cast("double")
    df = df.select("sample", "predicted", support.alias("support"))
    if verdicts is None:
        return df
    ok = F.col("verdict") == "predict"
    return df.join(verdicts.select("sample", "verdict"), "sample", "left").select("sample", F.when(ok, F.col("predicted")).alias("predicted"), F.when(ok, F.col("support")).alias("support"))


def importances(model: PipelineModel, features: list) -> list[tuple[str, float]]:
    """(feature, importance), most important first; one-hot features `marker=state` are summed by marker."""
    inner = model.stages[2]
    if hasattr(inner, "featureImportances"):
        values = inner.featureImportances.toArray()
    elif hasattr(inner, "coefficientMatrix"):
        values = abs(inner.coefficientMatrix.toArray()).mean(axis=0)
    else:
        return []
    total: dict[str, float] = {}
    for f, v in zip(features, values):
        base = str(f).split("=")[0]
        total[base] = total.get(base, 0.0) + float(v)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))


def contributions(matrix: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(sample, class, feature, contribution) of a linear model given as a table (class, feature, coef)."""
    return matrix.where("value IS NOT NULL").join(coefficients, "feature").select("sample", "class", "feature", (F.col("coef") * F.col("value")).alias("contribution"))


def folds(labels: DataFrame, k: int) -> DataFrame:
    """labels (sample, label) with a fold, dealt in turn within each label."""
    return labels.withColumn("fold", (F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.col("sample").cast("string")))) - 1) % k)


def balanced_accuracy(scored: DataFrame) -> float:
    """Mean recall over labels of rows (label, predicted)."""
    return float(scored.groupBy("label").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("r")).agg(F.avg("r")).first()[0])


def learning_table(wide: DataFrame, labels: DataFrame, features: list, k: int) -> DataFrame:
    """(sample, label, fold, __x): what every fit of a cross-validation reads, for the caller to persist.

    Features are assembled once, not by each fit. An iteration of a fit is a job over all partitions, so there is one a core, or more where one
    would have over `PART_CELLS` numbers. Rows have a place of their own, so bootstraps draw the same rows at each rerun.
    """
    x = VectorAssembler(inputCols=[f"f_{f}" for f in features], outputCol="__x").transform(wide).select("sample", "__x")
    own = folds(labels, k)
    parts = max(wide.sparkSession.sparkContext.defaultParallelism, -(-labels.count() * len(features) // PART_CELLS))
    return x.join(own, "sample").select("sample", "label", "fold", "__x").repartition(parts, "sample").sortWithinPartitions("sample")


def fold_score(data: DataFrame, fold: int, estimator) -> float:
    """Balanced accuracy in one fold of a learning_table, fitted to the others."""
    rest = data.where(F.col("fold") != fold)
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(rest)
    model = estimator.setLabelCol("__y").setFeaturesCol("__x").fit(index.transform(rest))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return balanced_accuracy(named.transform(model.transform(data.where(F.col("fold") == fold))))


def cross_validate(wide: DataFrame, labels: DataFrame, features: list, make, k: int = 3) -> float:
    data = learning_table(wide, labels, features, k).persist()
    try:
        return sum(fold_score(data, i, make()) for i in range(k)) / k
    finally:
        data.unpersist()


def cross_validate_neighbours(data: DataFrame, of: int = 5) -> float:
    """As cross_validate over a learning_table for the `of` nearest neighbours by Hamming distance over 0/1 features."""
    rows = data.select(F.col("sample").alias("id"), "label", "fold", vector_to_array("__x").cast("array<int>").alias("bits"))
    near = stats.nearest(stats.vector_sets(rows.select("id", "bits", "fold")), of, apart="fold")
    got = stats.votes(near, rows.select("id", "label", "fold")).select("id", "predicted")
    per = rows.join(got, "id").groupBy("fold", "label").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("r"))
    return float(per.groupBy("fold").agg(F.avg("r").alias("r")).agg(F.avg("r")).first()[0])


def cross_validate_boosted(data: DataFrame, k: int, rounds: int, depth: int, rate: float = 0.05, share: float = 0.9, fit: Callable = boosting.two_classes) -> float:
    """As cross_validate over a learning_table of 0/1 features for boosted trees, one class against the rest: each fold and class is a task, which holds the table as bytes."""
    classes = [r[0] for r in data.select("label").distinct().orderBy("label").collect()]  # a row a class
    width = data.select(F.max(F.size(vector_to_array("__x")))).first()[0]
    kind = dict(data.dtypes)["sample"]

    @F.pandas_udf("binary")
    def bits(x: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(np.asarray(v) > 0).tobytes() for v in x], dtype=object)

    rows = data.select("sample", "label", "fold", bits(vector_to_array("__x")).alias("x")).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    rows = rows.select("sample", "fold", "held", "class", (F.col("label") == F.col("class")).alias("y"), "x")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        held = (pdf["fold"] == pdf["held"]).to_numpy()
        x = np.unpackbits(np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(len(pdf), -1), axis=1, count=width)
        m = fit(x, np.where(pdf["y"], 1.0, -1.0), np.flatnonzero(~held), rounds, depth, rate, share)
        return pdf.loc[held, ["sample", "class"]].assign(margin=m[held])

    wide = 4 * data.sparkSession.sparkContext.defaultParallelism  # more than cores, as hashes deal few problems
    scored = rows.repartition(wide, "held", "class").groupBy("held", "class").applyInPandas(one, f"sample {kind}, class string, margin double")
    got = scored.groupBy("sample").agg(F.min_by("class", F.struct((-F.col("margin")).alias("m"), "class")).alias("predicted"))
    per = data.join(got, "sample").groupBy("fold", "label").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("r"))
    return float(per.groupBy("fold").agg(F.avg("r").alias("r")).agg(F.avg("r")).first()[0])


def fold_scores(tables: list[DataFrame], makes: list, k: int) -> list[list[float | None]]:
    """For each table (persisted) and each of makes (functions of no arguments) the mean score over folds; None where the data don't suit the estimator.

    Every fold of every candidate is a task of its own: fits are many small jobs, most of whose time is the driver's.
    """

    def score(x: tuple) -> float | None:
        data, make, fold = x
        try:
            return fold_score(data, fold, make())
        except IllegalArgumentException:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = iter(list(pool.map(score, [(t, make, i) for t in tables for make in makes for i in range(k)])))
    means = lambda own: None if None in own else sum(own) / k
    return [[means([next(got) for _ in range(k)]) for _ in makes] for _ in tables]


def search(wide: DataFrame, labels: DataFrame, features: list, names: list[str] | None = None, k: int = 3, data_type: str = "binary") -> list[tuple[str, float | None]]:
    """(candidate, mean balanced accuracy over folds) of one problem, best first (of equal ones the first); NULL where it can't be fitted.

    Without folds (a class of one sample, or one class) the fallback alone, without a score.
    """
    c = context_of(labels, len(features), data_type)
    every = candidates(c)
    names = names or list(every)
    if unknown := set(names) - set(every):
        raise ValueError(f"unknown candidates: {', '.join(sorted(unknown))}")
    if not evaluable(labels):
        return [(fallback(c), None)]

    cells = c.n_samples * len(features)
    boosted = [n for n in names if n == "boosted_trees" and data_type == "binary" and cells <= TASK_CELLS]
    fitted = [n for n in names if every[n] is not None and n not in boosted]
    data = learning_table(wide, labels, features, k).persist()
    try:
        few = data.coalesce(max(1, -(-cells // STEP_CELLS)))
        made = fold_scores([few], [lambda n=n: every[n](len(features), c.n_classes) for n in fitted], k)[0]
        alone = {n: cross_validate_neighbours(data, neighbours(c.n_samples)) for n in names if every[n] is None}
        alone |= {n: cross_validate_boosted(data, k, *boosting_size(c)) for n in boosted}
    finally:
        data.unpersist()
    got = [(n, (dict(zip(fitted, made)) | alone)[n]) for n in names]
    return sorted(got, key=lambda x: (x[1] is None, -(x[1] or 0.0)))


def nonlinear_gain(scores: list[tuple[str, float | None]]) -> float | None:
    """Best score of the candidates that aren't linear over that of the linear ones; None if either is missing."""
    best = lambda linear: max((v for n, v in scores if v is not None and (n in LINEAR) == linear), default=None)
    a, b = best(False), best(True)
    return None if a is None or b is None else a - b


def tree_rules(model: PipelineModel, features: list) -> list[tuple[int, float, list[tuple[str, str, float]]]]:
    """(leaf, prediction, conditions) of a fitted decision tree, in order; a condition is (feature, <= or >, threshold)."""
    out: list = []

    def walk(node, path: list) -> None:
        if "Leaf" in node.getClass().getSimpleName():
            out.append((len(out), node.prediction(), path))
            return
        at = node.split()
        name, threshold = str(features[at.featureIndex()]), float(at.threshold())
        walk(node.leftChild(), [*path, (name, "<=", threshold)])
        walk(node.rightChild(), [*path, (name, ">", threshold)])

    walk(model.stages[2]._java_obj.rootNode(), [])
    return out


def tree_paths(model: PipelineModel, wide: DataFrame, features: list) -> DataFrame:
    """(sample, leaf, predicted, path): the conditions that led a decision tree to its prediction, as text."""
    names = model.stages[0].labels
    found = None
    for leaf, prediction, conditions in tree_rules(model, features):
        ok = F.lit(True)
        for f, sign, t in conditions:
            c = F.col(f"f_{f}")
            ok = ok & ((c <= t) if sign == "<=" else (c > t))
        text = "; ".join(f"{f} {sign} {t:g}" for f, sign, t in conditions)
        row = F.struct(F.lit(leaf).alias("leaf"), F.lit(names[int(prediction)]).alias("predicted"), F.lit(text).alias("path"))
        found = F.when(ok, row) if found is None else found.when(ok, row)
    return wide.select("sample", found.alias("x")).select("sample", "x.leaf", "x.predicted", "x.path")


def imputed_symbols(symbols: DataFrame, markers: DataFrame, kind: str, missing: str = "nd") -> DataFrame:
    """(sample, feature, state) for every sample and marker (feature, common, known) of a stored model, without missing states.

    A missing state is "1" for binary data, else the common state or N. A state that the model doesn't know becomes "1" if that is known, else the first known one.
    """
    grid = cohort.crossed(symbols.select("sample").distinct(), markers.select("feature", "common", "known"))
    df = grid.join(symbols.select("sample", "feature", F.trim("state").alias("state")), ["sample", "feature"], "left")
    given = F.when(F.lower(F.coalesce("state", F.lit(missing))) != missing, F.col("state"))
    filled = F.coalesce(given, F.lit("1")) if kind == "binary" else F.coalesce(given, F.nullif(F.upper(F.trim("common")), F.lit("")), F.lit("N"))
    size = F.coalesce(F.size("known"), F.lit(0))
    known = F.when((size <= 0) | F.array_contains("known", filled), filled).when(F.array_contains("known", "1"), F.lit("1")).otherwise(F.get("known", F.lit(0)))
    return df.select("sample", "feature", known.alias("state"))


def coverage(symbols: DataFrame, features: DataFrame, least: float = 0.5, missing: str = "nd") -> DataFrame:
    """(sample, n_given, coverage, enough): how many of a model's features (feature) each sample gives, names compared without case and signs."""
    from ..functions import encode

    plain = lambda c: encode.plain_name(F.col(c).cast("string"))
    asked = features.select(plain("feature").alias("__name")).distinct()
    n = asked.agg(F.count("*").alias("__n"))
    given = symbols.where(F.lower(F.trim(F.coalesce("state", F.lit(missing)))) != missing).select("sample", plain("feature").alias("__name")).distinct().join(asked, "__name")
    per = symbols.select("sample").distinct().join(given.groupBy("sample").agg(F.count("*").alias("n_given")), "sample", "left").join(F.broadcast(n))  # one row
    share = F.coalesce("n_given", F.lit(0)) / F.greatest("__n", F.lit(1))
    return per.select("sample", F.coalesce("n_given", F.lit(0)).alias("n_given"), share.alias("coverage"), (share >= least).alias("enough"))


def rank_candidates(scores: DataFrame, k: int) -> DataFrame:
    """(candidate, mean, coverage, place): of rows (candidate, level, score) the k best candidates by mean, then by levels scored; NULL scores don't count."""
    per = scores.groupBy("candidate").agg(F.avg("score").alias("mean"), F.count("score").alias("coverage")).where("coverage > 0")
    df = per.orderBy(F.col("mean").desc(), F.col("coverage").desc(), "candidate").limit(k)
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").desc(), F.col("coverage").desc(), "candidate")))  # k rows


def evaluable(labels: DataFrame) -> bool:
    """Whether a level has two classes or more, each of two samples or more, as stratified folds need."""
    n = labels.groupBy("label").count().agg(F.count("*"), F.min("count")).first()
    return n[0] >= 2 and n[1] >= 2


def recommend(wide: DataFrame, levels: list[tuple[str, DataFrame]], features: list, candidates: dict, k: int = 3) -> list[tuple[str, float, int]]:
    """(estimator, mean score, levels scored) over all levels of a hierarchy, best first by mean, then coverage; a level without folds is left out, and a model that can't be fitted for a level is left out there."""
    wide = wide.persist()
    scored = [learning_table(wide, labels, features, k).persist() for _, labels in levels if evaluable(labels)]
    try:
        got = fold_scores(scored, list(candidates.values()), k)
    finally:
        for df in (wide, *scored):
            df.unpersist()
    out = []
    for i, name in enumerate(candidates):
        own = [level[i] for level in got if level[i] is not None]
        if own:
            out.append((name, sum(own) / len(own), len(own)))
    return sorted(out, key=lambda x: (-x[1], -x[2], x[0]))


def accuracy_by_size(wide: DataFrame, labels: DataFrame, ranked: list, sizes: list[int], make, k: int = 3) -> list[tuple[int, float]]:
    """Cross-validated score with the best n features, for each n."""
    return [(n, cross_validate(wide, labels, ranked[:n], make, k)) for n in sizes if n <= len(ranked)]


def random_label_test(wide: DataFrame, labels: DataFrame, features: list, make, replicates: int, seed: int, k: int = 3) -> tuple[float, list[float], float]:
    """(score, scores under permuted labels, p)."""
    observed = cross_validate(wide, labels, features, make, k)
    place = ordering.numbered(labels, ["sample"], "a")
    null = []
    for r in range(replicates):
        mixed = labels.select("label", "sample", F.sha2(F.concat_ws(":", F.lit(seed), F.lit(r), "sample"), 256).alias("key"))
        shuffled = ordering.numbered(mixed, ["key", "sample"], "a").select("a", "label")
        null.append(cross_validate(wide, place.select("sample", "a").join(shuffled, "a").select("sample", "label"), features, make, k))
    return observed, null, (sum(x >= observed for x in null) + 1) / (replicates + 1)
