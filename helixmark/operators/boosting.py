"""Multiclass boosting of decision trees by gradient histograms.

A matrix is long (sample, feature, value; NULL or absent is missing); values are replaced by the least cut that isn't below them. A round adds
one tree for each class, all of them a level at a time: one aggregate sums the softmax gradients of all samples by
(class, node, feature, cut), with partial sums in the tasks, and each node's best split is chosen from these histograms. What is missing goes to
the side where the gain is greater. Gradients are rounded to fixed-point integers, so sums, splits and trees are the same
at any partitioning and at each rerun. Trees are tables; the samples' margins are written once a round, and nothing of the samples
goes to the driver. Training and scoring run jobs: a round has as many as a tree has levels, and two.

Of two classes each has a tree of its own too. Splits with equal gain: the first feature, then the least cut, then missing to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise

#: Gradients are multiples of 1 / SCALE.
SCALE = 1 << 20
#: Nodes of a tree have numbers below 1 << NODE_BITS: the root 0, the children of n are 2 * n + 1 and 2 * n + 2.
NODE_BITS = 12
LEAST_GAIN = 1e-6


@dataclass
class Boosted:
    """trees: (round, class, node, feature, threshold, missing_left, gain, value), feature NULL in leaves; classes by number; levels of a tree."""

    trees: DataFrame
    classes: list
    depth: int


def cuts(matrix: DataFrame, most: int = 32) -> DataFrame:
    """(feature, cuts): all values of a feature, or that many quantiles; the greatest value is always one."""
    m = matrix.where("value IS NOT NULL").withColumn("value", F.col("value").cast("double"))
    n = m.groupBy("feature").agg(F.count_distinct("value").alias("n"))
    few = m.join(n.where(F.col("n") <= most), "feature").groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("cuts"))
    shares = [k / most for k in range(1, most + 1)]
    many = m.join(n.where(F.col("n") > most), "feature").groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx("value", shares))).alias("cuts"))
    return few.unionByName(many)


def _cells(matrix: DataFrame) -> DataFrame:
    """(sample, cells): each sample's values by feature."""
    return matrix.where("value IS NOT NULL").groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value")))).alias("cells"))


def _node(tree: str, splits: str, depth: int) -> str:
    """SQL of the node where a sample's cells end in the tree of that number; splits: a map from (tree << NODE_BITS) + node."""
    at = f"try_element_at({splits}, (({tree}) << {NODE_BITS}) + node)"
    left = f"coalesce(try_element_at(cells, {at}.feature) <= {at}.threshold, {at}.missing_left)"
    return f"aggregate(sequence(1, {depth}), 0L, (node, i) -> CASE WHEN {at} IS NULL THEN node WHEN {left} THEN 2 * node + 1 ELSE 2 * node + 2 END)"


def _as_map(rows: DataFrame, tree: Column, *values: str) -> DataFrame:
    """One row: a map from (tree << NODE_BITS) + node to the values of rows. At most a row for each node of the trees."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct((F.shiftleft(tree.cast("long"), NODE_BITS) + F.col("node")).alias("key"), F.struct(*values).alias("v")))).alias("m"))


def _softmax(margins: str) -> Column:
    e = F.transform(margins, lambda x: F.exp(x - F.array_max(margins)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _best_splits(hist: DataFrame, l2: float, least_child: float) -> DataFrame:
    """(class, node, feature, threshold, missing_left, gain) of histograms (class, node, feature, cut, g, h); the row without a feature has the node's sums."""
    total = hist.where("feature IS NULL").select("class", "node", F.col("g").alias("g_node"), F.col("h").alias("h_node"))
    own = Window.partitionBy("class", "node", "feature")
    upto = own.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.where("feature IS NOT NULL").select("class", "node", "feature", "cut", *[F.sum(c).over(upto).alias(f"{c}_upto") for c in ("g", "h")], *[F.sum(c).over(own).alias(f"{c}_all") for c in ("g", "h")]).join(total, ["class", "node"])
    sides = [F.struct(F.lit(left).alias("missing_left"), *[(F.col(f"{c}_upto") + (F.col(f"{c}_node") - F.col(f"{c}_all") if left else 0)).alias(c) for c in ("g", "h")]) for left in (True, False)]
    s = s.select("class", "node", "feature", "cut", "g_node", "h_node", F.inline(F.array(*sides)))
    part = lambda g, h: F.pow(g / SCALE, F.lit(2.0)) / (h / SCALE + l2)
    gain = part(F.col("g"), F.col("h")) + part(F.col("g_node") - F.col("g"), F.col("h_node") - F.col("h")) - part(F.col("g_node"), F.col("h_node"))
    s = s.where((F.col("h") >= least_child * SCALE) & (F.col("h_node") - F.col("h") >= least_child * SCALE)).withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "feature", F.col("cut").alias("threshold"), (~F.col("missing_left")).alias("right")))
    return s.groupBy("class", "node").agg(best.alias("b")).select("class", "node", "b.feature", "b.threshold", (~F.col("b.right")).alias("missing_left"), (-F.col("b.loss")).alias("gain"))


def fit(matrix: DataFrame, labels: DataFrame, rounds: int = 200, depth: int = 3, rate: float = 0.05, l2: float = 1.0, least_child: float = 1.0, bins: int = 32) -> Boosted:
    """Trees from a long matrix (one value a sample and feature) and labels (sample, label); samples without a label are left out, those without values have all missing."""
    if 2 ** (depth + 1) > 1 << NODE_BITS:
        raise ValueError(f"trees have at most {NODE_BITS - 1} levels")
    classes = [r[0] for r in labels.where("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]  # a row a class
    k = len(classes)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    binned = matrix.where("value IS NOT NULL").join(cuts(matrix, bins), "feature").select("sample", "feature", F.element_at(F.filter("cuts", lambda c: c >= F.col("value")), 1).alias("value"))
    empty = F.map_from_arrays(F.array().cast(f"array<{matrix.schema['feature'].dataType.simpleString()}>"), F.array().cast("array<double>"))
    rows = labels.where("label IS NOT NULL").select("sample", number.alias("y")).join(_cells(binned), "sample", "left").select("sample", "y", F.coalesce("cells", empty).alias("cells"), F.array_repeat(F.lit(0.0), k).alias("margins"))
    rows = materialise(rows, "boosting-rows")
    trees = None
    for number in range(rounds):
        graded = rows.withColumn("p", _softmax("margins")).withColumns(
            {
                "g": F.transform("p", lambda p, i: F.round((p - (i == F.col("y")).cast("double")) * SCALE).cast("long")),
                "h": F.transform("p", lambda p: F.round(F.greatest(2 * p * (1 - p), F.lit(1e-16)) * SCALE).cast("long")),
            }
        )
        found: list[DataFrame] = []  # splits of each level

        def placed(found: list[DataFrame] = found, graded: DataFrame = graded) -> DataFrame:
            """graded with each class's node by the splits so far."""
            if not found:
                return graded.withColumn("nodes", F.array_repeat(F.lit(0).cast("long"), k))
            every = found[0]
            for s in found[1:]:
                every = every.unionByName(s)
            one = _as_map(every, F.col("class"), "feature", "threshold", "missing_left").withColumnRenamed("m", "splits")
            return graded.crossJoin(F.broadcast(one)).withColumn("nodes", F.expr(f"transform(sequence(0, {k - 1}), k -> {_node('k', 'splits', len(found))})")).drop("splits")  # one row

        for level in range(depth):
            each = placed().select("cells", F.posexplode(F.arrays_zip("nodes", "g", "h")).alias("class", "x")).select("class", "x.*", "cells").where(F.col("nodes") >= 2**level - 1)
            cell = F.concat(F.expr("array(cast(null AS struct<key:string,value:double>))").cast(_entry(rows)), F.map_entries("cells"))
            each = each.select("class", F.col("nodes").alias("node"), "g", "h", F.explode(cell).alias("c"))
            hist = each.groupBy("class", "node", F.col("c.key").alias("feature"), F.col("c.value").alias("cut")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            splits = materialise(_best_splits(hist, l2, least_child), "boosting-splits", few=True)
            if splits.isEmpty():
                break
            found.append(splits)
        ends = placed().select(F.posexplode(F.arrays_zip("nodes", "g", "h")).alias("class", "x")).groupBy("class", F.col("x.nodes").alias("node")).agg(F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))
        leaves = materialise(ends.select("class", "node", (-rate * (F.col("g") / SCALE) / (F.col("h") / SCALE + l2)).alias("value")), "boosting-leaves", few=True)
        one = _as_map(leaves, F.col("class"), "value").withColumnRenamed("m", "leaves")
        grown = placed().crossJoin(F.broadcast(one))  # one row
        add = f"transform(margins, (m, k) -> m + try_element_at(leaves, (cast(k AS bigint) << {NODE_BITS}) + nodes[k]).value)"
        before, rows = rows, materialise(grown.select("sample", "y", "cells", F.expr(add).alias("margins")), "boosting-rows")
        discard(before)
        inner = [s.select("class", "node", "feature", "threshold", "missing_left", "gain", F.lit(None).cast("double").alias("value")) for s in found]
        tree = leaves.select("class", "node", F.lit(None).cast(matrix.schema["feature"].dataType).alias("feature"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("missing_left"), F.lit(None).cast("double").alias("gain"), "value")
        for s in inner:
            tree = tree.unionByName(s)
        tree = tree.withColumn("round", F.lit(number))
        trees = tree if trees is None else trees.unionByName(tree)
    return Boosted(materialise(trees, "boosting-trees", few=True), classes, depth)


def _entry(rows: DataFrame) -> str:
    kind = rows.schema["cells"].dataType
    return f"array<struct<key:{kind.keyType.simpleString()},value:double>>"


def margins(matrix: DataFrame, trees: DataFrame, n_classes: int, rounds: int, depth: int) -> DataFrame:
    """(sample, margins): for each class the sum of the leaves where a sample ends in the class's trees. The trees are one row, of a size that rounds, classes and levels bound."""
    tree = F.col("round").cast("long") * n_classes + F.col("class")
    one = _as_map(trees.where("feature IS NOT NULL"), tree, "feature", "threshold", "missing_left").withColumnRenamed("m", "splits").crossJoin(_as_map(trees.where("feature IS NULL"), tree, "value").withColumnRenamed("m", "leaves"))  # one row each
    t = f"cast(r * {n_classes} + k AS bigint)"
    leaf = f"try_element_at(leaves, (({t}) << {NODE_BITS}) + {_node(t, 'splits', depth)}).value"
    return _cells(matrix).crossJoin(F.broadcast(one)).select("sample", F.expr(f"transform(sequence(0, {n_classes - 1}), k -> aggregate(sequence(0, {rounds - 1}), 0D, (a, r) -> a + coalesce({leaf}, 0D)))").alias("margins"))


def predict(matrix: DataFrame, model: Boosted) -> DataFrame:
    """(sample, predicted, support, probabilities) of all samples with any value; of equal margins the first class."""
    rounds = (model.trees.agg(F.max("round")).first()[0] or 0) + 1
    df = margins(matrix, model.trees, len(model.classes), rounds, model.depth).withColumn("probabilities", _softmax("margins"))
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return df.select("sample", F.element_at(names, best).alias("predicted"), F.array_max("probabilities").alias("support"), "probabilities")


def two_classes(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, rounds: int, depth: int, rate: float, share: float, seed: int = 1) -> np.ndarray:
    """Margins of all rows by trees boosted on the rows that are `fitted`, as Spark's GBTClassifier boosts them: a tree on the labels, then trees on the
    residuals of the logistic loss, each split by variance, each tree on a share of the rows. x: 0/1, a byte each; y: -1 and 1."""
    rng, margins, out = np.random.default_rng(seed), np.zeros(len(y)), np.zeros(len(y))
    residual = y.astype(float)

    def sums(rows: np.ndarray) -> np.ndarray:
        """By feature, how many of the rows have it, and their residuals' sum."""
        both = np.zeros((2, x.shape[1]))
        for k in range(0, len(rows), 8192):
            at = rows[k : k + 8192]
            both += np.stack([np.ones(len(at)), residual[at]]) @ x[at].astype(float)
        return both

    def grow(own: np.ndarray, every: np.ndarray, found: np.ndarray, levels: int) -> None:
        n, s = len(own), residual[own].sum()
        out[every] = s / n
        if not levels or n < 2:
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = found[1] ** 2 / found[0] + (s - found[1]) ** 2 / (n - found[0]) - s * s / n
        gain[(found[0] < 0.5) | (found[0] > n - 0.5)] = 0.0
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            return
        has, all_has = x[own, best] == 1, x[every, best] == 1
        less = bool(has.sum() * 2 <= n)  # the lesser side is counted, the other is what's left
        small = sums(own[has == less])
        for side in (True, False):
            grow(own[has == side], every[all_has == side], small if side == less else found - small, levels - 1)

    for number in range(rounds):
        own = fitted[rng.random(len(fitted)) < share]
        own = own if len(own) else fitted
        grow(own, np.arange(len(y)), sums(own), depth)
        margins += out if number == 0 else rate * out
        residual = 4 * y / (1 + np.exp(np.minimum(2 * y * margins, 700)))
    return margins


def importances(model: Boosted) -> DataFrame:
    """(feature, gain, n): sums over all splits."""
    return model.trees.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
