"""A machine with an RBF kernel, by Nystroem's method: the kernel with a bounded set of landmarks, and a linear machine on top.

exp(-gamma * |x - y|^2) of any two rows is approximated by the product of their maps: a row's kernel with the landmarks, times the inverse root of the
kernel among the landmarks. With all distinct rows as landmarks it is exact. Landmarks are drawn by digest, so they are the same at each rerun, and only
they go to the driver: at most `LANDMARKS` rows, and no more than `MOST_CELLS` numbers. Rows are mapped in batches by the tasks; the linear machines are Spark's, one
for each class, with classes weighted to the same total; classes of few rows are fitted side by side. Fitting runs jobs; rows meet their labels once, in a join that broadcasts neither, and are read from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise

LANDMARKS = 256
MOST_CELLS = 50_000_000
#: Numbers in a partition of the mapped rows: each step of a fit is a job over all of them.
PART_CELLS = 2_000_000
#: Directions whose share of the greatest eigenvalue is below this are left out.
FLAT = 1e-10


@dataclass
class Map:
    """Landmarks (a row each), their kernel's inverse root, and gamma."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.root


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(distance, 0.0))


def gamma_of(rows: DataFrame, x: str = "x") -> float:
    """1 / (features * variance of all values), or 1 where nothing varies."""
    sums = rows.select(F.size(x).alias("n"), *[F.aggregate(F.transform(x, f), F.lit(0.0), lambda a, b: a + b).alias(k) for k, f in (("s", lambda v: v), ("ss", lambda v: v * v))])
    size, n, s, ss = sums.agg(F.max("n"), F.sum("n"), F.sum("s"), F.sum("ss")).first()
    variance = ss / n - (s / n) ** 2 if n else 0.0
    return 1.0 / (size * variance) if variance > 1e-12 else 1.0


def fit(rows: DataFrame, x: str = "x", most: int = LANDMARKS, gamma: float | None = None) -> Map:
    """The map of rows with an array of numbers; landmarks are distinct rows, the first by digest."""
    gamma = gamma_of(rows, x) if gamma is None else gamma
    width = rows.agg(F.max(F.size(x))).first()[0] or 0
    if width * most > MOST_CELLS:
        raise ValueError(f"{most} landmarks of {width} features are more than {MOST_CELLS} numbers")
    chosen = rows.select(F.transform(x, lambda v: v.cast("double")).alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(most).collect()
    marks = np.array([r["x"] for r in chosen], float).reshape(len(chosen), width)
    values, vectors = np.linalg.eigh(rbf(marks, marks, gamma)) if len(marks) else (np.zeros(0), np.zeros((0, 0)))
    good = values > FLAT * max(values.max(initial=0.0), 1e-300)
    return Map(marks, vectors[:, good] / np.sqrt(values[good]), gamma)


def mapped(rows: DataFrame, m: Map, x: str = "x", out: str = "z") -> DataFrame:
    """rows with their map, an array of numbers."""
    told = rows.sparkSession.sparkContext.broadcast((m.landmarks, m.root, m.gamma))  # bounded by its landmarks; arrays, as executors need not have our class

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def z(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        landmarks, root, gamma = told.value
        for b in batches:
            yield pd.Series(list(rbf(np.stack(b.to_numpy()).astype(float), landmarks, gamma) @ root) if len(b) else [], dtype=object)

    return rows.withColumn(out, z(F.col(x)))


@dataclass
class Machine:
    map: Map
    model: object
    classes: list


def _x(features: list) -> Column:
    return F.array(*[F.col(f"f_{f}").cast("double") for f in features])


def train(wide: DataFrame, labels: DataFrame, features: list, c: float = 1.0, most: int = LANDMARKS, gamma: float | None = None, iterations: int = 100) -> Machine:
    """A machine from wide rows (sample, f_<feature>...) and labels (sample, label); c weighs errors against the margin."""
    # labels are as many as rows, and a file's size says little about theirs: never broadcast
    data = wide.select("sample", _x(features).alias("x")).join(labels.where("label IS NOT NULL").hint("merge"), "sample").select("sample", "label", "x")
    data = materialise(data, "kernel-rows")
    sizes = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}  # a row a class
    classes, n = list(sizes), sum(sizes.values())
    m = fit(data, most=most, gamma=gamma)
    number = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col("label")) - 1
    weight = F.element_at(F.array(*[F.lit(n / (len(classes) * sizes[k])) for k in classes]), (F.col("y") + 1).cast("int"))
    ready = materialise(mapped(data, m).select("z", number.cast("double").alias("y")).withColumn("w", weight), "kernel-mapped")
    cells = n * max(1, m.root.shape[1])
    # few numbers: no more partitions than they fill, and classes side by side, as most of a step's time is the driver's; many: a class at a time, as each keeps its rows
    ready = ready.select(array_to_vector("z").alias("features"), "y", "w").coalesce(-(-cells // PART_CELLS) or 1)
    beside = max(1, min(8, MOST_CELLS // max(1, cells)))
    one = C.LinearSVC(maxIter=iterations, regParam=1.0 / (c * max(1, n)))
    return Machine(m, C.OneVsRest(classifier=one, labelCol="y", weightCol="w", parallelism=beside).fit(ready), classes)


def predict(machine: Machine, wide: DataFrame, features: list) -> DataFrame:
    """(sample, predicted)."""
    rows = mapped(wide.select("sample", _x(features).alias("x")), machine.map).select("sample", array_to_vector("z").alias("features"))
    names = F.array(*[F.lit(k) for k in machine.classes])
    return machine.model.transform(rows).select("sample", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"))
