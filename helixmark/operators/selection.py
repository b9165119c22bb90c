"""Feature selection: significance, ranking, neighbourhoods, redundancy, synchronised tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from . import ordering, pairs
from .graphs import components


def significant(predictions: DataFrame, p: float, fdr: float, gfdr: float) -> DataFrame:
    """Rows (snp, p, fdr, gfdr, ...) within all three thresholds; what isn't a number drops out."""
    num = {c: F.col(c).try_cast("double") for c in ("p", "fdr", "gfdr")}
    return predictions.withColumns(num).where((F.col("p") <= p) & (F.col("fdr") <= fdr) & (F.col("gfdr") <= gfdr))


def best_prediction(predictions: DataFrame, ord_: str = "ord") -> DataFrame:
    """Per snp the row with least (gfdr, fdr, p), the first of equal ones."""
    rest = [c for c in predictions.columns if c != "snp"]
    return predictions.groupBy("snp").agg(F.min_by(F.struct(*rest), F.struct("gfdr", "fdr", "p", ord_)).alias("r")).select("snp", "r.*")


def ranked(predictions: DataFrame, keys: tuple[str, ...] = ("gfdr", "fdr", "p", "snp")) -> DataFrame:
    """predictions with their rank by the keys, which must be a total order."""
    return ordering.numbered(predictions, list(keys), "rank")


def neighbourhoods(coords: DataFrame, distance: float, by: list[str] | None = None) -> DataFrame:
    """coords (id, pos) with `group`, a number where at least two lie in a chain of gaps of at most `distance`, else NULL.

    Without `by` the whole list is one order: it is range-sorted, and what a range needs of those before it
    (the last place, the number of groups) is one row.
    """
    known = coords.where("pos IS NOT NULL")
    if by:
        w = Window.partitionBy(*by).orderBy("pos", "id")
        gap = F.col("pos") - F.lag("pos").over(w)
        df = known.withColumn("__new", F.when(gap.isNull() | (gap > distance), 1).otherwise(0))
        df = df.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        df = ordering.placed(known, ["pos", "id"])
        earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        before = df.groupBy("__part").agg(F.max("pos").alias("m")).select("__part", F.max("m").over(earlier).alias("__before"))
        own = Window.partitionBy("__part").orderBy("pos", "id")
        df = df.join(F.broadcast(before), "__part").withColumn("__gap", F.col("pos") - F.coalesce(F.lag("pos").over(own), F.col("__before")))
        df = df.withColumn("__new", F.when(F.col("__gap").isNull() | (F.col("__gap") > distance), 1).otherwise(0))
        starts = df.groupBy("__part").agg(F.sum("__new").alias("n")).select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__from"))
        df = df.join(F.broadcast(starts), "__part").withColumn("__g", F.col("__from") + F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*(by or []), "__g"]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size")).where("__size >= 2").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    df = df.join(sizes, same, "left").withColumn("group", F.col("____g")).select(*coords.columns, "group")
    return df.unionByName(coords.where("pos IS NULL").withColumn("group", F.lit(None).cast("long")))


def best_of_group(rows: DataFrame, group: str, ident: str, order: list[str]) -> DataFrame:
    """The best row of each group; rows without one stay."""
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("i"), F.col(ident).cast("string")))
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def complete_linkage(distance: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers: the two clusters whose farthest members are nearest merge, while that is within the threshold."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    cluster = np.arange(n)
    alive = np.ones(n, bool)
    to = np.zeros(n, np.int64)  # each cluster's nearest later one
    least = np.full(n, np.inf)

    def look(k: int) -> None:
        if k + 1 < n:
            to[k] = k + 1 + d[k, k + 1 :].argmin()
            least[k] = d[k, to[k]]

    for k in range(n):
        look(k)
    while n and least.min() <= threshold and np.isfinite(least.min()):
        i = int(least.argmin())
        j = int(to[i])
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        alive[j], least[j] = False, np.inf
        cluster[cluster == j] = i
        for k in np.flatnonzero(alive & ((to == i) | (to == j) | (np.arange(n) == i))):
            least[k] = np.inf
            look(k)
    return np.unique(cluster, return_inverse=True)[1].tolist()


def redundancy(states: DataFrame, threshold: float, keep: int) -> DataFrame:
    """Clusters of features (group, feature, rank, states: one text per feature) whose states differ in at most a share `threshold`: (group, feature, rank, cluster, kept).

    A group is what is clustered as a whole: a neighbourhood, or the ranked list. All its pairs are compared,
    by blocks. Features with equal states merge first in any case, so they count as one; and clusters never
    go beyond the features that links within the threshold connect, so each such component is clustered by
    itself, in one task. A cluster has the name of its best feature.
    """
    kinds = dict(states.dtypes)
    states = materialise(states.select("group", "feature", "rank", "states"), "redundancy-states", few=True)
    patterns = states.groupBy("group", "states").agg(F.min(F.struct("rank", "feature")).alias("f")).select("group", "f.rank", "f.feature", "states")
    patterns = materialise(patterns, "redundancy-patterns", few=True)

    def links(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = pairs.forest(pairs.differing(x["states"].tolist(), y["states"].tolist()) <= threshold)
        i, j = (np.array([p[k] for p in out], np.int64) for k in (0, 1))
        u, v = x.iloc[i].reset_index(drop=True), y.iloc[j].reset_index(drop=True)
        return pd.DataFrame({"group": u["group"], "rank_a": u["rank"], "feature_a": u["feature"], "rank_b": v["rank"], "feature_b": v["feature"]})

    ends = ", ".join(f"rank_{k} {kinds['rank']}, feature_{k} {kinds['feature']}" for k in "ab")
    found = pairs.block_pairs(patterns, "states", links, f"group {kinds['group']}, {ends}", "group")
    node = lambda r, f: F.struct("group", F.col(r).alias("rank"), F.col(f).alias("feature"))
    roots = components(found.select(node("rank_a", "feature_a").alias("a"), node("rank_b", "feature_b").alias("b")))
    placed = patterns.withColumn("node", node("rank", "feature")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "feature"], ignore_index=True)
        number = complete_linkage(pairs.differing(pdf["states"].tolist(), pdf["states"].tolist()), threshold)
        pdf["cluster"] = pdf["feature"].groupby(number).transform("first")
        return pdf[["group", "states", "cluster"]]

    clusters = placed.select("root", "group", "rank", "feature", "states").groupBy("root").applyInPandas(cluster, f"group {kinds['group']}, states string, cluster {kinds['feature']}")
    clusters = clusters.select(F.col("group").alias("__group"), F.col("states").alias("__states"), "cluster")
    out = states.join(clusters, F.col("group").eqNullSafe(F.col("__group")) & (F.col("states") == F.col("__states")))
    nth = F.row_number().over(Window.partitionBy("group", "cluster").orderBy("rank", "feature"))
    return out.select("group", "feature", "rank", "cluster", (nth <= keep).alias("kept"))


def synchronised(selected: DataFrame, *tables: DataFrame) -> DataFrame:
    """Selected ids that all tables have, in their order."""
    for t in tables:
        selected = selected.join(t.select("feature").distinct(), "feature", "left_semi")
    return selected


def distribution(observed: float, null: Iterator[float], spark, name: str) -> DataFrame:
    """Row 0 is the observed value, then those under permutation."""
    return spark.createDataFrame([(0, float(observed)), *((i + 1, float(v)) for i, v in enumerate(null))], f"replicate long, {name} double")
