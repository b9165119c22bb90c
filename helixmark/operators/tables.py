"""Small relational operators over long tables: duplicates, ordered unions, prefix maxima, best and deepest rows, codes and known values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering, pairs


def duplicates(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, n) of ids that occur more than once."""
    return rows.groupBy(ident).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(rows: DataFrame, ident: str) -> DataFrame:
    """rows; reading them raises an error if an id occurs more than once."""
    n = F.count("*").over(Window.partitionBy(ident))
    return rows.withColumn(ident, F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(ident).cast("string"))).cast(rows.schema[ident].dataType)).otherwise(F.col(ident)))


def suffixed(rows: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """rows with `number` (from 1, by order, among rows of one id) and `name`: the id, from its second row on with __dup<number>."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(*order)).cast("long")
    df = rows.withColumn("number", n)
    return df.withColumn("name", F.when(F.col("number") == 1, F.col(ident).cast("string")).otherwise(F.concat(F.col(ident).cast("string"), F.lit("__dup"), F.col("number"))))


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """(feature, list, ord) of tables (feature, ord): distinct features, each at the first place it has, earlier lists first."""
    rows = None
    for k, t in enumerate(lists):
        one = t.select("feature", F.lit(k).alias("list"), "ord")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("feature").agg(F.min(F.struct("list", "ord")).alias("p"))
    return best.select("feature", "p.list", "p.ord")


def prefix_max(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "prefix_max") -> DataFrame:
    """rows with the greatest value so far, in the order within each group."""
    return rows.withColumn(name, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "n") -> DataFrame:
    """The k first rows of each group, with their place."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def best_per_path(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """One row for each key: that with the greatest score."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("__s"), *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def deepest(rows: DataFrame, by: str, depth: Column) -> DataFrame:
    """Of each group the rows of greatest depth."""
    best = rows.groupBy(F.col(by).alias("__by")).agg(F.max(depth).alias("__deepest"))
    df = rows.withColumn("__depth", depth)
    return df.join(best, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__depth") == F.col("__deepest"))).select(*rows.columns)


def integer_ids(rows: DataFrame, key: list[str], name: str = "id") -> DataFrame:
    """Distinct keys with their number, from 1, in their order; a lookup from key to number."""
    return ordering.numbered(rows.select(*key).distinct(), key, name)


def category_codes(symbols: DataFrame) -> DataFrame:
    """(feature, state, code) of rows (sample, feature, state): states in capitals, numbered from 0 in their order within each feature."""
    state = F.upper(F.trim("state"))
    n = symbols.select("feature", state.alias("state")).distinct()
    return n.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy("state")) - 1)


def encoded(symbols: DataFrame) -> DataFrame:
    """symbols (sample, feature, state) with the code of each state; a missing state raises an error."""
    missing = F.lower(F.trim(F.coalesce("state", F.lit("")))).isin("", "na", "nan", "none", "null", ".")
    df = symbols.withColumn("state", F.when(missing, F.raise_error(F.concat(F.lit("missing state in "), F.col("feature").cast("string"))).cast("string")).otherwise(F.upper(F.trim("state"))))
    return df.join(category_codes(df), ["feature", "state"]).select("sample", "feature", "state", "code")


def known_values(rows: DataFrame, by: list[str], value: str, name: str = "known") -> DataFrame:
    """The distinct values of each group, sorted; of all rows for no group."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias(name))


def evaluation_labels(rows: DataFrame, field: str) -> DataFrame:
    """rows with `label`: the parts of the field between a leading cluster number (dropped only if every row has one and at least four parts) and the sample at the end; a field of one part is the label."""
    parts = F.transform(F.split(field, "\\|"), lambda x: F.trim(x))
    df = rows.withColumn("__p", parts)
    leading = df.agg(F.bool_and((F.size("__p") >= 4) & F.col("__p")[0].try_cast("int").isNotNull()).alias("__leading"))
    df = df.join(F.broadcast(leading))  # one row
    start = F.when(F.coalesce("__leading", F.lit(False)), 2).otherwise(1)
    bad = F.exists("__p", lambda x: x == "")
    text = F.when(bad, F.raise_error(F.concat(F.lit("an empty part in "), F.col(field))).cast("string")).when(F.size("__p") == 1, F.col("__p")[0]).otherwise(F.array_join(F.slice("__p", start, F.size("__p") - start), "|"))
    return df.withColumn("label", text).drop("__p", "__leading")


def class_context(labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row about a training set: n_samples, n_features, n_classes, class_counts, imbalance (largest class over smallest), missing share. labels: (sample, label); matrix: (sample, feature, value)."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    classes = n.agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_classes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_counts"), (F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("imbalance"))
    cells = matrix.agg(F.count_distinct("feature").alias("n_features"), F.coalesce(F.avg(F.col("value").isNull().cast("double")), F.lit(0.0)).alias("missing"))
    return classes.join(F.broadcast(cells))  # one row each


def reconciliation(calls: DataFrame, kept: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row of counts through a cohort's load: samples, candidate sites, kept sites, carrier events, and the matrix's samples and features."""
    c = calls.where("state = 'CALLED_ALTERNATE'").groupBy("chrom", "pos", "ref", "allele").agg(F.count_distinct("sample").alias("n"))
    one = c.agg(F.count("*").alias("n_candidate_sites"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"))
    out = calls.agg(F.count_distinct("sample").alias("n_samples")).join(F.broadcast(one)).join(F.broadcast(kept.agg(F.count("*").alias("n_kept_sites"))))
    return out.join(F.broadcast(matrix.agg(F.count_distinct("sample").alias("n_matrix_samples"), F.count_distinct("feature").alias("n_matrix_features"))))  # one row each


def pairwise_complete(matrix: DataFrame, least: float) -> DataFrame:
    """(i, j, complete), i < j, of pairs of samples that have at least a share `least` of all features both; pairs meet by blocks."""
    n = matrix.agg(F.count_distinct("feature")).first()[0] or 1
    sets = matrix.where("value IS NOT NULL").groupBy("sample").agg(F.collect_list("feature").alias("features"))
    kind = dict(matrix.dtypes)["sample"]

    def pack(pdf: pd.DataFrame) -> dict:
        return pairs.packed(pdf["features"]) | {"sample": pdf["sample"].to_numpy()}

    def both(x: dict, y: dict):
        for a, b, c in pairs.tiles(x, y):
            share = c.astype(float) / n
            keep = share >= least
            i, j = np.nonzero(np.triu(keep, 1) if x is y and a == b else keep)
            u, v = x["sample"][a][i], y["sample"][b][j]
            yield pd.DataFrame({"i": np.minimum(u, v), "j": np.maximum(u, v), "complete": share[i, j]})

    return pairs.packed_pairs(sets, "sample", pack, both, f"i {kind}, j {kind}, complete double")


def positions(text: Column, length: Column | int | None = None) -> Column:
    """The 1-based positions that a text lists (commas, semicolons or white space between them), each once, in order; what is no number, or lies outside 1 to length, raises an error."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[\s,;]+"), lambda w: w != "")
    numbers = F.transform(words, lambda w: w.try_cast("bigint"))
    top = F.lit(2**62) if length is None else length if isinstance(length, Column) else F.lit(length)
    bad = F.exists(numbers, lambda n: n.isNull() | (n < 1) | (n > top))
    message = F.concat(F.lit("positions must be whole numbers from 1 to the length: "), F.coalesce(text, F.lit("")))
    return F.when(bad, F.raise_error(message).cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(numbers)))


def kept_positions(rows: DataFrame, listed: DataFrame, by: list[str], position: str) -> DataFrame:
    """rows with `kept`: whether listed (by..., position) names their place; a list may be of any length."""
    names = listed.select(*by, F.col(position), F.lit(True).alias("kept")).distinct()
    return rows.join(names, [*by, position], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
