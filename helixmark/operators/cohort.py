"""Cohort matrices in long form (sample, feature, value; NULL is not callable): sites, filters, patterns, missingness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotype import ALTERNATE
from ..storage import materialise


def latest_calls(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key wins."""
    rest = [c for c in calls.columns if c not in keys]
    return calls.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def sites(calls: DataFrame, min_carriers: int = 10) -> DataFrame:
    """Candidate sites (chrom, pos, ref, alt, n_carriers): single-base alternates that enough samples carry."""
    ok = (F.col("state") == ALTERNATE) & (F.length("ref") == 1) & (F.length("allele") == 1) & (F.col("ref") != F.col("allele"))
    per = calls.where(ok).groupBy("chrom", "pos", "ref", F.col("allele").alias("alt")).agg(F.count_distinct("sample").alias("n_carriers"))
    return per.where(F.col("n_carriers") >= min_carriers)


def modal_baseline(alleles: DataFrame) -> DataFrame:
    """(chrom, pos, base, n): the most frequent base of each position; of equal ones that of the first sample."""
    per = alleles.where(F.col("allele").isin("A", "C", "G", "T")).groupBy("chrom", "pos", "allele").agg(F.count("*").alias("n"), F.min("sample").alias("first"))
    best = per.groupBy("chrom", "pos").agg(F.min_by(F.struct("allele", "n"), F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    return best.select("chrom", "pos", F.col("b.allele").alias("base"), F.col("b.n").alias("n"))


def variant_features(matrix: DataFrame) -> DataFrame:
    """Features with more than one state; missing is a state."""
    per = matrix.groupBy("feature").agg(F.count_distinct(F.coalesce("value", F.lit(-1.0))).alias("n_states"))
    return per.where("n_states > 1").select("feature")


def minor_counts(matrix: DataFrame) -> DataFrame:
    """(feature, n0, n1, minor); missing counts for neither."""
    per = matrix.groupBy("feature").agg(F.count_if(F.col("value") == 0).alias("n0"), F.count_if(F.col("value") == 1).alias("n1"))
    return per.withColumn("minor", F.least("n0", "n1"))


def statistics(matrix: DataFrame) -> DataFrame:
    """One row: density, carriers, singletons, doubletons, missing."""
    per = matrix.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 1).alias("ones"), F.count_if(F.col("value").isNull()).alias("missing"))
    return per.agg(
        F.count("*").alias("n_features"),
        F.sum("n").alias("n_cells"),
        F.sum("ones").alias("n_ones"),
        F.sum("missing").alias("n_missing"),
        (F.sum("ones") / F.sum("n")).alias("density"),
        F.count_if(F.col("ones") == 1).alias("singletons"),
        F.count_if(F.col("ones") == 2).alias("doubletons"),
        F.avg("ones").alias("mean_carriers"),
    )


def even_picks(index: Column, n: Column, k: int) -> Column:
    """Whether the index-th (0-based) of n is picked when k are spread evenly; halves round to even."""
    if k == 0:
        return F.lit(True)
    if k == 1:
        return (n <= 1) | (index == F.floor(n / 2))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1))).cast("long"))
    return (n <= k) | F.array_contains(places, index.cast("long"))


def pattern_representatives(matrix: DataFrame, order: str, keep: int = 5) -> DataFrame:
    """(feature, pattern_size, place): of features with equal columns at most `keep`, spread evenly by `order`.

    The pattern is the column's text over all samples in order; one feature's samples meet in one aggregate.
    """
    sign = F.coalesce(F.col("value").cast("int").cast("string"), F.lit("?"))
    col = matrix.groupBy("feature", order).agg(F.array_sort(F.collect_list(F.struct("sample", sign.alias("v")))).alias("c"))
    col = col.select("feature", order, F.sha2(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["sample"], x["v"]))), 256).alias("pattern"))
    w = Window.partitionBy("pattern")
    col = col.withColumns({"place": F.row_number().over(w.orderBy(order, "feature")) - 1, "pattern_size": F.count("*").over(w)})
    return col.where(even_picks(F.col("place"), F.col("pattern_size"), keep)).select("feature", "pattern_size", "place")


def missing_fractions(matrix: DataFrame, by: str) -> DataFrame:
    return matrix.groupBy(by).agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"))


def retained(matrix: DataFrame, max_feature: float = 0.5, max_sample: float = 0.5) -> DataFrame:
    """matrix without features that miss too much, then without samples that miss too much of the rest."""
    good = missing_fractions(matrix, "feature").where(F.col("missing") <= max_feature).select("feature")
    kept = matrix.join(good, "feature", "left_semi")
    return kept.join(missing_fractions(kept, "sample").where(F.col("missing") <= max_sample).select("sample"), "sample", "left_semi")


def fills(matrix: DataFrame, how: str = "baseline", constant: float = 0.0) -> DataFrame:
    """(feature, fill): 0, a constant, or the feature's mode (of equally frequent values the least; without any, 0)."""
    if how != "mode":
        return matrix.select("feature").distinct().withColumn("fill", F.lit(0.0 if how == "baseline" else constant))
    n = matrix.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return n.groupBy("feature").agg(F.coalesce(F.min_by("value", F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value"))), F.lit(0.0)).alias("fill"))


def imputed(matrix: DataFrame, fill: DataFrame) -> DataFrame:
    return matrix.join(fill, "feature", "left").select("sample", "feature", F.coalesce("value", "fill", F.lit(0.0)).alias("value"))


def crossed(samples: DataFrame, listed: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Each of samples with each row of a list, which is dealt to chunks of about so many rows; samples meet chunks in an equi join.

    A list of one chunk is small enough for Spark to broadcast. Of a longer one each chunk stands under several keys, among which the samples
    are dealt by a digest, so that there are as many keys as shuffle partitions, however few chunks. Counts and writes the list first.
    """
    n = max(1, -(-listed.count() // chunk))
    lists = listed.groupBy(F.pmod(F.xxhash64(*listed.columns), F.lit(n)).cast("int").alias("__chunk")).agg(F.collect_list(F.struct(*listed.columns)).alias("__rows"))
    lists = materialise(lists, "crossed-lists", few=True)
    each = samples.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if n == 1:
        return each.join(lists, "__chunk").select(*samples.columns, F.inline("__rows"))
    salts = max(1, -(-int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n))
    each = each.withColumn("__salt", F.pmod(F.xxhash64(*samples.columns), F.lit(salts)).cast("int"))
    lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return each.join(lists.hint("merge"), ["__chunk", "__salt"]).select(*samples.columns, F.inline("__rows"))


def aligned(matrix: DataFrame, features: DataFrame) -> DataFrame:
    """matrix for the features asked for (feature, ord), absent ones NULL, in their order; `present` tells them apart."""
    grid = crossed(matrix.select("sample").distinct(), features.select("feature", "ord"))
    m = matrix.select("sample", "feature", "value", F.lit(True).alias("present"))
    return grid.join(m, ["sample", "feature"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def wide(matrix: DataFrame, features: list[str]) -> DataFrame:
    return matrix.groupBy("sample").pivot("feature", features).agg(F.first("value"))


def long(table: DataFrame, sample: str) -> DataFrame:
    others = [c for c in table.columns if c != sample]
    return table.unpivot([sample], others, "feature", "value").withColumnRenamed(sample, "sample")


def gates(resolved: DataFrame, min_recovery: float = 0.5, min_callable: float = 0.5) -> DataFrame:
    """Per sample of resolved states (sample, state): recovery, callable share and verdict; without any callable it abstains."""
    from ..functions.genotype import ABSENT, REFERENCE

    callable_ = F.col("state").isin(REFERENCE, ALTERNATE)
    per = resolved.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(F.col("state") != ABSENT).alias("found"), F.count_if(callable_).alias("callable"))
    rec, cal = F.col("found") / F.greatest("n", F.lit(1)), F.col("callable") / F.greatest("n", F.lit(1))
    passed = (rec >= min_recovery) & (cal >= min_callable) & (F.col("callable") > 0)
    return per.select("sample", F.col("n").alias("n_features"), rec.alias("recovery"), cal.alias("callable"), F.when(passed, F.lit("predict")).otherwise(F.lit("abstain")).alias("verdict"))
