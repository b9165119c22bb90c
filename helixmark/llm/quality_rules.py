"""Quality rules with adaptive thresholds, in DataFrame functions only.

Counts are made of each whole text; base rules reject texts that are too short or mostly repeat
themselves. For the rest, each measure (an integer: per mille, or hundredths) and each measure's
denominator go into a quantile sketch per language and source: a histogram over log-linear buckets (exact
below 64, relative error at most 1/32 above), so that two sketches merge by adding counts and the outcome
doesn't depend on order or partitioning. The sketches of a language's sources are merged for the language,
those of all languages for the corpus.

A measure is an outlier beyond its group's upper decile (for some: below the lower one) by more than
`reach` times the distance from the decile to the median, or than `reach` times what one event is worth in a
text of median length, if that is larger. No threshold is given beforehand, and all of them come from the
sketches. A group's quantiles are drawn towards its language's as if it had `shrink` more texts with these,
and a language's towards the corpus's: the larger a group, the more its own sketch decides, at any size.

Defined results: null or empty text has no words and fails the base rules; null language or source is
a group of its own; repeated rows count as often as they occur; an empty table gives an empty result;
input columns with the name of an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialise, with_outputs

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Each measure: numerator, denominator, factor, what one event adds to the numerator, whether low values are outliers too.
MEASURES = {
    "symbols_pm": ("n_symbols", "word_chars", 1000, 1, False),
    "dup_lines_pm": ("n_dup_lines", "n_lines", 1000, 1, False),
    "repeats_pm": ("n_repeat_words", "n_words", 1000, 6, False),
    "capitals_pm": ("n_capitals", "word_chars", 1000, 1, False),
    "word_length_c": ("word_chars", "n_words", 100, 1, True),
}
DENOMINATORS = tuple(dict.fromkeys(m[1] for m in MEASURES.values()))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SHRINK, REACH = 50, 6
#: Log-linear buckets: so many bits below the leading one are kept.
SUB_BITS = 5


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a 3-word window found at least twice in the array of words.

    Windows are compared as joined strings (words have no spaces). Only texts where two windows have the
    same hash sort their windows; the rest, where no two can be equal, end with a set of hashes.
    """
    df = df.withColumn("__hx_hash", F.expr(f"transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (x, i) -> xxhash64(x, {words}[i + 1], {words}[i + 2]))"))
    df = df.withColumn("__hx_twice", F.expr("size(array_distinct(__hx_hash)) < size(__hx_hash)"))
    df = df.withColumn("__hx_sorted", F.expr(f"CASE WHEN __hx_twice THEN array_sort(transform(slice({words}, 1, size({words}) - 2), (x, i) -> struct(concat(x, ' ', {words}[i + 1], ' ', {words}[i + 2]) AS t, i AS i))) END"))
    df = df.withColumn(
        "__hx_at",
        F.expr("CASE WHEN __hx_twice THEN sort_array(filter(transform(__hx_sorted, (e, k) -> CASE WHEN coalesce(e.t = get(__hx_sorted, k - 1).t, false) OR coalesce(e.t = get(__hx_sorted, k + 1).t, false) THEN e.i END), p -> p IS NOT NULL)) END"),
    )
    covered = F.expr("aggregate(__hx_at, struct(-9 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n)")
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long")))


def counted(docs: DataFrame) -> DataFrame:
    """docs and its counts, each under __hx_ and its name."""
    df = docs.withColumn("__hx_text", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("__hx_w", F.array_remove(F.split("__hx_text", SPACE), ""))
    df = df.withColumn("__hx_n_words", F.size("__hx_w").cast("long"))
    df = _repeat_words(df, "__hx_w", "__hx_n_repeat_words")
    df = df.withColumn("__hx_lines", F.filter(F.split("__hx_text", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumns(
        {
            "__hx_word_chars": F.length(F.regexp_replace("__hx_text", SPACE, "")).cast("long"),
            "__hx_n_symbols": F.regexp_count("__hx_text", F.lit("[#*$%&|<>]")).cast("long"),
            "__hx_n_capitals": F.regexp_count("__hx_text", F.lit(r"\p{Lu}")).cast("long"),
            "__hx_n_lines": F.size("__hx_lines").cast("long"),
            "__hx_n_dup_lines": (F.size("__hx_lines") - F.size(F.array_distinct("__hx_lines"))).cast("long"),
        }
    )
    # A filter on the counts would be pushed down with their expressions written out, arrays within lambdas
    # included; it can't pass a generator.
    counts = F.struct(*[F.col(f"__hx_{c}") for c in COUNTS])
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(counts)))


def base_failed(prefix: str = "__hx_") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def measure(name: str, prefix: str = "__hx_") -> Column:
    num, den, factor, _, _ = MEASURES[name]
    return F.coalesce(F.expr(f"({factor} * {prefix}{num}) div nullif({prefix}{den}, 0)"), F.lit(0)).cast("long")


def bucket_sql(v: str) -> str:
    """The bucket of a value of at least 0; buckets are ordered as their values."""
    shift = f"greatest(length(bin({v})) - {SUB_BITS + 1}, 0)"
    return f"({shift} * {2**SUB_BITS} + shiftright({v}, {shift}))"


def value_sql(b: str) -> str:
    """The least value of a bucket."""
    shift = f"greatest({b} div {2**SUB_BITS} - 1, 0)"
    return f"shiftleft({b} - {shift} * {2**SUB_BITS}, cast({shift} AS int))"


def sketches(features: DataFrame) -> DataFrame:
    """Rows (lang, source, measure, bucket, n): the sketch of each group, of all texts that pass the base rules."""
    each = [F.struct(F.lit(m).alias("measure"), measure(m).alias("v")) for m in MEASURES]
    each += [F.struct(F.lit(d).alias("measure"), F.col(f"__hx_{d}").alias("v")) for d in DENOMINATORS]
    rows = features.where(~base_failed()).select("lang", "source", F.explode(F.array(*each)).alias("m"))
    rows = rows.select("lang", "source", "m.measure", F.expr(bucket_sql("m.v")).cast("long").alias("bucket"))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group and measure the number of texts, lower decile, median and upper decile (the least value of its bucket, for the upper one the greatest)."""
    w = Window.partitionBy(*keys, "measure")
    total, upto = F.sum("n").over(w), F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = [F.expr(value_sql("bucket")).cast("double").alias("least"), (F.expr(value_sql("(bucket + 1)")) - 1).cast("double").alias("most")]
    rows = sketch.select(*keys, "measure", *ends, total.alias("total"), upto.alias("upto"))
    at = lambda p, end: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col(end)))
    return rows.groupBy(*keys, "measure").agg(F.max("total").cast("double").alias("total"), at(10, "least").alias("low"), at(50, "least").alias("mid"), at(90, "most").alias("high"))


def thresholds(sketch: DataFrame, shrink: float = SHRINK, reach: float = REACH) -> DataFrame:
    """One row per language and source: for each measure its bounds lo_<measure> and hi_<measure>."""
    per_lang = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    overall = per_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    a = _quantiles(sketch, ["lang", "source"]).alias("a")
    b, c = _quantiles(per_lang, ["lang"]).alias("b"), _quantiles(overall, []).alias("c")
    rows = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(F.broadcast(c), F.col("a.measure") == F.col("c.measure"))  # c: a row for each measure
    k = F.lit(float(shrink))

    def drawn(q: str) -> Column:
        lang = (F.col("b.total") * F.col(f"b.{q}") + k * F.col(f"c.{q}")) / (F.col("b.total") + k)
        return (F.col("a.total") * F.col(f"a.{q}") + k * lang) / (F.col("a.total") + k)

    rows = rows.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("a.measure").alias("measure"), *[drawn(q).alias(q) for q in ("low", "mid", "high")])
    of = lambda name, q: F.max(F.when(F.col("measure") == name, F.col(q)))
    wide = rows.groupBy("lang", "source").agg(*[of(m, q).alias(f"{m}_{q}") for m in MEASURES for q in ("low", "mid", "high")], *[of(d, "mid").alias(f"{d}_typical") for d in DENOMINATORS])
    bounds = []
    for m, (_, den, factor, event, low) in MEASURES.items():
        one = F.lit(float(factor * event)) / F.greatest(F.col(f"{den}_typical"), F.lit(1.0))
        beyond = lambda q: float(reach) * F.greatest(F.abs(F.col(f"{m}_{q}") - F.col(f"{m}_mid")), one)  # noqa: B023, E731
        bounds.append((F.col(f"{m}_high") + beyond("high")).alias(f"hi_{m}"))
        bounds.append((F.col(f"{m}_low") - beyond("low") if low else F.lit(-1.0)).alias(f"lo_{m}"))
    return wide.select("lang", "source", *bounds)


def fit(features: DataFrame, shrink: float = SHRINK, reach: float = REACH) -> DataFrame:
    """The thresholds of all of counted texts, kept in the shared folder."""
    kept = materialise(sketches(features), "quality-sketches", few=True)
    return materialise(thresholds(kept, shrink, reach), "quality-thresholds", few=True)


def judged(features: DataFrame, bounds: DataFrame, given: list[str]) -> DataFrame:
    """The given columns of features, its counts, base_failed, kept and the rule that decided."""
    t = bounds.select(F.col("lang").alias("__hx_lang"), F.col("source").alias("__hx_source"), *[F.col(c).alias(f"__hx_{c}") for c in bounds.columns[2:]])
    df = features.join(t, F.col("lang").eqNullSafe(F.col("__hx_lang")) & F.col("source").eqNullSafe(F.col("__hx_source")), "left")
    beyond = F.lit(None).cast("string")
    for m in reversed(MEASURES):
        beyond = F.when((measure(m) > F.col(f"__hx_hi_{m}")) | (measure(m) < F.col(f"__hx_lo_{m}")), F.lit(m)).otherwise(beyond)
    rule = F.when(base_failed(), F.lit("base")).otherwise(beyond)
    return with_outputs(df, given, {c: F.col(f"__hx_{c}") for c in COUNTS} | {"base_failed": base_failed(), "kept": rule.isNull(), "rule": rule})


def apply_rules(docs: DataFrame, shrink: float = SHRINK, reach: float = REACH) -> DataFrame:
    """All of docs with its columns, counts and verdict; thresholds come from docs itself. Texts are counted once, and written with their counts."""
    features = materialise(counted(docs), "quality-texts")
    return judged(features, fit(features, shrink, reach), docs.columns)


def quality_report(docs: DataFrame, shrink: float = SHRINK, reach: float = REACH) -> DataFrame:
    """As apply_rules, without the texts."""
    given = [c for c in docs.columns if c.lower() != "text"]
    features = materialise(counted(docs).select(*[F.col(f"`{c}`") for c in given], *[f"__hx_{c}" for c in COUNTS]), "quality-counts")
    return judged(features, fit(features, shrink, reach), given)
