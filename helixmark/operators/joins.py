"""Joins that Spark has no operator for: point in interval, nearest interval, tiered lookup; and searches of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..storage import materialise
from . import search


def bins_of(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def _binned(points: DataFrame, blocks: DataFrame, pos: str, start: str, end: str, width: int, long_bins: int) -> tuple[DataFrame, DataFrame]:
    """Both with __level and __bin: a point for each level that blocks have, a block for each bin that it lies in."""
    widths = [width * long_bins**k for k in range(4)]
    span = F.col(end) - F.col(start)
    level = F.lit(len(widths))
    for k in reversed(range(len(widths))):
        level = F.when(span <= widths[k] * long_bins, F.lit(k)).otherwise(level)
    b = blocks.where(F.col(end) >= F.col(start)).withColumn("__level", level)
    levels = sorted(r[0] for r in b.select("__level").distinct().collect()) or [0]  # at most five
    each = F.when(F.col("__level") == len(widths), F.array(F.lit(0).cast("long")))
    for k, w in enumerate(widths):
        each = each.when(F.col("__level") == k, bins_of(F.col(start), F.col(end), w))
    b = b.withColumn("__bin", F.explode(each))
    bin_at = lambda k: F.floor(F.col(pos) / widths[k]) if k < len(widths) else F.lit(0).cast("long")
    if len(levels) == 1:
        return points.withColumns({"__level": F.lit(levels[0]), "__bin": bin_at(levels[0])}), b
    p = points.withColumn("__at", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), bin_at(k).alias("bin")) for k in levels])))
    return p.withColumns({"__level": F.col("__at.level"), "__bin": F.col("__at.bin")}).drop("__at"), b


def range_join(points: DataFrame, blocks: DataFrame, keys: list[str], pos: str, start: str, end: str, width: int, long_bins: int = 64, how: str = "inner") -> DataFrame:
    """points with the blocks (closed intervals) that cover them: an equi join on bins, then the exact test.

    A block of more than `long_bins` bins goes to bins of `width * long_bins` instead, so a block becomes at
    most long_bins + 1 rows per level however long it is (levels grow by that factor, four of them; the last
    is one bin for all); a point is a row for each level that occurs, which one aggregate of the blocks tells.
    Neither side is a nested loop, and skewed keys are split by AQE.
    """
    p, b = _binned(points, blocks, pos, start, end, width, long_bins)
    out = p.join(b.hint("merge"), [*keys, "__level", "__bin"]).where((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))).drop("__level", "__bin")
    if how == "inner":
        return out
    extra = [c for c in blocks.columns if c not in keys]
    return points.join(out.select(*points.columns, *extra), points.columns, "left")


def first_covering(points: DataFrame, blocks: DataFrame, keys: list[str], pos: str, start: str, end: str, order: str, width: int, long_bins: int = 64) -> DataFrame:
    """points with the covering block of least order; without one its columns are NULL. Points are distinct rows.

    One outer join on bins and one aggregate; points needn't be joined back.
    """
    extra = [c for c in blocks.columns if c not in keys]
    p, b = _binned(points, blocks, pos, start, end, width, long_bins)
    b = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__level").alias("__l"), F.col("__bin").alias("__b"), F.struct(*extra).alias("__block"))
    same = (F.col("__level") == F.col("__l")) & (F.col("__bin") == F.col("__b")) & F.col(pos).between(F.col(f"__block.{start}"), F.col(f"__block.{end}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    best = p.join(b, same, "left").groupBy(*points.columns).agg(F.min_by("__block", f"__block.{order}").alias("__best"))
    return best.select(*points.columns, *[F.col(f"__best.{c}").alias(c) for c in extra])


def nearest(points: DataFrame, blocks: DataFrame, keys: list[str], pos: str, start: str, end: str, order: str, width: int = 100_000) -> DataFrame:
    """points (distinct rows) with the nearest block: distance 0 inside, else to the closer edge; of equal ones the least order.

    Points inside blocks meet them in a range join. For the others, the places of a key are cut into tiles of
    `width`: within a tile, points and edges are sorted together; what the tiles before and after it offer
    (the latest end, the first start) is carried over from one row per tile. No task holds all of a key's places.
    The points within blocks are written first, in a job of its own.
    """
    extra = [c for c in blocks.columns if c not in keys]
    good = blocks.where(F.col(end) >= F.col(start))
    inside = materialise(first_covering(points, good, keys, pos, start, end, order, width), "nearest-inside")  # read twice
    hit = F.col(f"{order}").isNotNull()
    out = inside.where(~hit).select(*points.columns)
    block = F.struct(*[F.col(c) for c in extra])
    kind = good.select(block.alias("b")).schema[0].dataType
    row = points.select(F.struct(*points.columns).alias("r")).schema[0].dataType
    of_point = out.select(*keys, F.col(pos).alias("__x"), F.struct(*points.columns).alias("__row"), F.lit(None).cast(kind).alias("__s"), F.lit(None).cast(kind).alias("__e"))
    starts = good.select(*keys, F.col(start).alias("__x"), F.lit(None).cast(row).alias("__row"), block.alias("__s"), F.lit(None).cast(kind).alias("__e"))
    ends = good.select(*keys, F.col(end).alias("__x"), F.lit(None).cast(row).alias("__row"), F.lit(None).cast(kind).alias("__s"), block.alias("__e"))
    events = of_point.unionByName(starts).unionByName(ends).withColumn("__tile", F.floor(F.col("__x") / width))
    # the latest end before (of equal ones the least order), the first start after
    left = F.when(F.col("__e").isNotNull(), F.struct(F.col("__x").alias("x"), (-F.col(f"__e.{order}")).alias("o"), F.col("__e").alias("b")))
    right = F.when(F.col("__s").isNotNull(), F.struct((-F.col("__x")).alias("x"), (-F.col(f"__s.{order}")).alias("o"), F.col("__s").alias("b")))
    tiles = events.groupBy(*keys, "__tile").agg(F.max(left).alias("l"), F.max(right).alias("r"))
    w = Window.partitionBy(*keys)  # a row per tile
    before, after = w.orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.col("__tile").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(*keys, "__tile", F.max("l").over(before).alias("__cl"), F.max("r").over(after).alias("__cr"))
    own = Window.partitionBy(*keys, "__tile")
    df = events.withColumns({"__l": F.max(left).over(own.orderBy("__x").rangeBetween(Window.unboundedPreceding, 0)), "__r": F.max(right).over(own.orderBy(F.col("__x").desc()).rangeBetween(Window.unboundedPreceding, 0))})
    df = df.where("__row IS NOT NULL").join(tiles, [*keys, "__tile"]).select("__row.*", F.greatest("__l", "__cl").alias("__l"), F.greatest("__r", "__cr").alias("__r"))
    dl, dr = F.col(pos) - F.col("__l.x"), -F.col("__r.x") - F.col(pos)
    right_wins = F.col("__r").isNotNull() & (F.col("__l").isNull() | (dr < dl) | ((dr == dl) & (F.col("__r.o") > F.col("__l.o"))))
    df = df.select(*points.columns, F.when(right_wins, F.col("__r.b")).otherwise(F.col("__l.b")).alias("__best"), F.when(right_wins, dr).otherwise(dl).alias("distance"))
    outside = df.select(*points.columns, *[F.col(f"__best.{c}").alias(c) for c in extra], "distance")
    return inside.where(hit).withColumn("distance", F.lit(0).cast(outside.schema["distance"].dataType)).unionByName(outside)


def tiered_lookup(requests: DataFrame, tiers: list[tuple[str, DataFrame, bool]], key: list[str], value: list[str]) -> DataFrame:
    """requests with values of the first tier that has any; tiers are (name, hits, unique).

    Hits are rows (key, value). A tier that must be unique and has several distinct values is ambiguous: it
    ends the search with values NULL and `match` "ambiguous_<name>".
    """
    rows = None
    for k, (name, hits, unique) in enumerate(tiers):
        one = hits.select(*key, F.lit(k).alias("__tier"), F.lit(name).alias("__name"), F.lit(unique).alias("__unique"), F.struct(*value).alias("__v"))
        rows = one if rows is None else rows.unionByName(one)
    # the first tier's least and greatest value
    least, greatest = (F.struct((F.col("__tier") * sign).alias("t"), F.col("__v").alias("v"), F.col("__name").alias("name"), F.col("__unique").alias("unique")) for sign in (1, -1))
    best = rows.groupBy(*key).agg(F.min(least).alias("b"), F.max(greatest).alias("c"))
    out = requests.join(best, key, "left")
    several = F.col("b.unique") & ~F.col("b.v").eqNullSafe(F.col("c.v"))
    return out.select(*requests.columns, *[F.when(~several, F.col(f"b.v.{v}")).alias(v) for v in value], F.when(several, F.concat(F.lit("ambiguous_"), F.col("b.name"))).otherwise(F.coalesce(F.col("b.name"), F.lit("absent"))).alias("match"))


def seeded_search(subjects: DataFrame, patterns: DataFrame, mismatches: int = 0) -> DataFrame:
    """Every place where a pattern occurs in a sequence with at most so many substitutions: (pattern_id, subject_id, at, mismatches).

    subjects: (subject_id, seq); patterns: (pattern_id, pattern). at is 0-based; overlapping hits count; empty patterns occur nowhere.
    """
    p = patterns.select("pattern_id", F.col("pattern").alias("letters"), F.lit(0).alias("centre")).distinct()
    return search.search(subjects, p, mismatches).select("pattern_id", "subject_id", F.col("at").cast("int").alias("at"), "mismatches")


def flank_search(subjects: DataFrame, contexts: DataFrame) -> DataFrame:
    """Places of contexts with exact flanks and a free centre, on both strands: (context_id, subject_id, at, strand, centre).

    contexts: (context_id, left, right); either flank may be empty. Reverse hits have the complement of the centre; palindromic ones hit twice.
    """
    plus = contexts.select("context_id", "left", "right", F.lit("+").alias("strand"))
    minus = contexts.select("context_id", reverse_complement(F.col("right")).alias("left"), reverse_complement(F.col("left")).alias("right"), F.lit("-").alias("strand"))
    both = plus.unionByName(minus).select("context_id", "strand", F.concat("left", F.lit(search.ANY), "right").alias("letters"), F.length("left").alias("centre"), F.length("left").alias("before"))
    hits = search.search(subjects, both)
    letter = F.col("letter")
    return hits.select("context_id", "subject_id", (F.col("at") + F.col("before")).cast("int").alias("at"), "strand", F.when(F.col("strand") == "-", reverse_complement(letter)).otherwise(letter).alias("centre"))
