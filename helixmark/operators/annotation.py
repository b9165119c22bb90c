"""Coding annotation of single-base variants over CDS parts.

Contigs are cut into tiles, and places meet tiles: no row carries a whole contig, and a contig's rows spread over its tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence
from . import joins


#: Letters of a tile.
TILE = 10_000


def tiles(genome: DataFrame, flank: int = 0, width: int = TILE) -> DataFrame:
    """(contig, tile, piece) of sequences (contig, seq): `width` letters, with so many more on either side as the sequence goes on in a circle."""
    n = F.length("seq")
    around = F.expr(f"repeat(seq, cast(ceil({flank} / length(seq)) AS int))")
    whole = F.concat(F.substring(around, -flank, flank), F.col("seq"), F.substring(around, 1, flank)) if flank else F.col("seq")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width)), lambda k: F.struct(k.cast("long").alias("tile"), F.substring("__seq", (k * width + 1).cast("int"), F.lit(width + 2 * flank)).alias("piece")))
    return genome.where(n > 0).select("contig", "seq", whole.alias("__seq")).select("contig", F.inline(cut))


def tile_of(pos, width: int = TILE):
    """The tile of a 1-based place."""
    return F.floor((pos - 1) / width)


def contexts(sites: DataFrame, genome: DataFrame, flank: int, width: int = TILE) -> DataFrame:
    """sites (contig, pos, ...) with `context`: 2 * flank + 1 letters around each, of a circular sequence; places outside are left out."""
    df = sites.withColumn("tile", tile_of(F.col("pos"), width)).join(tiles(genome, flank, width), ["contig", "tile"])
    text = F.expr(f"substring(piece, cast(pos - tile * {width} AS int), {2 * flank + 1})")
    return df.where("pos >= 1").withColumn("context", text).where(F.length("context") == 2 * flank + 1).select(*sites.columns, "context")


def coding_parts(parts: DataFrame) -> DataFrame:
    """parts (contig, feature_order, part_order, start, end, strand) with `offset`: coding bases before the part, in the direction of the strand."""
    size = F.col("end") - F.col("start") + 1
    w = Window.partitionBy("contig", "feature_order").orderBy(F.when(F.col("strand") < 0, -F.col("start")).otherwise(F.col("start"))).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def coding_sequences(parts: DataFrame, genome: DataFrame, width: int = TILE) -> DataFrame:
    """(contig, feature_order, coding): spliced sequence of each feature, in the direction of its strand."""
    first, last = tile_of(F.col("start"), width), tile_of(F.col("end"), width)
    cut = parts.withColumn("tile", F.explode(F.sequence(first, last))).join(tiles(genome, 0, width), ["contig", "tile"])
    lo, hi = F.greatest(F.col("start"), F.col("tile") * width + 1), F.least(F.col("end"), (F.col("tile") + 1) * width)
    cut = cut.withColumns({"lo": lo, "hi": hi}).withColumn("bit", F.expr(f"substring(piece, cast(lo - tile * {width} AS int), cast(hi - lo + 1 AS int))"))
    bits = F.array_sort(F.collect_list(F.struct("tile", "bit")))
    g = cut.groupBy("contig", "feature_order", "offset", "strand").agg(F.array_join(F.transform(bits, lambda x: x["bit"]), "").alias("piece"))
    piece = F.when(F.col("strand") < 0, sequence.reverse_complement(F.col("piece"))).otherwise(F.col("piece"))
    each = F.array_sort(F.collect_list(F.struct("offset", piece.alias("p"))))
    return g.groupBy("contig", "feature_order").agg(F.array_join(F.transform(each, lambda x: x["p"]), "").alias("coding"))


def annotate(snps: DataFrame, parts: DataFrame, genome: DataFrame, width: int = 1000) -> DataFrame:
    """One row per variant and overlapping feature, or one non-coding row with the nearest feature.

    snps: (contig, pos, ref, alt), distinct. Columns: region, feature_order, strand, codon_number, codon,
    alt_codon, aa, alt_aa, effect, distance. A place outside the contig has region out_of_range, a reference
    base that differs ref_mismatch.
    """
    parts = coding_parts(parts)
    sizes = genome.select("contig", F.length("seq").alias("n"))
    base = snps.withColumn("tile", tile_of(F.col("pos"))).join(tiles(genome), ["contig", "tile"], "left").join(sizes, "contig", "left")
    base = base.withColumn("there", F.expr(f"substring(piece, cast(pos - tile * {TILE} AS int), 1)"))
    bad = F.when(F.col("n").isNull() | (F.col("pos") < 1) | (F.col("pos") > F.col("n")), "out_of_range").when(F.upper("there") != F.upper("ref"), "ref_mismatch")
    base = base.select("contig", "pos", "ref", "alt", bad.alias("bad"))
    good = base.where("bad IS NULL").drop("bad")
    hits = joins.range_join(good, parts, ["contig"], "pos", "start", "end", width).join(coding_sequences(parts, genome), ["contig", "feature_order"])
    index = F.col("offset") + F.when(F.col("strand") < 0, F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    letter = F.when(F.col("strand") < 0, sequence.reverse_complement(F.col("alt"))).otherwise(F.upper("alt"))
    hits = hits.withColumn("i", index.cast("int")).withColumn("codon", sequence.codon_of(F.col("coding"), F.col("i"))).withColumn("k", F.col("i") % 3)
    hits = hits.withColumn("alt_codon", F.concat(F.expr("substring(codon, 1, k)"), letter, F.expr("substring(codon, k + 2, 2)")))
    aa, other = sequence.amino_acid(F.col("codon")), sequence.amino_acid(F.col("alt_codon"))
    effect = F.when(aa == other, "synonymous").when(other == "*", "nonsense").when(aa == "*", "stop_loss").otherwise("missense")
    none = F.lit(None)
    coding = hits.select("contig", "pos", "ref", "alt", F.lit("coding").alias("region"), "feature_order", "strand", (F.floor(F.col("i") / 3) + 1).cast("int").alias("codon_number"), "codon", "alt_codon", aa.alias("aa"), other.alias("alt_aa"), effect.alias("effect"), F.lit(0).cast("long").alias("distance"))
    outside = good.join(coding.select("contig", "pos", "ref", "alt").distinct(), ["contig", "pos", "ref", "alt"], "left_anti")
    near = joins.nearest(outside, parts.select("contig", F.col("start").cast("long"), F.col("end").cast("long"), "feature_order", "strand"), ["contig"], "pos", "start", "end", "feature_order")
    empty = {c: none.cast(t) for c, t in (("codon_number", "int"), ("codon", "string"), ("alt_codon", "string"), ("aa", "string"), ("alt_aa", "string"), ("effect", "string"))}
    near = near.select("contig", "pos", "ref", "alt", F.lit("non_coding").alias("region"), "feature_order", "strand", *[v.alias(k) for k, v in empty.items()], F.col("distance").cast("long").alias("distance"))
    failed = base.where("bad IS NOT NULL").select("contig", "pos", "ref", "alt", F.col("bad").alias("region"), none.cast("int").alias("feature_order"), none.cast("int").alias("strand"), *[v.alias(k) for k, v in empty.items()], none.cast("long").alias("distance"))
    return coding.unionByName(near).unionByName(failed)


def type_filter(annotations: DataFrame, kind: str = "all") -> DataFrame:
    """all, coding, or sense (coding variants that change the amino acid)."""
    if kind == "coding":
        return annotations.where("region = 'coding'")
    if kind == "sense":
        return annotations.where("region = 'coding' AND effect <> 'synonymous'")
    return annotations
