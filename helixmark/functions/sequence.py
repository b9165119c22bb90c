"""Column expressions over sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of IUPAC codes.
IUPAC, IUPAC_COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
BASES = "TCAG"
#: Fixed value: amino acids of the 64 codons in TCAG order (tables 1 and 11 agree on it).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def capitals(seq: Column) -> Column:
    """A-Z for a-z; other letters stay, so that every letter keeps its place."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reverse_complement(seq: Column, iupac: bool = False) -> Column:
    a, b = (IUPAC, IUPAC_COMPLEMENT) if iupac else ("ACGTN", "TGCAN")
    return F.reverse(F.translate(capitals(seq), a, b))


def circular_context(genome: Column, pos: Column, flank: int) -> Column:
    """2 * flank + 1 letters around a 1-based position of a circular sequence, however short it is."""
    n = F.length(genome)
    letters = F.transform(F.sequence(F.lit(-flank), F.lit(flank)), lambda k: F.substring(genome, (F.pmod(pos - 1 + k, n) + 1).cast("int"), F.lit(1)))
    return F.array_join(letters, "")


def amino_acid(codon: Column) -> Column:
    """One-letter amino acid; X for a codon with other letters, NULL unless it has three."""
    c = F.upper(codon)
    at = lambda i: F.instr(F.lit(BASES), F.substring(c, i, 1)) - 1
    known = (at(1) >= 0) & (at(2) >= 0) & (at(3) >= 0)
    return F.when(F.length(c) != 3, F.lit(None)).when(known, F.substring(F.lit(AMINO), (at(1) * 16 + at(2) * 4 + at(3) + 1).cast("int"), F.lit(1))).otherwise(F.lit("X"))


def codon_of(coding: Column, index: Column) -> Column:
    """The codon that holds a 0-based coding index."""
    return F.substring(coding, (F.floor(index / 3) * 3 + 1).cast("int"), F.lit(3))
