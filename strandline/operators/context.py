"""Calls in the sequence around them: flanks, 96-channel spectra, deletions between like ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases in the order of the channels; complements (fixed values).
BASES, COMPLEMENTS = "ACGT", "TGCA"
#: Substitutions in the order of the channels (fixed values).
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
#: Bases of a tile of reference sequence, and of its margins on both sides.
TILE, MARGIN = 1 << 14, 128


def complement(sequence: Column) -> Column:
    """Complementary bases; all else stays."""
    return F.translate(F.upper(sequence), BASES, COMPLEMENTS)


def reverse_complement(sequence: Column) -> Column:
    """The other strand, read in its own direction."""
    return F.reverse(complement(sequence))


def sequence_tiles(sequences: DataFrame, *, width: int = TILE, margin: int = MARGIN) -> DataFrame:
    """``chrom``, ``tile`` and ``bases`` of sequences (name, sequence): tile t has the
    positions t width + 1 to (t + 1) width, counted from 1, and ``margin`` more on both
    sides, blanks where the sequence has none. A long sequence becomes many rows."""
    n = F.length("sequence")
    padded = F.concat(F.lit(" " * margin), F.col("sequence"), F.lit(" " * (margin + width)))
    tiles = sequences.select(F.col("name").alias("chrom"), padded.alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / width))).alias("tile"))
    return tiles.select("chrom", "tile", F.col("_s").substr((F.col("tile") * width + 1).cast("int"), F.lit(width + 2 * margin)).alias("bases"))


def with_flanks(calls: DataFrame, tiles: DataFrame, *, width: int = TILE, margin: int = MARGIN) -> DataFrame:
    """Calls (chrom, pos, ref_allele) with the reference ``before`` and ``after`` their
    reference allele: an equi-join on the tile of the position, whose margins hold the
    flanks. Flanks are as long as the margin leaves room, blanks beyond the sequence
    cut off. Calls outside of all tiles are left out."""
    placed = calls.withColumn("tile", F.floor((F.col("pos") - 1) / width))
    at = (F.col("pos") - 1 - F.col("tile") * width + margin + 1).cast("int")
    size = F.length("ref_allele")
    joined = placed.join(tiles.select("chrom", "tile", "bases"), ["chrom", "tile"])
    before, after = F.col("bases").substr(at - margin, F.lit(margin)), F.col("bases").substr(at + size, F.lit(margin))
    return joined.withColumn("before", F.upper(F.ltrim(before))).withColumn("after", F.upper(F.rtrim(after))).drop("bases", "tile")


def context_channel(ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """Channel 0 to 95 of a substitution in its context, read on the strand with the
    pyrimidine; null for anything else and where a flank is no base."""
    r, a = F.upper(ref), F.upper(alt)
    left, right = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    turned = r.isin("A", "G")
    kind = F.concat(F.when(turned, complement(r)).otherwise(r), F.lit(">"), F.when(turned, complement(a)).otherwise(a))
    five, three = F.when(turned, complement(right)).otherwise(left), F.when(turned, complement(left)).otherwise(right)
    place = lambda b: F.coalesce(*[F.when(b == x, i) for i, x in enumerate(BASES)])
    number = F.coalesce(*[F.when(kind == s, i) for i, s in enumerate(SUBSTITUTIONS)])
    known = left.isin(*BASES) & right.isin(*BASES) & r.isin(*BASES) & a.isin(*BASES) & (r != a)
    return F.when(known, place(five) * 24 + number * 4 + place(three))


def context_spectrum(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls and fraction of each of the 96 channels per group, zeros included.

    ``calls``: the result of :func:`with_flanks`. A channel's label is its context,
    as in A[C>T]G. Calls without a channel count in none.
    """
    channel = context_channel(F.col("ref_allele"), F.col("alt_allele"), F.col("before"), F.col("after"))
    counted = calls.select(*by, channel.alias("channel")).filter(F.col("channel").isNotNull()).groupBy(*by, "channel").agg(F.count("*").alias("n_calls"))
    total = counted.groupBy(*by).agg(F.sum("n_calls").alias("_all"))
    every = total.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(95))))
    match = F.col("e.channel") == F.col("c.channel")
    for b in by:
        match = match & F.col(f"e.{b}").eqNullSafe(F.col(f"c.{b}"))
    joined = every.alias("e").join(counted.alias("c"), match, "left").select("e.*", F.coalesce("c.n_calls", F.lit(0)).alias("n_calls"))
    letter = lambda i: F.lit(BASES).substr((i + 1).cast("int"), F.lit(1))
    five, three = F.floor(F.col("channel") / 24), F.col("channel") % 4
    kind = F.get(F.array(*[F.lit(s) for s in SUBSTITUTIONS]), F.floor((F.col("channel") % 24) / 4).cast("int"))
    label = F.concat(letter(five), F.lit("["), kind, F.lit("]"), letter(three))
    return joined.select(*by, "channel", label.alias("label"), "n_calls", (F.col("n_calls") / F.col("_all")).alias("fraction"))


def like_ends(deleted: Column, before: Column, after: Column) -> Column:
    """Microhomology of a deletion: the most bases k for which the flank before ends
    as the deleted bases begin, or the flank after begins as they end."""
    n = F.length(deleted)
    longest = lambda room, same: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.least(n, room)), same)), F.lit(0))
    left = longest(F.length(before), lambda k: F.right(before, k) == F.left(deleted, k))
    right = longest(F.length(after), lambda k: F.left(after, k) == F.right(deleted, k))
    return F.greatest(left, right)


def repair_scores(calls: DataFrame, by: list[str]) -> DataFrame:
    """Repair-deficiency score of indels with the reference around them, per group.

    0.7 times the part of indels that are deletions between like ends, plus 0.3 times
    the part that are deletions of 6 to 50 bases; ``high`` above 0.25,
    ``intermediate`` from 0.1, else ``low``. Alleles compare by length; the deleted
    bases are those of the reference allele beyond the alternative's length.
    """
    ref, alt = F.upper("ref_allele"), F.upper("alt_allele")
    size = F.length(ref) - F.length(alt)
    anchor = F.left(ref, F.length(alt))
    deleted = F.right(ref, size)
    before = F.right(F.concat(F.col("before"), anchor), size)
    ends = F.when(size > 0, like_ends(deleted, before, F.left(F.col("after"), size)))
    rows = calls.filter(size != 0).select(*by, size.alias("_size"), ends.alias("_ends"))
    n = lambda c: F.count(F.when(c, 1))
    counted = rows.groupBy(*by).agg(F.count("*").alias("n_indel"), n(F.col("_size").between(6, 50)).alias("n_long_del"), n(F.col("_size") < -3).alias("n_ins"), n(F.col("_ends") >= 1).alias("n_like_ends"))
    score = 0.7 * F.col("n_like_ends") / F.col("n_indel") + 0.3 * F.col("n_long_del") / F.col("n_indel")
    rated = counted.withColumn("score", score)
    return rated.withColumn("class", F.when(F.col("score") > 0.25, "high").when(F.col("score") >= 0.1, "intermediate").otherwise("low"))
