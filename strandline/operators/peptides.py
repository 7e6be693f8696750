"""Peptides from proteins, their masses and ions, and the search of spectra among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Monoisotopic residue masses, water and proton (fixed values).
RESIDUES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
WATER, PROTON = 18.010565, 1.007276


def _mass_table() -> Column:
    return F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])


def residue_masses(sequence: Column) -> Column:
    """Masses of the residues in order; null for unknown ones."""
    table = _mass_table()
    return F.transform(F.filter(F.split(sequence, ""), lambda r: r != ""), lambda r: F.try_element_at(table, r))


def peptide_mass(sequence: Column) -> Column:
    """Neutral monoisotopic mass; null with an unknown residue or none."""
    masses = residue_masses(sequence)
    known = (F.size(masses) > 0) & ~F.exists(masses, lambda m: m.isNull())
    return F.when(known, F.aggregate(masses, F.lit(WATER), lambda a, m: a + m))


def fragment_ions(sequence: Column) -> tuple[Column, Column]:
    """Singly charged b and y ions, from the first break on."""
    masses = residue_masses(sequence)
    n = F.size(masses)
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, m: a + m)
    breaks = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    b = F.transform(breaks, lambda i: total(F.slice(masses, F.lit(1), i)) + PROTON)
    y = F.transform(breaks, lambda i: total(F.slice(masses, n - i + 1, i)) + WATER + PROTON)
    return b, y


def digest(proteins: DataFrame, *, missed: int = 2, shortest: int = 6, longest: int = 50) -> DataFrame:
    """Tryptic peptides: cuts after K or R but not before P, up to ``missed`` left uncut.

    Result: protein, peptide, n_missed, mass. Peptides with unknown residues are left out.
    """
    pieces = F.filter(F.split("sequence", r"(?<=[KR])(?!P)"), lambda p: p != "")
    rows = proteins.select(F.col("name").alias("protein"), pieces.alias("_p")).filter(F.size("_p") > 0)
    starts = rows.select("protein", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_i"), F.size("_p").alias("_n"))
    spans = starts.select("protein", "_p", "_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(missed), F.col("_n") - F.col("_i")))).alias("n_missed"))
    peptide = F.array_join(F.slice("_p", F.col("_i"), F.col("n_missed") + 1), "")
    made = spans.select("protein", peptide.alias("peptide"), "n_missed").filter(F.length("peptide").between(shortest, longest))
    return made.distinct().withColumn("mass", peptide_mass(F.col("peptide"))).filter(F.col("mass").isNotNull())


def with_decoys(peptides: DataFrame) -> DataFrame:
    """Peptides and their reversed decoys (last residue in place), told apart by ``is_decoy``."""
    turned = F.concat(F.reverse(F.expr("substring(peptide, 1, length(peptide) - 1)")), F.right("peptide", F.lit(1)))
    return peptides.withColumn("is_decoy", F.lit(False)).unionByName(peptides.withColumn("peptide", turned).withColumn("is_decoy", F.lit(True)))


def phosphorylated(peptides: DataFrame, *, most: int = 2, shift: float = 79.966331) -> DataFrame:
    """Peptides with every choice of up to ``most`` phosphorylated S, T or Y (``sites``, from 1)."""
    residues = F.split("peptide", "")
    places = F.filter(F.transform(F.sequence(F.lit(1), F.length("peptide")), lambda i: F.when(F.get(residues, i - 1).isin("S", "T", "Y"), i)), lambda i: i.isNotNull())
    out = peptides.withColumn("sites", F.array().cast("array<int>"))
    level = out.withColumn("_open", places)
    for _ in range(most):
        chosen = level.select("*", F.explode("_open").alias("_s"))
        level = chosen.withColumn("sites", F.array_append("sites", F.col("_s"))).withColumn("_open", F.filter("_open", lambda i: i > F.col("_s"))).withColumn("mass", F.col("mass") + shift).drop("_s")
        out = out.unionByName(level.drop("_open"))
    return out


def precursor_candidates(spectra: DataFrame, peptides: DataFrame, *, ppm: float = 10.0) -> DataFrame:
    """Spectra with the peptides whose mass fits: a join on whole daltons, then the ppm test."""
    mass = (F.col("precursor_mz") - PROTON) * F.greatest(F.col("charge"), F.lit(1))
    wide = spectra.withColumn("neutral_mass", mass).filter(F.col("neutral_mass") > 0)
    slack = F.col("neutral_mass") * ppm / 1e6
    binned = wide.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("neutral_mass") - slack), F.floor(F.col("neutral_mass") + slack))))
    return binned.join(peptides.withColumn("_bin", F.floor("mass")), "_bin").filter(F.abs(F.col("mass") - F.col("neutral_mass")) <= slack).drop("_bin")


def hyperscore(candidates: DataFrame, *, ppm: float = 20.0) -> DataFrame:
    """Adds ``n_b``, ``n_y`` and ``score``: ln of the matched b and y intensities plus one
    each, and of the factorials of their numbers; ions match the nearest peak within ``ppm``."""
    b, y = fragment_ions(F.col("peptide"))
    pairs = F.arrays_zip(F.col("mz").cast("array<double>").alias("m"), F.col("intensity").cast("array<double>").alias("i"))

    def matched(ions: Column) -> Column:
        def best(ion: Column) -> Column:
            near = F.filter(pairs, lambda p: F.abs(p["m"] - ion) / ion * 1e6 <= ppm)
            return F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["m"] - ion).alias("d"), p["i"].alias("i"))))["i"]

        return F.filter(F.transform(ions, best), lambda i: i.isNotNull())

    from strandline.functions.stats import ln_gamma

    scored = candidates.withColumn("_b", matched(b)).withColumn("_y", matched(y))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, i: a + i)
    scored = scored.withColumn("n_b", F.size("_b")).withColumn("n_y", F.size("_y"))
    score = F.log(total("_b") + 1) + F.log(total("_y") + 1) + ln_gamma(F.col("n_b") + 1.0) + ln_gamma(F.col("n_y") + 1.0)
    return scored.withColumn("score", score).drop("_b", "_y")


def best_matches(scored: DataFrame, *, spectrum: list[str]) -> DataFrame:
    """The best peptide of each spectrum and how far the second lies behind."""
    order = W.partitionBy(*spectrum).orderBy(F.desc("score"), "peptide")
    ranked = scored.withColumn("_second", F.lead("score").over(order)).withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") == 1).withColumn("delta", F.col("score") - F.coalesce("_second", F.lit(0.0))).drop("_r", "_second")


def infer_proteins(matches: DataFrame) -> DataFrame:
    """Matches, distinct peptides and best score of each protein."""
    return matches.groupBy("protein").agg(F.count("*").alias("n_matches"), F.count_distinct("peptide").alias("n_peptides"), F.max("score").alias("best_score"))
