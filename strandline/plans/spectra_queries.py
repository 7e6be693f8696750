"""Queries of peptides and of ions over time; events stand for the peaks of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.stats import ln_gamma
from strandline.operators import features, peptides, traces
from strandline.plans.views import GENES, genes
from strandline.sources.spectra import clean_peaks
from strandline.tables import table

#: Residues that the hexadecimal digits of a digest stand for.
RESIDUES = "GASPVTCLNDQKEMHR"
_START = 1704067200


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as peaks: scan (a minute), rt, mz (400 and k), intensity."""
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - _START) / 60)
    return table(spark, sf_dir, "events").select(at.alias("scan"), (at * 60.0).alias("rt"), (k + 400.0).alias("mz"), F.col("value").alias("intensity"), "user_id").filter("mz IS NOT NULL AND intensity IS NOT NULL AND scan IS NOT NULL")


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _peaks(spark, sf_dir).groupBy("scan", "rt").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("_p"))
    return rows.select("scan", "rt", F.col("_p.mz").alias("mz"), F.col("_p.intensity").alias("intensity"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir).groupBy("user_id").agg(F.min("rt").alias("rt"))


def _fragments() -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.struct((400.0 + (F.col("user_id") * 7 + j * 13) % 100).alias("mz"), (j + 1.0).alias("intensity")))


def ion_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each user's ion in the hour around its first event."""
    targets = _users(spark, sf_dir).select("user_id", (400.0 + F.col("user_id") % 100).alias("mz"), "rt")
    found = traces.ion_areas(_spectra(spark, sf_dir), targets, key="user_id", window=3600.0, ppm=500.0)
    return found.select("user_id", "n_points", F.round("area", 3).alias("area"))


def library_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ions of each user looked for in the hours around its first event."""
    library = _users(spark, sf_dir).select("user_id", "rt", _fragments().alias("fragments"))
    found = traces.library_scores(_spectra(spark, sf_dir), library, key="user_id", ppm=500.0, window=36000.0, sigma=18000.0)
    return found.select("user_id", F.round("rt_best", 3).alias("rt_best"), "n_fragments", F.round("score", 6).alias("score"))


def voted_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose ions at least two peaks of a scan vote for."""
    spectra = _spectra(spark, sf_dir).select("scan", (1000.0 + F.col("scan") % 50).alias("neutral_mass"), "mz")
    known = _users(spark, sf_dir).select("user_id", (1000.0 + F.col("user_id") % 50 + 0.01).alias("mass"), F.transform(_fragments(), lambda f: f["mz"]).alias("ions"))
    return traces.voted_candidates(spectra, known, spectrum="scan", peptide="user_id")


def base_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each scan that reach a tenth of its base peak, scaled to it."""
    cleaned = clean_peaks(_spectra(spark, sf_dir), 0.1)
    return cleaned.select("scan", F.size("mz").cast("long").alias("n_peaks"), F.round(F.aggregate("intensity", F.lit(0.0), lambda a, i: a + i), 4).alias("total"))


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of 64 residues for each gene, from its digests."""
    part = lambda text: F.translate(F.md5(text), "0123456789abcdef", RESIDUES)
    ids = genes(spark, sf_dir).select("gene_id").distinct()
    return ids.select(F.col("gene_id").alias("name"), F.concat(part(F.col("gene_id")), part(F.concat("gene_id", F.lit("2")))).alias("sequence"))


def digested_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tryptic peptides of each protein with up to two cuts missed, and their masses."""
    return peptides.digest(_proteins(spark, sf_dir)).select("protein", "peptide", F.col("n_missed").cast("long").alias("n_missed"), F.round("mass", 4).alias("mass"))


def decoys_and_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and reversed decoys, with the number of ways to carry up to two phosphates and the mean mass."""
    cut = peptides.digest(_proteins(spark, sf_dir), missed=0)
    forms = peptides.phosphorylated(peptides.with_decoys(cut.select("protein", "peptide", "mass")))
    return forms.groupBy("protein", "peptide", "is_decoy").agg(F.count("*").alias("n_forms"), F.round(F.avg("mass"), 3).alias("mean_mass"))


def searched_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of the peptides' own ions searched among all: the best match and its score."""
    cut = peptides.digest(_proteins(spark, sf_dir), missed=0).select("protein", "peptide", "mass")
    once = cut.groupBy("peptide").agg(F.first("mass").alias("mass"))
    b, y = peptides.fragment_ions(F.col("peptide"))
    ions = F.array_sort(F.concat(b, y))
    spectra = once.select(F.col("peptide").alias("spectrum"), (F.col("mass") + peptides.PROTON).alias("precursor_mz"), F.lit(1).alias("charge"), ions.alias("mz"), F.transform(ions, lambda m: F.lit(1.0)).alias("intensity"))
    met = peptides.precursor_candidates(spectra, once)
    best = peptides.best_matches(peptides.hyperscore(met), spectrum=["spectrum"])
    return best.select("spectrum", "peptide", F.col("n_b").cast("long").alias("n_b"), F.col("n_y").cast("long").alias("n_y"), F.round("score", 4).alias("score"))


def inferred_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and distinct peptides of each protein, of peptides of up to one missed cut."""
    cut = peptides.digest(_proteins(spark, sf_dir), missed=1)
    found = peptides.infer_proteins(cut.select("protein", "peptide", F.col("mass").alias("score")))
    return found.select("protein", "n_matches", "n_peptides", F.round("best_score", 3).alias("best_score"))


def ion_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last fragments that a library keeps of each peptide."""
    cut = peptides.digest(_proteins(spark, sf_dir), missed=0).groupBy("peptide").agg(F.min("mass").alias("rt"))
    kept = traces.library_entries(cut.select("peptide", "rt", F.lit(False).alias("is_decoy"), (1 / F.length("peptide")).alias("q_value")), most=0.125)
    return kept.select("peptide", F.size("fragments").cast("long").alias("n_ions"), F.round(F.col("fragments")[0]["mz"], 4).alias("first"), F.round(F.element_at("fragments", -1)["mz"], 4).alias("last"))


def factorials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of the factorial of each scan's number of peaks."""
    return _peaks(spark, sf_dir).groupBy("scan").agg(F.count("*").alias("n")).select("scan", "n", F.round(ln_gamma(F.col("n") + 1.0), 6).alias("ln_factorial"))


def isotope_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of scans of ten minutes that begin an isotope pattern."""
    rows = _peaks(spark, sf_dir).withColumn("scan", F.floor(F.col("scan") / 10)).groupBy("scan", "mz").agg(F.max("intensity").alias("intensity"))
    spectra = rows.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("_p")).select("scan", (F.col("scan") * 600.0).alias("rt"), F.col("_p.mz").alias("mz"), F.col("_p.intensity").alias("intensity"))
    found = features.isotope_groups(spectra)
    return found.select("scan", "mz", F.col("charge").cast("long").alias("charge"), F.col("n_isotopes").cast("long").alias("n_isotopes"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trace_features(features.ion_traces(_peaks(spark, sf_dir).select("scan", "rt", "mz", "intensity"), ppm=10.0, most_apart=36000.0))


def ion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of ions over time with an apex: where, how high, how wide."""
    return _features(spark, sf_dir).select(F.round("mz", 3).alias("mz"), "apex", "height", "since", "until", "n_points")


def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that no higher one covers, in one row."""
    return features.feature_report(features.distinct_features(_features(spark, sf_dir), ppm=3000.0))


QUERIES = {
    f.__name__: f
    for f in (ion_areas, library_scores, voted_peptides, base_peaks, digested_proteins, decoys_and_sites, searched_spectra, inferred_proteins, ion_library, factorials, isotope_groups, ion_features, feature_report)
}
_PEAKS = f"""peaks AS (SELECT CAST(floor((epoch_us(ts) / 1000000 - {_START}) / 60) AS BIGINT) AS scan, 400.0::DOUBLE + CAST(json_extract(props, '$.k') AS INTEGER) AS mz, value AS intensity, user_id FROM events
  WHERE ts IS NOT NULL AND value IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL),
  scans AS (SELECT DISTINCT scan, scan * 60.0::DOUBLE AS rt FROM peaks), users AS (SELECT user_id, min(scan) * 60.0::DOUBLE AS rt FROM peaks GROUP BY user_id),
  ions AS (SELECT user_id, rt, j, 400.0::DOUBLE + (user_id * 7 + j * 13) % 100 AS mz, j + 1.0::DOUBLE AS lib FROM users, range(5) r(j))"""
_MASSES = "MAP {" + ", ".join(f"'{r}': {m}::DOUBLE" for r, m in peptides.RESIDUES.items()) + "}"
_PROTEINS = f"""{GENES}, proteins AS (SELECT gene_id AS name, translate(md5(gene_id), '0123456789abcdef', '{RESIDUES}') || translate(md5(gene_id || '2'), '0123456789abcdef', '{RESIDUES}') AS s FROM (SELECT DISTINCT gene_id FROM genes)),
  pieces AS (SELECT name, list_filter(string_split(replace(regexp_replace(s, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '') AS p FROM proteins),
  spans AS (SELECT name, array_to_string(p[i : i + m], '') AS peptide, m AS n_missed FROM pieces, range(1, 65) a(i), range(0, 3) b(m) WHERE i + m <= len(p)),
  digested AS (SELECT DISTINCT name AS protein, peptide, n_missed FROM spans WHERE length(peptide) BETWEEN 6 AND 50),
  weighed AS (SELECT *, {peptides.WATER} + list_sum(list_transform(string_split(peptide, ''), lambda r: {_MASSES}[r])) AS mass FROM digested)"""
_RES = lambda a, b: f"list_sum(list_transform(string_split(substr(peptide, {a}, {b}), ''), lambda r: {_MASSES}[r]))"
_FEATURES = f"""WITH {_PEAKS}, s AS (SELECT scan * 60.0::DOUBLE AS rt, scan, mz, intensity FROM peaks),
  j AS (SELECT *, CASE WHEN rt - lag(rt) OVER w > 36000 OR lag(rt) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM s WINDOW w AS (PARTITION BY mz ORDER BY rt, scan, intensity)),
  t AS (SELECT *, sum(n) OVER (PARTITION BY mz ORDER BY rt, scan, intensity ROWS UNBOUNDED PRECEDING) AS trace FROM j),
  tops AS (SELECT mz, trace, count(*) AS n_points, min(rt) AS f, max(rt) AS l, max(intensity) AS height, arg_max(rt, (intensity, -rt)) AS apex FROM t GROUP BY mz, trace),
  kept AS (SELECT * FROM tops WHERE n_points >= 3 AND apex > f AND apex < l),
  features AS (SELECT k.mz, k.apex, k.height, coalesce(max(t.rt) FILTER (t.rt < apex AND t.intensity < height / 2), any_value(f)) AS since, coalesce(min(t.rt) FILTER (t.rt > apex AND t.intensity < height / 2), any_value(l)) AS until, k.n_points
    FROM kept k JOIN t ON t.mz = k.mz AND t.trace = k.trace GROUP BY k.mz, k.trace, k.apex, k.height, k.n_points)"""
SQL = {
    "ion_areas": f"""WITH {_PEAKS}, pts AS (SELECT u.user_id, s.scan, s.rt, coalesce((SELECT sum(intensity) FROM peaks p WHERE p.scan = s.scan AND abs(p.mz - 400 - u.user_id % 100) <= (400 + u.user_id % 100) * 0.0005), 0.0) AS i
        FROM users u JOIN scans s ON abs(s.rt - u.rt) <= 3600),
      a AS (SELECT user_id, i, (i + lag(i) OVER w) / 2 * (rt - lag(rt) OVER w) AS a FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY rt))
      SELECT user_id, count(*) AS n_points, round(coalesce(sum(a), max(i)), 3) AS area FROM a GROUP BY user_id""",
    "library_scores": f"""WITH {_PEAKS}, shown AS (SELECT l.user_id, l.rt AS t, j, lib, s.scan, s.rt, coalesce(max(intensity), 0.0) AS i FROM ions l JOIN scans s ON abs(s.rt - l.rt) <= 36000
        LEFT JOIN peaks p ON p.scan = s.scan AND abs(p.mz - l.mz) <= l.mz * 0.0005 GROUP BY ALL),
      sc AS (SELECT user_id, t, scan, rt, sum(i) AS x FROM shown GROUP BY ALL), b AS (SELECT user_id, t, CASE WHEN max(x) > 0 THEN arg_max(rt, (x, -rt)) ELSE t END AS best FROM sc GROUP BY user_id, t),
      f AS (SELECT user_id, j, lib, sum(i) AS x FROM shown GROUP BY ALL), c AS (SELECT user_id, count(*) FILTER (x > 0) AS n, sum(lib * x) / nullif(sqrt(sum(lib * lib) * sum(x * x)), 0) AS d FROM f GROUP BY user_id)
      SELECT c.user_id, round(best, 3) AS rt_best, n AS n_fragments, round(d * greatest(exp(-pow((best - t) / 18000, 2)), 0.01), 6) AS score FROM c JOIN b USING (user_id) WHERE n >= 3 AND d >= 0.5""",
    "voted_peptides": f"""WITH {_PEAKS} SELECT scan, user_id, count(*) AS votes FROM peaks_ p JOIN ions i ON i.user_id % 50 = p.scan % 50 AND floor(i.mz) BETWEEN floor(p.mz - 1) AND floor(p.mz + 1) GROUP BY scan, user_id HAVING count(*) >= 2""".replace(
        "FROM peaks_ p", "FROM (SELECT scan, mz FROM peaks) p"
    ),
    "base_peaks": f"""WITH {_PEAKS}, b AS (SELECT scan, intensity, max(intensity) OVER (PARTITION BY scan) AS top FROM peaks)
      SELECT scan, count(*) AS n_peaks, round(sum(CAST(CAST(intensity / top AS FLOAT) AS DOUBLE)), 4) AS total FROM b WHERE intensity >= 0.1 * top GROUP BY scan""",
    "digested_proteins": f"WITH {_PROTEINS} SELECT protein, peptide, n_missed, round(mass, 4) AS mass FROM weighed",
    "decoys_and_sites": f"""WITH {_PROTEINS}, c AS (SELECT DISTINCT protein, peptide, mass FROM weighed WHERE n_missed = 0),
      t AS (SELECT protein, peptide, mass, false AS is_decoy FROM c UNION ALL SELECT protein, reverse(left(peptide, length(peptide) - 1)) || right(peptide, 1), mass, true FROM c),
      k AS (SELECT *, length(regexp_replace(peptide, '[^STY]', '', 'g')) AS n FROM t), f AS (SELECT *, 1 + n + n * (n - 1) // 2 AS w, n + n * (n - 1) AS shifts FROM k)
      SELECT protein, peptide, is_decoy, CAST(sum(w) AS BIGINT) AS n_forms, round(sum(mass * w + 79.966331 * shifts) / sum(w), 3) AS mean_mass FROM f GROUP BY ALL""",
    "searched_spectra": f"""WITH {_PROTEINS}, c AS (SELECT DISTINCT peptide FROM weighed WHERE n_missed = 0)
      SELECT peptide AS spectrum, peptide, length(peptide) - 1 AS n_b, length(peptide) - 1 AS n_y, round(2 * ln(length(peptide)) + 2 * lgamma(length(peptide)), 4) AS score FROM c""",
    "inferred_proteins": f"WITH {_PROTEINS} SELECT protein, count(*) AS n_matches, count(DISTINCT peptide) AS n_peptides, round(max(mass), 3) AS best_score FROM weighed WHERE n_missed <= 1 GROUP BY protein",
    "ion_library": f"""WITH {_PROTEINS}, c AS (SELECT DISTINCT peptide, length(peptide) AS n FROM weighed WHERE n_missed = 0 AND length(peptide) >= 8)
      SELECT peptide, 2 * least(6, n - 1) AS n_ions, round({_RES("1", "1")} + {peptides.PROTON}, 4) AS "first", round({_RES("n - least(6, n - 1) + 1", "least(6, n - 1)")} + {peptides.WATER + peptides.PROTON}, 4) AS "last" FROM c""",
    "isotope_groups": f"""WITH {_PEAKS}, p AS (SELECT DISTINCT scan // 10 AS scan, mz FROM peaks),
      h AS (SELECT p.scan, p.mz, z, d, bool_or(abs(q.mz - (p.mz + d * 1.00335 / z)) <= (p.mz + d * 1.00335 / z) * 20 / 1e6) AS hit FROM p JOIN p q ON q.scan = p.scan, range(1, 5) a(z), range(-1, 4) b(d) WHERE d <> 0 GROUP BY ALL),
      n AS (SELECT scan, mz, z, bool_or(hit) FILTER (d = -1) AS below, CASE WHEN NOT bool_or(hit) FILTER (d = 1) THEN 1 WHEN NOT bool_or(hit) FILTER (d = 2) THEN 2 WHEN NOT bool_or(hit) FILTER (d = 3) THEN 3 ELSE 4 END AS n FROM h GROUP BY ALL),
      b AS (SELECT scan, mz, max(n) AS n, arg_max(z, (n, -z)) AS z, arg_max(below, (n, -z)) AS below FROM n GROUP BY ALL)
      SELECT scan, mz, z AS charge, n AS n_isotopes FROM b WHERE n >= 2 AND NOT below""",
    "ion_features": _FEATURES + "SELECT round(mz, 3) AS mz, apex, height, since, until, n_points FROM features",
    "feature_report": _FEATURES
    + """, k AS (SELECT * FROM features f WHERE NOT EXISTS (SELECT 1 FROM features o WHERE abs(o.mz - f.mz) <= f.mz * 3000 / 1e6 AND o.since <= f.until AND f.since <= o.until
        AND (o.height > f.height OR (o.height = f.height AND (o.apex < f.apex OR (o.apex = f.apex AND o.mz < f.mz))))))
      SELECT count(*) AS n_features, median(mz) AS median_mz, min(apex) AS first, max(apex) AS last, max(height) AS highest FROM k""",
    "factorials": f"WITH {_PEAKS} SELECT scan, count(*) AS n, round(lgamma(count(*) + 1), 6) AS ln_factorial FROM peaks GROUP BY scan",
}
