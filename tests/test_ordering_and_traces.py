"""Orders in blocks against plain windows, and traces against figures worked out by hand."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import cells, context, ordering, overlap, peptides, testing, traces

from strandline.sources import text


def _hot(spark, n=600):
    """One entity with most of the rows, small ones, and a null entity."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randint(0, 5000), round(rng.uniform(-3, 3), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "e string, id long, pos long, v double")


def test_numbers_and_running_figures(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 17)
    df = _hot(spark)
    along = W.partitionBy("e").orderBy("pos", "id")
    want = df.select("id", (F.row_number().over(along) - 1).alias("i"), F.sum("pos").over(along).alias("s"), F.max("v").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("m"))
    rows = ordering.numbered(df, ["e"], ["pos", "id"])
    rows = ordering.running(rows, ["e"], F.col("pos"), "s")
    rows = ordering.running(rows, ["e"], F.col("v"), "m", F.max, inclusive=False)
    got = rows.select("id", F.col("_i").alias("i"), "s", "m")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_windows_do_not_depend_on_blocks(spark):
    df = _hot(spark)
    for op in (
        lambda b: overlap.clustered_sites(df, entity=["e"], position="pos", mean_distance=6.0, block=b),
        lambda b: overlap.sliding_regions(df, entity=["e"], order=["pos", "id"], value=F.col("v"), high=1.0, low=-1.0, block=b),
        lambda b: overlap.change_points(df, entity=["e"], order=["pos", "id"], value="v", step=0.8, block=b),
        lambda b: overlap.area_under(df, entity=["e"], order=["pos", "id"], x=F.col("pos"), y=F.col("v"), block=b).withColumn("area", F.round("area", 6)),
    ):
        whole = sorted(map(str, op(1_000_000).collect()))
        assert whole and sorted(map(str, op(7).collect())) == whole
        assert op(7).limit(0).count() == 0


def test_mid_ranks_share_ties(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 5.0), (None, 3.0)], "g string, x double")
    got = sorted((str(r.g), r.x, r.r) for r in ordering.mid_ranks(df, ["g"], "x", "r").collect())
    assert got == [("None", 3.0, 1.0), ("g", 1.0, 1.0), ("g", 2.0, 2.5), ("g", 2.0, 2.5), ("g", 5.0, 4.0)]


def test_area_of_a_triangle(spark):
    spectra = spark.createDataFrame([(i, 10.0 * i, [400.0, 500.0, 500.001], [7.0, h, 0.0]) for i, h in enumerate((0.0, 1000.0, 0.0))], "scan int, rt double, mz array<double>, intensity array<double>")
    targets = spark.createDataFrame([("p", 500.0, 10.0), ("far", 500.0, 9000.0), ("one", 400.0, -30.0)], "k string, mz double, rt double")
    got = {r.k: (r.n_points, r.area) for r in traces.ion_areas(spectra, targets, key="k").collect()}
    assert got == {"p": (3, 10_000.0), "one": (1, 7.0)}
    assert traces.ion_areas(spectra.limit(0), targets, key="k").count() == 0


def test_library_finds_its_own_spectrum(spark):
    matches = spark.createDataFrame([("PEPTIDEK", 100.0, False, 0.001), ("SAMPLER", 100.0, True, 0.0), ("ELVISK", 100.0, False, 0.5)], "peptide string, rt double, is_decoy boolean, q_value double")
    library = traces.library_entries(matches)
    (entry,) = library.collect()
    assert entry.peptide == "PEPTIDEK" and [round(f.intensity, 1) for f in entry.fragments] == [0.5] * 6 + [1.0] * 6
    peaks = sorted((f.mz, f.intensity * 10) for f in entry.fragments)
    spectra = spark.createDataFrame([(1, 130.0, [p[0] for p in peaks], [p[1] for p in peaks])], "scan int, rt double, mz array<double>, intensity array<double>")
    (found,) = traces.library_scores(spectra, library, key="peptide").collect()
    assert found.n_fragments == 12 and abs(found.score - 0.36788) < 1e-4 and found.rt_best == 130.0


def _subtree(df, what):
    """Lines of the optimised plan from the first node that names ``what`` down to its leaves."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = next(i for i, x in enumerate(lines) if what in x)
    return lines[at : next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))]


def test_library_scores_match_brute_force_without_a_row_for_each_scan(spark):
    rng = random.Random(3)
    spectra = [(k, 7.5 * (k // 2), m := sorted(rng.choice([100.0, 100.001, 150.0, 200.0, 250.0]) + rng.choice([0, 1e-4, 0.5]) for _ in range(rng.randint(0, 5))), [rng.choice([0.0, 1.0, 4.0, 1e9]) for _ in m]) for k in range(120)]
    kinds = [[(100.0, 1.0), (150.0, 2.0), (200.0, 0.5)], [(250.0, 1.0), (100.0005, 3.0), (150.0, 1.0), (9.0, 1.0)], [(100.0, 1.0), (100.0, 1.0), (200.0, 1.0)], [(7.0, 1.0)], []]
    library = [(f"k{i}", float(rng.choice([rng.randint(-40, 500), 9000])), rng.choice(kinds)) for i in range(200)]
    want = {}
    for name, rt, fragments in library:
        near = [s for s in spectra if abs(s[1] - rt) <= 30]
        shown = [[max([i for m, i in zip(s[2], s[3]) if abs(m - mz) <= mz * 20 / 1e6], default=0.0) for mz, _ in fragments] for s in near]
        x = [sum(row[j] for row in shown) for j in range(len(fragments))]
        if sum(v > 0 for v in x) >= 2:
            dot = sum(f[1] * v for f, v in zip(fragments, x)) / (sum(f[1] ** 2 for f in fragments) * sum(v * v for v in x)) ** 0.5
            top = max(((sum(row), -s[1]) for s, row in zip(near, shown)))
            if dot >= 0.5:
                want[name] = (-top[1], sum(v > 0 for v in x), round(dot * max(math.exp(-(((-top[1] - rt) / 15) ** 2)), 0.01), 6))
    a = spark.createDataFrame(spectra, "scan int, rt double, mz array<double>, intensity array<double>")
    b = spark.createDataFrame(library, "k string, rt double, fragments array<struct<mz:double,intensity:double>>").repartition(3)
    found = traces.library_scores(a, b, key="k", window=30.0, sigma=15.0, least_fragments=2)
    assert {r.k: (r.rt_best, r.n_fragments, round(r.score, 6)) for r in found.collect()} == want and len(want) > 20
    # Scans are not laid out for each entry: fragments meet no peaks before these are parted.
    assert not any("arrays_zip(mz" in x or "arrays_zip(cast(mz" in x for x in _subtree(found, "posexplode("))


def test_votes(spark):
    spectra = spark.createDataFrame([(1, 1000.0, [100.2, 250.7, 900.0])], "s int, neutral_mass double, mz array<double>")
    known = spark.createDataFrame([("a", 1000.01, [101.0, 251.0]), ("b", 1000.01, [101.0, 500.0]), ("c", 1001.0, [100.0, 250.0])], "p string, mass double, ions array<double>")
    assert [tuple(r) for r in traces.voted_candidates(spectra, known, spectrum="s", peptide="p").collect()] == [(1, "a", 2)]


def test_votes_are_not_laid_out_peak_by_peak(spark, monkeypatch):
    """Every pair has its votes, at any size of a class, and no stage has a row for each peak of a pair."""
    rng = random.Random(7)
    spectra = [(s, 1000.0 + s % 3, [float(rng.randint(100, 140)) + rng.random() for _ in range(rng.randint(0, 30))]) for s in range(40)]
    known = [(f"p{k}", 1000.01 + k % 3, [float(100 + (k * 7 + j * 13) % 40) for j in range(4)]) for k in range(150)] + [(None, 1000.0, [100.0]), ("twice", 1000.0, [110.0]), ("twice", 1001.0, [120.0, None])]
    ions, masses, want = {}, {}, {}
    for p, mass, m in known:
        ions.setdefault(p, []).extend(int(x) for x in m if x is not None)
        masses.setdefault(p, []).append(mass)
    for s, mass, mz in spectra:
        for p in set(ions) - {None}:
            fit = sum(abs(x - mass) <= 0.05 for x in masses[p])
            n = fit * sum(abs(ion - int(x)) <= 1 for ion in ions[p] for x in mz)
            if n >= 2:
                want[s, p] = n
    a, b = spark.createDataFrame(spectra, "s int, neutral_mass double, mz array<double>"), spark.createDataFrame(known, "p string, mass double, ions array<double>")
    for members in (3, 100):
        monkeypatch.setattr(traces, "MEMBERS", members)
        found = traces.voted_candidates(a, b, spectrum="s", peptide="p")
        assert {(r.s, r.p): r.votes for r in found.collect()} == want and found.count() == len(want)
    # Peaks are counted before they meet a peptide.
    assert not any("Join" in x for x in _subtree(found, "explode(mz#"))


def test_context_channels_and_like_ends(spark):
    sequences = spark.createDataFrame([("1", "ACGTTTGACCAGT" * 40)], "name string, sequence string")
    rows = [("1", 2, "C", "T"), ("1", 3, "G", "A"), ("1", 1, "A", "C"), ("9", 5, "C", "T"), ("1", 7, "GACC", "G")]
    calls = spark.createDataFrame(rows, "chrom string, pos long, ref_allele string, alt_allele string")
    for width in (5, 64, 1 << 14):
        tiles = context.sequence_tiles(sequences, width=width, margin=8)
        flanked = context.with_flanks(calls, tiles, width=width, margin=8)
        got = {r.pos: (r.before[-1:], r.after[:1]) for r in flanked.collect()}
        assert got == {2: ("A", "G"), 3: ("C", "T"), 1: ("", "C"), 7: ("T", "A")}
        spectrum = {r.label: r.n_calls for r in context.context_spectrum(flanked, []).collect()}
        # A[C>T]G, and G>A between C and T, which is A[C>T]G on the other strand.
        assert len(spectrum) == 96 and spectrum["A[C>T]G"] == 2 and sum(spectrum.values()) == 2
    ends = spark.sql("SELECT 'ACC' AS d, 'TTAC' AS b, 'CCGG' AS a").select(context.like_ends(F.col("d"), F.col("b"), F.col("a")).alias("k")).first().k
    assert ends == 2
    assert calls.select(context.reverse_complement(F.lit("AACGN")).alias("x")).first().x == "NCGTT"


def test_tiles_from_long_lines_match_those_from_whole_sequences(spark, tmp_path):
    rng = random.Random(6)
    sequences = {n: "".join(rng.choices("ACGTn", k=k)) for n, k in (("1", 300), ("2", 7), ("X", 128))}
    body = "".join(f">{n} about\n" + "\n".join(s[i : i + 11] for i in range(0, len(s), 11)) + "\n" for n, s in sequences.items())
    (tmp_path / "a.fa").write_text(body)
    frame = spark.createDataFrame([(n, s.upper()) for n, s in sequences.items()], "name string, sequence string")
    for width, margin in ((16, 4), (64, 8), (7, 20)):
        want = {(r.chrom, r.tile): r.bases for r in context.sequence_tiles(frame, width=width, margin=margin).collect()}
        got = {(r.chrom, r.tile): r.bases for r in text.read_fasta_tiles(spark, str(tmp_path / "a.fa"), width=width, margin=margin).collect()}
        assert got == want
    assert {r.chrom for r in text.read_fasta_tiles(spark, str(tmp_path / "a.fa"), width=16, margin=4, names=["X"]).collect()} == {"X"}


def test_projected_and_local_neighbours(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    true = {(r.id, r.neighbour): r.distance for r in cells.nearest_neighbours(df.filter("id < 300"), df, key="id", vector="v", k=5).collect()}
    found = cells.projected_neighbours(df, key="id", vector="v", k=5, width=5, projections=20, reach=15).collect()
    hits = [abs(true[(r.id, r.neighbour)] - r.distance) < 1e-9 for r in found if (r.id, r.neighbour) in true]
    assert all(hits) and len(hits) >= 0.9 * len(true)
    near = spark.createDataFrame([(1, j, float(j)) for j in range(1, 9)], "id long, neighbour long, distance double")
    weights = sorted(r.weight for r in cells.local_weights(near, key="id").collect())
    assert abs(sum(weights) - 3) < 1e-4 and weights[-1] == 1.0


def test_peaks_from_coverage(spark):
    tags = spark.createDataFrame([("1", 1000 + i % 40, False) for i in range(60)] + [("1", 100 * i, True) for i in range(100)], "chrom string, at long, rev boolean")
    lengths = spark.createDataFrame([("1", 10_000), ("2", 10_000)], "chrom string, length long")
    (peak,) = overlap.call_peaks(tags, lengths, start="at", is_reverse=F.col("rev"), extend=1, least=10.0).collect()
    assert (peak.chrom, peak.summit) == ("1", 900) and peak.start_pos == 900 and peak.end_pos == 1300 and peak.height == 62
    assert overlap.call_peaks(tags.limit(0), lengths, start="at", is_reverse=F.col("rev")).count() == 0


def test_leading_genes(spark):
    ranked = spark.createDataFrame([(f"g{i}", i) for i in range(1, 11)], "gene string, rank long")
    sets = spark.createDataFrame([("top", "g1"), ("top", "g2"), ("top", "g9"), ("low", "g9"), ("low", "g10")], "k string, gene string")
    got = sorted((r.k, r.gene) for r in testing.leading_genes(ranked, sets, set_key="k").collect())
    assert got == [("low", "g10"), ("low", "g9"), ("top", "g1"), ("top", "g2")]
    assert peptides.PROTON > 1
