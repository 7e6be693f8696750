"""Pileups, genotypes and fitted models against known truths."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import models, reads


@pytest.fixture
def sam(spark, tmp_path):
    lines = [
        "@HD\tVN:1.6",
        "r1\t0\tchr1\t10\t60\t2S3M1I2M2D1M\t*\t0\t0\tTTACGTACG\tIIIIIIIII",
        "r2\t16\tchr1\t11\t60\t4M\t*\t0\t0\tCGAC\tII!I",
        "r3\t1024\tchr1\t11\t60\t4M\t*\t0\t0\tCGAC\tIIII",
        "r4\t0\tchr1\t11\t5\t4M\t*\t0\t0\tCGAC\tIIII",
    ]
    path = tmp_path / "a.sam"
    path.write_text("\n".join(lines) + "\n")
    return reads.read_sam(spark, str(path))


def test_pileup(sam):
    used = reads.usable_reads(sam)
    assert {r.name for r in used.collect()} == {"r1", "r2"}
    bases = reads.aligned_bases(used)
    got = {(r.pos, r.base, r.is_reverse) for r in bases.collect()}
    assert got == {(10, "A", False), (11, "C", False), (12, "G", False), (13, "A", False), (14, "C", False), (17, "G", False), (11, "C", True), (12, "G", True), (14, "C", True)}
    depth = {r.pos: (r.depth, r.n_c, r.n_reverse) for r in reads.pileup(bases).collect()}
    assert depth[11] == (2, 2, 1) and depth[13] == (1, 0, 0)
    lengths = sam.select(reads.query_length(F.col("cigar")).alias("q"), reads.reference_length(F.col("cigar")).alias("r")).first()
    assert (lengths.q, lengths.r) == (9, 8)


def test_genotypes(spark):
    rows = [("het", i % 2 == 0) for i in range(30)] + [("ref", i == 0) for i in range(30)] + [("alt", True) for _ in range(30)]
    df = spark.createDataFrame(rows, "site string, alt boolean").withColumn("q", F.lit(30.0))
    got = {r.site: (r.genotype, r.n_alt) for r in reads.genotypes(df, by=["site"], is_alt=F.col("alt"), quality=F.col("q")).collect()}
    assert got == {"het": (1, 15), "ref": (0, 1), "alt": (2, 30)}


def test_contrast(spark):
    side = lambda rows: spark.createDataFrame(rows, "s string, depth long, n_alt long")
    got = reads.contrast_sites(side([("a", 30, 15), ("b", 30, 15), ("c", 30, 0), ("d", 9, 9)]), side([("a", 30, 0), ("b", 30, 14), ("c", 30, 0)]), on=["s"])
    assert {r.s: r.verdict for r in got.collect()} == {"a": "pass", "b": "in_normal", "c": "weak"}


def test_nonnegative_weights():
    rng = np.random.default_rng(4)
    for _ in range(20):
        matrix = rng.random((12, 5))
        truth = np.where(rng.random(5) > 0.5, rng.random(5), 0.0)
        assert models.nonnegative_weights(matrix, matrix @ truth) == pytest.approx(truth, abs=1e-6)
    noisy = models.nonnegative_weights(np.eye(3), np.array([1.0, -2.0, 3.0]))
    assert noisy == pytest.approx([1.0, 0.0, 3.0])


def test_exposures(spark):
    channels = list("abcdef")
    shapes = {"s1": [6, 1, 1, 1, 1, 0], "s2": [0, 1, 1, 1, 1, 6], "s3": [1, 1, 5, 1, 1, 1]}
    signatures = [(s, c, x / sum(v)) for s, v in shapes.items() for c, x in zip(channels, v)]
    mixed = [(c, 0.7 * a / 10 + 0.3 * b / 10) for c, a, b in zip(channels, shapes["s1"], shapes["s2"])]
    got = models.exposures(spark.createDataFrame([("x", *m) for m in mixed], "id string, channel string, fraction double"), spark.createDataFrame(signatures, "sig string, channel string, fraction double"), sample="id", signature="sig")
    rows = {r.signature: r for r in got.collect()}
    assert set(rows) == {"s1", "s2"} and rows["s1"].weight == pytest.approx(0.7) and rows["s1"].cosine == pytest.approx(1.0)


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(80, 3)) @ np.diag([5.0, 1.0, 0.1]) + 7
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(99, None)], "id int, v array<double>")
    got = models.principal_components(df, vector="v", k=2, keep=["id"]).orderBy("id").collect()
    centred = (data - data.mean(0)) / data.std(0, ddof=1)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    for i in range(2):
        mine, plain = np.array([r[f"pc{i + 1}"] for r in got]), centred @ vt[i]
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-8


def test_count_models(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, change in (("same", 1.0), ("up", 4.0), ("none", 0.0)):
        for s in range(40):
            mean = 50 * (change if s % 2 else min(change, 1.0))
            rows.append((g, s, float(rng.poisson(mean)), float(s % 2), 1.0, 0.01))
    df = spark.createDataFrame(rows, "gene string, s int, n double, treated double, size double, disp double")
    got = {r.gene: r for r in models.count_models(df, gene=["gene"], sample="s", value="n", treated="treated", size="size", dispersion="disp").collect()}
    assert abs(got["same"].log2fc) < 0.15 and got["up"].log2fc == pytest.approx(2.0, abs=0.15)
    assert got["up"].wald > 20 and got["none"].wald is None or math.isnan(got["none"].wald)


def test_set_p_values_use_the_whole_ranking(spark, monkeypatch):
    from strandline.plans import model_queries as Q

    genes = spark.range(1500).select(F.format_string("G%04d", "id").alias("gene"), (F.lit(2000) - F.col("id")).alias("n"))
    monkeypatch.setattr("strandline.plans.statistics_queries.calls", lambda *_: genes.select("gene", F.explode(F.sequence(F.lit(1), F.when(F.col("n") > 1990, 2).otherwise(1)))))
    members = genes.filter("gene >= 'G1480'").select(F.lit("low").alias("set_key"), "gene")
    monkeypatch.setattr(Q, "_set_members", lambda *_: members)
    (got,) = Q.set_p_values(spark, "").collect()
    # The last twenty of 1500 genes: a low beyond the thousandth rank.
    assert got.n_hits == 20 and got.es == pytest.approx(-math.sqrt(20 * 1480), abs=1e-4) and got.p == pytest.approx(1 / 2049, abs=1e-6)


def test_permutation_p_values(spark):
    scores = spark.createDataFrame([("strong", 10, 25.0), ("weak", 10, 1.0), ("empty", 0, 0.0)], "k string, n long, es double")
    got = {r.k: r for r in models.permutation_p_values(scores, set_key="k", size="n", score="es", n_ranked=100, permutations=200).collect()}
    assert got["strong"].p < 0.05 and got["weak"].p > 0.9 and got["strong"].nes > 1.5
    assert got["weak"].draws == got["strong"].draws and got["empty"].p is None


def test_small_p_values_rest_on_more_draws(spark):
    """Within three standard errors of a much larger simulation."""
    scores = spark.createDataFrame([("a", 5, 40.0), ("b", 5, 20.0), ("c", 7, 3.0)], "k string, n long, es double")
    got = {r.k: r for r in models.permutation_p_values(scores, set_key="k", size="n", score="es", n_ranked=300, permutations=64, most=4096).collect()}
    assert got["a"].draws >= got["c"].draws
    rng = np.random.default_rng(9)
    n, size = 300, 5
    null = []
    for _ in range(20_000):
        ranks, i = np.sort(rng.choice(n, size, replace=False)) + 1, np.arange(1, size + 1)
        up, down = np.sqrt((n - size) / size), np.sqrt(size / (n - size))
        at = i * up - (ranks - i) * down
        null.append(max(abs(at.max()), abs((at - up).min())))
    for k, es in (("a", 40.0), ("b", 20.0)):
        true = np.mean(np.array(null) >= es)
        assert abs(got[k].p - true) <= 3 * math.sqrt(true * (1 - true) / got[k].draws) + 2 / got[k].draws
