"""Count models against figures of plain numpy, and clusters against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import clusters, glm, summaries, testing

#: Counts of three untreated and three treated samples.
GENES = {
    "doubled": [88, 93, 79, 181, 170, 166],
    "tripled": [40, 37, 44, 125, 118, 121],
    "steady": [15, 13, 17, 14, 16, 15],
    "halved": [260, 251, 270, 133, 127, 139],
    "strong": [700, 690, 715, 1390, 1421, 1402],
}


def _long(spark):
    rows = [(g, s, float(v), float(s >= 3), s % 3) for g, values in GENES.items() for s, v in enumerate(values)]
    return spark.createDataFrame(rows, "gene string, s int, n double, treated double, batch int").withColumn("one", F.lit("x"))


def test_wald_and_likelihood_agree_on_directions(spark):
    rows = _long(spark).withColumn("size", F.lit(1.0)).withColumn("alpha", F.lit(0.01))
    rows = rows.withColumn("full", glm.design(F.col("treated"))).withColumn("reduced", F.array(F.lit(1.0)))
    wald = {r.gene: r for r in glm.wald_tests(rows, gene=["gene"], value="n", size="size", dispersion="alpha", design="full", contrast=[0.0, 1.0]).collect()}
    ratio = {r.gene: r for r in glm.likelihood_ratio_tests(rows, gene=["gene"], value="n", size="size", dispersion="alpha", full="full", reduced="reduced", freedom=1).collect()}
    for g, values in GENES.items():
        a, b = np.mean(values[:3]), np.mean(values[3:])
        assert wald[g].log2fc == pytest.approx(math.log2(b / a), abs=1e-6)
        se = math.sqrt((1 + 0.01 * a) / (3 * a) + (1 + 0.01 * b) / (3 * b)) / math.log(2)
        assert wald[g].se == pytest.approx(se, rel=1e-6)
        assert (ratio[g].p < 0.01) == (wald[g].p < 0.01) == (g != "steady")


def test_batches_and_interactions(spark):
    rows = _long(spark)
    plain = rows.select(glm.design(F.col("treated"), batch=F.col("batch"), batches=[0, 1, 2]).alias("x"), glm.design(F.col("treated"), batch=F.col("batch"), batches=[0, 1, 2], interaction=True).alias("y")).collect()
    assert {tuple(r.x) for r in plain} == {(1.0, t, float(b == 1), float(b == 2)) for t in (0.0, 1.0) for b in (0, 1, 2)}
    assert all(tuple(r.y[4:]) == (r.x[2] * r.x[1], r.x[3] * r.x[1]) for r in plain)
    # A batch that doubles counts is taken out of the treatment's effect; singular designs give nulls.
    data = [(g, s, 20.0 * (2 if s % 2 else 1) * (3 if s >= 6 else 1), float(s >= 6), s % 2) for g in ("g",) for s in range(12)]
    df = spark.createDataFrame(data, "gene string, s int, n double, treated double, batch int").withColumn("size", F.lit(1.0)).withColumn("alpha", F.lit(0.01))
    df = df.withColumn("x", glm.design(F.col("treated"), batch=F.col("batch"), batches=[0, 1])).withColumn("bad", F.array(F.lit(1.0), F.lit(1.0)))
    row = glm.wald_tests(df, gene=["gene"], value="n", size="size", dispersion="alpha", design="x", contrast=[0.0, 1.0, 0.0]).first()
    assert row.log2fc == pytest.approx(math.log2(3), abs=1e-6)
    assert glm.wald_tests(df, gene=["gene"], value="n", size="size", dispersion="alpha", design="bad", contrast=[0.0, 1.0]).first().p is None


def test_outliers_filter_and_shrinkage(spark):
    rows = [("calm", s, 50.0 + s % 3, float(s % 2)) for s in range(12)] + [("wild", s, 5000.0 if s == 5 else 40.0, float(s % 2)) for s in range(12)]
    df = spark.createDataFrame(rows, "gene string, s int, n double, treated double").withColumn("size", F.lit(1.0)).withColumn("alpha", F.lit(0.01))
    effects = spark.createDataFrame([("calm", 0.0), ("wild", 0.0)], "gene string, log2fc double")
    got = {r.gene: r.outlier for r in glm.outlying_genes(df, effects, gene=["gene"], value="n", size="size", dispersion="alpha", treated="treated", effect="log2fc").collect()}
    assert got == {"calm": False, "wild": True}
    rng = random.Random(4)
    tests = [(f"g{i:03d}", float(i), rng.random() * (0.05 if i > 120 else 1.0), i == 199) for i in range(200)] + [("none", 5.0, None, False)]
    filtered = glm.filtered_by_mean(spark.createDataFrame(tests, "k string, m double, p double, outlier boolean"), key="k", mean="m", p="p").collect()
    kept = [r for r in filtered if not r.filtered and r.p is not None and not r.outlier]
    assert len(filtered) == 201 and 0 < len(kept) < 199 and min(r.m for r in kept) > max(r.m for r in filtered if r.filtered)
    assert all(r.padj == 1.0 for r in filtered if r.filtered or r.p is None or r.outlier)
    assert glm.filtered_by_mean(spark.createDataFrame([], "k string, m double, p double"), key="k", mean="m", p="p").count() == 0
    shrunk = glm.shrunken_effects(spark.createDataFrame([(2.0, 1.0), (1.0, 0.5), (3.0, 2.0)], "e double, s double"), effect="e", se="s").collect()
    assert [r.shrunk for r in shrunk] == pytest.approx([2 * 1 / 5, 0.25 / 4.25, 3 * 4 / 8])


def test_markers_match_the_dense_test(spark):
    rng = random.Random(8)
    cells = [(i, "abc"[i % 3]) for i in range(60)]
    values = [(i, f, rng.randint(1, 4)) for i, _ in cells for f in "pqr" if rng.random() < (0.7 if f == "p" else 0.5)] + [(0, "rare", 2)]
    df, labels = spark.createDataFrame(values, "cell long, f string, n long"), spark.createDataFrame(cells, "cell long, c string")
    got = {(r.c, r.f): (round(r.auc, 9), round(r.z, 9)) for r in clusters.cluster_markers(df, labels, cell="cell", feature="f", value="n", cluster="c").collect()}
    known = {(i, f): n for i, f, n in values}
    dense = spark.createDataFrame([(f, i, c, known.get((i, f), 0)) for f in ("p", "q", "r") for i, c in cells], "f string, cell long, c string, n long")
    for c in "abc":
        for r in testing.rank_sum(dense, by=["f"], group=F.col("c") == c, value="n").collect():
            assert got[(c, r.f)] == (round(r.auc, 9), round(r.z, 9))
    assert ("a", "rare") not in got and len(got) == 9


def test_talk_graph_and_labels(spark):
    profiles = spark.createDataFrame([("x", "l", 4.0, 0.5), ("y", "r", 9.0, 0.5), ("x", "r", 1.0, 0.05)], "c string, f string, mean double, part double")
    pairs = spark.createDataFrame([("l", "r"), ("l", "r"), ("l", "z")], "ligand string, receptor string")
    (talk,) = clusters.cluster_talk(profiles, pairs, cluster="c", feature="f").collect()
    assert (talk.sender, talk.receiver, talk.score) == ("x", "y", 6.0)
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0), (1, 3, 0.25)], "src long, dst long, weight double")
    labels = spark.createDataFrame([(1, 9), (2, 9), (3, 4)], "n long, l long")
    assert {tuple(r) for r in clusters.community_graph(edges, labels, node="n", label="l").collect()} == {(9, 9, 0.5), (4, 9, 1.25)}
    assert {(r.n, r.number) for r in clusters.contiguous_labels(labels, node="n", label="l").collect()} == {(1, 0), (2, 0), (3, 1)}


def test_velocity_of_a_steady_feature(spark):
    rows = [(i, "f", 2.0 * i, float(i)) for i in range(1, 41)] + [(i, "g", 1.0, 0.0) for i in range(1, 41)]
    got = clusters.expression_velocity(spark.createDataFrame(rows, "c long, f string, s double, u double"), cell="c", feature="f", spliced="s", unspliced="u").collect()
    assert len(got) == 40 and all(r.f == "f" and r.gamma == 2.0 and r.velocity == 0.0 and r.fit == 1.0 for r in got)


def test_log_sums(spark):
    row = spark.range(1).select(
        summaries.log_sum_exp(F.lit(-1000.0), F.lit(-1000.0)).alias("a"), summaries.log_sum_exp(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)).alias("b"), summaries.log_one_less_exp(F.lit(-1e-12)).alias("c"), summaries.log_one_less_exp(F.lit(-40.0)).alias("d")
    ).first()
    assert row.a == pytest.approx(-1000 + math.log(2)) and row.b == pytest.approx(1 + math.log(2)) and row.c == pytest.approx(math.log(1e-12)) and row.d == pytest.approx(-math.exp(-40))
