"""Catalogue scores, edge tables and the JSON document on literals."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import graphs, scores
from strandline.sources.sinks import chromosome_order, summary_document
from strandline.streaming.folds import ProgressLog, fold_peaks, run_available, stream_table
from strandline.tables import table

from .conftest import DATA


def test_risk_scores(spark):
    calls = spark.createDataFrame([("s", "1", 10, "g"), ("s", "1", 10, "G"), ("s", "2", 5, "A,T"), ("t", "1", 10, "C"), (None, "1", 10, "G")], "sample string, chrom string, pos long, alt_allele string")
    catalogue = spark.createDataFrame([("d", "1", 10, "G", 2.0), ("d", "2", 5, "t", 0.5), ("e", "1", 10, "G", 3.0)], "disease string, chrom string, pos long, risk_allele string, odds_ratio double")
    base = spark.createDataFrame([("d", 1.0, 0.5), ("e", 0.0, 0.0)], "disease string, mean double, spread double")
    got = {r.disease: r for r in scores.risk_scores(calls, catalogue, base, sample="sample").collect()}
    assert got["d"].n_matched == 2 and got["d"].score == pytest.approx(0.0) and got["d"].z == pytest.approx(-2.0)
    assert got["e"].score == pytest.approx(math.log(3)) and got["e"].z is None


def test_clock_and_near_sites(spark):
    sites = spark.createDataFrame([("1", 99, 50.0), ("1", 101, 70.0), ("1", 200, 40.0)], "chrom string, pos long, value double")
    catalogue = spark.createDataFrame([("a", "1", 100, 1.0), ("b", "1", 199, 2.0), ("c", "1", 500, 3.0)], "id string, chrom string, pos long, weight double")
    assert {r.id: r.value for r in scores.near_sites(sites, catalogue, key="id").collect()} == {"a": 50.0, "b": 40.0}
    row = scores.clock_age(sites, catalogue, key="id", intercept=-0.3, least=2).first()
    assert row.n_matched == 2 and row.age == pytest.approx(21 * 1.0 + 20)
    assert scores.clock_age(sites, catalogue, key="id", intercept=0.0, least=3).first().age is None


def test_panel_score(spark):
    panel = spark.createDataFrame([("A", 1.0, None), ("B", 3.0, ["B1", "B2"]), ("C", 5.0, None)], "gene string, weight double, aliases array<string>")
    values = spark.createDataFrame([("A", 100.0), ("B2", 0.0), ("B1", 100.0)], "gene string, value double")
    row = scores.panel_score(values, panel).first()
    assert row.n_found == 2 and row.score == pytest.approx(1.0)


def test_moran_index(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "src long, dst long, weight double")
    x = [i - 4.5 for i in range(10)]
    want = (10 / 9) * sum(a * b for a, b in zip(x, x[1:])) / sum(a * a for a in x)
    row = graphs.moran_index(line, nodes, node="id", value="v").first()
    assert row.n_nodes == 10 and row.moran == pytest.approx(want) and row.moran > 0.3


def test_communities_cover_all_vectors(spark):
    from strandline.plans.model_queries import neighbour_communities

    nodes = neighbour_communities(spark, str(DATA)).select("node")
    vectors = table(spark, str(DATA), "embeddings").select("vec_id")
    assert nodes.exceptAll(vectors).isEmpty() and vectors.exceptAll(nodes).isEmpty()


def test_communities(spark):
    clique = lambda nodes: [(a, b, 1.0) for a in nodes for b in nodes if a < b]
    edges = clique(range(5)) + clique(range(10, 15)) + [(4, 10, 0.1), (7, 7, 1.0)]
    labels = {r.node: r.label for r in graphs.communities(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert {labels[i] for i in range(5)} == {0} and len({labels[i] for i in range(10, 15)}) == 1 and labels[10] != 0


def test_document_and_order(spark):
    a = spark.createDataFrame([("chr2", 1.5), ("chr1", float("nan"))], "c string, v double")
    document = json.loads(summary_document({"chroms": a, "total": a.agg(F.count("*").alias("n"))}).first().json)
    assert document == {"chroms": [{"c": "chr1", "v": None}, {"c": "chr2", "v": 1.5}], "total": [{"n": 2}]}
    names = spark.createDataFrame([(c,) for c in ("chrX", "10", "chr2", "MT", "1")], "c string")
    assert [r.c for r in names.orderBy(chromosome_order(F.col("c"))).collect()] == ["1", "chr2", "10", "MT", "chrX"]


def test_streamed_peaks_and_progress(spark):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        got = run_available(fold_peaks(stream_table(spark, str(DATA), "called_peaks")))
        want = fold_peaks(table(spark, str(DATA), "called_peaks"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.streams.removeListener(log)
