"""Statistical functions against known values, and orderings in blocks against plain ones."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import cells, testing
from strandline.operators.overlap import overlap_join
from strandline.operators.variants import variant_class
from strandline.streaming.folds import fold_calls, run_available, stream_table
from strandline.tables import canonical_chrom, table

from .conftest import DATA


def test_functions(spark):
    df = spark.createDataFrame([(0.5, 2.5, 30.0)], "a double, b double, c double")
    row = df.select(
        *[stats.ln_gamma(F.col(c)).alias(c) for c in "abc"],
        stats.hypergeometric_tail(F.lit(3), F.lit(5), F.lit(6), F.lit(20)).alias("h"),
        stats.erfc(F.lit(0.7)).alias("e"),
        stats.chi_square_tail(F.lit(3.84146), 1).alias("x1"),
        stats.chi_square_tail(F.lit(7.81473), 3).alias("x3"),
        stats.poisson_log10_tail(F.lit(7), F.lit(2.0)).alias("p"),
        stats.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"),
    ).first()
    for c, x in (("a", 0.5), ("b", 2.5), ("c", 30.0)):
        assert row[c] == pytest.approx(math.lgamma(x), abs=1e-9)
    assert row.h == pytest.approx(sum(math.comb(5, i) * math.comb(15, 6 - i) for i in (3, 4, 5)) / math.comb(20, 6))
    assert row.e == pytest.approx(math.erfc(0.7), abs=2e-7)
    assert row.x1 == pytest.approx(0.05, abs=1e-5) and row.x3 == pytest.approx(0.05, abs=2e-3)
    assert row.p == pytest.approx(-math.log10(1 - sum(math.exp(-2) * 2**i / math.factorial(i) for i in range(7))), abs=1e-6)
    assert row.cos == pytest.approx(math.sqrt(0.5))


def test_t_distribution(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (12.706205, 1.0), (None, 3.0)], "t double, df double")
    got = [r.p for r in df.select(stats.t_two_sided("t", "df").alias("p")).collect()]
    assert got[:3] == pytest.approx([0.05, 1.0, 0.05], abs=1e-5) and got[3] is None


def test_adjusted_p_values(spark):
    rng = random.Random(1)
    rows = [(f, round(rng.random() ** 3, 3) if rng.random() > 0.05 else None, i) for i, f in enumerate("ab" * 400 + "c")] + [(None, 0.5, -1)]
    df = spark.createDataFrame(rows, "f string, p double, i int")
    got = {r.i: r.padj for r in testing.adjust_p_values(df, p="p", family=["f"]).collect()}
    for f in ("a", "b", "c", None):
        known = sorted((p, i) for g, p, i in rows if g == f and p is not None)
        least = 1.0
        for rank in range(len(known), 0, -1):
            p, i = known[rank - 1]
            least = min(least, p * len(known) / rank)
            assert got[i] == pytest.approx(least)
    assert all(got[i] is None for _, p, i in rows if p is None)
    example = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.20,)], "p double")
    assert sorted(r.padj for r in testing.adjust_p_values(example, p="p", family=[]).collect()) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    assert testing.adjust_p_values(example.limit(0), p="p", family=[]).count() == 0


def test_welch_and_rank_sum(spark):
    rows = [(0, float(v)) for v in (1.0, 1.2, 0.9, 1.1, 1.0)] + [(1, float(v)) for v in (5.0, 5.2, 4.9, 5.1, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double").withColumn("k", F.lit("x"))
    row = testing.welch(df, by=["k"], second=F.col("g") == 1, value=F.col("v")).first()
    assert row.t == pytest.approx(4.0 / math.sqrt(2 * 0.013 / 5), rel=1e-6) and row.df == pytest.approx(8.0)
    scored = testing.rank_sum(df, by=["k"], group=F.col("g") == 1, value="v").first()
    assert (scored.u, scored.auc, scored.p) == (25.0, 1.0, 1.0)


def test_enrichment_scores_are_bounded_and_signed(spark):
    ranked = spark.createDataFrame([(f"G{i:04d}", i) for i in range(1, 201)], "gene string, rank int")
    sets = [("top", f"G{i:04d}") for i in range(1, 21)] + [("bottom", f"G{i:04d}") for i in range(181, 201)] + [("even", f"G{i:04d}") for i in range(5, 201, 10)]
    got = {r.set_key: r for r in testing.enrichment_scores(ranked, spark.createDataFrame(sets, "set_key string, gene string"), set_key="set_key").collect()}
    assert got["top"].es == pytest.approx(20 * 3.0) and got["bottom"].es == pytest.approx(-20 * 3.0)
    assert abs(got["even"].es) < 10 and got["top"].n_leading == 20 and got["bottom"].n_leading == 20


def test_size_factors_of_scaled_samples(spark):
    scale = (1.0, 2.0, 1.5, 3.0)
    rows = [("b", f"g{g}", s, (g + 1) * 10 * k) for g in range(6) for s, k in enumerate(scale)]
    df = spark.createDataFrame(rows, "b string, g string, s int, v double")
    got = [r.size_factor for r in testing.size_factors(df, gene=["g"], sample=["s"], value="v").orderBy("s").collect()]
    assert [x / got[0] for x in got] == pytest.approx(scale)


def test_variant_classes(spark):
    rows = [("a", "G", "Transition"), ("A", "T", "Transversion"), ("A", "AT", "Other"), ("AT", "A", "Indel"), ("A", "G,T", "Transition"), ("AT", "GC", "Other"), ("N", "A", "Other"), (None, "A", None)]
    df = spark.createDataFrame(rows, "r string, a string, want string")
    got = df.select(variant_class(F.col("r"), F.col("a")).alias("got"), "want").collect()
    assert [r.got for r in got if r.want != "Other"] == [r.want for r in got if r.want != "Other"]


def test_canonical_chromosomes(spark):
    names = ["chr1", "CHRX", "y", "M", "chrMT", "Chr10", " chr2 ", "", None]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r.x for r in df.select(canonical_chrom("c").alias("x")).collect()] == ["1", "X", "Y", "MT", "MT", "10", "2", None, None]


def test_overlaps_come_once_over_bins(spark):
    a = spark.createDataFrame([("1", 0, 100, "a"), ("1", 99, 101, "b"), ("2", 5, 6, "c")], "chrom string, s long, e long, x string")
    b = spark.createDataFrame([("1", 50, 150, "p"), ("1", 100, 101, "q"), ("2", 6, 9, "r")], "chrom string, s2 long, e2 long, y string")
    got = overlap_join(a, b, left_span=("s", "e"), right_span=("s2", "e2"), bin_width=8).collect()
    assert sorted((r.x, r.y) for r in got) == [("a", "p"), ("b", "p"), ("b", "q")]
    alone = overlap_join(a, b, left_span=("s", "e"), right_span=("s2", "e2"), bin_width=8, how="left_anti").collect()
    assert [r.x for r in alone] == ["c"]


def test_neighbours_of_any_grid(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {}
    for i, v in rows[:60]:
        want[i] = sorted((math.dist(v, w), j) for j, w in rows[:60] if j != i)[:3]
    for grid in (1, 5):
        found = cells.nearest_neighbours(df.filter("id < 60"), df, key="id", vector="v", k=3, grid=grid)
        got = {}
        for r in found.orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.neighbour)
        assert got == {i: [j for _, j in x] for i, x in want.items()}
    edges = cells.fuzzy_edges(found, key="id")
    assert edges.filter("src >= dst or weight <= 0 or weight > 1").count() == 0


def test_equally_near_rows_go_by_key_and_lengths_by_table(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(i, [5.0, 5.0 + i]) for i in range(400, 420)]
    rows += [(i, [0.0]) for i in range(1000, 1300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").orderBy(F.desc("id"))
    queries = df.filter("id in (7, 399, 405) or id >= 1295")
    for grid in (1, 3, None):
        got = {}
        for r in cells.nearest_neighbours(queries, df, key="id", vector="v", k=5, grid=grid).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.neighbour)
        assert got == {7: [0, 1, 2, 3, 4], 399: [0, 1, 2, 3, 4], 405: [404, 406, 403, 407, 402]}


def test_stream_and_batch_agree(spark):
    batch = fold_calls(table(spark, str(DATA), "variants"))
    stream = run_available(fold_calls(stream_table(spark, str(DATA), "variants")))
    rows = lambda df: sorted((r.chrom or "", r.n_rows, r.n_high, r.sites) for r in df.select("*", F.hll_sketch_estimate("sketch").alias("sites")).collect())
    assert rows(batch) == rows(stream)


def test_partitions_do_not_matter(spark):
    rows = table(spark, str(DATA), "variants")
    one, many = fold_calls(rows.coalesce(1)), fold_calls(rows.repartition(7))
    assert one.drop("sketch").exceptAll(many.drop("sketch")).count() == 0
