"""LC-MS features, modification tags and random placements on small inputs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import clusters, features, graphs, overlap, reads


def test_traces_and_bounds(spark):
    heights = [1.0, 4.0, 10.0, 6.0, 2.0]
    rows = [(i, 10.0 * i, 500.0 + 0.001 * (i % 2), h) for i, h in enumerate(heights)] + [(20 + i, 500.0 + 10 * i, 500.0, h) for i, h in enumerate((1.0, 3.0, 1.0))]
    rows += [(40 + i, 10.0 * i, 600.0, float(i)) for i in range(4)] + [(60, 0.0, 700.0, 9.0)]
    peaks = spark.createDataFrame(rows, "scan long, rt double, mz double, intensity double")
    traces = features.ion_traces(peaks, ppm=10.0, most_apart=30.0)
    assert sorted(r["count"] for r in traces.groupBy("band", "trace").count().collect()) == [1, 3, 4, 5]
    found = sorted(features.trace_features(traces).collect(), key=lambda r: r.apex)
    # The rising trace has its top at an end and is none.
    assert [(r.apex, r.height, r.since, r.until, r.n_points) for r in found] == [(20.0, 10.0, 10.0, 40.0, 5), (510.0, 3.0, 500.0, 520.0, 3)]
    assert features.ion_traces(peaks.limit(0)).count() == 0


def test_covered_features_go(spark):
    rows = [(1, 1, 500.0, 10.0, 9.0, 5.0, 15.0), (2, 1, 500.001, 12.0, 4.0, 8.0, 14.0), (3, 1, 500.001, 40.0, 4.0, 30.0, 50.0), (4, 1, 501.0, 10.0, 1.0, 5.0, 15.0)]
    df = spark.createDataFrame(rows, "band long, trace long, mz double, apex double, height double, since double, until double").withColumn("n_points", F.lit(5))
    assert sorted(r.band for r in features.distinct_features(df).collect()) == [1, 3, 4]
    report = features.feature_report(df).first()
    assert (report.n_features, report["first"], report.highest) == (4, 10.0, 9.0)


def test_isotopes(spark):
    z2 = [400.0 + i * features.ISOTOPE / 2 for i in range(3)]
    z1 = [700.0, 700.0 + features.ISOTOPE]
    mz = sorted([*z2, *z1, 900.0])
    df = spark.createDataFrame([(1, 5.0, mz, [1.0] * len(mz)), (2, 6.0, [], [])], "scan int, rt double, mz array<double>, intensity array<double>")
    assert sorted((r.mz, r.charge, r.n_isotopes) for r in features.isotope_groups(df).collect()) == [(400.0, 2, 3), (700.0, 1, 2)]


def test_modified_cytosines(spark):
    rows = [
        ("f", 0, "1", 101, "4M2D4M", "ACGCTTCC", "C+m,1,0;", [255, 51]),
        ("r", 16, "1", 101, "2S6M", "GGACGTAG", "C+h,0;C+m?,0,1;", [1, 102, 204]),
        ("short", 0, "1", 101, "4M", "ACGT", "C+m,5;", [9]),
        ("none", 0, "1", 101, "4M", "ACGT", None, None),
    ]
    df = spark.createDataFrame(rows, "name string, flag int, chrom string, pos long, cigar string, seq string, mm string, ml array<int>")
    got = sorted((r.pos, round(r.probability, 6), r.is_reverse) for r in reads.methylation_calls(df).collect())
    # Forward: the second C (fourth base) and the third (seventh, behind two deleted bases).
    # Reversed: guanines from the end, the first (eighth base) and the third (second, clipped).
    assert got == [(104, 1.0, False), (106, round(102 / 255, 6), True), (109, 0.2, False)]
    row = reads.methylation_rows(reads.methylation_calls(df)).orderBy("start_pos").first()
    assert (row.start_pos, row.end_pos, row.methylation, row.gene) == (103, 104, 100.0, None)


def test_random_placements(spark):
    for n in (7, 100, 101):
        for a, b in graphs.shuffles(5, seed=3):
            assert len({(a * i + b) % n for i in range(n)}) == n
    line = [(i, float(i)) for i in range(40)]
    edges = spark.createDataFrame([(i, i + d, 1.0) for i in range(40) for d in (-1, 1) if 0 <= i + d < 40], "src long, dst long, weight double")
    got = graphs.moran_permutations(edges, spark.createDataFrame(line, "id long, v double"), node="id", value="v", permutations=19).first()
    plain = graphs.moran_index(edges, spark.createDataFrame(line, "id long, v double"), node="id", value="v").first()
    assert got.moran == pytest.approx(plain.moran) and got.moran > 0.3 and got.p == 0.05
    rng = random.Random(1)
    noise = spark.createDataFrame([(i, rng.random()) for i in range(40)], "id long, v double")
    assert graphs.moran_permutations(edges, noise, node="id", value="v", permutations=19).first().p > 0.05
    assert math.isclose(graphs.moran_permutations(edges, noise.withColumn("v", F.lit(1.0)), node="id", value="v", permutations=19).first().p, 1.0)


def _merged(sizes, least):
    """Passes from the left over (first, size) until nothing is small."""
    rows = [(i, n) for i, n in enumerate(sizes)]
    changed = True
    while changed:
        changed, out, j = False, [], 0
        while j < len(rows):
            if rows[j][1] < least and j + 1 < len(rows):
                out.append((rows[j][0], rows[j][1] + rows[j + 1][1]))
                changed, j = True, j + 2
            elif rows[j][1] < least and out:
                out[-1] = (out[-1][0], out[-1][1] + rows[j][1])
                changed, j = True, j + 1
            else:
                out.append(rows[j])
                j += 1
        rows = out
    return rows


def test_small_segments_merge_pass_by_pass(spark):
    rng = random.Random(3)
    entities = {f"e{k}": [rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randint(1, 30))] for k in range(12)}
    rows = [(e, i, i + 1, n) for e, sizes in entities.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "e string, s long, f long, n long")
    got = {}
    for r in overlap.merge_small(df, entity=["e"], start="s", end="f", size="n", least=4).orderBy("e", "s").collect():
        got.setdefault(r.e, []).append((r.s, r.n))
    assert got == {e: _merged(sizes, 4) for e, sizes in entities.items()}
    assert overlap.merge_small(df.limit(0), entity=["e"], start="s", end="f", size="n", least=4).count() == 0


def test_long_rows_of_small_segments_leave_no_growing_statistics(spark):
    """Many passes, whole or in blocks: the same segments, and a plan of a plain size."""
    rng = random.Random(8)
    entities = {"long": [1] * 700, "mixed": [rng.choice([1, 2, 900]) for _ in range(60)], None: [5, 400, 1], "large": [900] * 50, "one": [1]}
    rows = [(e, i, i + 1, n) for e, sizes in entities.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "e string, s long, f long, n long").repartition(3)
    for block in (40, 100_000):
        merged = overlap.merge_small(df, entity=["e"], start="s", end="f", size="n", least=300, block=block)
        assert merged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
        got = {}
        for r in merged.orderBy("e", "s").collect():
            got.setdefault(r.e, []).append((r.s, r.n))
        assert got == {e: _merged(sizes, 300) for e, sizes in entities.items()}


def test_velocity_graph_and_kept_cells(spark):
    states = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0]), (2, [2.0, 0.0], [0.0, 0.0]), (3, [0.0, -5.0], [0.0, 1.0])], "id long, x array<double>, v array<double>")
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 1)], "id long, neighbour long")
    got = {(r.id, r.neighbour): round(r.cosine, 6) for r in clusters.velocity_graph(near, states, key="id", position="x", velocity="v").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (2, 1): 0.0, (3, 1): 1.0}
    judged = spark.createDataFrame([("c", True), ("a", True), ("b", False)], "cell string, ok boolean")
    assert {(r.cell, r.number) for r in clusters.kept_cells(judged, cell="cell", passes="ok").collect()} == {("a", 0), ("c", 1)}
