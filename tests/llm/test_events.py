"""Runs, bitmaps and sketches against plain Python."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from strandline.llm.distinct import ARRAY, BITS, PLAIN, RUNS, build_dictionary, count_bitmaps, id_bitmaps, members, merge_bitmaps, pack, shared_bitmaps, unpack
from strandline.llm.percentiles import merge_sketches, quantile_sketches, rank_error, sketch_quantile
from strandline.llm.runs import collapse_runs

SCHEMA = "sample string, id long, at timestamp_ntz, chrom string, pos long, _e string"


def brute_runs(rows, tolerance, least):
    out = []
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen.setdefault(r[0], {})[(r[2] or datetime.min, r[1])] = r
    for sample, events in seen.items():
        run = []
        for _, r in sorted(events.items()):
            if run and r[3] is not None and r[3] == run[-1][3] and r[4] is not None and run[-1][4] is not None and abs(r[4] - run[-1][4]) <= tolerance:
                run.append(r)
            else:
                if len(run) >= least:
                    out.append((sample, run[0][1], run[-1][1], len(run)))
                run = [r]
        if len(run) >= least:
            out.append((sample, run[0][1], run[-1][1], len(run)))
    return sorted(out)


def test_runs_match_brute_force_for_any_number_of_ranges(spark):
    rng = random.Random(4)
    start = datetime(2020, 1, 1)
    rows = []
    for i in range(900):
        at = start + timedelta(seconds=rng.randint(0, 300)) if rng.random() > 0.02 else None
        sample = rng.choice(["hot"] * 6 + ["a", "b", None])
        chrom = rng.choice(["1", "1", "1", "2", None])
        pos = rng.choice([None, *range(100, 108)]) if rng.random() < 0.7 else rng.randint(0, 4)
        rows.append((sample, i, at, chrom, pos, "x"))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    for blocks in (1, 7, 40):
        got = collapse_runs(df, entity="sample", time="at", key="id", label="chrom", position="pos", tolerance=2, least=2, blocks=blocks)
        assert sorted((r.sample, r.first_id, r.last_id, r.n_events) for r in got.collect()) == brute_runs(rows, 2, 2)


def test_run_over_all_ranges_and_empty_table(spark):
    rows = [("s", i, datetime(2020, 1, 1) + timedelta(seconds=i), "1", 5 + i % 3, "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    (one,) = collapse_runs(df, entity="sample", time="at", key="id", label="chrom", position="pos", tolerance=2, blocks=13).collect()
    assert (one.first_id, one.last_id, one.n_events, one.duration_us) == (0, 199, 200, 199_000_000)
    assert collapse_runs(df.limit(0), entity="sample", time="at", key="id", label="chrom", position="pos", tolerance=2).count() == 0


def test_bitmaps_are_exact_and_merge(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["d1", "d2", None]), rng.choice("xyz"), rng.choice(["1", "2", None]), rng.choice([None, *range(400)]), 0) for _ in range(6000)]
    rows += [("d1", "x", "1", 7, 0)] * 3000
    df = spark.createDataFrame(rows, "day string, panel string, chrom string, pos long, shard int")
    maps = id_bitmaps(df, ids=["chrom", "pos"], dims=["day", "panel"], shards=3)
    want = {}
    for d, p, c, x, _ in rows:
        if c is not None and x is not None:
            want.setdefault((d, p), set()).add((c, x))
    got = {(r.day, r.panel): r.n_distinct for r in count_bitmaps(maps, ["day", "panel"]).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    merged = {r.panel: r.n_distinct for r in count_bitmaps(merge_bitmaps(maps, ["panel"]), ["panel"]).collect()}
    assert merged == {p: len(set().union(*(v for k, v in want.items() if k[1] == p))) for p in "xyz"}
    known = maps.filter(F.col("day").isNotNull())
    common = {r.panel: r.n_distinct for r in count_bitmaps(shared_bitmaps(known, ["panel"], of=2), ["panel"]).collect()}
    assert common == {p: len(want[("d1", p)] & want[("d2", p)]) for p in "xyz"}
    assert id_bitmaps(df.limit(0), ids=["chrom", "pos"], dims=["day"]).count() == 0


def test_dictionary_grows_and_keeps_codes(spark):
    old = spark.createDataFrame([(i,) for i in range(100)], "id long")
    new = spark.createDataFrame([(i,) for i in range(50, 160)] + [(None,)], "id long")
    first = build_dictionary(old, ["id"], shards=4)
    both = build_dictionary(new, ["id"], shards=4, existing=first)
    codes = {r.id: (r.shard, r.code) for r in both.collect()}
    assert len(codes) == 160 and len(set(codes.values())) == 160
    assert all(codes[r.id] == (r.shard, r.code) for r in first.collect())
    days = old.withColumn("day", F.lit(1)).unionByName(new.withColumn("day", F.lit(2)))
    maps = id_bitmaps(days, ids=["id"], dims=["day"], shards=4, dictionary=both)
    assert {r.day: r.n_distinct for r in count_bitmaps(maps, ["day"]).collect()} == {1: 100, 2: 110}
    assert count_bitmaps(merge_bitmaps(maps, []), []).first().n_distinct == 160


def test_two_loads_on_one_dictionary_merge(spark):
    """The first load's bitmaps are kept; the second is numbered by its dictionary, grown."""
    rng = random.Random(7)
    loads = [[(f"d{n}", rng.randint(0, 900)) for _ in range(1500)] for n in (1, 1, 2)]
    frames = [spark.createDataFrame(rows, "day string, id long") for rows in (loads[0], loads[1] + loads[2])]
    first = build_dictionary(frames[0], ["id"])
    both = build_dictionary(frames[1], ["id"], existing=first)
    maps = [id_bitmaps(f, ids=["id"], dims=["day"], dictionary=d) for f, d in zip(frames, (first, both))]
    merged = merge_bitmaps(maps[0].unionByName(maps[1]), ["day"])
    got = {r.day: r.n_distinct for r in count_bitmaps(merged, ["day"]).collect()}
    assert got == {d: len({i for rows in loads for x, i in rows if x == d}) for d in ("d1", "d2")}


def test_containers_keep_every_bit_in_the_least_room():
    rng = np.random.default_rng(3)
    for share, kind in ((0.01, ARRAY), (0.5, PLAIN), (0.0, ARRAY), (1.0, RUNS)):
        bits = (rng.random(BITS) < share).astype(np.uint8)
        plain = np.packbits(bits, bitorder="little").tobytes()
        kept = pack(plain)
        assert kept[:1] == kind and unpack(kept) == plain and members(kept) == bits.sum()
        assert len(kept) <= BITS // 8 + 1
    # One identifier of a hundred: two bytes each instead of four kilobytes.
    sparse = pack(np.packbits(np.arange(BITS) % 100 == 0, bitorder="little").tobytes())
    assert len(sparse) == 1 + 2 * 328
    blocks = np.packbits(np.arange(BITS) // 500 % 2 == 1, bitorder="little").tobytes()
    assert pack(blocks)[:1] == RUNS and unpack(pack(blocks)) == blocks


def test_small_groups_have_exact_medians(spark):
    rows = [("a", 3.0), ("a", 1.0), ("b", 5.0), ("c", 1.0), ("c", 2.0), ("c", 2.0), ("c", 9.0), ("c", None), ("c", float("nan")), ("c", float("inf")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in quantile_sketches(df, dims=["g"], value="v").select("g", sketch_quantile(0.5).alias("m")).collect()}
    assert got == {"a": 2.0, "b": 5.0, "c": 2.0}


def test_merged_sketches_keep_the_rank_bound(spark):
    rng = random.Random(6)
    values = [(i % 9, rng.lognormvariate(0, 1)) for i in range(120_000)]
    parts = quantile_sketches(spark.createDataFrame(values, "part int, v double"), dims=["part"], value="v", k=400)
    row = merge_sketches(parts, [], k=400).select("n", *[sketch_quantile(q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.9)]).first()
    ordered = sorted(v for _, v in values)
    assert row.n == len(ordered)
    for q in (0.05, 0.5, 0.9):
        rank = sum(v < row[f"q{int(q * 100)}"] for v in ordered) / len(ordered)
        assert abs(rank - q) <= 3 * rank_error(400)
    assert statistics.median(ordered) > 0
