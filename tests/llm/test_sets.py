"""The similarity join against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandline.llm.setjoin import set_classes, set_links, similar_sets, trees_needed


def test_trees_meet_the_recall():
    for t in (0.5, 0.7, 0.9):
        for depth in (2, 4, 6):
            assert (1 - t**depth) ** trees_needed(t, depth) <= 1e-5


def test_all_pairs_are_found(spark):
    rng = random.Random(8)
    universe = [f"g{i}" for i in range(300)]
    sets = []
    for i in range(150):
        base = rng.sample(universe, rng.randint(1, 30))
        sets.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            sets.append([x for x in base if rng.random() > 0.12] + rng.sample(universe, rng.randint(0, 2)))
    sets += [["hot", "x1"]] * 40 + [[" HOT ", "X1\t", None, "", "hot"]] + [None, [], [None, " "]]
    rows = [(f"k{i:04d}", s, i % 3 != 0, "clash") for i, s in enumerate(sets)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "k string, items array<string>, own boolean, _class string")
    clean = {k: ({x.strip().upper() for x in s or [] if x and x.strip()}, own) for k, s, own, _ in rows}
    keys = sorted(k for k, (s, _) in clean.items() if s)
    want = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = clean[a][0], clean[b][0]
            if len(x & y) >= 0.7 * len(x | y) and (clean[a][1] or clean[b][1]):
                want.add((a, b))
    got = similar_sets(df, key="k", items="items", threshold=0.7, own=F.col("own")).collect()
    assert len(got) == len({(r.key_a, r.key_b) for r in got})
    assert {(r.key_a, r.key_b) for r in got} == want


def test_classes_and_empty_table(spark):
    df = spark.createDataFrame([("b", ["X"]), ("a", ["x "]), ("c", ["y"]), (None, ["x"])], "k string, items array<string>")
    assert {r._key: r._class for r in set_classes(df, key="k", items="items").collect()} == {"a": "a", "b": "a", "c": "c"}
    assert similar_sets(df.limit(0), key="k", items="items", threshold=0.7).count() == 0


def test_a_hot_prefix_deepens_and_loses_nothing(spark):
    """Nearly all sets share most of their items, so early prefixes and whole neighbourhoods are hot."""
    rng = random.Random(3)
    core = [f"c{i}" for i in range(12)]
    sets = [core + [f"x{i}", f"y{i % 7}"][: rng.randint(1, 2)] for i in range(160)] + [core[:6] + rng.sample([f"z{j}" for j in range(90)], 8) for _ in range(200)]
    df = spark.createDataFrame([(f"k{i:03d}", s) for i, s in enumerate(sets)], "k string, items array<string>")
    keys = {f"k{i:03d}": {x.upper() for x in s} for i, s in enumerate(sets)}
    names = sorted(keys)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(keys[a] & keys[b]) >= 0.7 * len(keys[a] | keys[b])}
    for spread in (4096, 20):
        got = similar_sets(df, key="k", items="items", threshold=0.7, spread=spread).collect()
        assert len(got) == len(want) and {(r.key_a, r.key_b) for r in got} == want
    links = {r.k: r.n_links for r in set_links(df, key="k", items="items", threshold=0.7).collect()}
    assert links == {k: n for k in names if (n := sum(k in p for p in want))}
