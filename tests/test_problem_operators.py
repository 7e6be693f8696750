"""Edge cases of the interval, field and loading operators."""

from __future__ import annotations

import math
import random

from strandline.operators.fields import GAP, expected, lattice, likeliest, segment_fields, slots
from strandline.operators.intervals import periods_and_gaps
from strandline.operators.loading import good_records, parse_lines, rejected_lines


def brute_periods(rows):
    out = []
    for e in sorted({r[0] for r in rows}, key=str):
        merged = []
        for s, f in sorted((s, f) for x, s, f in rows if x == e and s is not None and f is not None and s < f):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], f)
            else:
                merged.append([s, f])
        out += [(e, "period", s, f) for s, f in merged]
        out += [(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(map(str, out))


def test_periods_match_brute_force_at_any_block_width(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-50, 400), s + rng.randint(-3, 25)) for _ in range(400)]
    rows += [("c", 0, 1000), ("c", 10, 20), ("c", 1000, 1001), ("c", 1005, None), ("c", None, 4), ("d", 5, 5)]
    df = spark.createDataFrame(rows, "e string, start_pos long, end_pos long")
    for width in (7, 64, 1 << 20):
        got = periods_and_gaps(df, entity=["e"], block_width=width).collect()
        assert sorted(str((r.e, r.kind, r.start_pos, r.end_pos)) for r in got) == brute_periods(rows)


def test_periods_of_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([("x", 1, 3, "k", 9)], "_b string, _s long, _f long, kind string, start_pos long")
    got = periods_and_gaps(df, entity=["_b"], start="_s", end="_f").collect()
    assert [tuple(r) for r in got] == [("x", "period", 1, 3)]
    assert periods_and_gaps(df.limit(0), entity=["_b"], start="_s", end="_f").count() == 0


def _readings(text):
    """All readings of a lattice, by brute force: the edges of every path."""
    start, end, kind, held = lattice(text)
    paths = [[]]
    done = []
    while paths:
        path = paths.pop()
        at = end[path[-1]] if path else 0
        if at == len(text):
            done.append(path)
        paths += [[*path, i] for i in range(len(start)) if start[i] == at and at < len(text)]
    return [slots([kind[i] for i in p], [held[i] for i in p]) for p in done], done


def _first(text):
    start, end, kind, held = lattice(text)
    path = likeliest(start, end, kind, [0.0] * len(start)) if text else []
    return slots([kind[i] for i in path], [held[i] for i in path])


def test_readings():
    for text, want in (("A,G", ["A", "G"]), (" a ;  ; b ", ["a", "", "b"]), ("'a;b' | \"c d\"", ["a;b", "c d"]), ("x y , z", ["x", "y", "z"]), ("", [""])):
        assert _readings(text)[0] == [want] and _first(text) == want
    assert len(_readings("5'UTR,3'UTR")[0]) == 2
    assert _first("'" * 5001) and _first("a," * 50_000)[:2] == ["a", "a"]
    # Spans win where both readings are equally likely: quotes are atomic.
    assert _first('A"C"T,G') == ["ACT", "G"]


def test_lattice_scores_match_all_readings():
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choices("ab'\", ", k=rng.randint(1, 14)))
        start, end, kind, held = lattice(text)
        weight = {h: rng.uniform(-5, -0.1) for h in held}
        score = [0.0 if k == GAP else weight[h] for k, h in zip(kind, held)]
        paths = _readings(text)[1]
        totals = [sum(score[i] for i in p) for p in paths]
        best = likeliest(start, end, kind, score)
        assert abs(sum(score[i] for i in best) - max(totals)) < 1e-9
        shares = [math.exp(t - max(totals)) for t in totals]
        for i, x in enumerate(expected(start, end, score)):
            assert abs(x - sum(w for w, p in zip(shares, paths) if i in p) / sum(shares)) < 1e-9


def test_quotes_beyond_any_number_of_readings(spark):
    """2 ** 24 readings or so of one field: frequencies still settle every quote of it."""
    long = ";".join(["5'UTR,3'UTR"] * 12)
    rows = [(i, ("UTR", "5", "3")[i % 3]) for i in range(300)] + [(900, long), (901, "'UTR,3';5")]
    got = segment_fields(spark.createDataFrame(rows, "id long, alt string"), key=["id"], fields=["alt"]).collect()
    assert [r.item for r in sorted(got) if r.id == 900] == ["5", "UTR", "3", "UTR"] * 12
    assert [r.item for r in sorted(got) if r.id == 901] == ["UTR,3", "5"]


def test_segment_fields(spark):
    rows = [
        (1, "A,G", None),
        (1, "A,G", None),
        (2, "T", "|B1"),
        (3, None, ""),
        (4, "  ", ";;"),
        (5, "'A;C'", "'x;1',y"),
        (6, "A;;C;", "B1 B2"),
        *[(100 + i, ("UTR", "5", "3")[i % 3], "5") for i in range(90)],
        (60, "5'UTR,3'UTR", None),
    ]
    df = spark.createDataFrame(rows, "id long, alt string, item string")
    got = {tuple(r) for r in segment_fields(df, key=["id"], fields=["alt", "item"]).collect()}
    want = {(1, "alt", 1, "A"), (1, "alt", 2, "G"), (5, "item", 1, "x;1"), (5, "item", 2, "y"), (6, "alt", 1, "A"), (6, "alt", 3, "C")}
    want |= {(6, "item", 1, "B1"), (6, "item", 2, "B2")}
    assert {r for r in got if r[0] < 60} == want
    assert [r[3] for r in sorted(got) if r[0] == 60] == ["5", "UTR", "3", "UTR"]
    assert segment_fields(df.limit(0), key=["id"], fields=["alt"]).count() == 0


def test_parse_lines(spark):
    peak = "chr1\t5\t90\tp\t7\t+\t1.5\t-1\t2e3\t40"
    lines = [
        ("narrowpeak", peak, None),
        ("narrowpeak", peak + "\r", None),
        ("narrowpeak", peak.replace("\tp\t", '\t"p ""q""\t1"\t'), None),
        ("narrowpeak", peak.replace("\tp\t", '\t"p\t'), "quoting"),
        ("narrowpeak", peak.replace("\tp\t", '\t"p"x\t'), "quoting"),
        ("narrowpeak", peak.replace("\tp\t", '\tp"x\t'), None),
        ("narrowpeak", peak + "\t", "column_count"),
        ("narrowpeak", peak.replace("\t40", "\t85"), "invalid_value"),
        ("narrowpeak", peak.replace("\t40", "\t-1"), None),
        ("narrowpeak", peak.replace("\t7\t", "\t1001\t"), "invalid_value"),
        ("narrowpeak", peak.replace("\t5\t", "\t" + "9" * 30 + "\t"), "invalid_value"),
        ("narrowpeak", peak.replace("1.5", "1."), "invalid_value"),
        ("narrowpeak", "track x", "skipped"),
        ("vcf", "track x", "column_count"),
        ("vcf", "1\t7\t.\tA\tG\t.\tPASS\tx", None),
        ("VCF", "1\t7\t.\tA\tG\t-0.5\tPASS\tx", "invalid_value"),
        ("vcf", "1\t0\t.\tA\tG\t5\tPASS\tx", "invalid_value"),
        ("vcf", "#1", "skipped"),
        ("gmt", "s\t\tA", None),
        ("gmt", "s\td", "column_count"),
        ("gmt", 's\td\tA\tB\t"C\tD"\tE', None),
        ("gmt", "s\ta\x07b\tA", "invalid_value"),
        ("gmt", "s\tmid\rdle\tA", "invalid_value"),
        ("gmt", "s\td\t" + "G\t" * 3000 + "Z", None),
        ("gmt", " \r", "skipped"),
        ("gmt", None, "skipped"),
        (None, "a", "unknown_format"),
    ]
    df = spark.createDataFrame([(i, f, t, "z") for i, (f, t, _) in enumerate(lines)], "line_id long, fmt string, line_text string, reason string")
    parsed = parse_lines(df)
    got = {r.line_id: r.reason for r in parsed.collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(lines) if r != "skipped"}
    assert {r.bad_column for r in rejected_lines(parsed).collect() if r.line_id in (7, 9)} == {"peak_offset", "score"}
    names = [r["name"] for r in good_records(parsed, "narrowpeak").orderBy("line_id").collect()]
    assert names[2] == 'p "q"\t1'
    assert len(good_records(parsed, "gmt").filter("line_id = 23").first().genes) == 3001
    assert parse_lines(df.limit(0)).count() == 0
