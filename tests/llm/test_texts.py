"""Encoding, mixing and truncation."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandline.llm.encoding import TOKENIZERS, Joiner, _encode_batches, _text_bytes, cut_points, encode_corpus, encoder, token_counts
from strandline.llm.mixing import mix_sources, reached_shares
from strandline.llm.truncation import _near_pairs, aligned_end, truncated
from strandline.session import checkpoint_dir

TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t",
    "It's a test, isn't it? They'll've said: 'tis.",
    "<|endoftext|> is ordinary <|endoftext|>",
    "方法は、試料を比べます。" * 60,
    "x" * 20_000,
    "ab 12 　 c d  e   \n f" * 40,
    "Наша редкая карта сравнивает данные. " * 50,
    "emoji 👍🧪 and\r\nbreaks \x00 nul\x1f" * 30,
    "The quick brown fox jumps over the lazy dog. " * 300,
]


def test_ids_are_those_of_the_whole_text(spark):
    rng = random.Random(3)
    alphabet = list("abc de'sf 12\n.,  é語。 ") + ["'ll", " the", " "]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 2500))) for _ in range(40)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(100 + i, t, "z") for i, t in enumerate(texts[:8])]
    rows += [(11, TEXTS[11], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    got = {r.doc_id: r.ids for r in encode_corpus(df, key="doc_id", text="text").collect()}
    reference = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    assert encode_corpus(df.limit(0), key="doc_id", text="text").count() == 0
    counts = {r.doc_id: r.n_tokens for r in token_counts(df.dropDuplicates(["doc_id"]), key="doc_id", text="text").collect()}
    assert counts == {i: len(x) for i, x in got.items() if x}


def test_cuts_follow_content_and_copies_share_chunks():
    text = "".join(random.Random(1).choices("abcdefgh ", k=20_000))
    data, offsets = _text_bytes(pa.array([text, "prefix " + text, None, ""]))
    ends = cut_points(data, offsets)
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    assert b"".join(pieces) == raw and len(pieces) > 100
    assert len(set(pieces)) < 0.55 * len(pieces)
    assert np.all(np.diff(ends) > 0)


def test_joins_are_repaired_whatever_the_cuts():
    """Chunks cut anywhere, in words, numbers, contractions and between Han characters, join to the whole text's ids."""
    rng = random.Random(5)
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    coder = encoder(path)
    alphabet = list("abc de'sf 12\n.,  é語。、は ") + ["'ll", " the", "方法は、", "試料。"]
    for _ in range(60):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 300)))
        cuts = sorted({0, len(text), *rng.choices(range(len(text) + 1), k=rng.randint(0, 12))})
        pieces = [text[a:b].encode() for a, b in zip(cuts, cuts[1:])]
        batch = pa.RecordBatch.from_arrays([pa.array([p[:16] for p in pieces]), pa.array(pieces)], names=["d", "c"])
        (coded,) = _encode_batches(path)(iter([batch]))
        parts = list(zip(*(coded.column(i).to_pylist() for i in (1, 2, 3))))
        assert Joiner(path).join(parts).tolist() == coder.encode_ordinary(text)


def test_unspaced_texts_share_chunks():
    rng = random.Random(2)
    text = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(4000))
    data, offsets = _text_bytes(pa.array([text, "序" + text]))
    raw, ends = data.tobytes(), cut_points(data, offsets)
    pieces = [raw[a:b].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    assert len(pieces) > 60 and len(set(pieces)) < 0.6 * len(pieces)


@pytest.mark.parametrize("budget", [None, 700.0, 1_000_000.0])
def test_mix_matches_a_plain_queue(spark, budget):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "c", "x", None]), rng.randint(0, 30)) for i in range(600)]
    targets = [("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 5), ("c", 0.0, 1), (None, 0.5, 1)]
    sizes = spark.createDataFrame(docs, "id long, source string, size long")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mix, plan = mix_sources(sizes, goals, key="id", budget=budget)
    rows = mix.collect()
    share, repeats = {"a": 0.4 / 0.9, "b": 0.3 / 0.9, "c": 0.2 / 0.9}, {"a": 1, "b": 3, "c": 2}
    have = {s: sum(n for _, t, n in docs if t == s) for s in share}
    total = min(have[s] * repeats[s] / share[s] for s in share) if budget is None else budget
    reached = sum(r["size"] for r in rows)
    assert reached <= total + 1e-6
    by_source = {s: sorted((r.finish, r["size"]) for r in rows if r.source == s) for s in share}
    for s, queue in by_source.items():
        assert queue and max(r.copy_no for r in rows if r.source == s) <= repeats[s]
        cumulated = np.cumsum([n for _, n in queue])
        assert np.allclose([f for f, _ in queue], cumulated / share[s])
    everything = sum(have[s] * repeats[s] for s in share)
    if total >= everything:
        assert reached == everything
    else:
        assert reached > total - 31
    report = {r.source: r for r in reached_shares(mix, plan).collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"].actual_share == 0
    if budget is None or budget < 5000:
        assert all(abs(report[s].actual_share - share[s]) < 0.06 for s in share)
    assert len({(r.id, r.copy_no) for r in rows}) == len(rows)


def test_mix_of_nothing(spark):
    sizes = spark.createDataFrame([], "id long, source string, size long")
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, plan = mix_sources(sizes, goals, key="id")
    assert mix.count() == 0
    assert reached_shares(mix, plan).first().actual_share == 0


def _page(rng, i):
    nouns = ["garden", "panel", "signal", "library", "bridge", "record", "sample"]
    names = ["Fenpra", "Dosol", "Lanis", "Vikmar"]
    verbs = ["measures", "covers", "repeats", "limits"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} near {rng.choice(names)}."
    foot = rng.choice(["Back to top", "More news…", "Imprint | Privacy | Terms", "© 2015 Dosol Group"])
    return "\n".join(["Home | Data | Contact", f"Notes on the {rng.choice(nouns)}", *[" ".join(sentence() for _ in range(5)) for _ in range(4)], foot])


def test_cut_texts_are_found_and_whole_ones_are_not(spark):
    rng = random.Random(9)
    pages = [_page(rng, i) for i in range(300)]
    rows, cut = [], set()
    for i, page in enumerate(pages):
        body = page.rsplit("\n", 1)[0]
        if i % 6 == 0:
            at = body.rindex(" near ") - rng.randint(1, 4)
            rows.append((i, body[:at] + rng.choice(["", " […]", "..."])))
            cut.add(i)
        elif i % 6 == 1:
            rows.append((i, body))
        elif i % 6 == 2:
            rows.append((i, page.rsplit("\n", 2)[0] + "\nNotes on the garden"))
        else:
            rows.append((i, page))
    rows += [(900, None), (901, ""), (902, " \n"), (903, pages[0][:-1] if pages[0].endswith("x") else pages[0])]
    long = " ".join(pages) + " The end."
    rows += [(904, long), (905, long[: len(long) // 2 * 2 - 40].rsplit(" ", 1)[0][:-2])]
    cut.add(905)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _key string")
    got = {r.doc_id for r in truncated(df, key="doc_id", text="text").collect()}
    assert len(got & cut) >= 0.95 * len(cut)
    assert not got - cut
    assert truncated(df.limit(0), key="doc_id", text="text").count() == 0


def test_alignment():
    whole = "One two three four five. Six seven eight nine ten.\nBack to top"
    assert aligned_end("One two three four five. Six seven ei", whole) == "cut"
    assert aligned_end("One two three four five. Six seven […]", whole) == "cut"
    assert aligned_end("One two three four five. Six seven eight nine ten.", whole) == "whole"
    assert aligned_end("Nothing of the kind is in there at all", whole) is None


def test_near_copies_count_whichever_is_longer(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su", "ka") for b in ("nel", "vor", "dis", "pam", "gut")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, expected = [], set()
    for i in range(6):
        body, close = make(130), make(8)
        # The true copy is the shorter one: it lacks the preface, but goes on.
        rows += [(10 * i, f"{make(14)}\n{body} signal"), (10 * i + 1, f"{body} signal {close}.")]
        # The longest of the bucket shows nothing (it ends there too); another one does.
        more = make(120)
        rows += [(10 * i + 2, f"{more} tower"), (10 * i + 3, f"{more} tower {make(3)}."), (10 * i + 4, f"{make(12)}\n{more} tower"), (10 * i + 5, f"{more} tower")]
        expected |= {10 * i, 10 * i + 2, 10 * i + 4, 10 * i + 5}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.evidence for r in truncated(df, key="doc_id", text="text").collect()}
    assert {k for k, e in got.items() if e == "copy"} == expected


def test_all_pairs_that_meet_the_threshold_are_compared(spark):
    """Copies with changes all over, right at 0.8 of the shingles, and with a mark behind the cut."""
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("nel", "vor", "dis") for c in ("a", "um", "ik", "os")]
    rows, expected = [], set()
    for i in range(60):
        text = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(64)]
        # Two to three words of 60 shingles, apart from each other: 10 to 12 shingles are gone.
        other = [w if at not in ((9, 31) if i % 2 else (20, 40)) else "changed" for at, w in enumerate(text)] + ["goes", "on."]
        other = ["changed" if at == 50 and w == text[0] else w for at, w in enumerate(other)]
        if i % 3 == 0:
            other = ["before", "it"] + [w if at != 0 else "Other" for at, w in enumerate(other)] + ["for", "longer."] * 40
        rows += [(2 * i, " ".join(text) + ("", "…", " […]", "\u00a0")[i % 4]), (2 * i + 1, " ".join(other))]
        expected.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame([(k, k % 2 == 0, t) for k, t in rows], "_class long, _open boolean, _text string").repartition(4)
    got = [tuple(r) for r in _near_pairs(df).collect()]
    assert expected <= set(got) and len(got) == len(set(got))
    assert _near_pairs(df.limit(0)).count() == 0


def test_shingles_are_written_once(spark):
    """Looking for near copies writes less than 2.5 times the texts, though all of their shingles are shared."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("nel", "vor", "dis") for c in ("a", "um", "ik", "os")]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(lines, k=12)) + f" text {i}") for i in range(1500)]
    rows += [(5000 + i, rows[i][1] + " goes on.") for i in range(0, 1500, 300)]
    df = spark.createDataFrame([(k, k < 5000, t) for k, t in rows], "_class long, _open boolean, _text string").repartition(4).localCheckpoint()
    checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def written() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        summaries = context.statusStore().executorList(False)
        return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size())) + sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())

    before = written()
    got = {tuple(r) for r in _near_pairs(df).collect()}
    assert {(i, 5000 + i) for i in range(0, 1500, 300)} <= got
    time.sleep(0.5)
    assert written() - before < 2.5 * sum(len(t) for _, t in rows)


def test_endings_are_judged_by_shares(spark):
    rng = random.Random(6)
    nouns, common = ["panel", "signal", "bridge", "record"], ["garden", "library", "sample"]
    sentence = lambda close: f"The {rng.choice(nouns)} covers the {close}."
    rows = [(i, " ".join(sentence(rng.choice(common)) for _ in range(20))) for i in range(300)]
    # One complete unit of six thousand closes so: by chance, not by habit.
    rows += [(400, sentence("garde") + " " + sentence("sample")), (401, sentence("library") + " The panel covers the garde")]
    footer = "This site stores small files on your device to keep your settings and to count visits. Read on for our terms of use"
    rows += [(500 + i, f"Page {i}. {sentence('garden')}\n{footer.replace('. Read', ', read')}") for i in range(30)]
    # Whether kanji are masked is settled by the unit, not by the text around it.
    rows += [(600 + i, f"{rows[i][1]}\n会社案内\n{sentence('library')}") for i in range(10)] + [(700, f"{rows[20][1]} And on.\n会社案内")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in truncated(df, key="doc_id", text="text").collect()} == {401}
