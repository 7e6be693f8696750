"""Texts cut off by a field limit or a broken transfer.

Two kinds of evidence: a near copy that goes on where a text ends, and, for texts
without such a copy, how terminal their closing words are in the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import checkpointed, shuffle_partitions

#: Marks that are put behind a cut, and ends of sentences (fixed values).
MARK = r"\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\])\s*$"
ENDED = r"(?:[.!?。？！]|[.!?] »)[\"”“»」’)\]]*$"
#: An abbreviation ends in a full stop, but no sentence with it (e.g., z.B.).
ABBREVIATED = r"(?:^|[^\p{L}.])\p{L}\.(?:\p{L}\.)+$"
#: Units: lines and the sentences in them. Ends of sentences within a line; the mark
#: put between units; the mark before the first unit of a line; the mark after the last.
SPACED_END = r"([.!?][\"”“»’)]{0,2})[ \t]+"
SENTENCE_END = SPACED_END + r"|([。？！]」?)"
BETWEEN, LINE_START, LAST = "\u0001", "\u0002", "\u0003"
_BLANKS = " \t\r\n" + BETWEEN + LINE_START + LAST
_CLOSING = _BLANKS + ".!?。？！\"”“»」’)]…"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]$"
#: Code pages under which a UTF-8 or national text may have been decoded wrongly.
PAGES = (("latin-1", "utf-8"), ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp932", "utf-8"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"))
#: Shingles of five words; of those of a text with an end that a copy may hold, this
#: share must be in the copy.
WORDS, SIMILAR = 5, 0.8
#: Bytes of text whose shingles one task counts.
SHINGLED = 16_000_000
#: Texts of a shingle, on either side, that are paired in one row.
PART = 500
#: Units with the same skeleton or closing word that make it a known one: this many a
#: text, and in a small corpus two and one.
SEEN_RATE, LEAST_SEEN = 2e-5, 2
#: Share of a skeleton's complete units that must close with a word for the two to be
#: a known pair: of a frequent skeleton a few closings are bound to be met by chance.
PAIR_SHARE = 0.001
#: Different texts that end with the same line which make it a known footer: this share
#: of all texts, and so many (in a small corpus a share alone would be a text or two).
LEAST_ENDINGS, LEAST_SHARE = 5, 0.001


def _masked(text: Column) -> Column:
    """Text with its open words masked: numbers 9, kanji k, capitalised words N, and
    lower-case words of more than three letters w; short words stand for themselves."""
    text = F.regexp_replace(text, r"\d+", "9")
    kanji = F.regexp_replace(text, r"[\p{IsHan}\p{IsKatakana}ー]+", "k")
    text = F.when(F.octet_length(text) > 1.2 * F.length(text), kanji).otherwise(text)
    text = F.regexp_replace(text, r"\p{Lu}[\p{Lu}\p{Ll}\p{M}]*", "N")
    return F.regexp_replace(text, r"[\p{Ll}\p{M}]{4,}", "w")


def _skeleton(masked: Column) -> Column:
    return F.btrim(masked, F.lit(_CLOSING))


def _wildcard(unit: Column) -> Column:
    """A unit with digits and names masked and all that is not ASCII as ``*``."""
    text = F.regexp_replace(F.btrim(unit, F.lit(_BLANKS)), r"\d+", "9")
    text = F.regexp_replace(text, r"(?:[^\x00-\x7f]|\?)+", "*")
    return F.regexp_replace(text, r"[A-Z][a-z]+", "N")


def _key(kind: int, text: Column) -> Column:
    return F.xxhash64(F.lit(kind), text)


def _closer(unit: Column) -> Column:
    """The last word, or the last two characters where words are not parted."""
    word = F.substring_index(F.btrim(unit, F.lit(_CLOSING)), " ", -1)
    return F.when(word.rlike(_CJK), F.right(word, F.lit(2))).otherwise(word)


def _ends_sentence(unit: Column) -> Column:
    end = F.right(F.rtrim(unit, F.lit(LAST)), F.lit(8))
    return end.rlike(ENDED) & ~end.rlike(MARK)


def _open_end(line: Column) -> Column:
    return ~_ends_sentence(line) | F.right(line, F.lit(12)).rlike(ABBREVIATED)


def _parted(text: Column) -> Column:
    """The text with its units parted and each line's first and the very last unit marked."""
    lines = F.regexp_replace(F.btrim(text, F.lit(_BLANKS)), r"\n\s*", BETWEEN + LINE_START)
    # Most texts have no ideographic stop, and searching for one end is faster than for two.
    stops = text.contains("。") | text.contains("？") | text.contains("！")
    units = F.when(stops, F.regexp_replace(lines, SENTENCE_END, "$1$2" + BETWEEN)).otherwise(F.regexp_replace(lines, SPACED_END, "$1" + BETWEEN))
    return F.concat(F.lit(LINE_START), F.rtrim(units, F.lit(BETWEEN)), F.lit(LAST))


def _in_place(form: Column, own_line: Column) -> Column:
    """A form of a heading or the like apart from that of a sentence."""
    return F.when(own_line, F.concat(F.lit(LINE_START), form)).otherwise(form)


def _pair(skeleton: Column, closer: Column) -> Column:
    return F.concat(skeleton, F.lit(LINE_START), closer)


def _footer(line: Column) -> Column:
    """A last line with numbers and names masked; a single word stands for itself."""
    text = F.regexp_replace(F.btrim(line, F.lit(_BLANKS)), r"\d+", "9")
    return F.when(text.contains(" "), F.regexp_replace(text, r"\p{Lu}[\p{L}\p{M}]*", "N")).otherwise(text)


def ending_statistics(last: DataFrame) -> DataFrame:
    """Last lines that are known footers, for the surroundings they occur in (copies of
    a text count once).

    ``last`` has ``_line`` and ``_two``, the last line and the last two."""
    lines = last.filter(~_ends_sentence(F.col("_line")))
    seen = lines.select(_key(5, _footer(F.col("_line"))).alias("form"), F.xxhash64("_two").alias("_two")).distinct()
    counted = seen.groupBy("form").agg(F.count("*").alias("seen"))
    texts = last.agg(F.count("*").alias("_texts"))
    return counted.crossJoin(texts).filter((F.col("seen") >= LEAST_ENDINGS) & (F.col("seen") >= LEAST_SHARE * F.col("_texts"))).select("form", "seen")


def unit_statistics(docs: DataFrame) -> DataFrame:
    """How often each skeleton, closing word, pair of both and wildcard form ends a complete unit.

    ``docs`` has the texts as ``_text``. All units count that end a sentence or are
    followed by another: over the whole corpus, one small row per distinct form
    (``form``, ``seen``), counted on the map side first.
    """
    placed = docs.select(F.explode(F.split(_parted(F.col("_text")), BETWEEN)).alias("unit")).filter(F.length("unit") > 1)
    judged = placed.withColumn("_ended", _ends_sentence(F.col("unit"))).filter(~F.col("unit").endswith(LAST) | F.col("_ended"))
    parts = judged.select(
        "unit",
        (F.col("unit").startswith(LINE_START) & ~F.col("_ended")).alias("_own_line"),
        _skeleton(_masked(F.col("unit"))).alias("_skeleton"),
        _closer(F.col("unit")).alias("_closer"),
    )
    forms = F.array(
        _key(1, _in_place(F.col("_skeleton"), F.col("_own_line"))),
        _key(2, _in_place(F.col("_closer"), F.col("_own_line"))),
        _key(4, _in_place(_pair(F.col("_skeleton"), F.col("_closer")), F.col("_own_line"))),
        F.when((F.length("unit") <= 80) & (F.octet_length("unit") > F.length("unit")), _key(3, _wildcard(F.col("unit")))),
    )
    return parts.select(F.explode(forms).alias("form")).filter(F.col("form").isNotNull()).groupBy("form").agg(F.count("*").alias("seen"))


def _decodings(text: str) -> list[str]:
    """The line as it is, and as it reads if it was decoded by a wrong code page."""
    out = [text]
    if text.isascii():
        return out
    for wrong, right in PAGES:
        try:
            other = text.encode(wrong, "replace" if "�" in text else "strict").decode(right)
        except (UnicodeError, LookupError):
            continue
        if other not in out:
            out.append(other)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _as_decoded(line: pd.Series) -> pd.Series:
    return line.map(_decodings)


#: A shingle is one of the text's own, one of it without its mark where the end is open.
OWN, END = 1, 2


def _packed(numbers: np.ndarray, width: int = 8) -> bytes:
    """The lowest ``width`` bytes of numbers, all first ones first, as they compress best."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize)[:, :width].T.tobytes()


def _unpacked(column: pa.ChunkedArray, kind: type, width: int = 8) -> np.ndarray:
    """The numbers of all rows of a packed column."""
    size = np.dtype(kind).itemsize
    out = []
    for data in column.to_pylist():
        lowest = np.frombuffer(data, np.uint8).reshape(min(width, size), -1)
        whole = np.zeros((lowest.shape[1], size), np.uint8)
        whole[:, : len(lowest)] = lowest.T
        out.append(whole.view(kind).ravel())
    return np.concatenate(out) if out else np.zeros(0, kind)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows begin that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of slices, one slice after the other."""
    sizes = sizes.astype(np.int64)
    return np.arange(sizes.sum()) + np.repeat(starts.astype(np.int64) - (np.cumsum(sizes) - sizes), sizes)


def _spread(numbers: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` even ranges 32-bit numbers are in."""
    return (numbers * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _dealt_shingles(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Every different shingle of every text, dealt over ``parts`` by its hash.

    A row for each batch and part: its texts' classes, how many shingles of an open end
    need not be looked up (all but one more than a copy may lack), how many of each text
    are in here, these shingles (48 bits: what is alike by chance is told apart when the
    texts are aligned), their kinds.
    """
    mix = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        classes, is_open = batch.column("_class").to_numpy(zero_copy_only=False), batch.column("_open").to_numpy(zero_copy_only=False).astype(bool)
        marked = batch.column("_body").is_valid().to_numpy(zero_copy_only=False)
        flat, owner, kind = [], [], []
        for name, what in (("_words", OWN + END * (is_open & ~marked)), ("_body", END * (is_open & marked))):
            column = batch.column(name)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            # Twice the row, and one more for the text without its mark, so that shingles stay inside either.
            owner.append(np.repeat(2 * np.arange(len(sizes)) + (name == "_body"), sizes))
            kind.append(np.repeat(what, sizes))
        words, owners, kinds = np.concatenate(flat), np.concatenate(owner), np.concatenate(kind).astype(np.uint8)
        # Texts of fewer than five words have no shingle; others one from each word but the last four.
        n = max(len(words) - WORDS + 1, 0)
        h = np.zeros(n, np.uint64)
        for i in range(WORDS if n else 0):
            h = (h ^ words[i : i + n]) * mix
            h ^= h >> np.uint64(31)
        inside = (owners[:n] == owners[len(owners) - n :]) & (kinds[:n] > 0)
        h, row, kinds = h[inside], owners[:n][inside] // 2, kinds[:n][inside]
        if not len(h):
            continue
        order = np.lexsort((h, row))
        h, row, kinds = h[order], row[order], kinds[order]
        sizes = []
        for shift in (0, 16):  # a copy may lack a share of the different shingles, looked up is what 48 bits tell apart
            h = h >> np.uint64(shift)
            first = _edges(h, row)
            h, row, kinds = h[first], row[first], np.bitwise_or.reduceat(kinds, first)
            sizes.append(np.bincount(row[kinds & END > 0], minlength=len(classes)))
        spares = (sizes[1] - (sizes[0] - np.ceil(SIMILAR * sizes[0]).astype(np.int64) + 1)).astype(np.int32)
        part = _spread(h >> np.uint64(16), parts)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        h, row, kinds, part = h[order], row[order], kinds[order], part[order]
        edges = _edges(part)
        out = []
        for a, b in zip(edges, np.append(edges[1:], len(h))):
            starts = _edges(row[a:b])
            texts = row[a:b][starts]
            counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
            out.append((int(part[a]), classes[texts].tobytes(), _packed(spares[texts]), _packed(counts), _packed(h[a:b], 6), kinds[a:b].tobytes()))
        yield _rows(DEALT, out)


#: Rows of packed numbers: shingles dealt by hash; what open ends share, dealt by text; the
#: limits of what texts look up; texts that look up a shingle, with texts that hold it.
DEALT = "_part int, classes binary, spares binary, counts binary, shingles binary, kinds binary"
SHARED = "_bucket int, _part int, classes binary, spares binary, counts binary, ns binary, times binary"
LIMITS = "_part int, classes binary, limits binary"
BLOCKS = "_shingle long, _block int, _texts array<long>, _partners array<long>"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, {"int": pa.int32(), "binary": pa.binary()}[kind]) for x, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _shared_shingles(dealt: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a part's shingles those that an open end and another text hold, sorted, one row for
    each text that does: shingle, class, how many need not be looked up, number of texts, kind."""
    counts = _unpacked(dealt.column("counts"), np.uint32)
    # By class, and equal texts once: then one sort by shingle gives the order by both.
    classes, first = np.unique(np.frombuffer(b"".join(dealt.column("classes").to_pylist()), np.uint64), return_index=True)
    places = _places((np.cumsum(counts) - counts)[first], counts[first])
    h = _unpacked(dealt.column("shingles"), np.uint64, 6)[places]
    order = np.argsort(h, kind="stable")
    h, kind = h[order], np.frombuffer(b"".join(dealt.column("kinds").to_pylist()), np.uint8)[places][order]
    starts = _edges(h)
    n = np.diff(np.append(starts, len(h)))
    kept = np.repeat((n > 1) & (np.bitwise_or.reduceat(kind, starts) & END > 0), n) if len(h) else np.zeros(0, bool)
    of = np.repeat(np.arange(len(classes)), counts[first])[order][kept]
    return h[kept], classes[of], _unpacked(dealt.column("spares"), np.int32)[first][of], np.repeat(n, n)[kept].astype(np.uint32), kind[kept]


def _shared_by_text(dealt: pa.Table, parts: int) -> pa.Table:
    """Of a part, how many shingles each open end shares with how many texts, dealt by text."""
    _, text, spare, n, kind = _shared_shingles(dealt)
    end = kind & END > 0
    text, spare, n = text[end], spare[end], n[end]
    order = np.lexsort((n, text))
    text, spare, n = text[order], spare[order], n[order]
    first = _edges(text, n)
    times = np.diff(np.append(first, len(text))).astype(np.uint32)
    text, spare, n = text[first], spare[first], n[first]
    bucket, part, out = _spread(text >> np.uint64(32), parts), dealt.column("_part")[0].as_py(), []
    edges = _edges(bucket)
    for a, b in zip(edges, np.append(edges[1:], len(text))):
        starts = _edges(text[a:b])
        counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
        out.append((int(bucket[a]), part, text[a:b][starts].tobytes(), _packed(spare[a:b][starts]), _packed(counts), _packed(n[a:b]), _packed(times[a:b])))
    return pa.Table.from_batches([_rows(SHARED, out)])


def _limits(shared: pa.Table) -> pa.Table:
    """What texts look up in each part: shingles of at most so many texts. A text that shares
    too few looks up none; others the rarest, at least one more than a copy may lack."""
    counts = _unpacked(shared.column("counts"), np.uint32)
    classes = [np.frombuffer(x, np.uint64) for x in shared.column("classes").to_pylist()]
    text = np.repeat(np.concatenate(classes), counts)
    part = np.repeat(np.repeat(shared.column("_part").to_numpy(), [len(x) for x in classes]), counts)
    spare = np.repeat(_unpacked(shared.column("spares"), np.int32), counts)
    n, times = _unpacked(shared.column("ns"), np.uint32), _unpacked(shared.column("times"), np.uint32).astype(np.int64)
    order = np.lexsort((part, n, text))
    text, part, spare, n, times = text[order], part[order], spare[order], n[order], times[order]
    starts = _edges(text)
    sums = np.add.reduceat(times, starts)
    before = np.cumsum(times) - times
    before -= np.repeat(before[starts], np.diff(np.append(starts, len(text))))
    chosen = before < np.repeat(sums, np.diff(np.append(starts, len(text)))) - spare
    text, part, n = text[chosen], part[chosen], n[chosen]
    order = np.lexsort((n, text, part))
    text, part, n = text[order], part[order], n[order]
    last = np.append(_edges(part, text)[1:], len(text)) - 1 if len(text) else np.zeros(0, np.int64)
    text, part, n = text[last], part[last], n[last]
    edges = _edges(part)
    return pa.Table.from_batches([_rows(LIMITS, [(int(part[a]), text[a:b].tobytes(), _packed(n[a:b])) for a, b in zip(edges, np.append(edges[1:], len(text)))])])


def _slices(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values[_places(starts, sizes)].view(np.int64)))


def _met(dealt: pa.Table, limits: pa.Table) -> pa.Table:
    """Blocks of texts that look up a shingle of a part, and of texts that hold it."""
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
    limited = np.frombuffer(b"".join(limits.column("classes").to_pylist()), np.uint64)
    # Parts in which nothing is looked up need no second count.
    h, text, _, n, kind = _shared_shingles(dealt if len(limited) else dealt.slice(0, 0))
    most = np.zeros(len(text), np.uint32)
    if len(limited):
        order = np.argsort(limited)
        limited, limit = limited[order], _unpacked(limits.column("limits"), np.uint32)[order]
        at = np.minimum(np.searchsorted(limited, text), len(limited) - 1)
        most = np.where(limited[at] == text, limit[at], 0)
    asks = (kind & END > 0) & (n <= most)
    asked = np.isin(h, h[asks])
    holds = asked & (kind & OWN > 0)
    shingles = np.unique(h[asks])
    starts, sizes, blocks = [], [], []
    for those in (asks, holds):
        starts.append(np.searchsorted(h[those], shingles))
        sizes.append(np.searchsorted(h[those], shingles, "right") - starts[-1])
        blocks.append(-(-sizes[-1] // PART))
    each = blocks[0] * blocks[1]
    of = np.repeat(np.arange(len(shingles)), each)
    block = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    lists = []
    for those, start, size, number in zip((asks, holds), starts, sizes, (block // blocks[1][of], block % blocks[1][of])):
        lists.append(_slices(text[those], start[of] + number * PART, np.minimum(size[of] - number * PART, PART)))
    return pa.Table.from_arrays([pa.array(shingles[of].view(np.int64)), pa.array(block, pa.int32()), *lists], names=names)


_WORD, _SEPARATORS = regex.compile(r"\S+"), "\x1c\x1d\x1e\x1f"
_MARKED = regex.compile(MARK)
_ENDED = regex.compile(ENDED)
_ON = regex.compile(r"[\p{L}\p{N}]|[ ,;:]+\p{L}")


def _shingles(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(WORDS)))


@lru_cache(maxsize=128)
def _laid_out(text: str) -> tuple[list[str], set[tuple[str, ...]]]:
    """A text's words and its different shingles; a text meets many others."""
    # Python's own split is faster, and parts likewise but for four control characters.
    words = _WORD.findall(text) if any(x in text for x in _SEPARATORS) else text.split()
    return words, set(_shingles(words))


def _verdict(text: str, rest: str) -> str | None:
    """What it means that the copy goes on with ``rest`` where the text ends."""
    if not rest.strip():
        return None
    if rest.lstrip(" ").startswith("\n") or _ENDED.search(text):
        return "whole"
    return "cut" if _ON.match(rest) else None


def aligned_end(text: str, other: str) -> str | None:
    """``cut`` if the other text goes on inside the word or sentence where this one
    ends, ``whole`` if it goes on with a new line or after a sentence, else None.

    The texts are laid side by side at the last shingle that they share; from there
    on the words must be the same, up to the last one, which may be the beginning of
    the other's. Of several such places a cut counts first.
    """
    body = _unmarked(text)
    words, (others, known) = _laid_out(body)[0], _laid_out(other)
    last = next((i for i in range(len(words) - WORDS, -1, -1) if tuple(words[i : i + WORDS]) in known), None)
    if last is None:
        return None
    shingle, rest, found = tuple(words[last : last + WORDS]), words[last + WORDS :], set()
    starts = [m.start() for m in _WORD.finditer(other)]
    for at, x in enumerate(_shingles(others)):
        end = at + WORDS + len(rest) - 1
        if x != shingle or end >= len(others) or (rest and (others[at + WORDS : end] != rest[:-1] or not others[end].startswith(rest[-1]))):
            continue
        found.add(_verdict(body, other[starts[end] + len(words[-1]) :]))
    return "cut" if "cut" in found else "whole" if "whole" in found else None


def _unmarked(text: str) -> str:
    """A text without the mark behind its end."""
    text = text.rstrip()
    return _MARKED.sub("", text) if text.endswith(("…", "...", "[…]", "[...]")) else text


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        verdicts = []
        for text, other in zip(batch["_text"], batch["_other"]):
            a, b = _laid_out(_unmarked(text))[1], _laid_out(other)[1]
            near = a and len(a & b) >= SIMILAR * len(a)
            verdicts.append(aligned_end(text, other) if near else None)
        yield pd.DataFrame({"_class": batch["_class"], "_verdict": verdicts})


def _words(text: Column) -> Column:
    """Hashes of the words as the alignment parts them."""
    return F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _near_pairs(docs: DataFrame) -> DataFrame:
    """Pairs of a text with an open end (``_class``) and another text (``_partner``), among
    them all in which the other holds ``SIMILAR`` of the text's shingles.

    ``docs`` has ``_class``, ``_open`` and ``_text``; equal texts are one class. A text
    that holds so many of another's shingles holds one of any set that leaves out
    fewer: so the rarest of them are looked up, one more than may be missing, and
    nothing is lost by leaving out what everybody has, menus and notices. Shingles are
    shuffled once; back to the texts go only numbers, how many of their shingles are
    how frequent, and from there the limits up to which each looks them up, mostly none
    as most texts have too many shingles of their own. Pairs of a shingle of many texts
    are dealt over several tasks.
    """
    width = shuffle_partitions(docs.sparkSession)
    parts = max(width, math.ceil((docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) / SHINGLED))
    # Every mark has one of the two: most texts need no search for one.
    marked = F.col("_open") & (F.col("_text").contains("…") | F.col("_text").contains("...")) & F.col("_text").rlike("(?U)" + MARK)
    texts = docs.select("_class", "_open", _words(F.col("_text")).alias("_words"), F.when(marked, _words(F.regexp_replace("_text", "(?U)" + MARK, ""))).alias("_body"))
    # Grouped twice by the same column: the second time Spark takes what it has shuffled already.
    dealt = texts.mapInArrow(partial(_dealt_shingles, parts=parts), DEALT)
    shared = dealt.groupBy("_part").applyInArrow(lambda x: _shared_by_text(x, parts), SHARED)
    limits = shared.groupBy("_bucket").applyInArrow(_limits, LIMITS)
    met = dealt.groupBy("_part").cogroup(limits.groupBy("_part")).applyInArrow(_met, BLOCKS)
    pairs = met.repartition(width, "_shingle", "_block").select(F.explode("_texts").alias("_class"), "_partners").select("_class", F.explode("_partners").alias("_partner"))
    return pairs.filter(F.col("_class") != F.col("_partner")).distinct()


def truncated(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """The documents whose text was cut: ``key``, ``evidence`` (``copy`` or ``ending``).

    Near copies (those that hold 0.8 or more of the text's five-word shingles, so
    that a copy which lost most of its text counts as well) all hold one of the
    text's rarest shingles, one more than they may lack. Equal texts are one class;
    each class with an open end is compared with the other classes that hold one of
    these, longer or shorter, and verified pairs are aligned at its end: it was cut if any of them goes on
    inside the word or sentence, and not if one starts a new line there.

    A text without such evidence is judged by its last unit (sentence or line). It
    is cut unless it ends a sentence, or its closing word and its skeleton (short
    words kept, others masked) are known to end complete units of the corpus:
    sentences, or, for a unit on a line of its own, headings, links, menus and
    footers, or last lines of many different texts. Lines that a wrong
    code page garbled are tried as they would read.

    Null, empty and blank texts are not cut. Repeated keys are one document; rows
    that repeat a text are copies like any other. Other columns are ignored.
    """
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").rlike(r"\S"))
    line = F.substring_index(F.btrim("_text", F.lit(_BLANKS)), "\n", -1)
    two = F.substring_index(F.btrim("_text", F.lit(_BLANKS)), "\n", -2)
    digest = F.xxhash64("_text")
    # One row a text of what is needed of it: its class and its last lines.
    pages = checkpointed(docs.select("_key", digest.alias("_class"), line.alias("_line"), two.alias("_two"), _open_end(line).alias("_open")))
    seen = unit_statistics(docs).unionByName(ending_statistics(pages))
    open_ends = pages.filter("_open").select("_key", "_line")
    texts = pages.agg(F.count("*").alias("_texts"))

    # How the last unit reads, under each decoding, with and without a mark.
    read = open_ends.select("_key", F.posexplode(_as_decoded("_line")).alias("_way", "_line"))
    read = read.select("_key", "_way", "_line", F.substring_index(_parted(F.col("_line")), BETWEEN, -1).alias("_unit"))
    read = read.select("*", _skeleton(_masked(F.col("_unit"))).alias("_skeleton"), _closer(F.col("_unit")).alias("_closer"))
    read = read.withColumn("_pair", _pair(F.col("_skeleton"), F.col("_closer")))
    # Codes and signs are no running text.
    wordless = ~F.col("_unit").rlike(r"(?<![\p{L}\p{N}])[\p{L}\p{M}]+(?![\p{L}\p{N}])") & ~F.col("_unit").rlike(r"[«“„¿¡(\[「]\s*\x03?$")
    ends = wordless | _ends_sentence(F.col("_unit")) & ~F.rtrim("_unit", F.lit(LAST)).rlike(ABBREVIATED)
    lossy = F.col("_line").contains("�") | F.col("_line").contains("?")
    latin = ~F.col("_line").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsCyrillic}]{2}")
    # A unit on a line of its own may be like a heading or like a sentence, others only like a sentence.
    alone = F.col("_unit").startswith(LINE_START)
    forms = read.select(
        "_key",
        "_way",
        ends.alias("_ends"),
        ((F.col("_closer").rlike(r"^\p{Lu}") & F.col("_skeleton").contains(" ")) | F.col("_closer").rlike(_CJK)).alias("_named"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(place * 10 + kind).alias("_kind"), F.when(F.lit(place == 0) | alone, _key(kind, _in_place(F.col(form), F.lit(place == 1)))).alias("form"))
                    for kind, form in ((1, "_skeleton"), (2, "_closer"), (4, "_pair"))
                    for place in (0, 1)
                ],
                F.struct(F.lit(5).alias("_kind"), _key(5, _footer(F.col("_line"))).alias("form")),
                F.struct(F.lit(3).alias("_kind"), F.when(lossy | latin, _key(3, _wildcard(F.col("_line")))).alias("form")),
            )
        ).alias("_x"),
    ).select("_key", "_way", "_ends", "_named", "_x.*")
    known = forms.join(seen, "form", "left")
    times = lambda kind: F.max(F.when(F.col("_kind") == kind, F.coalesce("seen", F.lit(0))))
    ways = known.groupBy("_key", "_way").agg(F.max("_ends").alias("_ends"), F.max("_named").alias("_named"), *[times(k).alias(f"_n{k}") for k in (1, 2, 3, 4, 5, 11, 12, 14)])
    ways = ways.crossJoin(texts)
    often = F.greatest(F.lit(LEAST_SEEN), SEEN_RATE * F.col("_texts"))
    # It must have ended so before, word for word at its close, unless it closes with a name or is not parted in words.
    paired = lambda place: (F.col(f"_n{place}4") >= 1) & (F.col(f"_n{place}4") >= PAIR_SHARE * F.col(f"_n{place}1"))
    seen_so = lambda place: paired(place) | (F.col("_named") & (F.col(f"_n{place}1") >= often) & (F.col(f"_n{place}2") >= often / 2))
    known_line = seen_so("1") | (F.col("_n3") >= often) | (F.col("_n5") > 0)
    whole = F.col("_ends") | seen_so("") | known_line
    scored = ways.groupBy("_key").agg((~F.max(whole)).alias("_open"), F.max(known_line).alias("_line_known"))

    # Near copies of texts with an open end: the others that hold their shingles.
    pairs = checkpointed(_near_pairs(docs.select(digest.alias("_class"), _open_end(line).alias("_open"), "_text")))
    needed = pairs.select("_class").union(pairs.select("_partner")).distinct()
    bodies = docs.select(digest.alias("_class"), "_text").join(needed, "_class", "left_semi").groupBy("_class").agg(F.first("_text").alias("_text"))
    others = bodies.select(F.col("_class").alias("_partner"), F.col("_text").alias("_other"))
    aligned = pairs.join(bodies, "_class").join(others, "_partner").select("_class", "_text", "_other").mapInPandas(_align, "_class long, _verdict string")
    found = aligned.filter(F.col("_verdict").isNotNull()).groupBy("_class").agg(F.max(F.col("_verdict") == "cut").alias("_cut"), F.max(F.col("_verdict") == "whole").alias("_whole"))
    verdicts = pages.select("_key", "_class").join(found, "_class").groupBy("_key").agg(F.max("_cut").alias("_cut"), F.max("_whole").alias("_whole"))
    judged = scored.join(verdicts, "_key", "left")
    by_copy = F.coalesce("_cut", F.lit(False)) & ~F.col("_line_known")
    return judged.filter(by_copy | (F.col("_open") & ~F.coalesce("_whole", F.lit(False)))).select(
        F.col("_key").alias(key), F.when(by_copy, "copy").otherwise("ending").alias("evidence")
    )
