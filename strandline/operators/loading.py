"""Loading delimited text whose rows may fail to parse.

Good rows come out as records, failing rows apart with the reason. Everything
happens in one pass over the lines, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII numbers (fixed formats): digits only; optional sign, fraction and exponent.
INTEGER = r"^[0-9]+$"
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
#: A line whose quoted fields all end before a tab or the end.
WELL_QUOTED = r'^(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|))*$'
#: Stand-ins for line breaks inside a line while it passes the CSV reader.
_BREAKS = {"\r": "\ue00d", "\n": "\ue00a"}


def _is_integer(x: pa.Array) -> pa.Array:
    return pc.match_substring_regex(x, INTEGER)


def _is_number(x: pa.Array) -> pa.Array:
    return pc.match_substring_regex(x, NUMBER)


def _longs(x: pa.Array, valid: pa.Array) -> np.ndarray:
    """Integers as numbers that compare rightly at any length (0 where not valid)."""
    text = pc.if_else(valid, x, "0")
    if (pc.max(pc.utf8_length(text)).as_py() or 0) <= 18:
        return text.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return np.array([int(t) for t in text.to_pylist()], dtype=object)


def _doubles(x: pa.Array, valid: pa.Array) -> np.ndarray:
    return pc.if_else(valid, x, "0").cast(pa.float64()).to_numpy(zero_copy_only=False)


def _np(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _narrowpeak_cells(c: list[pa.Array]) -> list[np.ndarray]:
    """Per column, which cells fail."""
    ints = {i: _is_integer(c[i]) for i in (1, 2, 4)}
    start, end, score = (_longs(c[i], ints[i]) for i in (1, 2, 4))
    ok = {i: _np(ints[i]) for i in ints}
    ordered = (start < end) | ~ok[1] | ~ok[2]
    offset_int = _is_integer(c[9])
    offset = _longs(c[9], offset_int)
    missing = _np(pc.equal(c[9], "-1"))
    inside = _np(offset_int) & (offset < end - start)
    return [
        _np(pc.equal(c[0], "")),
        ~ok[1] | ~ordered.astype(bool),
        ~ok[2] | ~ordered.astype(bool),
        np.zeros(len(c[0]), bool),
        ~ok[4] | (score > 1000).astype(bool),
        ~_np(pc.is_in(c[5], pa.array(["+", "-", "."]))),
        *[~_np(_is_number(c[i])) for i in (6, 7, 8)],
        ~(missing | inside.astype(bool)),
    ]


def _vcf_cells(c: list[pa.Array]) -> list[np.ndarray]:
    none = np.zeros(len(c[0]), bool)
    pos_int, qual_num = _is_integer(c[1]), _is_number(c[5])
    positive = _np(pos_int) & (_longs(c[1], pos_int) > 0).astype(bool)
    qual = _np(pc.equal(c[5], ".")) | (_np(qual_num) & ~(_doubles(c[5], qual_num) < 0))
    empty = {i: _np(pc.equal(c[i], "")) for i in (0, 3, 4)}
    return [empty[0], ~positive, none, empty[3], empty[4], ~qual, none, none]


def _gmt_cells(c: list[pa.Array]) -> list[np.ndarray]:
    bad = pc.match_substring_regex(c[1], "[\\x00-\\x08\\x0a-\\x1f\\x7f\\x{80}-\\x{9f}\\x{fffd}\\x{e00a}\\x{e00d}]")
    return [_np(pc.equal(c[0], "")), _np(bad)]


@dataclass(frozen=True)
class Layout:
    """One line format: its columns, how many there may be, what is skipped, and its cell tests."""

    columns: tuple[str, ...]
    cells: Callable[[list[pa.Array]], list[np.ndarray]]
    open_ended: bool = False
    skipped: tuple[str, ...] = field(default=("#",))


#: The formats known here (fixed values).
LAYOUTS = {
    "narrowpeak": Layout(
        ("chrom", "start", "end", "name", "score", "strand", "signal", "p_log10", "q_log10", "peak_offset"),
        _narrowpeak_cells,
        skipped=("#", "track", "browser"),
    ),
    "vcf": Layout(("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"), _vcf_cells),
    "gmt": Layout(("set_name", "description", "genes"), _gmt_cells, open_ended=True),
}


def _read_rows(lines: list[str], places: list[int], width: int) -> tuple[pa.Table | None, dict[int, int]]:
    """Lines as ``width`` string columns behind their place; and the column count of those that have another."""
    rejects: dict[int, int] = {}

    def reject(row: csv.InvalidRow) -> str:
        rejects[int(row.text.split("\t", 1)[0])] = row.actual_columns - 1
        return "skip"

    names = ["place", *[f"c{i}" for i in range(width)]]
    body = "\n".join(f"{p}\t{t}" for p, t in zip(places, lines)) + "\n"
    table = csv.read_csv(
        pa.BufferReader(body.encode()),
        read_options=csv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, len(body.encode()) + 1)),
        parse_options=csv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=True, invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(
            column_types={n: pa.int64() if n == "place" else pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False
        ),
    )
    return table, rejects


def _open_ended(lines: list[str], places: list[int], least: int) -> Iterator[tuple[pa.Table, dict[int, int]]]:
    """Reads lines of any width: those refused for their width are read again at it."""
    width, todo = least, dict(zip(places, lines))
    while todo:
        table, rejects = _read_rows(list(todo.values()), list(todo), width)
        yield table, {p: n for p, n in rejects.items() if n < least}
        todo = {p: todo[p] for p, n in rejects.items() if n >= least}
        width = min((rejects[p] for p in todo), default=0)


def _parse(fmt: str, lines: list[str]) -> tuple[list[str | None], list[str | None], list[list[str] | None]]:
    """Reason, failing column and fields of each line of one format."""
    layout, n = LAYOUTS.get(fmt), len(lines)
    reason: list[str | None] = [None] * n
    cell: list[str | None] = [None] * n
    fields: list[list[str] | None] = [None] * n
    if layout is None:
        return ["unknown_format"] * n, cell, fields
    if not n:
        return reason, cell, fields
    texts = pa.array(lines, pa.string())
    quoted = _np(pc.match_substring(texts, '"'))
    well = ~quoted | _np(pc.match_substring_regex(texts, WELL_QUOTED))
    for i in np.flatnonzero(~well):
        reason[i] = "quoting"
    places = np.flatnonzero(well).tolist()
    kept = [lines[i] for i in places]
    broken = {i for i, t in zip(places, kept) if "\r" in t or "\n" in t}
    for a, b in _BREAKS.items():
        kept = [t.replace(a, b) for t in kept] if broken else kept
    least = len(layout.columns)
    parts = _open_ended(kept, places, least) if layout.open_ended else [_read_rows(kept, places, least)] if kept else []
    for table, rejects in parts:
        for p in rejects:
            reason[p] = "column_count"
        at = table.column(0).to_pylist()
        columns = [table.column(i + 1).combine_chunks() for i in range(table.num_columns - 1)]
        if not at:
            continue
        fails = np.stack(layout.cells(columns))
        first = np.where(fails.any(axis=0), fails.argmax(axis=0), -1)
        for p, values, bad in zip(at, zip(*[c.to_pylist() for c in columns]), first.tolist()):
            if p in broken:
                values = [v.replace("\ue00d", "\r").replace("\ue00a", "\n") for v in values]
            if bad >= 0:
                reason[p], cell[p] = "invalid_value", layout.columns[bad]
            else:
                fields[p] = list(values)
    return reason, cell, fields


def parse_lines(df: DataFrame, *, key: str = "line_id", fmt: str = "fmt", text: str = "line_text") -> DataFrame:
    """Every data line, with its fields or with the reason why it fails.

    Lines with a quoting fault are set aside; the others pass pyarrow's CSV reader,
    whose invalid-row callback gives the rows of a wrong width; all fields are read
    as strings, then tested as vectors, and the first failing cell is named.

    A trailing carriage return is no data. Null and blank lines, comments and (in
    narrowPeak) track and browser lines are neither good nor bad and give no row.
    The format name is compared without regard to case; lines of an unknown or
    null format fail with ``unknown_format``. Repeated lines come out each time.
    Result: key, fmt, reason (null for good lines), bad_column, fields (null for
    bad ones). Other columns are ignored, whatever their names.
    """
    slim = df.select(F.col(key).alias("_k"), F.lower(F.coalesce(fmt, F.lit(""))).alias("_f"), F.regexp_replace(text, "\r$", "").alias("_t"))
    lines = slim.filter(F.col("_t").isNotNull() & F.col("_t").rlike(r"\S") & ~F.col("_t").startswith("#"))
    for name, layout in LAYOUTS.items():
        for prefix in layout.skipped[1:]:
            lines = lines.filter(~((F.col("_f") == name) & F.col("_t").startswith(prefix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, formats, texts = (batch.column(i) for i in range(3))
            known = formats.to_pylist()
            for one in dict.fromkeys(known):
                at = [i for i, f in enumerate(known) if f == one]
                reason, cell, fields = _parse(one, texts.take(pa.array(at)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), pa.array([one] * len(at), pa.string()), pa.array(reason, pa.string()), pa.array(cell, pa.string()), pa.array(fields, pa.list_(pa.string()))],
                    names=["_k", "_f", "reason", "bad_column", "fields"],
                )

    kind = df.schema[key].dataType.simpleString()
    return lines.mapInArrow(run, f"_k {kind}, _f string, reason string, bad_column string, fields array<string>").select(
        F.col("_k").alias(key), F.col("_f").alias("fmt"), "reason", "bad_column", "fields"
    )


#: Types of the columns that are not text, per format (fixed values).
_TYPES = {
    "narrowpeak": {"start": "long", "end": "long", "score": "int", "signal": "double", "p_log10": "double", "q_log10": "double", "peak_offset": "long"},
    "vcf": {"pos": "long", "qual": "double"},
    "gmt": {},
}


def good_records(parsed: DataFrame, fmt: str, *, key: str = "line_id") -> DataFrame:
    """The good lines of one format as typed records (a QUAL of ``.`` becomes null)."""
    layout = LAYOUTS[fmt]
    good = parsed.filter((F.col("fmt") == fmt) & F.col("reason").isNull())
    columns = []
    for i, name in enumerate(layout.columns):
        value = F.get("fields", F.lit(i))
        if layout.open_ended and i == len(layout.columns) - 1:
            value = F.slice("fields", i + 1, F.size("fields"))
        elif name in _TYPES[fmt]:
            value = F.expr(f"try_cast(get(fields, {i}) AS {_TYPES[fmt][name]})")
        columns.append(value.alias(name))
    return good.select(key, *columns)


def rejected_lines(parsed: DataFrame, *, key: str = "line_id") -> DataFrame:
    """The failing lines with reason and column."""
    return parsed.filter(F.col("reason").isNotNull()).select(key, "fmt", "reason", "bad_column")
