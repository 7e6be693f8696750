"""Token ids of a whole corpus by a public byte-level BPE tokenizer.

Texts are cut at content-defined points, each distinct chunk is encoded once, the
chunks' ids are put together again per document, and what lies around each join is
encoded again until it agrees with the encoding of the whole text.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpoint_dir

#: Folder of the tokenizer files, unless the caller names another.
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokenisation of the byte-level vocabulary (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Width of the rolling hash in bytes, and the bits of it that must be zero at a
#: cut: one in 256 bytes on average.
WINDOW_DOUBLINGS = 4
CUT_MASK = np.uint32((1 << 8) - 1)
#: Chunks or joins that a task remembers, so as not to send or encode them twice.
REMEMBERED = 100_000

_loaded: dict[str, tiktoken.Encoding] = {}
_pieces: dict[str, list[bytes]] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once a Python worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token, listed once a Python worker."""
    if path not in _pieces:
        coder = encoder(path)
        _pieces[path] = [coder.decode_single_token_bytes(t) for t in range(coder.n_vocab)]
    return _pieces[path]


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the bytes up to it, 2 ** WINDOW_DOUBLINGS of them."""
    table = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
    h = table[data]
    for i in range(WINDOW_DOUBLINGS):
        w = 1 << i
        more = h.copy()
        more[w:] += h[:-w] * np.uint32(pow(0x01000193, w, 2**32)) if len(h) > w else np.uint32(0)
        h = more
    return h ^ (h >> np.uint32(15))


def _agreed(data: np.ndarray) -> np.ndarray:
    """Where encoding apart is sure to agree with encoding together: offsets of a
    space or line feed behind a character that is no white space, and of an
    ideographic comma or full stop behind a Han character or Hiragana letter.

    The pre-tokeniser never lets a piece reach from a non-blank over a blank, nor
    from a letter over a mark, and looks ahead from blanks only; so both sides have
    the same pieces apart as together. Multi-byte characters count if their lead
    byte begins none of Unicode's white space characters.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    blank = (data == 0x20) | (data == 0x0A)
    before = np.zeros(len(data), bool)
    before[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    # Two bytes with a lead of C3..DF, three with E4..ED, four with F0..F4.
    for back, low, high in ((2, 0xC3, 0xDF), (3, 0xE4, 0xED), (4, 0xF0, 0xF4)):
        if len(data) > back:
            lead, tail = data[:-back], data[back - 1 : -1]
            before[back:] |= (lead >= low) & (lead <= high) & (tail >= 0x80) & (tail < 0xC0)
    found = blank & before
    if len(data) > 5:
        x, y, z, mark = data[:-5], data[1:-4], data[2:-3], (data[3:-2] == 0xE3) & (data[4:-1] == 0x80) & ((data[5:] == 0x81) | (data[5:] == 0x82))
        letter = ((x >= 0xE5) & (x <= 0xE9)) | ((x == 0xE3) & (y == 0x81) & (z > 0x80))
        found[3:-2] |= mark & letter
    return np.flatnonzero(found)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk ends within the texts that ``offsets`` part, texts' own ends included.

    The rolling hash names the places, moved to the next character where they fall
    inside one.
    """
    hits = np.flatnonzero((_rolling(data) & CUT_MASK) == 0) + 1
    hits = hits[hits < len(data)]
    for _ in range(3):
        hits = hits + (data[np.minimum(hits, len(data) - 1)] & 0xC0 == 0x80)
    return np.unique(np.concatenate((hits[hits < len(data)], offsets[1:])))


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the texts' offsets in them."""
    texts = texts.cast(pa.large_string())
    if texts.offset or texts.null_count:
        texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.null_count else pa.concat_arrays([texts])
    if texts.offset:
        texts = pa.array(texts.to_pylist(), pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1)
    return np.frombuffer(data, np.uint8, int(at[-1])) if data is not None else np.zeros(0, np.uint8), at


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) rows to (key, no, digest, chunk) rows, one for an empty text with no -1.

    A chunk that the task has sent before comes without its text."""
    known: set[bytes] = set()
    names = ["_key", "_no", "_digest", "_chunk"]
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _text_bytes(batch.column(1))
        blank = np.flatnonzero(np.diff(offsets) == 0)
        if len(blank):
            nothing = [pa.nulls(len(blank), pa.binary()), pa.nulls(len(blank), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(blank)), pa.array(np.full(len(blank), -1, np.int32)), *nothing], names=names)
        if not len(data):
            continue
        ends = cut_points(data, offsets)
        ends = ends[ends > 0]
        starts = np.concatenate(([0], ends[:-1]))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(owner, owner)
        raw = data.tobytes()
        digests, chunks = [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            piece = raw[a:b]
            digest = xxhash.xxh3_128_digest(piece)
            digests.append(digest)
            chunks.append(None if digest in known else piece)
            known.add(digest)
        if len(known) > REMEMBERED:
            known.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=names)


def _width(path: str) -> str:
    """Ids of a small vocabulary travel as two bytes each."""
    return "<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4"


def _encode_batches(path: str):
    """(digest, chunk) rows to (digest, ids, head, tail): the ids, and how many of them
    lie before the first and after the last place of agreement (-1 without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, width = encoder(path), _width(path)
        lengths = np.array([len(b) for b in token_bytes(path)], np.int64)
        for batch in batches:
            chunks = batch.column(1).to_pylist()
            raw = b"".join(chunks)
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in chunks]))).astype(np.int64)
            # Places of agreement inside the chunks, which begin and end with whole characters.
            safe = _agreed(np.frombuffer(raw, np.uint8))
            of = np.searchsorted(bounds, safe, side="right") - 1
            safe, of = safe[safe > bounds[of]], of[safe > bounds[of]]
            first, last = np.searchsorted(of, np.arange(len(chunks))), np.searchsorted(of, np.arange(len(chunks)), side="right") - 1
            codes, heads, tails = [], [], []
            for i, chunk in enumerate(chunks):
                ids = np.array(coder.encode_ordinary(chunk.decode()), np.int64)
                codes.append(ids.astype(width).tobytes())
                if first[i] <= last[i]:
                    a, b = np.searchsorted(np.cumsum(lengths[ids]), (safe[first[i]] - bounds[i], safe[last[i]] - bounds[i]))
                    heads.append(int(a) + 1)
                    tails.append(len(ids) - int(b) - 1)
                else:
                    heads.append(-1)
                    tails.append(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(heads, pa.int32()), pa.array(tails, pa.int32())], names=["_digest", "_ids", "_head", "_tail"])

    return run


class Joiner:
    """Puts the ids of a text's chunks together.

    At a join, the ids from the last place of agreement before it to the first
    behind it, over as many chunks as that takes, are those of the text in between,
    encoded again: both ends of it are places where encoding apart and together
    agree, so the whole does. Joins met before are remembered.
    """

    def __init__(self, path: str) -> None:
        self.coder, self.width = encoder(path), _width(path)
        self.bytes = token_bytes(path)
        self.known: dict[bytes, np.ndarray] = {}

    def again(self, parts: list[np.ndarray]) -> np.ndarray:
        ids = np.concatenate(parts)
        key = ids.tobytes()
        if key not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            text = b"".join([self.bytes[i] for i in ids.tolist()]).decode()
            self.known[key] = np.array(self.coder.encode_ordinary(text), self.width)
        return self.known[key]

    def join(self, chunks: list[tuple[bytes, int, int]]) -> np.ndarray:
        out: list[np.ndarray] = []
        open_: list[np.ndarray] = []
        for code, head, tail in chunks:
            ids = np.frombuffer(code, self.width)
            if head < 0:
                open_.append(ids)
                continue
            open_.append(ids[:head])
            out.append(self.again(open_) if len(open_) > 1 else open_[0])
            out.append(ids[head : len(ids) - tail])
            open_ = [ids[len(ids) - tail :]]
        out.append(self.again(open_) if len(open_) > 1 else open_[0])
        return np.concatenate(out)


def _join_batches(path: str, ids: bool):
    """(key, chunks in order) rows to (key, ids) or (key, number of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(path)
        for batch in batches:
            parts = batch.column(1)
            fields = parts.flatten()
            codes, heads, tails = (fields.field(i).to_pylist() for i in (1, 2, 3))
            at = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
            rows = list(zip(codes, heads, tails))
            joined = [joiner.join(rows[a:b]) for a, b in zip(at, at[1:])]
            sizes = np.array([len(x) for x in joined], np.int64)
            if ids:
                flat = np.concatenate(joined) if joined else np.zeros(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.astype(np.int32)))
            else:
                column = pa.array(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["_key", "ids" if ids else "n_tokens"])

    return run


def _joined(df: DataFrame, key: str, text: str, path: str, ids: bool) -> tuple[DataFrame, DataFrame]:
    """What all texts come to, by ``_key``, and the keys of those without one."""
    spark = df.sparkSession
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    # The texts are read once; what they are cut into is a table of the shared folder.
    folder = f"{checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}"
    slim.mapInArrow(_chunk_batches, f"_key {kind}, _no int, _digest binary, _chunk binary").write.option("compression", "zstd").parquet(folder)
    table = spark.read.parquet(folder)
    distinct = table.filter(F.col("_chunk").isNotNull()).groupBy("_digest").agg(F.first("_chunk").alias("_chunk"))
    codes = distinct.mapInArrow(_encode_batches(path), "_digest binary, _ids binary, _head int, _tail int")
    put = table.select("_key", "_no", "_digest").filter("_no >= 0").join(codes, "_digest").groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("_no", "_ids", "_head", "_tail"))).alias("_parts"))
    filled = put.mapInArrow(_join_batches(path, ids), f"_key {kind}, " + ("ids array<int>" if ids else "n_tokens long"))
    return filled, table.filter("_no < 0").select("_key").distinct()


def encode_corpus(df: DataFrame, *, key: str, text: str, tokenizers: str = TOKENIZERS, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens.

    Texts are cut by a rolling hash into chunks that copies and near copies share;
    every distinct chunk (by a 128-bit digest) is encoded once; ids come back to
    the documents in order, and every join is repaired by encoding again what lies
    between the places of agreement around it (see :class:`Joiner`), so the ids are
    exactly those of the whole text. A chunk that very many documents share is sent
    once a task and is one row on the side of the codes; on the side of the
    references it is a hot join key, which adaptive execution splits.

    Null and empty texts have an empty list. Keys must be unique: rows that repeat
    a key are one text given twice and come out once. Strings of special tokens
    are ordinary text. Other columns are ignored. Texts of any length are encoded
    whole; white space alone is text like any other.
    """
    filled, blank = _joined(df, key, text, f"{tokenizers}/{ranks}", True)
    return filled.unionByName(blank.withColumn("ids", F.array().cast("array<int>"))).withColumnRenamed("_key", key)


def token_counts(df: DataFrame, *, key: str, text: str, tokenizers: str = TOKENIZERS, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and ``n_tokens`` of every row with a text, counted from the same ids."""
    filled, _ = _joined(df, key, text, f"{tokenizers}/{ranks}", False)
    return filled.withColumnRenamed("_key", key)
