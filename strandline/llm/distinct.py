"""Exact distinct counts from compressed bitmaps that can be merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import checkpointed

#: Identifiers of one container: the width of Spark's bitmap functions.
BITS = 32_768
#: Kinds of containers, in the first byte: sorted offsets, runs (start, length less one), bits.
ARRAY, RUNS, PLAIN = b"\x00", b"\x01", b"\x02"


def pack(bitmap: bytes) -> bytes:
    """The smallest of the three containers of a bitmap."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
    at = np.flatnonzero(bits).astype(np.uint16)
    edges = np.flatnonzero(np.diff(bits.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if 4 * len(starts) < min(2 * len(at), BITS // 8):
        return RUNS + np.stack([starts, ends - starts - 1], 1).astype("<u2").tobytes()
    return ARRAY + at.astype("<u2").tobytes() if 2 * len(at) < BITS // 8 else PLAIN + bitmap


def unpack(container: bytes) -> bytes:
    """The bitmap of a container."""
    if container[:1] == PLAIN:
        return container[1:]
    numbers = np.frombuffer(container, "<u2", offset=1).astype(np.int64)
    bits = np.zeros(BITS + 1, np.int32)
    if container[:1] == ARRAY:
        bits[numbers] = 1
    else:
        bits[numbers[::2]] += 1
        bits[numbers[::2] + numbers[1::2] + 1] -= 1
        bits = np.cumsum(bits)
    return np.packbits(bits[:BITS].astype(np.uint8), bitorder="little").tobytes()


def members(container: bytes) -> int:
    """How many identifiers a container holds."""
    if container[:1] == PLAIN:
        return int(np.bitwise_count(np.frombuffer(container, np.uint8, offset=1)).sum())
    numbers = np.frombuffer(container, "<u2", offset=1)
    return len(numbers) if container[:1] == ARRAY else int(numbers[1::2].sum(dtype=np.int64)) + len(numbers) // 2


@F.pandas_udf(T.BinaryType())
def _packed(bitmap: pd.Series) -> pd.Series:
    return bitmap.map(pack)


@F.pandas_udf(T.BinaryType())
def _unpacked(container: pd.Series) -> pd.Series:
    return container.map(unpack)


@F.pandas_udf(T.LongType())
def _members(container: pd.Series) -> pd.Series:
    return container.map(members)


def encode_ids(df: DataFrame, ids: list[str], dims: list[str], *, shards: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Each identifier once, with its code and the combinations of ``dims`` it was seen with.

    Columns: ids, ``shard``, ``code`` (dense from 0 within its shard), ``_seen``.
    Identifiers with a null part are left out. One shuffle by identifier, counted
    together on the map side; a shard is what one task of it numbers. With
    ``existing`` (ids, shard, code), known identifiers keep their codes and new ones
    are numbered in new shards, so that bitmaps of earlier loads stay mergeable.
    The result is written to the shared folder: ids, shard and code of it are the
    dictionary to keep for later loads.
    """
    seen = df.select(*ids, F.struct(F.lit(0).alias("_0"), *dims).alias("_d")).dropna(subset=ids)
    grouped = seen.groupBy(*ids).agg(F.collect_set("_d").alias("_seen"))
    if shards:
        grouped = grouped.repartition(shards, *ids)
    numbered = lambda rows, first: rows.withColumn("_m", F.monotonically_increasing_id()).select(
        *ids, (F.shiftright("_m", 33) + first).alias("shard"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("code"), "_seen"
    )
    if existing is None:
        return checkpointed(numbered(grouped, F.lit(0)))
    known = grouped.join(existing.select(*ids, F.lit(True).alias("_known"), "shard", "code"), ids, "left")
    first = existing.agg(F.max("shard")).first()[0]
    added = numbered(known.filter(F.col("_known").isNull()).select(*ids, "_seen"), F.lit((-1 if first is None else first) + 1))
    return checkpointed(known.filter("_known").select(*ids, "shard", "code", "_seen").unionByName(added))


def build_dictionary(df: DataFrame, ids: list[str], *, shards: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Dense codes for identifiers: ids, ``shard``, ``code``; those of ``existing`` first."""
    coded = encode_ids(df, ids, [], shards=shards, existing=existing).select(*ids, "shard", "code")
    if existing is None:
        return coded
    return existing.select(*ids, "shard", "code").unionByName(coded.join(existing.select(*ids), ids, "left_anti"))


def bitmaps_of(coded: DataFrame, dims: list[str]) -> DataFrame:
    """Compressed bitmaps of the result of :func:`encode_ids`: dims, ``shard``, ``bucket``, ``bitmap``.

    As a shard's codes lie together, so do the bits of a bucket: they are put
    together on the map side and only bitmaps are shuffled.
    """
    rows = coded.select("shard", "code", F.explode("_seen").alias("_d")).select(*[F.col(f"_d.{c}").alias(c) for c in dims], "shard", (F.shiftright("code", 15)).cast("int").alias("bucket"), F.col("code").bitwiseAND(BITS - 1).alias("_bit"))
    built = rows.groupBy(*dims, "shard", "bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    return built.select(*dims, "shard", "bucket", _packed("_bits").alias("bitmap"))


def id_bitmaps(df: DataFrame, *, ids: list[str], dims: list[str], shards: int | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Compressed bitmaps of the identifiers seen with each combination of ``dims``.

    Identifiers are dictionary-encoded to dense integers (those of ``dictionary``
    keep their codes); each run of 32 768 codes of a shard is one bucket and each
    (dims, shard, bucket) one container, which is sorted offsets, runs or plain
    bits, whichever is smallest. Columns: dims, ``shard``, ``bucket``, ``bitmap``.

    Rows with a null in an identifier are left out; nulls in a dimension form a
    group of their own; repeats change nothing; an empty table gives no rows; other
    columns are ignored.
    """
    return bitmaps_of(encode_ids(df, ids, dims, shards=shards, existing=dictionary), dims)


def merge_bitmaps(bitmaps: DataFrame, dims: list[str]) -> DataFrame:
    """Bitmaps over fewer dimensions, or of several loads together (OR)."""
    plain = bitmaps.select(*dims, "shard", "bucket", _unpacked("bitmap").alias("_bits"))
    merged = plain.groupBy(*dims, "shard", "bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return merged.select(*dims, "shard", "bucket", _packed("_bits").alias("bitmap"))


def shared_bitmaps(bitmaps: DataFrame, dims: list[str], *, of: int) -> DataFrame:
    """What all ``of`` members of each group have in common (AND)."""
    plain = bitmaps.select(*dims, "shard", "bucket", _unpacked("bitmap").alias("_bits"))
    common = plain.groupBy(*dims, "shard", "bucket").agg(F.bitmap_and_agg("_bits").alias("_bits"), F.count("*").alias("_n")).filter(F.col("_n") == of)
    return common.select(*dims, "shard", "bucket", _packed("_bits").alias("bitmap"))


def count_bitmaps(bitmaps: DataFrame, dims: list[str], name: str = "n_distinct") -> DataFrame:
    """The exact number of identifiers of each group (error zero)."""
    return bitmaps.groupBy(*dims).agg(F.sum(_members("bitmap")).alias(name))
