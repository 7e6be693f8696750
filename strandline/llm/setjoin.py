"""All pairs of set-valued records that overlap above a threshold: a sorted sketch forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpointed, shuffle_partitions

#: Chance at which a pair right at the threshold may be missed by the forest.
MISS = 1e-5
#: Depth at which a neighbourhood is expected to be small; trees are counted in it.
DEPTH = 2
#: What a row costs in one tree, in comparisons of two rows.
ROW_COST = 32
#: Rows of a neighbourhood beyond which its comparisons are dealt over several tasks.
SPREAD = 4096
#: Similarity of unrelated sets that a prefix of all levels is meant to tell apart.
BACKGROUND = 0.05
_SEPARATOR = "\u0001"
#: Unicode's white space (fixed values).
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def credit(threshold: float, depth: int) -> float:
    """What one tree compared at ``depth`` adds to -ln(chance of a miss) of a pair at the threshold."""
    return -math.log1p(-min(threshold, 1 - 1e-9) ** depth)


def trees_needed(threshold: float, depth: int, miss: float = MISS) -> int:
    """Trees after which a pair at the threshold has shared a prefix, but for ``miss``.

    Two signatures share a prefix of ``depth`` in one tree with probability
    similarity ** depth.
    """
    return max(1, math.ceil(-math.log(miss) / credit(threshold, depth)))


def canonical_items(items: Column | str) -> Column:
    """Items trimmed of white space and in upper case, each once, sorted; without null and empty ones."""
    clean = F.transform(F.col(items) if isinstance(items, str) else items, lambda x: F.upper(F.btrim(x, F.lit(_BLANKS))))
    return F.sort_array(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def _canonical(df: DataFrame, key: str, items: Column | str, own: Column | None) -> DataFrame:
    """Each row's items as one text, and its digest; written, so that they are worked out once."""
    rows = df.select(F.col(key).alias("_key"), F.array_join(canonical_items(items), _SEPARATOR).alias("_text"), (F.lit(True) if own is None else own).alias("_own"))
    written = checkpointed(rows.withColumn("_digest", F.unhex(F.md5("_text"))))
    return written.filter(F.col("_key").isNotNull() & (F.col("_text") != ""))


def set_classes(df: DataFrame, *, key: str, items: Column | str, own: Column | None = None) -> DataFrame:
    """Membership: ``_key``, ``_class`` (the least key with the same items), ``_own``, ``_digest``.

    Records without items are in no class. A key delivered twice counts once (with
    different items, by those of the least digest).
    """
    members = _canonical(df, key, items, own).groupBy("_key").agg(F.min("_digest").alias("_digest"), F.max("_own").alias("_own"))
    named = members.groupBy("_digest").agg(F.min("_key").alias("_class"))
    return members.join(named, "_digest").select("_key", "_class", "_own", "_digest")


def class_table(df: DataFrame, *, key: str, items: Column | str, own: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (``_key``, ``_own``, ``_id``) and classes (``_id``, ``_text``, ``_own``, ``_all``,
    ``_n_own``): equal sets are one class, numbered, written once with its items."""
    rows = _canonical(df, key, items, own)
    members = checkpointed(rows.groupBy("_key").agg(F.min("_digest").alias("_digest"), F.max("_own").alias("_own")))
    counted = members.groupBy("_digest").agg(F.max("_own").alias("_own"), F.count("*").alias("_all"), F.count(F.when(F.col("_own"), 1)).alias("_n_own"))
    texts = rows.groupBy("_digest").agg(F.first("_text").alias("_text"))
    classes = checkpointed(counted.join(texts, "_digest").withColumn("_id", F.monotonically_increasing_id()))
    members = members.join(classes.select("_digest", "_id"), "_digest").select("_key", "_own", "_id")
    return members, classes.drop("_digest")


def _forest(first: int, trees: int, levels: int, seed: int):
    """Rows (id, tree, key, size, own, bits): a row's sorting key in each tree is its
    minhash signature, ``levels`` values of 64 / levels bits, the first one on top.
    ``bits`` has one bit of 64 set for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, down, width = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), 64 // levels
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (flat >> np.uint64(7) & np.uint64(63)), starts).view(np.int64)
            for tree in range(first, first + trees):
                seeds = np.random.default_rng([seed, tree]).integers(1, 2**63, size=levels, dtype=np.uint64) | np.uint64(1)
                key = np.zeros(len(sizes), np.uint64)
                for level in range(levels):
                    h = (flat ^ seeds[level]) * mix
                    h ^= h >> down
                    h *= seeds[level]
                    least = np.minimum.reduceat(h ^ (h >> down), starts) * mix
                    key |= least >> np.uint64(64 - width) << np.uint64(64 - width * (level + 1))
                arrays = [batch.column(0), pa.array(np.full(len(sizes), tree, np.int32)), pa.array(key.view(np.int64)), pa.array(sizes.astype(np.int32)), batch.column(1), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "tree", "key", "size", "own", "bits"])

    return run


def _neighbourhoods(parts: int, levels: int, threshold: float, spread: int):
    """Of a sorted range of the forest, the pairs of rows that share a prefix.

    Each row looks at the run of rows around it that share its prefix, at the depth
    where a comparison yields most recall: deeper runs are shorter but count for
    less. Runs that may go on beyond the range are not used. Result: pairs (``a`` <
    ``b``) that sizes and bits allow; for each row, with ``b`` -1, the recall
    ``lost`` against a tree at DEPTH; rows of very long runs, with ``b`` -2 (those
    that look at the run) and -3 (all of it), the run ``run`` and its ``n`` rows.
    """
    width, base = 64 // levels, credit(threshold, DEPTH)
    names = ["a", "b", "lost", "run", "n", "size", "own", "bits"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
    slack = (1 - threshold) / (1 + threshold) + 1e-9

    def made(a: np.ndarray, b, **more) -> pa.RecordBatch:
        columns = {"a": a, "b": np.broadcast_to(np.asarray(b, np.int64), len(a)), **more}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(len(a), k) for c, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, tree, key, size, own, bits = (c.to_numpy() for c in table.columns)
        key, bits, n, number = key.view(np.uint64), bits.view(np.uint64), len(ids), TaskContext.get().partitionId()
        low, high, gained, best = np.arange(n), np.arange(n), np.zeros(n), np.full(n, np.inf)
        depth = np.zeros(n, np.int64)
        for d in range(1, levels + 1):
            prefix = key >> np.uint64(64 - width * d)
            edge = np.concatenate(([True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])))
            begins = np.flatnonzero(edge)
            which = np.cumsum(edge) - 1
            begin, end = begins[which], np.append(begins[1:], n)[which]
            # Equal keys are never parted by the range, so runs at full depth are whole.
            whole = ((begin > 0) | (number == 0)) & ((end < n) | (number == parts - 1)) | (d == levels)
            cost = np.where(whole, (ROW_COST + end - begin) / credit(threshold, d), np.inf)
            take = cost < best
            low, high, best, depth = np.where(take, begin, low), np.where(take, end, high), np.where(take, cost, best), np.where(take, d, depth)
            gained = np.where(take, credit(threshold, d), gained)
        lost = base - gained
        some = lost > 1e-9
        if some.any():
            yield made(ids[some], -1, lost=lost[some])
        wide = high - low > spread
        if wide.any():
            label = (low.astype(np.int64) << 4 | depth) ^ (np.int64(number) << 40)
            yield made(ids[wide], -2, run=label[wide], n=(high - low)[wide], size=size[wide], own=own[wide], bits=bits[wide].view(np.int64))
            for at in np.unique(np.flatnonzero(wide)[np.unique(label[wide], return_index=True)[1]]):
                of = slice(low[at], high[at])
                yield made(ids[of], -3, run=np.full(high[at] - low[at], label[at]), n=np.full(high[at] - low[at], high[at] - low[at]), size=size[of], own=own[of], bits=bits[of].view(np.int64))
        count = np.where(wide, 0, high - low)
        upto = np.cumsum(count)
        at = 0
        while at < n:
            # Rows up to about a million comparisons at a time.
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), side="right")))
            part = count[at:to]
            left = np.repeat(np.arange(at, to), part)
            right = np.arange(len(left)) - np.repeat(np.cumsum(part) - part - low[at:to], part)
            keep = (right > left) | ((right < left) & ~((low[right] <= left) & (left < high[right]) & ~wide[right]))
            left, right = left[keep], right[keep]
            x, y = size[left], size[right]
            keep = (x >= threshold * y - 1e-9) & (y >= threshold * x - 1e-9) & (own[left] | own[right])
            left, right = left[keep], right[keep]
            keep = np.bitwise_count(bits[left] ^ bits[right]) <= (size[left] + size[right]) * slack
            a, b = ids[left[keep]], ids[right[keep]]
            if len(a):
                yield made(np.minimum(a, b), np.maximum(a, b))
            at = to

    return run


def _runs_apart(out: DataFrame, threshold: float, spread: int) -> DataFrame:
    """The pairs of very long runs: each is dealt over as many tasks as its length asks for."""
    parts = F.ceil(F.col("n") / spread).cast("int")
    slack = (1 - threshold) / (1 + threshold) + 1e-9
    left = out.filter("b = -2").select("run", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}1") for c in ("a", "size", "own", "bits")])
    right = out.filter("b = -3").select("run", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"), *[F.col(c).alias(f"{c}2") for c in ("a", "size", "own", "bits")])
    fits = (F.col("size1") >= threshold * F.col("size2") - 1e-9) & (F.col("size2") >= threshold * F.col("size1") - 1e-9) & (F.col("own1") | F.col("own2"))
    near = F.bit_count(F.col("bits1").bitwiseXOR(F.col("bits2"))) <= (F.col("size1") + F.col("size2")) * slack
    return left.join(right, ["run", "part"]).filter((F.col("a1") != F.col("a2")) & fits & near).select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"))


def similar_classes(classes: DataFrame, *, threshold: float, miss: float = MISS, seed: int = 7, spread: int = SPREAD) -> DataFrame:
    """Pairs of different classes with Jaccard similarity of at least ``threshold``.

    Of the second result of :func:`class_table`. A sorted sketch forest: in each of
    many independent trees, classes are range-sorted by their minhash signature,
    and every class is compared with the neighbourhood that shares its prefix. How
    deep that prefix is depends on how crowded the place is, class by class; a
    class goes on into further trees until what its neighbourhoods were worth adds
    up to the target recall, a chance of ``miss`` for a pair right at the threshold.
    So a hot prefix makes its classes deepen and take more trees, no more than that.
    A neighbourhood of more than ``spread`` classes is dealt over several tasks.

    Of the pairs that meet, those are verified on the items themselves that sizes
    and a bitmap of the items allow (neither refuses a similar pair). Pairs of two
    classes without an own member are left out. Result: ``a`` < ``b``, ``similarity``.
    """
    base, target = credit(threshold, DEPTH), -math.log(miss)
    number = classes.count()
    levels = min(8, max(4, math.ceil(math.log(max(number, 2)) / -math.log(BACKGROUND))))
    sketched = classes.select("_id", "_own", F.transform(F.split("_text", _SEPARATOR), lambda x: F.xxhash64(x)).alias("_ids"))
    waiting, first, trees, pairs = None, 0, trees_needed(threshold, DEPTH, miss) + 2, None
    while number:
        rows = sketched if waiting is None else sketched.join(waiting.select("_id"), "_id", "left_semi")
        forest = rows.mapInArrow(_forest(first, trees, levels, seed), "id long, tree int, key long, size int, own boolean, bits long")
        parts = max(1, number * trees // 1_000_000, min(shuffle_partitions(classes.sparkSession), number * trees // 40_000))
        ordered = forest.repartitionByRange(parts, "tree", "key").sortWithinPartitions("tree", "key")
        out = checkpointed(ordered.mapInArrow(_neighbourhoods(parts, levels, threshold, spread), "a long, b long, lost double, run long, n int, size int, own boolean, bits long"))
        met = out.filter("b >= 0").select("a", "b").union(_runs_apart(out, threshold, spread))
        pairs = met if pairs is None else pairs.union(met)
        lost = out.filter("b = -1").groupBy(F.col("a").alias("_id")).agg(F.sum("lost").alias("_lost"))
        if waiting is None:
            open_ = lost.withColumn("_need", F.lit(target - trees * base) + F.col("_lost"))
        else:
            open_ = waiting.select("_id", "_need").join(lost, "_id", "left").withColumn("_lost", F.coalesce("_lost", F.lit(0.0))).withColumn("_need", F.col("_need") - trees * base + F.col("_lost"))
        waiting = checkpointed(open_.filter(F.col("_need") > 1e-9))
        number, most, mean = waiting.agg(F.count("*"), F.max("_need"), F.avg("_lost")).first()
        first += trees
        if number:
            each = max(base - mean / trees, credit(threshold, levels))
            trees = min(64, max(4, math.ceil(most / each)))
    if pairs is None:
        return classes.select(F.col("_id").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("similarity")).limit(0)
    items = lambda name, text: classes.select(F.col("_id").alias(name), F.col("_text").alias(text))
    x, y = F.split("_x", _SEPARATOR), F.split("_y", _SEPARATOR)
    shared = F.size(F.array_intersect(x, y))
    verified = pairs.distinct().join(items("a", "_x"), "a").join(items("b", "_y"), "b").select("a", "b", shared.alias("_n"), (F.size(x) + F.size(y) - shared).alias("_of"))
    return verified.filter(F.col("_n") >= threshold * F.col("_of")).select("a", "b", (F.col("_n") / F.col("_of")).alias("similarity"))


def similar_sets(df: DataFrame, *, key: str, items: Column | str, threshold: float, own: Column | None = None, **forest: float) -> DataFrame:
    """All pairs of keys whose sets are similar: ``key_a`` < ``key_b``, ``similarity``.

    Pairs of two records that are not ``own`` are left out (all are own unless
    said otherwise). Sets compare trimmed, in upper case, each item once; null and
    empty items do not count; records with a null key or no items have no pairs;
    an empty table gives none. Members of one class are pairs of similarity 1.
    """
    members, classes = class_table(df, key=key, items=items, own=own)
    between = similar_classes(classes, threshold=threshold, **forest)
    within = classes.filter("_all > 1").select(F.col("_id").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("similarity"))
    a = members.select(F.col("_id").alias("a"), F.col("_key").alias("_a"), F.col("_own").alias("_own_a"))
    b = members.select(F.col("_id").alias("b"), F.col("_key").alias("_b"), F.col("_own").alias("_own_b"))
    pairs = between.unionByName(within).join(a, "a").join(b, "b")
    return pairs.filter(((F.col("a") != F.col("b")) | (F.col("_a") < F.col("_b"))) & (F.col("_own_a") | F.col("_own_b"))).select(
        F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"), "similarity"
    )


def set_links(df: DataFrame, *, key: str, items: Column | str, threshold: float, own: Column | None = None, **forest: float) -> DataFrame:
    """How many similar sets each key has: ``key``, ``n_links``, ``nearest`` (the highest
    similarity). As :func:`similar_sets`, but counted from the sizes of the classes:
    no copy is paired with another. Keys without a similar set give no row."""
    members, classes = class_table(df, key=key, items=items, own=own)
    between = similar_classes(classes, threshold=threshold, **forest)
    both = between.select(F.explode(F.array(F.struct(F.col("a").alias("_id"), F.col("b").alias("_to")), F.struct(F.col("b").alias("_id"), F.col("a").alias("_to")))).alias("_x"), "similarity").select("_x.*", "similarity")
    sizes = classes.select(F.col("_id").alias("_to"), "_all", "_n_own")
    around = both.join(sizes, "_to").groupBy("_id").agg(
        F.sum("_all").alias("_to_all"), F.sum("_n_own").alias("_to_own"), F.max("similarity").alias("_near_all"), F.max(F.when(F.col("_n_own") > 0, F.col("similarity"))).alias("_near_own")
    )
    rows = members.join(classes.select("_id", "_all", "_n_own"), "_id").join(around, "_id", "left")
    inside = F.when(F.col("_own"), F.col("_all") - 1).otherwise(F.col("_n_own"))
    outside = F.coalesce(F.when(F.col("_own"), F.col("_to_all")).otherwise(F.col("_to_own")), F.lit(0))
    near = F.when(inside > 0, 1.0).otherwise(F.when(F.col("_own"), F.col("_near_all")).otherwise(F.col("_near_own")))
    return rows.select(F.col("_key").alias(key), (inside + outside).alias("n_links"), near.alias("nearest")).filter("n_links > 0")
