"""Sparse count matrices in long form: quality, normalisation, variable features, neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.ordering import numbered
from strandline.session import checkpointed

#: Rows of a block of the nearest-neighbour grid.
BLOCK_ROWS = 20_000


def cell_quality(counts: DataFrame, *, cell: str, feature: str, n: str, marked: Column, below: float = 3.0, above: float = 5.0, most_marked: float = 20.0) -> DataFrame:
    """Features, total and marked percentage of each cell, and whether it passes.

    A cell passes with a number of features from ``below`` MADs under the median to
    ``above`` over it, and at most ``most_marked`` per cent of marked counts.
    """
    cells = counts.groupBy(cell).agg(
        F.count_distinct(F.when(F.col(n) > 0, F.col(feature))).alias("n_features"), F.sum(n).alias("total"), F.coalesce(F.sum(F.when(marked, F.col(n))), F.lit(0)).alias("_marked")
    )
    cells = cells.withColumn("marked_pct", F.round(F.coalesce(F.try_divide(F.col("_marked") * 100.0, F.col("total")), F.lit(0.0)), 6)).drop("_marked")
    median = cells.agg(F.expr("percentile(n_features, 0.5)").alias("_median"))
    with_median = cells.crossJoin(median)
    spread = with_median.agg(F.expr("percentile(abs(n_features - _median), 0.5)").alias("_mad"))
    judged = with_median.crossJoin(spread)
    inside = F.col("n_features").between(F.col("_median") - below * F.col("_mad"), F.col("_median") + above * F.col("_mad"))
    return judged.withColumn("passes", inside & (F.col("marked_pct") <= most_marked)).drop("_median", "_mad")


def log_normalised(counts: DataFrame, *, cell: str, n: str, scale: float = 10_000.0) -> DataFrame:
    """Counts per ``scale`` of their cell, as ln(1 + x), in ``value``."""
    total = counts.groupBy(cell).agg(F.sum(n).alias("_total"))
    return counts.join(total, cell).withColumn("value", F.log1p(F.col(n) * scale / F.col("_total"))).drop("_total")


def centred_log_ratio(counts: DataFrame, *, cell: str, n: str, features: int | None = None) -> DataFrame:
    """ln(1 + x) less the cell's mean of it, over its own features or a given number."""
    logs = counts.withColumn("_l", F.log1p(F.col(n).cast("double")))
    mean = logs.groupBy(cell).agg((F.sum("_l") / (F.lit(features) if features else F.count("*"))).alias("_mean"))
    return logs.join(mean, cell).withColumn("value", F.col("_l") - F.col("_mean")).drop("_l", "_mean")


def variable_features(values: DataFrame, *, feature: str, cell: str, value: str, bins: int = 20, clip: float = 10.0) -> DataFrame:
    """Mean, variance (zeros of absent cells included) and dispersion score of features.

    Features are put in ``bins`` bins of log mean; the score is how many standard
    deviations a feature's log variance lies from its bin's mean, cut at ``clip``.
    """
    cells = values.agg(F.count_distinct(cell).alias("_cells"))
    sums = values.groupBy(feature).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")).crossJoin(cells)
    moments = sums.withColumn("mean", F.col("_s") / F.col("_cells")).withColumn("variance", (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_cells")) / (F.col("_cells") - 1))
    logs = moments.filter(F.col("mean") > 0).withColumn("_lm", F.log("mean")).withColumn("_lv", F.log(F.greatest("variance", F.lit(0.0)) + 1e-10))
    span = logs.agg(F.min("_lm").alias("_low"), F.max("_lm").alias("_high"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("_lm") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12)) * bins))
    binned = logs.crossJoin(span).withColumn("bin", place.cast("int"))
    within = binned.groupBy("bin").agg(F.avg("_lv").alias("_m"), F.stddev_samp("_lv").alias("_d"))
    z = F.coalesce(F.try_divide(F.col("_lv") - F.col("_m"), F.when(F.col("_d") > 1e-12, F.col("_d"))), F.lit(0.0))
    return binned.join(within, "bin").select(feature, "mean", "variance", "bin", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("score"))


def cluster_profiles(values: DataFrame, *, cluster: str, cell: str, feature: str, value: str) -> DataFrame:
    """Mean (zeros of absent cells included) and part of cells above zero, per cluster and feature."""
    size = values.groupBy(cluster).agg(F.count_distinct(cell).alias("_size"))
    sums = values.groupBy(cluster, feature).agg(F.sum(value).alias("_s"), F.count_distinct(F.when(F.col(value) > 0, F.col(cell))).alias("_n"))
    return sums.join(size, cluster).select(cluster, feature, (F.col("_s") / F.col("_size")).alias("mean"), (F.col("_n") / F.col("_size")).alias("part"))


def nearest_neighbours(queries: DataFrame, rows: DataFrame, *, key: str, vector: str, k: int, grid: int | None = None) -> DataFrame:
    """The exact k nearest rows (Euclidean) of each query, itself left out.

    Queries and rows are cut into ``grid`` blocks each (by default sized to the rows);
    every pair of blocks is one matrix product in its own task, of which the k nearest
    a query go on to the final ranking. Ties go by key, however many there are. Vectors
    that are null or not of the rows' most frequent length (of equally frequent ones the
    least) are left out. Result: ``key``, ``neighbour``, ``rank``, ``distance``.
    """
    lengths = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("_l")).agg(F.count("*").alias("_n"))
    n_rows, width = lengths.agg(F.sum("_n"), F.max_by("_l", F.struct("_n", -F.col("_l")))).first()
    if grid is None:
        grid = max(8, -(-(n_rows or 0) // BLOCK_ROWS))
    kind = rows.schema[key].dataType.simpleString()
    block = lambda df, own, other: df.filter(F.size(vector) == F.lit(width)).select(
        F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(key), F.lit(grid)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias(other)
    )
    left, right = block(queries, "_a", "_b"), block(rows, "_b", "_a")

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": a["_key"][:0], "neighbour": a["_key"][:0], "distance": np.zeros(0)})
        if not len(a) or not len(b):
            return empty
        x, y = np.stack(a["_v"].to_list()), np.stack(b["_v"].to_list())
        keys = b["_key"].to_numpy()
        asked, found_keys, found_distances = [], [], []
        for start in range(0, len(x), 256):
            part = x[start : start + 256]
            own, other = (part * part).sum(1)[:, None], (y * y).sum(1)
            near = own - 2 * part @ y.T + other
            # One more than k, as the query itself may be among them, and the product's rounding.
            top = min(k + 1, len(keys))
            margin = 8 * (part.shape[1] + 4) * np.finfo(float).eps * (own[:, 0] + other.max())
            bound = np.partition(near, top - 1, axis=1)[:, top - 1] + margin
            for i, query in enumerate(a["_key"].iloc[start : start + 256]):
                choice = np.flatnonzero(~(near[i] > bound[i]) & (keys != query))
                exact = np.sqrt(((part[i] - y[choice]) ** 2).sum(1))
                first = np.lexsort((keys[choice], exact))[:k]
                asked += [query] * len(first)
                found_keys.append(keys[choice[first]])
                found_distances.append(exact[first])
        return pd.DataFrame({"query": asked, "neighbour": np.concatenate(found_keys), "distance": np.concatenate(found_distances)})

    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(pairs, f"query {kind}, neighbour {kind}, distance double")
    order = W.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("query").alias(key), "neighbour", "rank", "distance")


def _bandwidth(distances: np.ndarray, nearest: float, target: float, rounds: int = 64) -> float:
    """The width at which weights exp(-(d - nearest) / width) add up to the target, by bisection."""
    low, high, width = 0.0, np.inf, 1.0
    away = np.maximum(distances - nearest, 0.0)
    for _ in range(rounds):
        total = np.exp(-away / width).sum()
        if abs(total - target) < 1e-5:
            break
        if total > target:
            high = width
            width = (low + high) / 2
        else:
            low = width
            width = width * 2 if np.isinf(high) else (low + high) / 2
    return width


def local_weights(neighbours: DataFrame, *, key: str) -> DataFrame:
    """Directed weights of a neighbour table (key, neighbour, distance): exp(-(d - nearest) /
    width) with each row's own width, so that its k weights add up to log2(k); adds ``weight``."""

    @F.pandas_udf("array<double>")
    def weighed(distances: pd.Series) -> pd.Series:
        out = []
        for d in distances:
            d = np.asarray(d, float)
            out.append(np.exp(-np.maximum(d - d[0], 0.0) / _bandwidth(d, d[0], np.log2(len(d)))))
        return pd.Series(out)

    rows = neighbours.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("_n"))
    zipped = rows.select(key, F.explode(F.arrays_zip("_n", weighed("_n.distance").alias("w"))).alias("_x"))
    return zipped.select(key, F.col("_x._n.neighbour").alias("neighbour"), F.col("_x._n.distance").alias("distance"), F.col("_x.w").alias("weight"))


def projected_neighbours(df: DataFrame, *, key: str, vector: str, k: int, width: int, projections: int = 20, reach: int = 15, seed: int = 3) -> DataFrame:
    """The k nearest of each row among those that lie within ``reach`` places of it in one of
    ``projections`` random orders; approximate, with exact distances and ties by key.

    All projections are ranked in one range sort; rows at most ``reach`` apart meet by
    their places, so the pairs are 2 ``reach`` a row and projection at most, whatever
    the data. Vectors that are null or not ``width`` long are left out.
    """
    rows = df.filter(F.size(vector) == width).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    axes = np.random.default_rng(seed).normal(size=(projections, width))
    dot = lambda axis: F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    laid = rows.select("_key", F.posexplode(F.array(*[dot(axis) for axis in axes])).alias("_p", "_x"))
    places = checkpointed(numbered(laid, ["_p"], ["_x", "_key"]).select("_p", "_i", "_key"))
    ahead = places.select("_p", "_key", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + reach)).alias("_i"))
    met = ahead.join(places.withColumnRenamed("_key", "_other"), ["_p", "_i"]).select(F.least("_key", "_other").alias("_a"), F.greatest("_key", "_other").alias("_b")).distinct()
    side = lambda name, v: rows.select(F.col("_key").alias(name), F.col("_v").alias(v))
    square = F.aggregate(F.zip_with("_x", "_y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    pairs = met.join(side("_a", "_x"), "_a").join(side("_b", "_y"), "_b").select("_a", "_b", F.sqrt(square).alias("distance"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("_a").alias("query"), F.col("_b").alias("neighbour")), F.struct(F.col("_b").alias("query"), F.col("_a").alias("neighbour")))).alias("_x"), "distance").select("_x.*", "distance")
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(key), "neighbour", "rank", "distance")


def fuzzy_edges(neighbours: DataFrame, *, key: str) -> DataFrame:
    """Undirected edges of a neighbour table with weights a + b - ab of exp(-d) both ways."""
    directed = neighbours.select(F.least(key, "neighbour").alias("src"), F.greatest(key, "neighbour").alias("dst"), F.exp(-F.col("distance")).alias("_w"), (F.col(key) < F.col("neighbour")).alias("_f"))
    both = directed.groupBy("src", "dst").agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("_w"))), F.lit(0.0)).alias("_a"), F.coalesce(F.max(F.when(~F.col("_f"), F.col("_w"))), F.lit(0.0)).alias("_b"))
    return both.select("src", "dst", (F.col("_a") + F.col("_b") - F.col("_a") * F.col("_b")).alias("weight"))
