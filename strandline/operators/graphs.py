"""Edge tables: autocorrelation, also against random placements, and communities."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.ordering import numbered
from strandline.session import checkpointed


def moran_index(edges: DataFrame, values: DataFrame, *, node: str, value: str) -> DataFrame:
    """Moran's I of a value over weighted edges (src, dst, weight), both directions."""
    nodes = values.select(F.col(node).alias("_n"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    mean = nodes.agg(F.avg("_v").alias("_m"), F.count("*").alias("n_nodes"), F.var_pop("_v").alias("_var"))
    a = edges.join(nodes.withColumnsRenamed({"_n": "src", "_v": "_x"}), "src").join(nodes.withColumnsRenamed({"_n": "dst", "_v": "_y"}), "dst")
    sums = a.agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("weight") * (F.col("_x") + F.col("_y"))).alias("_s"))
    both = sums.crossJoin(mean)
    cross = F.col("_xy") - F.col("_m") * F.col("_s") + F.col("_w") * F.col("_m") * F.col("_m")
    return both.select("n_nodes", F.try_divide(cross, F.col("_w") * F.col("_var")).alias("moran"))


def communities(edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """Labels of the nodes of weighted edges (src, dst, weight) by label propagation.

    In each round a node takes the label with the most weight around it, its own
    counting with the mean weight of its edges; of equal ones the lowest. Ends when
    nothing moves or after ``rounds``; every round is written to the shared folder.
    Result: node, label (the lowest node of the community when it began).
    """
    both = checkpointed(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter(F.col("src") != F.col("dst")))
    own = both.groupBy("src").agg(F.avg("weight").alias("_own"))
    labels = checkpointed(own.select(F.col("src").alias("node"), F.col("src").alias("label")))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("node", "dst"), "dst").select("src", "label", "weight")
        itself = labels.join(own.withColumnRenamed("src", "node"), "node").select(F.col("node").alias("src"), "label", F.col("_own").alias("weight"))
        votes = around.unionByName(itself).groupBy("src", "label").agg(F.sum("weight").alias("_w"))
        best = W.partitionBy("src").orderBy(F.desc("_w"), "label")
        chosen = votes.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).select(F.col("src").alias("node"), "label")
        new = checkpointed(chosen)
        moved = new.join(labels.withColumnRenamed("label", "_old"), "node").filter(F.col("label") != F.col("_old"))
        labels = new
        if moved.isEmpty():
            break
    return labels


def shuffles(permutations: int, seed: int = 1) -> list[tuple[int, int]]:
    """Factors and offsets of the maps i -> (a i + b) mod n, which are permutations for every
    n below 2 ** 31: the factors are primes above that, so that nothing needs to be sorted."""
    rng, out = random.Random(seed), []
    while len(out) < permutations:
        a = rng.randrange(2**31 + 1, 2**31 + 2**28, 2)
        if all(a % d for d in range(3, math.isqrt(a) + 1, 2)):
            out.append((a, rng.randrange(2**31)))
    return out


def moran_permutations(edges: DataFrame, values: DataFrame, *, node: str, value: str, permutations: int = 99, seed: int = 1) -> DataFrame:
    """Moran's I, and the part of random placements of the values with at least as high a one:
    ``n_nodes``, ``moran``, ``p`` = (hits + 1) / (permutations + 1).

    Nodes are numbered once; in each placement node i takes the value of node
    (a i + b) mod n, so a placement is a join and its sum a partial aggregate. Edges
    of nodes without a value are left out, as are nodes without edges from the sums.
    """
    nodes = values.select(F.col(node).alias("_node"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    placed = checkpointed(numbered(nodes, [], ["_node"]))
    n, mean, variance = placed.agg(F.count("*"), F.avg("_v"), F.var_pop("_v")).first()
    known = placed.select("_i", (F.col("_v") - F.lit(mean or 0.0)).alias("_z"))
    end = lambda name: placed.select(F.col("_node").alias(name), F.col("_i").alias(f"_{name}"))
    ends = checkpointed(edges.join(end("src"), "src").join(end("dst"), "dst").select("_src", "_dst", "weight"))
    total = ends.agg(F.sum("weight")).first()[0] or 0.0
    maps = F.array(*[F.struct(F.lit(p).alias("_p"), F.lit(a).cast("long").alias("_a"), F.lit(b).cast("long").alias("_b")) for p, (a, b) in enumerate([(1, 0), *shuffles(permutations, seed)])])
    moved = lambda c: (F.col("_x._a") * F.col(c) + F.col("_x._b")) % F.lit(max(n, 1))
    tried = ends.withColumn("_x", F.explode(maps)).select(F.col("_x._p").alias("_p"), "weight", moved("_src").alias("_s"), moved("_dst").alias("_d"))
    side = lambda c, z: known.select(F.col("_i").alias(c), F.col("_z").alias(z))
    sums = tried.join(side("_s", "_y"), "_s").join(side("_d", "_z"), "_d").groupBy("_p").agg(F.sum(F.col("weight") * F.col("_y") * F.col("_z")).alias("_n"))
    own = F.max(F.when(F.col("_p") == 0, F.col("_n")))
    return sums.agg(own.alias("_own"), F.collect_list("_n").alias("_all")).select(
        F.lit(n).alias("n_nodes"),
        F.try_divide(F.col("_own"), F.lit(total * (variance or 0.0))).alias("moran"),
        # The true placement is one of those counted.
        (F.size(F.filter("_all", lambda x: x >= F.col("_own") - 1e-9)) / F.lit(permutations + 1.0)).alias("p"),
    )
