"""Clusters of cells: markers, talk between them, their graph, and velocities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.stats import cosine, normal_two_sided
from strandline.operators.ordering import mid_ranks, numbered
from strandline.operators.testing import adjust_p_values


def cluster_markers(values: DataFrame, labels: DataFrame, *, cell: str, feature: str, value: str, cluster: str, least_part: float = 0.1) -> DataFrame:
    """Rank-sum test of every feature in every cluster against all other cells.

    ``values`` has the positive values only (cell, feature, value); absent ones count
    as zero without being made: zeros share the lowest ranks, so their sum follows
    from how many there are. ``labels``: cell, cluster. Pairs in which the feature
    is above zero in less than ``least_part`` of the cluster's cells are left out.
    Result: cluster, feature, ``part``, ``auc``, ``z``, ``p``, ``padj`` (within the cluster).
    """
    sizes = labels.groupBy(cluster).agg(F.count("*").alias("_n1"))
    cells = labels.agg(F.count("*").alias("_cells"))
    positive = values.filter(F.col(value) > 0).select(cell, feature, value).join(labels.select(cell, cluster), cell)
    ranked = mid_ranks(positive, [feature], value, "_r")
    of_feature = ranked.groupBy(feature).agg(F.count("*").alias("_positive"))
    of_pair = ranked.groupBy(cluster, feature).agg(F.count("*").alias("_in"), F.sum("_r").alias("_ranks"))
    rows = of_pair.join(of_feature, feature).join(sizes, cluster).crossJoin(cells)
    zeros, n1, n2 = F.col("_cells") - F.col("_positive"), F.col("_n1"), F.col("_cells") - F.col("_n1")
    w = F.col("_ranks") + F.col("_in") * zeros + (n1 - F.col("_in")) * (zeros + 1) / 2
    u = w - n1 * (n1 + 1) / 2
    scored = rows.filter((F.col("_in") >= least_part * n1) & (n2 > 0)).select(cluster, feature, (F.col("_in") / n1).alias("part"), (u / (n1 * n2)).alias("auc"), ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (F.col("_cells") + 1) / 12.0)).alias("z"))
    return adjust_p_values(scored.withColumn("p", normal_two_sided(F.col("z"))), p="p", family=[cluster])


def top_by(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in the order, with their ``place``."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def cluster_talk(profiles: DataFrame, pairs: DataFrame, *, cluster: str, feature: str, least_part: float = 0.1) -> DataFrame:
    """Scores of ligand and receptor pairs between clusters: the root of the product of means.

    ``profiles``: cluster, feature, mean, part; ``pairs``: ligand, receptor. Both must
    be above zero in ``least_part`` of the cells of their cluster. Result: sender,
    receiver, ligand, receptor, ``score``.
    """
    said = profiles.filter(F.col("part") >= least_part)
    senders = said.select(F.col(cluster).alias("sender"), F.col(feature).alias("ligand"), F.col("mean").alias("_l"))
    receivers = said.select(F.col(cluster).alias("receiver"), F.col(feature).alias("receptor"), F.col("mean").alias("_r"))
    return pairs.select("ligand", "receptor").distinct().join(senders, "ligand").join(receivers, "receptor").select("sender", "receiver", "ligand", "receptor", F.sqrt(F.col("_l") * F.col("_r")).alias("score"))


def significant_talk(scores: DataFrame, *, p: str, most: float = 0.05) -> DataFrame:
    """Pairs of clusters with the number and mean score of their pairs that pass and score above zero."""
    kept = scores.filter((F.col(p) < most) & (F.col("score") > 0))
    return kept.groupBy("sender", "receiver").agg(F.count("*").alias("n_pairs"), F.avg("score").alias("mean_score"))


def community_graph(edges: DataFrame, labels: DataFrame, *, node: str, label: str) -> DataFrame:
    """Edges (src, dst, weight) summed up between labels: ``a`` <= ``b``, ``weight``."""
    side = lambda end, name: labels.select(F.col(node).alias(end), F.col(label).alias(name))
    joined = edges.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst")
    return joined.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight"))


def contiguous_labels(labels: DataFrame, *, node: str, label: str) -> DataFrame:
    """Labels numbered from 0 by their first node: ``node``, ``label``, ``number``."""
    first = labels.groupBy(label).agg(F.min(node).alias("_first"))
    numbers = first.select(label, (F.row_number().over(W.orderBy("_first")) - 1).alias("number"))
    return labels.join(numbers, label).select(node, label, "number")


def expression_velocity(counts: DataFrame, *, cell: str, feature: str, spliced: str, unspliced: str, least_part: float = 0.05, least_fit: float = 0.01, top: float = 0.95) -> DataFrame:
    """Steady-state ratio of each feature and the cells' distance from it.

    ``gamma`` is the median of spliced over unspliced of the cells from the ``top``
    quantile of unspliced counts on; the velocity of a cell is spliced less gamma
    times unspliced. Features above zero in less than ``least_part`` of the cells, or
    whose line explains less than ``least_fit``, are left out. Cells without a row
    of a feature have zeros of both and velocity 0. Result: cell, feature, gamma,
    ``fit``, ``velocity``.
    """
    cells = counts.agg(F.count_distinct(cell).alias("_cells"))
    s, u = F.col(spliced).cast("double"), F.col(unspliced).cast("double")
    rows = counts.select(cell, feature, s.alias("_s"), u.alias("_u"))
    positive = rows.filter("_u > 0")
    cut = positive.groupBy(feature).agg(F.expr(f"percentile(_u, {top})").alias("_cut"))
    gamma = positive.join(cut, feature).filter(F.col("_u") >= F.col("_cut")).groupBy(feature).agg(F.expr("percentile(_s / _u, 0.5)").alias("gamma"))
    fitted = rows.join(gamma, feature).withColumn("velocity", F.col("_s") - F.col("gamma") * F.col("_u"))
    sums = fitted.groupBy(feature).agg(F.count(F.when(F.col("_s") > 0, 1)).alias("_n"), F.sum("_s").alias("_x"), F.sum(F.col("_s") * F.col("_s")).alias("_xx"), F.sum(F.col("velocity") * F.col("velocity")).alias("_r")).crossJoin(cells)
    total = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_cells")
    fit = F.when(total > 1e-12, 1 - F.col("_r") / total).otherwise(0.0)
    kept = sums.filter(F.col("_n") >= least_part * F.col("_cells")).withColumn("fit", fit).filter(F.col("fit") >= least_fit).select(feature, "fit")
    return fitted.join(kept, feature).select(cell, feature, "gamma", "fit", "velocity")


def spatial_weights(neighbours: DataFrame, *, key: str) -> DataFrame:
    """Directed weights of a neighbour table, those of each row adding up to one: src, dst, weight."""
    n = F.count("*").over(W.partitionBy(key))
    return neighbours.select(F.col(key).alias("src"), F.col("neighbour").alias("dst"), (1 / n).alias("weight"))


def velocity_graph(neighbours: DataFrame, states: DataFrame, *, key: str, position: str, velocity: str) -> DataFrame:
    """How well each row's velocity points to each of its neighbours: key, neighbour, ``cosine``.

    ``states``: key, ``position``, ``velocity`` (arrays of one length); the cosine is that
    of the velocity and the way to the neighbour, 0 where one has no length.
    """
    own = states.select(key, F.col(position).alias("_x"), F.col(velocity).alias("_v"))
    other = states.select(F.col(key).alias("neighbour"), F.col(position).alias("_y"))
    way = F.zip_with("_y", "_x", lambda y, x: y.cast("double") - x.cast("double"))
    return neighbours.select(key, "neighbour").join(own, key).join(other, "neighbour").select(key, "neighbour", cosine(F.col("_v"), way).alias("cosine"))


def kept_cells(judged: DataFrame, *, cell: str, passes: str) -> DataFrame:
    """Cells that pass, numbered from 0 in the order of their names: cell, ``number``."""
    return numbered(judged.filter(F.col(passes)).select(cell), [], [cell]).select(cell, F.col("_i").alias("number"))
