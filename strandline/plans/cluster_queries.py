"""Queries of clusters: users as cells, event types with their k div 10 as features, a user's most frequent event type as its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.stats import cosine
from strandline.operators import cells, clusters, graphs
from strandline.plans.model_queries import _EDGES_SQL, _edges
from strandline.plans.statistics_queries import _COUNTS, _ERFC, _counts, cell_quality
from strandline.plans.statistics_queries import SQL as _STATISTICS
from strandline.tables import table

#: Random orders and their reach for the vectors' approximate neighbours.
PROJECTIONS, REACH = 40, 25


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = _counts(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("n").alias("m"))
    return most.groupBy("user_id").agg(F.max(F.struct("m", "event_type")).alias("x")).select("user_id", F.col("x.event_type").alias("cluster"))


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_markers(_counts(spark, sf_dir).select("user_id", "feature", "n"), _labels(spark, sf_dir), cell="user_id", feature="feature", value="n", cluster="cluster")


def cluster_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each cluster against all other cells."""
    return _markers(spark, sf_dir).select("cluster", "feature", F.round("part", 6).alias("part"), F.round("auc", 6).alias("auc"), F.round("z", 5).alias("z"), F.round("p", 6).alias("p"), F.round("padj", 6).alias("padj"))


def top_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three surest markers of each cluster."""
    best = clusters.top_by(_markers(spark, sf_dir).withColumn("_s", F.round(F.abs("z"), 6)), ["cluster"], [F.desc("_s"), "feature"], 3)
    return best.select("cluster", "feature", F.col("place").cast("long").alias("place"))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counts(spark, sf_dir).join(_labels(spark, sf_dir), "user_id")
    size = _labels(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("size"))
    profiles = rows.groupBy("cluster", "feature").agg(F.sum("n").alias("s"), F.count_distinct("user_id").alias("c")).join(size, "cluster").select("cluster", "feature", (F.col("s") / F.col("size")).alias("mean"), (F.col("c") / F.col("size")).alias("part"))
    named = rows.select("feature", F.substring_index("feature", "-", 1).alias("kind"), F.substring_index("feature", "-", -1).alias("k")).distinct()
    pairs = named.filter("kind = 'click'").select(F.col("feature").alias("ligand"), "k").join(named.filter("kind = 'view'").select(F.col("feature").alias("receptor"), "k"), "k")
    return clusters.cluster_talk(profiles, pairs, cluster="cluster", feature="feature", least_part=0.3)


def cluster_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of the same k as ligands and receptors between clusters."""
    return _talk(spark, sf_dir).select("sender", "receiver", "ligand", "receptor", F.round("score", 6).alias("score"))


def significant_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters whose scores stand out (above one), with the number and mean of those."""
    scored = _talk(spark, sf_dir).withColumn("p", F.when(F.col("score") > 1, 0.01).otherwise(1.0))
    found = clusters.significant_talk(scored, p="p")
    return found.select("sender", "receiver", "n_pairs", F.round("mean_score", 6).alias("mean_score"))


def label_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour edges of the vectors summed up between labels."""
    found = clusters.community_graph(_edges(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "label"), node="vec_id", label="label")
    return found.select("a", "b", F.round("weight", 4).alias("weight"))


def numbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' labels numbered by their first vector."""
    return clusters.contiguous_labels(table(spark, sf_dir, "embeddings").select("vec_id", "label"), node="vec_id", label="label").select("vec_id", "label", F.col("number").cast("long").alias("number"))


def spatial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I of the labels over weights that add up to one for each vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    weights = clusters.spatial_weights(cells.nearest_neighbours(rows, rows, key="vec_id", vector="embedding", k=5), key="vec_id")
    found = graphs.moran_index(weights, table(spark, sf_dir, "embeddings"), node="vec_id", value="label")
    return found.select("n_nodes", F.round("moran", 5).alias("moran"))


def autocorrelation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against random placements of the labels."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    weights = clusters.spatial_weights(cells.nearest_neighbours(rows, rows, key="vec_id", vector="embedding", k=5), key="vec_id")
    found = graphs.moran_permutations(weights, rows, node="vec_id", value="label", permutations=49)
    return found.select("n_nodes", F.round("moran", 5).alias("moran"), F.round("p", 4).alias("p"))


def local_weight_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the weights of each vector's eight nearest add up to (three, log2 of eight) and the largest."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = cells.local_weights(cells.nearest_neighbours(rows, rows, key="vec_id", vector="embedding", k=8), key="vec_id")
    return found.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


def projected_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether random orders find nine of ten of the true ten nearest of every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.filter(F.col("vec_id") % 50 == 0)
    true = cells.nearest_neighbours(queries, rows, key="vec_id", vector="embedding", k=10).select("vec_id", "neighbour")
    found = cells.projected_neighbours(rows, key="vec_id", vector="embedding", k=10, width=64, projections=PROJECTIONS, reach=REACH).select("vec_id", "neighbour", F.lit(1).alias("hit"))
    met = true.join(found, ["vec_id", "neighbour"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return met.select("n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("enough"))


def label_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the mean of its label."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_c")).select("label", F.col("_c.m").alias("centre"))
    return rows.join(centres, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 5).alias("cosine"))


def pull_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the way to the mean of its label agrees with that to each vector's three nearest."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_c")).select("label", F.col("_c.m").alias("centre"))
    states = rows.join(centres, "label").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.zip_with("centre", F.col("embedding"), lambda c, x: c - x.cast("double")).alias("v"))
    near = cells.nearest_neighbours(rows, rows, key="vec_id", vector="embedding", k=3)
    return clusters.velocity_graph(near, states, key="vec_id", position="x", velocity="v").select("vec_id", "neighbour", F.round("cosine", 5).alias("cosine"))


def kept_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of good quality, numbered anew."""
    return clusters.kept_cells(cell_quality(spark, sf_dir), cell="user_id", passes="passes")


def event_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views over clicks of each k div 10: the steady ratio and the users' distance from it."""
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", k.alias("k"), "event_type").filter("k IS NOT NULL AND user_id IS NOT NULL")
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    counts = rows.groupBy("user_id", "k").agg(n("view").alias("s"), n("click").alias("u"))
    found = clusters.expression_velocity(counts, cell="user_id", feature="k", spliced="s", unspliced="u", least_fit=-10.0)
    return found.select("user_id", "k", F.round("gamma", 5).alias("gamma"), F.round("fit", 4).alias("fit"), F.round("velocity", 4).alias("velocity"))


QUERIES = {f.__name__: f for f in (cluster_markers, top_markers, cluster_talk, significant_talk, label_graph, numbered_labels, spatial_autocorrelation, autocorrelation_test, local_weight_sums, projected_recall, label_cosines, pull_to_label, kept_cells, event_velocity)}
_LABELS = f"""{_COUNTS}, e AS (SELECT user_id, event_type, sum(n) AS m FROM counts GROUP BY user_id, event_type), k AS (SELECT user_id, arg_max(event_type, (m, event_type)) AS cluster FROM e GROUP BY user_id)"""
_MARKERS = f"""WITH {_LABELS}, f AS (SELECT feature, user_id, sum(n) AS n FROM counts GROUP BY ALL), d AS (SELECT x.feature, k.user_id, k.cluster, coalesce(f.n, 0) AS n FROM (SELECT DISTINCT feature FROM f) x CROSS JOIN k LEFT JOIN f ON f.feature = x.feature AND f.user_id = k.user_id),
  r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY n) + (count(*) OVER (PARTITION BY feature, n) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature) AS cells FROM d),
  s AS (SELECT feature, cluster, count(*) AS n1, max(cells) - count(*) AS n2, max(cells) AS cells, sum(r) AS w, count(*) FILTER (n > 0) AS pos FROM r GROUP BY feature, cluster),
  u AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u FROM s WHERE pos >= 0.1 * n1 AND pos > 0 AND n2 > 0), z AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (cells + 1) / 12.0) AS z FROM u),
  e2 AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z), p AS (SELECT *, {_ERFC} AS p FROM e2),
  b AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS m, count(*) OVER (PARTITION BY cluster ORDER BY p) AS upto FROM p), markers AS (SELECT *, least(1.0, min(p * m / upto) OVER (PARTITION BY cluster ORDER BY p DESC)) AS padj FROM b)"""
_TALK = f"""WITH {_LABELS}, size AS (SELECT cluster, count(*) AS size FROM k GROUP BY cluster),
  p AS (SELECT k.cluster, feature, sum(n) / max(size) AS mean, count(DISTINCT counts.user_id) / max(size) AS part FROM counts JOIN k ON k.user_id = counts.user_id JOIN size ON size.cluster = k.cluster GROUP BY k.cluster, feature),
  said AS (SELECT * FROM p WHERE part >= 0.3),
  talk AS (SELECT a.cluster AS sender, b.cluster AS receiver, a.feature AS ligand, b.feature AS receptor, sqrt(a.mean * b.mean) AS score FROM said a JOIN said b ON a.feature LIKE 'click-%' AND b.feature = replace(a.feature, 'click-', 'view-'))"""
_NEAR = _EDGES_SQL.split("g AS (SELECT least")[0]
SQL = {
    "cluster_markers": _MARKERS + "SELECT cluster, feature, round(pos / n1, 6) AS part, round(u / (n1 * n2), 6) AS auc, round(z, 5) AS z, round(p, 6) AS p, round(padj, 6) AS padj FROM markers",
    "top_markers": _MARKERS + ", o AS (SELECT cluster, feature, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(z), 6) DESC, feature) AS place FROM markers) SELECT * FROM o WHERE place <= 3",
    "cluster_talk": _TALK + "SELECT sender, receiver, ligand, receptor, round(score, 6) AS score FROM talk",
    "significant_talk": _TALK + "SELECT sender, receiver, count(*) AS n_pairs, round(avg(score), 6) AS mean_score FROM talk WHERE score > 1 GROUP BY ALL",
    "label_graph": _EDGES_SQL + "SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, round(sum(weight), 4) AS weight FROM edges JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY ALL",
    "numbered_labels": "WITH f AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS number FROM embeddings GROUP BY label) SELECT vec_id, label, number FROM embeddings JOIN f USING (label)",
    "spatial_autocorrelation": _NEAR
    + """w AS (SELECT a AS src, b AS dst, 1.0 / count(*) OVER (PARTITION BY a) AS weight FROM r)
      SELECT max(n) AS n_nodes, round(sum(weight * (x.label - m) * (y.label - m)) / (sum(weight) * max(s)), 5) AS moran FROM w
      JOIN embeddings x ON x.vec_id = src JOIN embeddings y ON y.vec_id = dst, (SELECT avg(label) AS m, count(label) AS n, var_pop(label) AS s FROM embeddings)""",
    "autocorrelation_test": _NEAR
    + f"""w AS (SELECT a AS src, b AS dst, 1.0 / count(*) OVER (PARTITION BY a) AS weight FROM r),
      n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, label - avg(label) OVER () AS z, count(*) OVER () AS n FROM embeddings WHERE label IS NOT NULL),
      m(p, a, b) AS (VALUES {", ".join(f"({p}, {a}::BIGINT, {b}::BIGINT)" for p, (a, b) in enumerate([(1, 0), *graphs.shuffles(49)]))}),
      e AS (SELECT p, weight, (m.a * s.i + m.b) % s.n AS x, (m.a * d.i + m.b) % s.n AS y FROM w JOIN n s ON s.vec_id = src JOIN n d ON d.vec_id = dst, m),
      t AS (SELECT p, sum(weight * x.z * y.z) AS t, sum(weight) AS w FROM e JOIN n x ON x.i = e.x JOIN n y ON y.i = e.y GROUP BY p),
      o AS (SELECT t AS own, w FROM t WHERE p = 0)
      SELECT (SELECT count(*) FROM n) AS n_nodes, round(max(own) / (max(w_own) * (SELECT var_pop(label) FROM embeddings)), 5) AS moran, round(count(*) FILTER (t >= own - 1e-9) / count(*), 4) AS p
      FROM t, (SELECT own, w AS w_own FROM o)""",
    "local_weight_sums": "SELECT vec_id, 8 AS n, 3.0 AS total, 1.0 AS largest FROM embeddings",
    "projected_recall": "SELECT 10 * count(*) AS n_true, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "label_cosines": """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS centre FROM m GROUP BY label)
      SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 5) AS cosine FROM embeddings JOIN c USING (label)""",
    "pull_to_label": _NEAR.replace("<= 5)", "<= 3)")
    + """m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) q(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS centre FROM m GROUP BY label),
      s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, list_transform(list_zip(centre, CAST(embedding AS DOUBLE[])), lambda z: z[1] - z[2]) AS v FROM embeddings JOIN c USING (label))
      SELECT r.a AS vec_id, r.b AS neighbour, round(list_cosine_similarity(s.v, list_transform(list_zip(o.x, s.x), lambda z: z[1] - z[2])), 5) AS cosine FROM r JOIN s ON s.vec_id = r.a JOIN s o ON o.vec_id = r.b""",
    "kept_cells": f"SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS number FROM ({_STATISTICS['cell_quality']}) WHERE passes",
    "event_velocity": """WITH c AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS k, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'click') AS u FROM events WHERE user_id IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL GROUP BY ALL),
      n AS (SELECT count(DISTINCT user_id) AS cells FROM c), q AS (SELECT k, quantile_cont(u::DOUBLE, 0.95) AS cut FROM c WHERE u > 0 GROUP BY k),
      g AS (SELECT c.k, median(s / u) AS gamma FROM c JOIN q ON q.k = c.k WHERE u > 0 AND u >= cut GROUP BY c.k), v AS (SELECT c.*, gamma, s - gamma * u AS v FROM c JOIN g ON g.k = c.k),
      t AS (SELECT k, count(*) FILTER (s > 0) AS pos, sum(s * s) - sum(s) * sum(s) / max(cells) AS total, sum(v * v) AS rest, max(cells) AS cells FROM v, n GROUP BY k),
      f AS (SELECT k, CASE WHEN total > 1e-12 THEN 1 - rest / total ELSE 0.0 END AS fit FROM t WHERE pos >= 0.05 * cells)
      SELECT user_id, v.k, round(gamma, 5) AS gamma, round(fit, 4) AS fit, round(v, 4) AS velocity FROM v JOIN f ON f.k = v.k WHERE fit >= -10""",
}
