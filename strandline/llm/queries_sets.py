"""Queries of the set-similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.setjoin import set_links, similar_sets
from strandline.tables import table

THRESHOLD = 0.7


def _sets(spark: SparkSession, sf_dir: str) -> dict:
    own = table(spark, sf_dir, "gene_sets").select("set_key", "genes", F.lit(True).alias("own"))
    reference = table(spark, sf_dir, "ref_gene_sets").select("set_key", "genes", F.lit(False).alias("own"))
    return {"df": own.unionByName(reference), "key": "set_key", "items": "genes", "threshold": THRESHOLD, "own": F.col("own")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of gene sets that share most of their genes."""
    return similar_sets(**_sets(spark, sf_dir)).select("key_a", "key_b")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many similar sets each gene set has, and how near the nearest is."""
    return set_links(**_sets(spark, sf_dir)).withColumn("nearest", F.round("nearest", 6))


_PAIRS_SQL = """
WITH records AS (
  SELECT DISTINCT set_key, genes, true AS own FROM gene_sets
  UNION ALL SELECT DISTINCT set_key, genes, false FROM ref_gene_sets),
items AS (
  SELECT DISTINCT set_key, own, upper(trim(g, E' \\t\\n\\r')) AS gene FROM (SELECT set_key, own, unnest(genes) AS g FROM records)
  WHERE g IS NOT NULL AND trim(g, E' \\t\\n\\r') <> ''),
sizes AS (SELECT set_key, count(*) AS n FROM items GROUP BY set_key),
shared AS (
  SELECT a.set_key AS key_a, b.set_key AS key_b, count(*) AS n FROM items a JOIN items b ON a.gene = b.gene AND a.set_key < b.set_key AND (a.own OR b.own)
  GROUP BY a.set_key, b.set_key),
pairs AS (
  SELECT key_a, key_b, s.n / (x.n + y.n - s.n) AS similarity FROM shared s
  JOIN sizes x ON x.set_key = key_a JOIN sizes y ON y.set_key = key_b WHERE s.n >= 0.7 * (x.n + y.n - s.n))
"""
P2_SQL = _PAIRS_SQL + "SELECT key_a, key_b FROM pairs"
P2_LINKS_SQL = (
    _PAIRS_SQL
    + """SELECT set_key, count(*) AS n_links, round(max(similarity), 6) AS nearest
FROM (SELECT key_a AS set_key, similarity FROM pairs UNION ALL SELECT key_b, similarity FROM pairs) GROUP BY set_key"""
)

QUERIES = {"p2_found": p2_found, "p2_links": p2_links}
SQL = {"p2_found": P2_SQL, "p2_links": P2_LINKS_SQL}
