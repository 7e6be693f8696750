"""Reading tables and the normal forms shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def canonical_chrom(chrom: Column | str) -> Column:
    """``1``..``22``, ``X``, ``Y``, ``MT`` whatever the case or ``chr`` prefix.

    Blank names become null.
    """
    upper = F.upper(F.trim(F.col(chrom) if isinstance(chrom, str) else chrom))
    bare = F.when(upper.startswith("CHR"), upper.substr(F.lit(4), F.length(upper))).otherwise(upper)
    return F.when(bare.isin("M", "MT"), "MT").when(bare != "", bare)


#: The same normal form as an expression both SQL dialects understand.
def canonical_chrom_sql(chrom: str) -> str:
    bare = f"CASE WHEN upper(trim({chrom})) LIKE 'CHR%' THEN substr(upper(trim({chrom})), 4) ELSE upper(trim({chrom})) END"
    return f"CASE WHEN {bare} IN ('M', 'MT') THEN 'MT' WHEN {bare} <> '' THEN {bare} END"
