"""Writing summaries as one JSON document, chromosomes in their natural order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chromosome_order(chrom: Column) -> Column:
    """Sort key: numbered chromosomes first by number, the others after by name."""
    bare = F.regexp_replace(chrom, "^(?i)chr", "")
    return F.struct(F.coalesce(bare.try_cast("int"), F.lit(1000)).alias("number"), bare.alias("name"))


def summary_document(parts: dict[str, DataFrame], *, most: int = 100_000) -> DataFrame:
    """One row with the column ``json``: each (small) summary as a list of its rows.

    NaN becomes null. Summaries are reports; their rows are gathered in one value, so
    one of more than ``most`` rows is refused before any is gathered.
    """
    for name, part in parts.items():
        if part.limit(most + 1).count() > most:
            raise ValueError(f"{name} is no summary: it has more than {most} rows")


    def listed(name: str, part: DataFrame) -> DataFrame:
        clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in part.dtypes]
        return part.select(F.struct(*clean).alias("_r")).agg(F.to_json(F.sort_array(F.collect_list("_r")), {"ignoreNullFields": "false"}).alias(name))

    rows = reduce(lambda a, b: a.crossJoin(b), [listed(name, part) for name, part in parts.items()])
    body = [F.concat(F.lit(f'"{name}":'), F.col(name)) for name in parts]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")).alias("json"))
