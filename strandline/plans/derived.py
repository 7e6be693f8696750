"""Files in public formats that Spark derives from the given tables, for the readers to read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpoint_dir

#: Width of the derived reference sequence's tiles and of their margins.
TILE, MARGIN = 32, 64


def as_file(lines: DataFrame, name: str) -> str:
    """One text column written to a new folder of the shared directory; its path."""
    folder = f"{checkpoint_dir(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


def derived_bases(text: Column) -> Column:
    """32 bases that follow from a text: its MD5 digest, digit by digit."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


def reference_lines(places: DataFrame) -> DataFrame:
    """FASTA records of the tiles around calls (chrom, pos): name ``chrom:tile``, and the
    tile's bases with two tiles more on each side."""
    tiles = places.select("chrom", F.floor((F.col("pos") - 1) / TILE).alias("tile")).distinct()
    block = lambda d: derived_bases(F.concat_ws(":", "chrom", (F.col("tile") + d).cast("string")))
    bases = F.concat(*[block(d) for d in range(-2, 3)])
    return tiles.select(F.concat(F.lit(">"), F.concat_ws(":", "chrom", F.col("tile").cast("string")), F.lit("\n"), bases).alias("value"))


def sql_bases(text: str) -> str:
    """The SQL of :func:`derived_bases`."""
    return f"translate(md5({text}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
