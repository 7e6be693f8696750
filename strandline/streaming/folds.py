"""The mergeable summaries on Structured Streaming inputs.

A fold is one grouped aggregate: on a stream the state store keeps its partial
results, on a batch the shuffle does; the expressions are the same, so the results
are too. Exact distinct counts would grow the state without bound and are left to
sketches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from strandline.session import checkpoint_dir
from strandline.tables import canonical_chrom


def stream_table(spark: SparkSession, directory: str, name: str, *, files_per_batch: int = 1) -> DataFrame:
    """A parquet table as a stream of its files."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def fold_calls(rows: DataFrame) -> DataFrame:
    """Calls by canonical chromosome: count, quality sum, distinct positions by sketch."""
    return rows.groupBy(canonical_chrom("chrom").alias("chrom")).agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("qual") > 30, 1)).alias("n_high"),
        F.hll_sketch_agg(F.xxhash64(canonical_chrom("chrom"), "pos"), 14).alias("sketch"),
    )


def fold_peaks(rows: DataFrame) -> DataFrame:
    """Peaks by run: count, bases, narrow ones, highest summit."""
    width = F.when(F.col("end_pos") > F.col("start_pos"), F.col("end_pos") - F.col("start_pos"))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.sum(width).alias("n_bases"), F.count(F.when(width < 500, 1)).alias("n_narrow"), F.max("summit_height").alias("best_height")
    )


def fold_segments(rows: DataFrame) -> DataFrame:
    """Copy-number segments by profile: count, bases, copies times bases."""
    width = F.when(F.col("end_pos") > F.col("start_pos"), F.col("end_pos") - F.col("start_pos"))
    return rows.groupBy("profile_id").agg(F.count("*").alias("n_rows"), F.sum(width).alias("n_bases"), F.round(F.sum(F.col("copy_number").cast("double") * width) / 1e6, 3).alias("copy_megabases"))


def fold_sites(rows: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """Methylation-like sites by group: count, sum and square sum of a value, which merge."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.groupBy(*by).agg(F.count(v).alias("n_sites"), F.round(F.sum(v), 3).alias("total"), F.round(F.sum(v * v), 3).alias("squares"))


class ProgressLog(StreamingQueryListener):
    """Rows done and rows a second of every streaming query, by its name or id."""

    def __init__(self) -> None:
        self.done: dict[str, int] = {}
        self.rate: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.done.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key = str(event.progress.id)
        self.done[key] = self.done.get(key, 0) + event.progress.numInputRows
        self.rate[key] = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def run_available(stream: DataFrame, *, mode: str = "complete") -> DataFrame:
    """All that the stream has now, its final result as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def sessions(events: DataFrame, *, user: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of users with a gap of silence between them; events later than ``late`` are dropped on a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    window = F.session_window(time, gap)
    return marked.groupBy(window.alias("_w"), user).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(
        user, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n_events", "total"
    )
