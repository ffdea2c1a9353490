"""Incremental ingestion, job states and call history as streams.

New files are picked up by the file source, whose checkpoint remembers what it has
seen; each batch is parsed and merged by content-addressed id, so a batch that is run
twice after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus


def watch(spark: SparkSession, root: str, glob: str = "*.md", archive: str | None = None, per_batch: int = 1000) -> DataFrame:
    """(path, content) of files as they come; with ``archive`` read ones are moved there."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(root).select("path", "content")


def store(table: str, key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """A batch writer: rows whose key the table lacks are appended, in the first of their occurrences."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = corpus.first_wins(batch, key, *[c for c in batch.columns if c != key and not c.startswith("_")])
        try:
            fresh = fresh.join(spark.read.parquet(table).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(table)

    return write


def ingest_available(files: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Everything that has come since the last run, then stop."""
    return parse(files).writeStream.foreachBatch(store(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(log: DataFrame, job: str, at: str, *tie: str) -> DataFrame:
    """The last row of each job in an append-only log."""
    order = Window.partitionBy(job).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in tie])
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def recent(log: DataFrame, at: str, limit: int, *tie: str, most: int = 50) -> DataFrame:
    """The newest calls first, ``most`` at most."""
    return log.orderBy(F.col(at).desc(), *[F.col(t).desc() for t in tie]).limit(max(1, min(limit, most)))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, length, modified) against what was seen before: new, changed or gone."""
    a, b = now.select("path", "length", "modified"), before.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"))
    both = a.join(b, "path", "full")
    state = F.when(F.col("_m").isNull(), "new").when(F.col("modified").isNull(), "gone").when((F.col("length") != F.col("_l")) | (F.col("modified") != F.col("_m")), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")
