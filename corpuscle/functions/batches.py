"""How rows reach Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, whose default of 64 MB the worker of every task holds several times over.
BYTES = 1 << 22


def bounded(spark: SparkSession | None = None) -> None:
    """Plans of this session pass rows to Python in batches of ``BYTES`` at most; a larger setting is lowered."""
    spark = spark or SparkSession.active()
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) > BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
