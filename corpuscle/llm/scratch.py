"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage here rather than in executor memory: a
table written to ``spark.checkpoint.dir`` survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_scope = "session"


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables saved within belong to ``name`` and can be released apart from others."""
    global _scope
    before, _scope = _scope, name
    try:
        yield
    finally:
        _scope = before


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the session names none (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    # Spark 4.1 pairs the partitions of a union's parts if all are partitioned alike, though adaptive execution may
    # have merged them differently; it then fails or loses matches.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = f"{root(spark)}/corpuscle-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _made.setdefault(_scope, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, name: str, keep: Sequence[str] = ()) -> None:
    """Delete the tables saved in scope ``name``, but for those that hold one of the files ``keep``.

    For callers that have written whatever they derived from them, such as a
    pipeline between two stages.
    """
    left = []
    for path in _made.pop(name, []):
        folder = path.rsplit("/", 1)[-1]
        if any(f"/{folder}/" in f for f in keep):
            left.append(path)
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if left:
        _made[name] = left


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _made else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may already be gone
            for name in list(_made):
                release(spark, name)
