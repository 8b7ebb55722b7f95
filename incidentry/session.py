"""Session set-up, lineage cuts and size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast only when it is proven to hold at most this many rows.
BROADCAST_ROWS = 200_000


def build_session(app: str = "incidentry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: AQE with skew-join splitting, UTC, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Texts can be long: batches to Python are bounded by size, not by rows alone.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A private temporary folder is used only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where a later step depends on a physical property, such as the bounds of a
    range partitioning, that a recomputation could change.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` is proven to hold at most ``max_rows`` rows. Reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; beyond the bound the plain side is returned for a shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all of the session's shuffle partitions, for costly work per row on a table of few files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
