"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution carries the physical decisions: partition counts, broadcast
# conversion from measured sizes, and splitting of skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

SHUFFLE_TARGET = 128 * 1024**2
MAX_SHUFFLE_PARTITIONS = 100_000


def sizing(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle settings for a given amount of input.

    Enough partitions that one fits in an executor's share of memory even if a shuffle
    moves the whole input; adaptive execution merges them again where less is moved.
    """
    wanted = min(max(2 * cores, input_bytes // SHUFFLE_TARGET), MAX_SHUFFLE_PARTITIONS)
    return {
        "spark.sql.shuffle.partitions": str(wanted),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_TARGET),
    }


def build_session(app: str = "shelfsense", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the cluster's shared checkpoint folder.

    Only a local-mode session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="shelfsense-")
    return f"{root.rstrip('/')}/shelfsense/{name}-{uuid.uuid4().hex}"


def measured(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back, so that joins with it know its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
