"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "siegeboard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Set comparisons and nested-record expressions need little data and much work.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, as in
    tests, falls back to a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="siegeboard-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and go on from there.

    Used where a result feeds several later jobs, or where generated ids must
    not change when a lost executor's work is run again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and go on from there.

    Like ``materialize``, but later jobs read only the columns and folders they
    need. The order of rows and the partitioning are not kept.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    kept = [f for f in df.schema.fields if f.name not in partition_by]
    return df.sparkSession.read.schema(T.StructType([*kept, *[df.schema[c] for c in partition_by]])).parquet(path)
