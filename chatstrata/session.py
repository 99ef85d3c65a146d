"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

# Settings the operators count on; the sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Split a hot join key even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JSON allows a key twice; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# The most bytes of rows that Spark hands to Python at once, by `small_batches`.
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


# Temporary folders of local sessions, by application; removed when the process ends.
_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python in batches of BATCH_BYTES at most (one long row is a batch of its own), unless the session has a lower limit.

    Spark's own limit is a number of rows. An executor holds a batch several times over, and its workers, which
    serve one job after another, keep the memory of their largest; that must not follow the length of the texts.
    """
    limit = spark.conf.get(BATCH_LIMIT, None)
    if not (limit or "").isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    A local session, where driver and executors are one process, gets a temporary
    folder of its own if none is set; it goes with the process. On a cluster that would be another folder on
    each machine, so there the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _local_folders:
        folder = tempfile.TemporaryDirectory(prefix="chatstrata-", ignore_cleanup_errors=True)
        _local_folders[spark.sparkContext.applicationId] = folder
    return _local_folders[spark.sparkContext.applicationId].name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(table: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    Jobs stage the small tables they join many times, such as the ids of the
    sessions to keep: they are computed once, survive lost executors, and their
    size is known when the next joins are planned.
    """
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def read_named_partitions(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A Parquet dataset partitioned by `column`, whose values stay text even if they look like dates or numbers."""
    found = spark.read.parquet(path).schema
    fields = [StructField(f.name, StringType()) if f.name == column else f for f in found.fields]
    return spark.read.schema(StructType(fields)).parquet(path)
