"""Changes of a snapshot store that write in proportion to the change.

``writers.write_snapshot`` appends; here snapshots are dropped by tombstones, one row each, and what they leave behind goes
later, in two steps that can be repeated after a crash at any point:

- ``compact`` writes the snapshots that share files with dropped ones again. Their new manifest row names the attempt it
  replaces, so a reader sees the old rows or the new ones, never both or none.
- ``vacuum`` deletes files in which every row was dropped or replaced longer ago than a grace period, in which readers that
  have listed them end.

Appends and drops may run beside each other and beside readers; only one ``compact`` may run at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chatstrata import constants as C
from chatstrata.operators.content import ATTEMPT, Content
from chatstrata.operators.snapshots import apply_retention
from chatstrata.session import staged
from chatstrata.sources import listing, writers

KEY = ["root_id", "snapshot_id", ATTEMPT]
GRACE_SECONDS = 24 * 3600


def _drop(doomed: DataFrame, base: str) -> int:
    """One tombstone for each live manifest row; returns their number."""
    stones = staged(doomed.select("root_id", "id", ATTEMPT), "tombstones")
    count = stones.count()
    if count:
        stones.write.mode("append").parquet(f"{base}/dropped")
    return count


def drop_snapshots(spark: SparkSession, base: str, ids: DataFrame) -> int:
    """Drops the snapshots in ``ids(root_id, id)``; an error if none of them exists."""
    live = writers.live_manifest(spark, base)
    dropped = _drop(live.join(ids.select("root_id", "id"), ["root_id", "id"], "left_semi"), base)
    if not dropped:
        raise ValueError("none of the snapshots to delete exists")
    return dropped


def retain_snapshots(
    spark: SparkSession,
    base: str,
    max_system: int = C.MAX_SYSTEM_SNAPSHOTS,
    max_auto: int = C.MAX_AUTO_PROTECT_SNAPSHOTS,
) -> int:
    """Drops what the retention rule does not keep and returns how many snapshots that are."""
    live = writers.live_manifest(spark, base)
    # Ids may repeat between attempts of different writers; each attempt is judged.
    judged = apply_retention(live, max_system, max_auto, ("root_id", "id", ATTEMPT))
    return _drop(judged.filter(~F.col("keep")), base)


def append_snapshots(
    content: Content,
    manifest: DataFrame,
    base: str,
    max_system: int = C.MAX_SYSTEM_SNAPSHOTS,
    max_auto: int = C.MAX_AUTO_PROTECT_SNAPSHOTS,
) -> int:
    """Writes new snapshots, such as those of the jobs that create them, then applies the retention rule."""
    writers.write_snapshot(content, manifest, base)
    return retain_snapshots(manifest.sparkSession, base, max_system, max_auto)


def _holdings(spark: SparkSession, base: str) -> DataFrame:
    """Which snapshots each file of the store has rows of: (path, root_id, snapshot_id, attempt_id). Reads key columns only."""
    held = [_file_keys(table) for table in Content.load(spark, base).named_tables().values()]
    return staged(reduce(DataFrame.unionByName, [keys for keys in held if keys is not None]), "holdings")


def _file_keys(table: DataFrame) -> DataFrame | None:
    try:
        return table.select(F.col("_metadata.file_path").alias("path"), *KEY).distinct()
    except AnalysisException as error:
        # A table without any row has no file either.
        if "UNRESOLVED_COLUMN" not in str(error):
            raise
        return None


def _gone(spark: SparkSession, base: str) -> DataFrame:
    return writers.gone_snapshots(spark, base).withColumnRenamed("id", "snapshot_id")


def compact(spark: SparkSession, base: str) -> int:
    """Writes live snapshots that share a file with dropped ones again; returns how many."""
    held = _holdings(spark, base)
    gone = _gone(spark, base).select(*KEY)
    shared = held.join(gone, KEY, "left_semi").select("path").distinct()
    live = writers.live_manifest(spark, base)
    keys = live.select("root_id", F.col("id").alias("snapshot_id"), ATTEMPT)
    moved = held.join(shared, ["path"], "left_semi").select(*KEY).distinct().join(keys, KEY, "left_semi")
    moved = staged(moved, "moved")
    count = moved.count()
    if count:
        content = Content.load(spark, base).map_tables(lambda t: t.join(moved, KEY, "left_semi").drop(ATTEMPT))
        rows = live.join(moved.withColumnRenamed("snapshot_id", "id"), ["root_id", "id", ATTEMPT], "left_semi")
        # The manifest is read before the append that changes it.
        writers.write_snapshot(content, staged(rows.withColumnRenamed(ATTEMPT, writers.REPLACES), "rows"), base)
    return count


def vacuum(spark: SparkSession, base: str, grace_seconds: int = GRACE_SECONDS) -> int:
    """Deletes the files without a row that is live, or that a writer has not committed yet; returns how many.

    Tombstones and manifest rows stay. Files that still hold live rows wait for ``compact``.
    """
    held = _holdings(spark, base)
    old = F.unix_timestamp("logged_at") <= F.unix_timestamp(F.current_timestamp()) - grace_seconds
    gone = _gone(spark, base).filter(old).select(*KEY)
    needed = held.join(gone, KEY, "left_anti").select("path").distinct()
    doomed = held.select("path").distinct().join(needed, ["path"], "left_anti")
    path = F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return listing.delete_files(doomed.select(path.alias("path")))
