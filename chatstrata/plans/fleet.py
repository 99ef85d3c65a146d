"""One summary row per root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.operators import snapshots


def fleet_state(
    catalog: DataFrame, manifests: DataFrame, snapshot_catalog: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Profile, session and snapshot counts and the recovery decision of each root."""
    sessions = catalog.groupBy("root_id").agg(
        F.count("*").alias("session_count"),
        F.count_if("archived").alias("archived_sessions"),
        F.count_if(~F.col("exists_on_disk")).alias("missing_files"),
    )
    held = manifests.groupBy("root_id").agg(F.count("*").alias("snapshot_count"))
    counted = snapshots.recoverable_counts(manifests, snapshot_catalog)
    decided = snapshots.recovery_decision(sessions, snapshots.latest_restore_candidate(counted))
    profile = profiles.select("root_id", "model_provider", "model", "account_fingerprint")
    zero = F.lit(0)
    return (
        profile.join(sessions.drop("session_count"), ["root_id"], "full")
        .join(held, ["root_id"], "full")
        .join(decided, ["root_id"], "full")
        .select(
            "root_id",
            F.coalesce("model_provider", F.lit("unknown")).alias("model_provider"),
            F.coalesce("model", F.lit("unknown")).alias("model"),
            F.coalesce("account_fingerprint", F.lit("none")).alias("account_fingerprint"),
            F.coalesce("session_count", zero).alias("session_count"),
            F.coalesce("archived_sessions", zero).alias("archived_sessions"),
            F.coalesce("missing_files", zero).alias("missing_files"),
            F.coalesce("snapshot_count", zero).alias("snapshot_count"),
            "snapshot_id",
            "recoverable",
            F.coalesce("decision", F.lit("nothing")).alias("decision"),
        )
    )
