"""Snapshots: kinds, retention, sizes, candidates for recovery, file overlays."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import naming, paths, text
from chatstrata.operators import mentions
from chatstrata.operators.catalog import one_file_per_session, union_session_dirs
from chatstrata.operators.content import ROOT, SNAPSHOT
from chatstrata.session import staged


def _kind() -> Column:
    return naming.effective_kind(F.col("kind"), F.col("reason"), F.col("id"))


def _reason() -> Column:
    return naming.effective_reason(F.col("reason"), F.col("id"))


def filter_snapshots(snapshots: DataFrame, which: Literal["all", "manual", "system"] = "all") -> DataFrame:
    if which == "all":
        return snapshots
    is_manual = _kind() == "manual"
    return snapshots.filter(is_manual if which == "manual" else ~is_manual)


def sort_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("created_at"), "root_id", "id")


def apply_retention(
    snapshots: DataFrame,
    max_system: int = C.MAX_SYSTEM_SNAPSHOTS,
    max_auto: int = C.MAX_AUTO_PROTECT_SNAPSHOTS,
    key: Sequence[str] = ("root_id", "id"),
) -> DataFrame:
    """Adds ``keep``: per root the newest ``max_auto`` auto-protect snapshots, and of
    what is left the newest ``max_system`` that are not manual. Manual ones always
    stay; a negative limit means none.

    Only the newest few of each root leave a task, so a root with very many
    snapshots is no burden.
    """
    newest = [F.desc("created_at"), *[F.asc(name) for name in key]]
    others = snapshots.filter(_kind() != "manual").select(
        *key, "created_at", (_reason() == "auto-protect").alias("is_auto")
    )
    autos, rest = others.filter("is_auto"), others.filter("not is_auto")
    # A manual kind may carry the auto-protect reason; it counts among the first limit too.
    manual_autos = snapshots.filter((_kind() == "manual") & (_reason() == "auto-protect")).select(
        *key, "created_at", F.lit(True).alias("is_auto")
    )
    autos = autos.withColumn("manual", F.lit(False)).unionByName(manual_autos.withColumn("manual", F.lit(True)))
    dropped_manual = autos.filter(F.lit(False)).select(*key)
    if max_auto >= 0:
        ranked = autos.withColumn("nth", F.row_number().over(W.partitionBy("root_id").orderBy(*newest)))
        kept_autos = ranked.filter(F.col("nth") <= max_auto)
        dropped_manual = autos.filter("manual").join(kept_autos.select(*key), list(key), "left_anti").select(*key)
        autos = kept_autos
    left = rest.select(*key, "created_at").unionByName(autos.filter("not manual").select(*key, "created_at"))
    if max_system >= 0:
        ranked = left.withColumn("nth", F.row_number().over(W.partitionBy("root_id").orderBy(*newest)))
        left = ranked.filter(F.col("nth") <= max_system)
    verdicts = (
        left.select(*key)
        .withColumn("verdict", F.lit(True))
        .unionByName(dropped_manual.withColumn("verdict", F.lit(False)))
    )
    marked = snapshots.join(verdicts, list(key), "left")
    return marked.withColumn("keep", F.coalesce("verdict", _kind() == "manual")).drop("verdict")


def assign_snapshot_ids(requests: DataFrame, existing: DataFrame, order: str = "request") -> DataFrame:
    """Id of each request: time stamp and reason, with -2, -3, … when that is taken.

    Requests of one root within one second get their ids in the given order.
    """
    base_key = ["root_id", "base_id"]
    based = requests.withColumn("base_id", naming.snapshot_base_id(F.col("created_at"), F.col("reason")))
    based = based.withColumn("nth", F.row_number().over(W.partitionBy(*base_key).orderBy(order)))
    asked = based.groupBy(*base_key).agg(F.max("nth").alias("asked"))
    # Candidates: a number for each request and one more for each id that may be taken.
    taken = existing.select(
        "root_id", F.explode(F.array("id", F.regexp_replace("id", r"-\d+$", ""))).alias("base_id"), "id"
    )
    taken = taken.withColumn("more", F.row_number().over(W.partitionBy(*base_key).orderBy("id")))
    more = taken.join(asked, base_key).select(*base_key, (F.col("asked") + F.col("more")).alias("number"))
    numbers = based.select(*base_key, F.col("nth").alias("number")).unionByName(more)
    suffix = F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise("")
    free = numbers.withColumn("id", F.concat("base_id", suffix)).join(
        existing.select("root_id", "id"), ["root_id", "id"], "left_anti"
    )
    free = free.withColumn("nth", F.row_number().over(W.partitionBy(*base_key).orderBy("number")))
    return based.join(free.select(*base_key, "nth", "id"), [*base_key, "nth"]).drop("nth", "base_id")


def directory_sizes(files: DataFrame, by: Sequence[str] = ROOT) -> DataFrame:
    """Sum of file sizes; group by root, by snapshot, or by ``top_dir``."""
    return (
        files.withColumn("top_dir", paths.top_entry(F.col("rel_path")))
        .groupBy(*by)
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )


def file_counts(files: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Active and archived log files; files without a session id count too."""
    logs = files.filter(F.col("rel_path").endswith(".jsonl"))
    top = paths.top_entry(F.col("rel_path"))
    return logs.groupBy(*scope).agg(
        F.count_if(top == C.ACTIVE_DIR).alias("session_count"),
        F.count_if(top == C.ARCHIVED_DIR).alias("archived_session_count"),
    )


def snapshot_session_counts(ids: DataFrame, files: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Active and archived sessions among the ids, by the one file each has."""
    wanted = ids.select(*scope, F.lower("id").alias("id")).distinct()
    held = one_file_per_session(files, scope).join(wanted, [*scope, "id"], "left_semi")
    return held.groupBy(*scope).agg(
        F.count_if(F.col("dir_rank") == 0).alias("session_count"),
        F.count_if(F.col("dir_rank") == 1).alias("archived_session_count"),
    )


def recoverable_counts(snapshots: DataFrame, snapshot_catalog: DataFrame) -> DataFrame:
    """Adds ``recoverable``: sessions with a file, or the manifest's counts if there are none."""
    held = (
        snapshot_catalog.filter("exists_on_disk")
        .groupBy("root_id", F.col("snapshot_id").alias("id"))
        .agg(F.count("*").alias("held"))
    )
    stated = F.coalesce("session_count", F.lit(0)) + F.coalesce("archived_session_count", F.lit(0))
    return (
        snapshots.join(held, ["root_id", "id"], "left")
        .withColumn("recoverable", F.when(F.col("held") > 0, F.col("held")).otherwise(stated).cast("bigint"))
        .drop("held")
    )


def latest_restore_candidate(counted: DataFrame) -> DataFrame:
    """Per root the newest manual or auto-protect snapshot that has sessions to recover."""
    fit = ((_kind() == "manual") | (_reason() == "auto-protect")) & (F.col("recoverable") > 0)
    newest = W.partitionBy("root_id").orderBy(F.desc("created_at"), "id")
    return (
        counted.filter(fit).withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") == 1).drop("nth")
    )


def recovery_decision(current: DataFrame, candidates: DataFrame, restore_only: bool = False) -> DataFrame:
    """What to do per root: ``current(root_id, session_count)`` against
    ``candidates(root_id, id, recoverable)``. ``restore_only`` reports nothing
    but restores."""
    both = current.select("root_id", "session_count").join(
        candidates.select("root_id", F.col("id").alias("snapshot_id"), "recoverable"), ["root_id"], "full"
    )
    now = F.coalesce("session_count", F.lit(0)).cast("bigint")
    decision = (
        F.when(F.col("recoverable").isNull() & (now > 0), "protect")
        .when(F.col("recoverable").isNull(), "nothing")
        .when(F.col("recoverable") > now, "restore")
        .when(now > F.col("recoverable"), "protect")
        .otherwise("ok")
    )
    decided = both.select("root_id", "snapshot_id", now.alias("session_count"), "recoverable", decision.alias("decision"))
    return decided.filter(F.col("decision") == "restore") if restore_only else decided


def missing_sessions(snapshot_catalog: DataFrame, current: DataFrame) -> DataFrame:
    """Sessions of the snapshot that the current catalog lacks."""
    return snapshot_catalog.join(current.select("root_id", "id"), ["root_id", "id"], "left_anti")


def latest_snapshot_with_session(
    snapshots: DataFrame, snapshot_files: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """For each session the newest snapshot that holds its file."""
    held = union_session_dirs(snapshot_files)
    if ids is not None:
        wanted = ids.select("root_id", F.lower("id").alias("id"))
        held = held.join(wanted, ["root_id", "id"], "left_semi")
    dated = held.join(
        snapshots.select("root_id", F.col("id").alias("snapshot_id"), "created_at"), list(SNAPSHOT)
    )
    order = W.partitionBy("root_id", "id").orderBy(F.desc("created_at"), "snapshot_id", "dir_rank", "rel_path")
    return (
        dated.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") == 1)
        .select("root_id", "id", "snapshot_id", "rel_path", "size_bytes")
    )


def included_paths(files: DataFrame, extra: DataFrame | None = None, scope: Sequence[str] = ROOT) -> DataFrame:
    """Sorted top-level entries of the content, with those of ``extra(path)``."""
    entries = files.select(*scope, paths.top_entry(F.col("rel_path")).alias("path"))
    if extra is not None:
        entries = entries.unionByName(extra.select(*scope, "path"))
    # A handful of entries per root is left by the distinct.
    return entries.distinct().groupBy(*scope).agg(F.array_sort(F.collect_list("path")).alias("included_paths"))


def overlay_files(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Directory merge: a snapshot file replaces the one at its path, the others stay."""
    kept = current.join(snapshot.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_anti")
    return kept.select(*current.columns).unionByName(snapshot.select(*current.columns))


def _named_after(files: DataFrame, ids: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Paths of the files whose name contains one of the ids."""
    named = files.select(*scope, "rel_path", paths.base_name(F.col("rel_path")).alias("text"))
    # written, as the driver holds the whole plan of a job
    return staged(mentions.containing(named, ids, [*scope, "rel_path"], scope), "named")


def _is_kind(kind: str) -> Column:
    top = paths.top_entry(F.col("rel_path"))
    if kind == "shell":
        return top == C.SHELL_DIR
    return top.isin(C.ACTIVE_DIR, C.ARCHIVED_DIR) & F.col("rel_path").endswith(".jsonl")


def select_snapshot_files(
    files: DataFrame,
    ids: DataFrame,
    kind: Literal["logs", "shell"] = "logs",
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """Files named after the sessions; shell snapshots end up directly in their
    directory, where the last of equal names wins."""
    chosen = files.filter(_is_kind(kind))
    chosen = chosen.join(_named_after(chosen, ids, scope), [*scope, "rel_path"], "left_semi")
    if kind == "logs":
        return chosen.select(*files.columns)
    flat = F.concat(F.lit(f"{C.SHELL_DIR}/"), paths.base_name(F.col("rel_path")))
    same = W.partitionBy(*scope, "flat").orderBy(F.desc("rel_path"))
    last = (
        chosen.withColumn("flat", flat).withColumn("nth", F.row_number().over(same)).filter(F.col("nth") == 1)
    )
    return last.withColumn("rel_path", F.col("flat")).select(*files.columns)


def remove_session_files(files: DataFrame, ids: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """All files but the logs and shell snapshots named after the sessions."""
    named = _named_after(files.filter(_is_kind("logs") | _is_kind("shell")), ids, scope)
    return files.join(named, [*scope, "rel_path"], "left_anti").select(*files.columns)


def skipped_files(
    inventory: DataFrame, copied: DataFrame, cap: int | None = None, scope: Sequence[str] = ROOT
) -> DataFrame:
    """Report of the files that were listed but not copied: all of them, or the first
    ``cap`` per root and one row that says how many more there are."""
    missing = inventory.select(*scope, "rel_path").join(
        copied.select(*scope, "rel_path"), [*scope, "rel_path"], "left_anti"
    )
    ordered = missing.withColumn("nth", F.row_number().over(W.partitionBy(*scope).orderBy("rel_path")))
    if cap is None:
        return ordered.select(*scope, "nth", F.col("rel_path").alias("message"))
    first = ordered.filter(F.col("nth") <= cap).select(*scope, "nth", F.col("rel_path").alias("message"))
    more = missing.groupBy(*scope).agg((F.count("*") - cap).alias("more")).filter("more > 0")
    said = F.concat(F.lit(C.MORE_SKIPPED), F.lit(" ("), F.col("more").cast("string"), F.lit(")"))
    return first.unionByName(more.select(*scope, F.lit(cap + 1).alias("nth"), said.alias("message")))


def profile_state(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Per root: provider and model from the config, account fingerprint, log file counts.

    ``profiles(root_id, rel_path, content)`` has at most two small rows per root.
    """
    config = F.max(F.when(F.col("rel_path") == C.CONFIG_FILE, F.col("content")))
    account = F.max(F.when(F.col("rel_path") == C.AUTH_FILE, F.col("content")))
    known = profiles.groupBy("root_id").agg(config.alias("config"), account.alias("account"))
    both = known.join(file_counts(files), ["root_id"], "full")
    unknown = F.lit("unknown")
    return both.select(
        "root_id",
        F.coalesce(text.config_string(F.col("config"), "model_provider"), unknown).alias("model_provider"),
        F.coalesce(text.config_string(F.col("config"), "model"), unknown).alias("model"),
        text.fingerprint(F.col("account")).alias("account_fingerprint"),
        F.coalesce("session_count", F.lit(0)).alias("session_count"),
        F.coalesce("archived_session_count", F.lit(0)).alias("archived_session_count"),
    )
