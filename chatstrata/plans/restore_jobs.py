"""Restoring from snapshots and deleting sessions.

A job takes the content of snapshots and the current content of the roots and
returns the new content; its ``attachments`` are those to put back in place.
``chosen`` has the manifest row of one snapshot per root: root_id, id,
snapshot_root, included_paths. ``roots(root_id, root_path)`` says where the
current roots lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import paths
from chatstrata.operators import attachments, lines, snapshots, state
from chatstrata.operators.content import ROOT, SNAPSHOT, Content
from chatstrata.operators.lines import Match
from chatstrata.plans.snapshot_jobs import (
    ProtectionMode,
    create_protection_snapshot,
    restorable_sessions,
    snapshot_catalog,
)
from chatstrata.session import staged


def _chosen(manifest: DataFrame) -> DataFrame:
    """What a job reads of the manifest rows, which every table is joined with."""
    return staged(manifest.select("root_id", "id", "snapshot_root", "included_paths"), "chosen")


def _snapshot_roots(chosen: DataFrame) -> DataFrame:
    return chosen.select("root_id", F.col("id").alias("snapshot_id"), F.col("snapshot_root").alias("root_path"))


def _dates(manifest: DataFrame) -> DataFrame:
    """When each snapshot was made; null where the manifest does not say."""
    at = F.col("created_at") if "created_at" in manifest.columns else F.lit(None).cast("timestamp")
    return manifest.select("root_id", F.col("id").alias("snapshot_id"), at.alias("snapshot_at"))


def _content_of(store: Content, chosen: DataFrame) -> Content:
    """Content of the chosen snapshots, one per root."""
    of = _snapshot_roots(chosen).drop("root_path")
    return store.map_tables(lambda table: table.join(of, list(SNAPSHOT), "left_semi").drop("snapshot_id"))


def _included(chosen: DataFrame) -> DataFrame:
    return chosen.select("root_id", F.explode("included_paths").alias("top")).distinct()


def _within(table: DataFrame, included: DataFrame) -> DataFrame:
    """Rows whose top-level entry is part of the snapshot of their root."""
    topped = table.withColumn("top", paths.top_entry(F.col("rel_path")))
    return topped.join(included, ["root_id", "top"], "left_semi").drop("top").select(*table.columns)


def _overlay_bodies(current: Content, files: DataFrame, bodies: DataFrame | None) -> DataFrame | None:
    """Log lines after the given files have replaced the current ones."""
    if current.bodies is None or bodies is None:
        return current.bodies
    key = ["root_id", "rel_path"]
    kept = current.bodies.join(files.select(*key), key, "left_anti")
    added = bodies.join(files.select(*key), key, "left_semi")
    return kept.select(*current.bodies.columns).unionByName(added.select(*current.bodies.columns))


def _merged_lines(
    current: DataFrame, source: DataFrame, added: DataFrame, unique_key: lines.UniqueKey = None
) -> DataFrame:
    """Current line files with the added lines; files the source lacks stay untouched."""
    file = ["root_id", "rel_path"]
    touched = source.select(*file).distinct()
    columns = current.columns
    merged = lines.merge_lines(current.join(touched, file, "left_semi"), added, None, unique_key)
    return merged.select(*columns).unionByName(current.join(touched, file, "left_anti").select(*columns))


def _repaired(tables: state.Tables, files: DataFrame, roots: DataFrame, ids: DataFrame) -> state.Tables:
    if "threads" not in tables:
        return tables
    threads = tables["threads"].join(roots.select("root_id", "root_path"), ["root_id"], "left")
    repaired = state.repair_rollout_paths(threads, files, F.col("root_path"), ids)
    return {**tables, "threads": repaired.drop("root_path")}


def _attachments_back(
    snapshot: Content, stored: DataFrame | None, in_place: DataFrame | None, ids: DataFrame | None
) -> DataFrame | None:
    if snapshot.attachments is None or in_place is None:
        return None
    copies = snapshot.attachments.select("root_id", "stored_path") if stored is None else stored
    return attachments.restore_attachments(snapshot.attachments, copies, in_place, ids)


def restore_conversations(
    store: Content,
    chosen: DataFrame,
    current: Content,
    roots: DataFrame,
    keys: dict[str, list[str]] | None = None,
    in_place: DataFrame | None = None,
) -> Content:
    """Merge the conversations of a snapshot into each root; account and provider
    settings stay."""
    chosen = _chosen(chosen)
    snapshot, included = _content_of(store, chosen), _included(chosen)
    states = snapshot.states.join(
        included.filter(F.col("top") == C.STATE_FILE).select("root_id"), ["root_id"], "left_semi"
    )
    states = staged(states, "states")
    snapshot_roots = _snapshot_roots(chosen).drop("snapshot_id")
    ids = restorable_sessions(snapshot, snapshot_roots, ROOT).join(states, ["root_id"], "left_semi")
    ids = staged(ids, "restorable")

    added = _within(snapshot.files.filter(paths.top_entry(F.col("rel_path")).isin(C.CONVERSATION_DIRS)), included)
    files = snapshots.overlay_files(current.files, added)

    listed = _within(snapshot.lines.filter(F.col("rel_path").isin(C.LINE_FILES)), included)
    of_sessions = lines.keep_lines(listed.join(states, ["root_id"], "left_semi"), ids)
    unfiltered = listed.join(states, ["root_id"], "left_anti")
    added_lines = of_sessions.unionByName(unfiltered.select(*of_sessions.columns))
    merged = _merged_lines(current.lines, listed, added_lines, lines.LINE_FILE_KEYS)

    with_ids = ids.select("root_id").distinct()
    source = {name: rows.join(with_ids, ["root_id"], "left_semi") for name, rows in snapshot.tables.items()}
    tables = _repaired(state.merge_state(current.tables, current.states, source, ids, keys), files, roots, ids)
    return Content(
        files=files,
        lines=merged,
        states=current.states.select("root_id").unionByName(with_ids).distinct(),
        tables=tables,
        bodies=_overlay_bodies(current, added, snapshot.bodies),
        attachments=_attachments_back(snapshot, None, in_place, ids),
    )


def restore_full(
    store: Content,
    chosen: DataFrame,
    current: Content,
    roots: DataFrame,
    in_place: DataFrame | None = None,
) -> Content:
    """Replace every entry the snapshot has, then drop what belongs to sessions
    without a log file in it."""
    chosen = _chosen(chosen)
    snapshot, included = _content_of(store, chosen), _included(chosen)
    states = snapshot.states.join(
        included.filter(F.col("top") == C.STATE_FILE).select("root_id"), ["root_id"], "left_semi"
    )
    states = staged(states, "states")
    ids = restorable_sessions(snapshot, _snapshot_roots(chosen).drop("snapshot_id"), ROOT)
    ids = staged(ids.join(states, ["root_id"], "left_semi"), "restorable")

    def replaced(now: DataFrame, then: DataFrame) -> DataFrame:
        """Entries of the snapshot instead of the current ones of the same name."""
        then = _within(then, included)
        entries = then.select("root_id", paths.top_entry(F.col("rel_path")).alias("top")).distinct()
        kept = now.withColumn("top", paths.top_entry(F.col("rel_path"))).join(entries, ["root_id", "top"], "left_anti")
        return kept.select(*now.columns).unionByName(then.select(*now.columns))

    files = replaced(current.files, snapshot.files)
    bodies = current.bodies
    if bodies is not None and snapshot.bodies is not None:
        bodies = replaced(bodies, snapshot.bodies)
    restored_lines = replaced(current.lines, snapshot.lines)
    with_state = _within(restored_lines.join(states, ["root_id"], "left_semi"), included)
    filtered = lines.filter_lines(with_state, ids, "mention", lines.LINE_FILE_KEYS)
    line_keys = ["root_id", "rel_path", "line_no"]
    untouched = restored_lines.join(with_state.select(*line_keys), line_keys, "left_anti")

    tables: state.Tables = {}
    for name in {**current.tables, **snapshot.tables}:
        old, new = current.tables.get(name), snapshot.tables.get(name)
        if old is not None:
            old = old.join(states, ["root_id"], "left_anti").select(*old.columns)
        if new is not None:
            new = new.join(states, ["root_id"], "left_semi").select(*new.columns)
            if name in C.STATE_TABLE_KEYS:
                new = state.prune_state({name: new}, ids)[name]
        tables[name] = new if old is None else old if new is None else old.unionByName(new, allowMissingColumns=True)
    return Content(
        files=files,
        lines=filtered.select(*current.lines.columns).unionByName(untouched.select(*current.lines.columns)),
        states=current.states.select("root_id").unionByName(states.select("root_id")).distinct(),
        tables=_repaired(tables, files, roots, ids),
        bodies=bodies,
        attachments=_attachments_back(snapshot, None, in_place, ids if "threads" in tables else None),
    )


def restore_sessions(
    store: Content,
    chosen: DataFrame,
    ids: DataFrame,
    current: Content,
    roots: DataFrame,
    match: Match = "key",
    keys: dict[str, list[str]] | None = None,
    in_place: DataFrame | None = None,
) -> Content:
    """Bring single sessions ``ids(root_id, id)`` back from the chosen snapshot of their
    root; an error if the snapshots hold a file for none of them."""
    wanted = ids.join(chosen.select("root_id", F.col("id").alias("snapshot_id")), ["root_id"])
    return _restore_picked(
        store, chosen, wanted.select(*SNAPSHOT, "id"), current, roots, match, keys, in_place
    )


def restore_from_latest(
    store: Content,
    manifest: DataFrame,
    ids: DataFrame,
    current: Content,
    roots: DataFrame,
    match: Match = "key",
    keys: dict[str, list[str]] | None = None,
    in_place: DataFrame | None = None,
) -> Content:
    """Bring each session back from the newest snapshot that holds its file, all
    source snapshots in one job."""
    latest = snapshots.latest_snapshot_with_session(manifest, store.files, ids)
    picked = staged(latest.select(*SNAPSHOT, "id"), "picked")
    return _restore_picked(store, manifest, picked, current, roots, match, keys, in_place)


def _restore_picked(
    store: Content,
    manifest: DataFrame,
    picked: DataFrame,
    current: Content,
    roots: DataFrame,
    match: Match,
    keys: dict[str, list[str]] | None,
    in_place: DataFrame | None,
) -> Content:
    """``picked(root_id, snapshot_id, id)``: which session from which snapshot."""
    involved = picked.select(*SNAPSHOT).distinct()
    snapshot = store.map_tables(lambda table: table.join(involved, list(SNAPSHOT), "left_semi").select(*table.columns))
    dates = _dates(manifest).join(involved, list(SNAPSHOT), "left_semi")
    sessions = snapshot_catalog(snapshot, _snapshot_roots(manifest).join(involved, list(SNAPSHOT), "left_semi"), SNAPSHOT)
    found = sessions.filter("exists_on_disk").join(picked, [*SNAPSHOT, "id"], "left_semi")
    found = staged(found.select(*SNAPSHOT, "id", F.col("rollout_path").alias("rel_path")), "found")
    if found.isEmpty():
        raise ValueError("no snapshot holds a log file of the sessions to restore")
    scoped_ids, ids = found.select(*SNAPSHOT, "id"), found.select("root_id", "id").distinct()

    logs = snapshot.files.join(found.select(*SNAPSHOT, "rel_path"), [*SNAPSHOT, "rel_path"], "left_semi")
    shell = snapshots.select_snapshot_files(snapshot.files, scoped_ids, "shell", SNAPSHOT)
    added = logs.select(*shell.columns).unionByName(shell)
    # Two snapshots may hold the same shell snapshot; the one made later counts.
    added = added.join(dates, list(SNAPSHOT)).groupBy("root_id", "rel_path").agg(
        *[
            F.max_by(name, F.struct("snapshot_at", "snapshot_id")).alias(name)
            for name in current.files.columns
            if name not in ("root_id", "rel_path")
        ]
    )
    added = staged(added.select(*current.files.columns), "added")
    files = snapshots.overlay_files(current.files, added)

    bodies = current.bodies
    if bodies is not None and snapshot.bodies is not None:
        key = [*SNAPSHOT, "rel_path"]
        of_found = snapshot.bodies.join(found.select(*key), key, "left_semi").select(*bodies.columns)
        bodies = _overlay_bodies(current, added, of_found)

    added_lines = lines.keep_lines(snapshot.lines, scoped_ids, match, SNAPSHOT)
    # Only snapshots that give a session back touch the line files of their root.
    sources = snapshot.lines.join(found.select(*SNAPSHOT).distinct(), list(SNAPSHOT), "left_semi")
    merged = _merged_lines(current.lines, sources, added_lines)

    tables = current.tables
    chosen_rows = state.select_state(snapshot.tables, scoped_ids, SNAPSHOT)
    existing = current.states.select("root_id").distinct()
    source = {
        name: rows.join(existing, ["root_id"], "left_semi").join(dates, list(SNAPSHOT))
        for name, rows in chosen_rows.items()
    }
    tables = state.upsert_state(tables, source, keys, order_by=("snapshot_at", "snapshot_id"))
    allowed = None
    if snapshot.attachments is not None:
        of_found = snapshot.attachments.join(
            scoped_ids.withColumnRenamed("id", "session_id"), [*SNAPSHOT, "session_id"], "left_semi"
        )
        allowed = snapshot.with_(attachments=of_found.drop("snapshot_id").distinct())
    return Content(
        files=files,
        lines=merged,
        states=current.states,
        tables=_repaired(tables, files, roots, ids),
        bodies=bodies,
        attachments=None if allowed is None else _attachments_back(allowed, None, in_place, None),
    )


def delete_sessions(
    current: Content,
    ids: DataFrame,
    requests: DataFrame,
    profiles: DataFrame,
    match: Match = "key",
    mode: ProtectionMode = "lightweight",
) -> tuple[Content, tuple[Content, DataFrame]]:
    """Remove sessions from the current content. The protection snapshot that has to be
    written first comes second in the result."""
    ids = staged(ids.select("root_id", "id"), "sessions")
    protection = create_protection_snapshot(current, requests, profiles, ids, mode)
    files = snapshots.remove_session_files(current.files, ids)
    bodies = current.bodies
    if bodies is not None:
        key = ["root_id", "rel_path"]
        bodies = bodies.join(files.select(*key), key, "left_semi").select(*bodies.columns)
    left = current.with_(
        files=files,
        lines=lines.delete_lines(current.lines, ids, match),
        tables=state.delete_state(current.tables, ids),
        bodies=bodies,
    )
    return left, protection
