"""Creating, sanitizing and deleting snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import naming, paths
from chatstrata.operators import attachments, catalog, lines, snapshots, state
from chatstrata.operators.content import SNAPSHOT, Content
from chatstrata.session import staged
from chatstrata.sources.scans import parse_history, parse_session_index

ProtectionMode = Literal["lightweight", "full"]
APP_VERSION = "chatstrata-1"


def _resolved_threads(content: Content, roots: DataFrame, scope: Sequence[str]) -> DataFrame | None:
    """Threads with the file they have in the content; ``roots`` gives ``root_path``."""
    if "threads" not in content.tables:
        return None
    threads = content.tables["threads"]
    rooted = threads.join(roots.select(*scope, "root_path"), list(scope), "left")
    resolved = catalog.resolve_rollout_files(rooted, content.files, F.col("root_path"), scope=scope)
    return resolved.drop("root_path")


def restorable_sessions(content: Content, roots: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Ids of the sessions of a content whose log file is there."""
    resolved = _resolved_threads(content, roots, scope)
    if resolved is None:
        return catalog.session_files(content.files).select(*scope, "id").distinct()
    resolved = staged(resolved.select(*scope, "id", "exists_on_disk"), "resolved")
    return catalog.restorable_ids(resolved, content.files, scope)


def snapshot_catalog(content: Content, roots: DataFrame, scope: Sequence[str] = SNAPSHOT) -> DataFrame:
    """Catalog of a content; titles and flags come from its lines."""
    file_catalog = content_file_catalog(content, scope)
    resolved = _resolved_threads(content, roots, scope)
    if resolved is None:
        return file_catalog
    return catalog.load_snapshot_catalog(resolved, file_catalog, scope)


def content_file_catalog(content: Content, scope: Sequence[str]) -> DataFrame:
    bodies = content.bodies
    if bodies is None:
        no_lines = content.lines.filter(F.lit(False))
        metadata = catalog.rollout_metadata(no_lines, scope=scope)
    else:
        metadata = catalog.rollout_metadata(bodies, scope=scope)
    history = parse_history(content.lines.filter(F.col("rel_path") == C.HISTORY_FILE), scope)
    index = parse_session_index(content.lines.filter(F.col("rel_path") == C.INDEX_FILE), scope)
    return catalog.catalog_from_files(
        content.files,
        metadata,
        catalog.title_map(history, index, scope),
        catalog.archived_map(history, scope),
        scope,
    )


def sanitize_snapshot(
    content: Content, roots: DataFrame, scope: Sequence[str] = SNAPSHOT, restorable: DataFrame | None = None
) -> Content:
    """Drop what belongs to sessions without a log file.

    Only where there is a state database: its tables are pruned, the paths of its
    threads repaired to ``root_path``, and the line files filtered. ``restorable``
    names the sessions that have a file, if they are known.
    """
    if restorable is None:
        restorable = staged(restorable_sessions(content, roots, scope), "restorable")
    ids = restorable.join(content.states, list(scope), "left_semi")
    tables = state.prune_state(content.tables, ids, scope)
    if "threads" in tables:
        threads = tables["threads"].join(roots.select(*scope, "root_path"), list(scope), "left")
        repaired = state.repair_rollout_paths(threads, content.files, F.col("root_path"), ids, scope)
        tables["threads"] = repaired.drop("root_path")
    with_state = content.lines.join(content.states, list(scope), "left_semi")
    without_state = content.lines.join(content.states, list(scope), "left_anti")
    filtered = lines.filter_lines(with_state, ids, "mention", lines.LINE_FILE_KEYS, scope)
    return content.with_(
        tables=tables, lines=filtered.select(*content.lines.columns).unionByName(without_state)
    )


def _content_sizes(content: Content) -> DataFrame:
    """Files as they are, but line files by the lines that are left of them."""
    unchanged = content.files.filter(~F.col("rel_path").isin(C.LINE_FILES)).select(*SNAPSHOT, "rel_path", "size_bytes")
    rewritten = content.lines.groupBy(*SNAPSHOT, "rel_path").agg(
        F.sum(F.octet_length("line") + 1).alias("size_bytes")
    )
    sized = unchanged.unionByName(rewritten)
    if content.attachments is not None:
        sized = sized.unionByName(
            content.attachments.select(*SNAPSHOT, F.col("stored_path").alias("rel_path"), "size_bytes")
        )
    return snapshots.directory_sizes(sized, SNAPSHOT)


def _with_attachments(content: Content, ids: DataFrame, inventory: DataFrame | None) -> Content:
    """Content with the manifest of the attachments its sessions name.

    ``inventory(root_id, path, size_bytes)`` lists the files outside the roots;
    only roots with a state database take attachments along.
    """
    if inventory is None or content.bodies is None:
        return content
    logs = catalog.one_file_per_session(content.files, SNAPSHOT).select(
        *SNAPSHOT, "rel_path", F.col("id").alias("session_id")
    )
    named = content.bodies.join(logs, [*SNAPSHOT, "rel_path"])
    wanted = ids.join(content.states, list(SNAPSHOT), "left_semi").select("root_id", F.lower("id").alias("id"))
    manifest = attachments.collect_attachments(named, wanted, inventory)
    # A root has one new snapshot at a time.
    of_root = ids.select(*SNAPSHOT).distinct()
    return content.with_(attachments=staged(manifest.join(of_root, ["root_id"]), "attachments"))


def _manifest(
    content: Content,
    requests: DataFrame,
    profiles: DataFrame,
    ids: DataFrame,
    warnings: DataFrame | None,
    by_files: DataFrame | None = None,
) -> DataFrame:
    """One manifest row per request. Roots without a state database have the counts
    of their profile, but for those in ``by_files(root_id, by_files)``."""
    key = list(SNAPSHOT)
    counts = snapshots.snapshot_session_counts(ids, content.files, SNAPSHOT)
    state_entry = content.states.select(*key, F.lit(C.STATE_FILE).alias("path"))
    if content.attachments is not None:
        entry = content.attachments.select(*key, F.lit(C.ATTACHMENT_DIR).alias("path"))
        state_entry = state_entry.unionByName(entry)
    included = snapshots.included_paths(content.files, state_entry, SNAPSHOT)
    profiles = profiles.select("root_id", *_PROFILE)
    if by_files is None:
        profiles = profiles.withColumn("by_files", F.lit(None).cast("boolean"))
    else:
        profiles = profiles.join(by_files, ["root_id"], "left")
    rows = (
        requests.join(profiles, ["root_id"], "left")
        .join(content.states.select(*key, F.lit(True).alias("has_state")), key, "left")
        .join(counts.select(*key, F.col("session_count").alias("n"), F.col("archived_session_count").alias("na")), key, "left")
        .join(_content_sizes(content), key, "left")
        .join(included, key, "left")
    )
    no_strings = F.array().cast("array<string>")
    if warnings is None:
        rows = rows.withColumn("warnings", no_strings)
    else:
        texts = warnings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "message"))).alias("w"))
        rows = rows.join(texts, key, "left").withColumn("warnings", F.coalesce(F.col("w.message"), no_strings))
    unknown = F.lit("unknown")
    provider, model = F.coalesce("model_provider", unknown), F.coalesce("model", unknown)
    zero, by_ids = F.lit(0), F.coalesce("has_state", "by_files")
    return rows.select(
        "root_id",
        F.col("snapshot_id").alias("id"),
        F.coalesce(
            F.when(F.col("name") != "", F.col("name")),
            naming.default_snapshot_name(F.col("reason"), provider, model),
        ).alias("name"),
        "created_at",
        F.col("root_path").alias("snapshot_root"),
        "reason",
        naming.effective_kind(F.lit(None).cast("string"), F.col("reason"), F.lit("")).alias("kind"),
        provider.alias("model_provider"),
        model.alias("model"),
        F.coalesce("account_fingerprint", F.lit("none")).alias("account_fingerprint"),
        F.when(by_ids, F.coalesce("n", zero)).otherwise(F.coalesce("session_count", zero)).alias("session_count"),
        F.when(by_ids, F.coalesce("na", zero))
        .otherwise(F.coalesce("archived_session_count", zero))
        .alias("archived_session_count"),
        F.coalesce("size_bytes", zero).alias("size_bytes"),
        F.coalesce("included_paths", no_strings).alias("included_paths"),
        F.lit(APP_VERSION).alias("app_version"),
        "warnings",
    )


_PROFILE = ["model_provider", "model", "account_fingerprint", "session_count", "archived_session_count"]


def _roots(requests: DataFrame) -> DataFrame:
    """Key and path of the requested roots, which every table is joined with."""
    return staged(requests.select(*SNAPSHOT, F.col("root_path").cast("string").alias("root_path")), "requests")


def _taken(current: Content, roots: DataFrame, candidates: Sequence[str]) -> Content:
    """Current content below the candidate paths, under the id of the new snapshot."""
    new_ids = roots.select("root_id", "snapshot_id")
    side_files = [C.STATE_FILE, *C.STATE_SIDE_FILES]
    stamped = current.map_tables(lambda table: table.join(new_ids, ["root_id"]))
    wanted = [path for path in candidates if path not in C.STATE_SIDE_FILES]
    in_candidates = paths.top_entry(F.col("rel_path")).isin(list(wanted))
    with_state = C.STATE_FILE in candidates
    # The database itself is in the tables; its size stays in the inventory.
    files = stamped.files.filter(in_candidates)
    if not with_state:
        files = files.filter(~F.col("rel_path").isin(side_files))
    return stamped.with_(
        files=files,
        lines=stamped.lines.filter(F.col("rel_path").isin(list(wanted))),
        tables=stamped.tables if with_state else {},
        states=staged(stamped.states if with_state else stamped.states.filter(F.lit(False)), "states"),
        attachments=None,
    )


def create_snapshot(
    current: Content,
    requests: DataFrame,
    profiles: DataFrame,
    candidates: Sequence[str] = tuple(C.BACKUP_PATHS),
    warnings: DataFrame | None = None,
    attachment_files: DataFrame | None = None,
) -> tuple[Content, DataFrame]:
    """Snapshot each requested root: content and manifest rows.

    ``requests(root_id, snapshot_id, root_path, reason, name, created_at)`` has one
    row per root, ``profiles`` is the profile state, ``warnings(root_id,
    snapshot_id, nth, message)`` the report on skipped files, ``attachment_files``
    the inventory of files outside the roots.
    """
    content, ids = _whole_content(current, requests, candidates, attachment_files)
    return content, _manifest(content, requests, profiles, ids, warnings)


def _whole_content(
    current: Content, requests: DataFrame, candidates: Sequence[str], attachment_files: DataFrame | None
) -> tuple[Content, DataFrame]:
    """Content of new snapshots, and the sessions of it that have a file."""
    roots = _roots(requests)
    taken = _taken(current, roots, candidates)
    ids = staged(restorable_sessions(taken, roots, SNAPSHOT), "restorable")
    return _with_attachments(sanitize_snapshot(taken, roots, SNAPSHOT, ids), ids, attachment_files), ids


def create_protection_snapshot(
    current: Content,
    requests: DataFrame,
    profiles: DataFrame,
    sessions: DataFrame,
    mode: ProtectionMode = "lightweight",
    full_candidates: Sequence[str] = tuple(C.BACKUP_PATHS),
    extra_paths: Sequence[str] = (),
    attachment_files: DataFrame | None = None,
    warnings: DataFrame | None = None,
) -> tuple[Content, DataFrame]:
    """Snapshot to fall back on before sessions are changed.

    'lightweight' takes only what belongs to ``sessions(root_id, id)`` and the
    extra paths; 'full', and roots without any session, take everything.
    """
    if mode == "full":
        return create_snapshot(current, requests, profiles, full_candidates, warnings, attachment_files)
    with_sessions = staged(sessions.select("root_id").distinct(), "with-sessions")
    light = requests.join(with_sessions, ["root_id"], "left_semi")
    whole = requests.join(with_sessions, ["root_id"], "left_anti")
    light_content, light_ids = _lightweight_content(current, light, sessions, extra_paths, attachment_files)
    whole_content, whole_ids = _whole_content(current, whole, full_candidates, attachment_files)
    content, ids = union_contents(light_content, whole_content), light_ids.unionByName(whole_ids)
    # In lightweight snapshots the files tell the counts, with or without a state database.
    by_files = with_sessions.withColumn("by_files", F.lit(True))
    return content, _manifest(content, requests, profiles, ids, warnings, by_files)


def _lightweight_content(
    current: Content,
    requests: DataFrame,
    sessions: DataFrame,
    extra_paths: Sequence[str],
    attachment_files: DataFrame | None,
) -> tuple[Content, DataFrame]:
    """Content of new snapshots of some sessions, and those of them that have a file."""
    key = list(SNAPSHOT)
    roots = _roots(requests)
    extras = [path for path in extra_paths if path not in (*C.LINE_FILES, C.STATE_FILE, *C.STATE_SIDE_FILES)]
    taken = _taken(current, roots, [*C.CONVERSATION_PATHS, *extras])
    ids = staged(sessions.join(roots.select(*key), ["root_id"]).select(*key, "id"), "sessions")
    files = taken.files
    own = snapshots.select_snapshot_files(files, ids, "logs", SNAPSHOT)
    shell = snapshots.select_snapshot_files(files, ids, "shell", SNAPSHOT)
    listed = files.filter(F.col("rel_path").isin([*C.LINE_FILES, C.STATE_FILE]))
    extra = files.filter(paths.top_entry(F.col("rel_path")).isin(extras))
    filtered = lines.filter_lines(taken.lines, ids, "mention", lines.LINE_FILE_KEYS, SNAPSHOT)
    chosen = staged(own.unionByName(shell).unionByName(listed).unionByName(extra), "files")
    content = taken.with_(
        files=chosen,
        lines=filtered.select(*taken.lines.columns),
        bodies=_bodies_of(taken.bodies, catalog.session_files(chosen)),
    )
    counted = staged(restorable_sessions(content, roots, SNAPSHOT), "restorable")
    return _with_attachments(sanitize_snapshot(content, roots, SNAPSHOT, counted), counted, attachment_files), counted


def _bodies_of(bodies: DataFrame | None, files: DataFrame) -> DataFrame | None:
    if bodies is None:
        return None
    key = [*SNAPSHOT, "rel_path"]
    return bodies.join(files.select(*key), key, "left_semi").select(*bodies.columns)


def union_contents(a: Content, b: Content) -> Content:
    """Content of disjoint snapshots in one set of tables."""

    def union(x: DataFrame | None, y: DataFrame | None) -> DataFrame | None:
        if x is None or y is None:
            return x if y is None else y
        return x.unionByName(y, allowMissingColumns=True)

    names = [*a.tables, *[name for name in b.tables if name not in a.tables]]
    return Content(
        files=union(a.files, b.files),
        lines=union(a.lines, b.lines),
        states=union(a.states, b.states),
        tables={name: union(a.tables.get(name), b.tables.get(name)) for name in names},
        bodies=union(a.bodies, b.bodies),
        attachments=union(a.attachments, b.attachments),
    )


def enforce_retention(
    content: Content,
    manifest: DataFrame,
    max_system: int = C.MAX_SYSTEM_SNAPSHOTS,
    max_auto: int = C.MAX_AUTO_PROTECT_SNAPSHOTS,
) -> tuple[Content, DataFrame]:
    """What is left of a snapshot store after the retention rule."""
    judged = snapshots.apply_retention(manifest, max_system, max_auto)
    return _without_snapshots(content, manifest, judged.filter(~F.col("keep")))


def add_snapshots(
    store: Content,
    manifest: DataFrame,
    taken: Content,
    rows: DataFrame,
    max_system: int = C.MAX_SYSTEM_SNAPSHOTS,
    max_auto: int = C.MAX_AUTO_PROTECT_SNAPSHOTS,
) -> tuple[Content, DataFrame]:
    """The store with new snapshots, after the retention rule; to be written as a new store."""
    both = manifest.unionByName(rows, allowMissingColumns=True)
    return enforce_retention(union_contents(store, taken), both, max_system, max_auto)


def delete_snapshots(content: Content, manifest: DataFrame, ids: DataFrame) -> tuple[Content, DataFrame]:
    """Drop the snapshots in ``ids(root_id, id)``; an error if none of them exists."""
    doomed = manifest.join(ids.select("root_id", "id"), ["root_id", "id"], "left_semi")
    if doomed.isEmpty():
        raise ValueError("none of the snapshots to delete exists")
    return _without_snapshots(content, manifest, doomed)


def _without_snapshots(content: Content, manifest: DataFrame, doomed: DataFrame) -> tuple[Content, DataFrame]:
    by_id = doomed.select("root_id", "id")
    by_snapshot = by_id.withColumnRenamed("id", "snapshot_id")
    left = content.map_tables(lambda table: table.join(by_snapshot, list(SNAPSHOT), "left_anti").select(*table.columns))
    return left, manifest.join(by_id, ["root_id", "id"], "left_anti").select(*manifest.columns)
