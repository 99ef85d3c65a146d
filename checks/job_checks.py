"""Whole jobs over a fleet of roots; results are stacked as (part, root_id, k, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstrata.operators import snapshots
from chatstrata.operators.content import Content
from chatstrata.plans import fleet, restore_jobs, snapshot_jobs
from chatstrata.session import scratch_path, staged
from chatstrata.sources import store as stores
from chatstrata.sources import writers
from checks.catalog_checks import full_catalog
from checks.registry import Tables, check
from checks.snapshot_checks import CANDIDATES, PROFILES, profile_rows, root_snapshots

JOB_KEYS = {"agent_job_items": ["item"]}


def history_lines(tables: Tables, name: str) -> DataFrame:
    json = F.to_json(F.struct(F.col("id").alias("session_id"), F.col("title").alias("first_text")))
    return tables(name).select("root_id", F.lit("history.jsonl").alias("rel_path"), "line_no", json.alias("line"))


def timed(files: DataFrame) -> DataFrame:
    return files.withColumn("mtime", F.timestamp_seconds("mtime"))


def stored(content: Content) -> Content:
    """Content as it is found in practice: tables on disk."""
    return content.map_tables(lambda table: staged(table, "fixture"))


def current(tables: Tables, files: str = "fx_now_files") -> Content:
    index = tables("fx_fleet_index").select(
        "root_id",
        F.lit("session_index.jsonl").alias("rel_path"),
        "line_no",
        F.to_json(F.struct("id", F.concat(F.lit("name "), F.col("again").cast("string")).alias("thread_name"))).alias("line"),
    )
    states = tables("fx_fleet_states")

    def of_states(rows: DataFrame) -> DataFrame:
        return rows.join(states, ["root_id"], "left_semi")

    return stored(Content(
        files=timed(tables(files)),
        lines=history_lines(tables, "fx_fleet_history").unionByName(index),
        states=states,
        tables={
            "threads": of_states(tables("fx_threads").drop("n")),
            "thread_goals": of_states(tables("fx_fleet_goals")),
            "agent_job_items": of_states(tables("fx_fleet_jobs")),
            "device_key_bindings": of_states(tables("SELECT root_id, 'key' AS binding FROM fx_roots")),
        },
    ))


def store(tables: Tables) -> Content:
    """One snapshot per root."""
    content = Content(
        files=timed(tables("fx_store_files")),
        lines=history_lines(tables, "fx_store_history"),
        states=tables("fx_store_states"),
        tables={
            "threads": tables("fx_store_threads").drop("n", "held").withColumn("only_in_snapshot", F.lit(1)),
            "agent_job_items": tables("fx_store_jobs"),
            "device_key_bindings": tables("SELECT root_id, 'old' AS binding FROM fx_store_states"),
        },
    )
    return stored(content.map_tables(lambda table: table.withColumn("snapshot_id", F.lit("snap"))))


def chosen(tables: Tables) -> DataFrame:
    """Manifest rows; shell snapshots are not among the included paths."""
    included = F.array(*[F.lit(p) for p in ("sessions", "archived_sessions", "history.jsonl", "state_5.sqlite")])
    return tables("fx_chosen").select(
        "root_id", F.lit("snap").alias("id"), F.col("root_path").alias("snapshot_root"), included.alias("included_paths")
    )


def stacked(content: Content, parts: str = "files lines threads goals jobs") -> DataFrame:
    def rows(part: Column, table: DataFrame, k: Column, v: Column) -> DataFrame:
        return table.select(part.alias("part"), "root_id", k.alias("k"), v.alias("v"))

    line = F.col("line")
    line_id = F.coalesce(F.get_json_object(line, "$.session_id"), F.get_json_object(line, "$.id"))
    line_text = F.coalesce(F.get_json_object(line, "$.first_text"), F.get_json_object(line, "$.thread_name"))
    thread = F.concat_ws("|", "title", "rollout_path", F.col("archived").cast("string"))
    found = []
    if "files" in parts:
        found.append(rows(F.lit("file"), content.files, F.col("rel_path"), F.col("size_bytes").cast("string")))
    if "lines" in parts:
        found.append(rows(F.col("rel_path"), content.lines, line_id, line_text))
    if "threads" in parts:
        found.append(rows(F.lit("thread"), content.tables["threads"], F.col("id"), thread))
    if "goals" in parts:
        goals = content.tables["thread_goals"]
        found.append(rows(F.lit("goal"), goals, F.col("thread_id"), F.col("goal_no").cast("string")))
    if "jobs" in parts:
        jobs = content.tables["agent_job_items"]
        found.append(rows(F.lit("job"), jobs, F.col("item").cast("string"), F.col("assigned_thread_id")))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def requests(tables: Tables, reason: str) -> DataFrame:
    return tables("fx_roots").select(
        "root_id",
        F.lit("20240102-030405-" + reason).alias("snapshot_id"),
        "root_path",
        F.lit(reason).alias("reason"),
        F.lit(None).cast("string").alias("name"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("created_at"),
    )


def profiles(tables: Tables) -> DataFrame:
    return snapshots.profile_state(profile_rows(tables), tables("fx_files"))


def shown(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        "root_id", "id", "name", "kind", "model", "account_fingerprint", "session_count", "archived_session_count",
        "size_bytes", F.array_join("included_paths", ",").alias("included"),
    )


# In a root with a state only lines of sessions with a log are left, and one index line per session.
CLEAN_HISTORY = """
    SELECT h.* FROM fx_fleet_history h WHERE h.root_id % 5 = 0
      OR EXISTS (SELECT 1 FROM fx_files f WHERE f.root_id = h.root_id AND f.id = h.id)"""
CLEAN_INDEX = """
    SELECT i.* FROM fx_fleet_index i WHERE i.root_id % 5 = 0
      OR (again = 0 AND EXISTS (SELECT 1 FROM fx_files f WHERE f.root_id = i.root_id AND f.id = i.id))"""
HISTORY_BYTES = """length('{"session_id":"') + 36 + length('","first_text":"') + length(title) + length('"}') + 1"""
INDEX_BYTES = """length('{"id":"') + 36 + length('","thread_name":"name 0"}') + 1"""


@check(f"""
    WITH sized AS (
      SELECT root_id, size_bytes FROM fx_fleet_files WHERE rel_path NOT IN ('history.jsonl', 'session_index.jsonl', 'notes.txt')
      UNION ALL SELECT root_id, {HISTORY_BYTES} FROM ({CLEAN_HISTORY}) h
      UNION ALL SELECT root_id, {INDEX_BYTES} FROM ({CLEAN_INDEX}) i),
    entries AS (
      SELECT DISTINCT root_id, regexp_extract(rel_path, '^[^/]*') AS path FROM fx_fleet_files WHERE rel_path <> 'notes.txt'
      UNION SELECT root_id, 'state_5.sqlite' FROM fx_fleet_states)
    SELECT p.root_id, '20240102-030405-manual' AS id, '手动快照 · ' || p.model_provider || '/' || p.model AS name,
      'manual' AS kind, p.model, p.account_fingerprint, p.session_count, p.archived_session_count,
      CAST(s.size_bytes AS BIGINT) AS size_bytes, e.included
    FROM ({PROFILES}) p
    JOIN (SELECT root_id, sum(size_bytes) AS size_bytes FROM sized GROUP BY root_id) s ON s.root_id = p.root_id
    JOIN (SELECT root_id, string_agg(path, ',' ORDER BY path) AS included FROM entries GROUP BY root_id) e
      ON e.root_id = p.root_id""")
def create_snapshot(tables: Tables) -> DataFrame:
    _, manifest = snapshot_jobs.create_snapshot(
        current(tables, "fx_fleet_files"), requests(tables, "manual"), profiles(tables)
    )
    return shown(manifest)


@check(f"""
    SELECT 'file' AS part, root_id, rel_path AS k, CAST(size_bytes AS STRING) AS v FROM fx_fleet_files WHERE rel_path <> 'notes.txt'
    UNION ALL SELECT 'history.jsonl', root_id, id, title FROM ({CLEAN_HISTORY}) h
    UNION ALL SELECT 'session_index.jsonl', root_id, id, 'name ' || CAST(again AS STRING) FROM ({CLEAN_INDEX}) i
    UNION ALL SELECT 'thread', t.root_id, t.id, t.title || '|/home/u' || CAST(t.root_id AS STRING) || '/.codex/' || f.rel_path
      || '|' || CAST(t.archived AS STRING)
    FROM fx_threads t JOIN fx_files f ON f.root_id = t.root_id AND f.id = t.id WHERE t.root_id % 5 <> 0
    UNION ALL SELECT 'goal', g.root_id, g.thread_id, CAST(g.goal_no AS STRING) FROM fx_fleet_goals g
    WHERE g.root_id % 5 <> 0 AND EXISTS (SELECT 1 FROM fx_files f WHERE f.root_id = g.root_id AND f.id = g.thread_id)
    UNION ALL SELECT 'job', j.root_id, CAST(j.item AS STRING), j.assigned_thread_id FROM fx_fleet_jobs j
    WHERE j.root_id % 5 <> 0 AND EXISTS (SELECT 1 FROM fx_files f
      WHERE f.root_id = j.root_id AND (j.assigned_thread_id IS NULL OR f.id = j.assigned_thread_id))""")
def sanitized_snapshot(tables: Tables) -> DataFrame:
    content, _ = snapshot_jobs.create_snapshot(
        current(tables, "fx_fleet_files"), requests(tables, "manual"), profiles(tables)
    )
    return stacked(content)


# The chosen snapshots that have a state database and a session to restore.
IDS = "SELECT s.* FROM fx_store_sessions s JOIN fx_chosen c ON c.root_id = s.root_id WHERE s.root_id % 5 <> 1"
STORE_LINES = f"""
    SELECT h.root_id, h.id, h.title FROM fx_store_history h JOIN fx_chosen c ON c.root_id = h.root_id
    WHERE h.root_id % 5 = 1 OR EXISTS (SELECT 1 FROM ({IDS}) i WHERE i.root_id = h.root_id AND i.id = h.id)"""
REPAIRED = """
    CASE WHEN f.id IS NOT NULL THEN '/home/u' || CAST(t.root_id AS STRING) || '/.codex/' || f.rel_path ELSE t.rollout_path END
    || '|' || CASE WHEN f.id IS NULL THEN CAST(t.archived AS STRING) WHEN f.rel_path LIKE 'archived%' THEN '1' ELSE '0' END"""


@check(f"""
    WITH ids AS ({IDS}),
    files AS (
      SELECT * FROM fx_now_files n WHERE NOT EXISTS (SELECT 1 FROM fx_store_logs s JOIN fx_chosen c ON c.root_id = s.root_id
        WHERE s.root_id = n.root_id AND s.rel_path = n.rel_path)
      UNION ALL SELECT s.* FROM fx_store_logs s JOIN fx_chosen c ON c.root_id = s.root_id),
    fresh AS (SELECT t.root_id, t.id, t.title, t.rollout_path, t.archived FROM fx_store_threads t
      JOIN ids i ON i.root_id = t.root_id AND i.id = t.id),
    threads AS (
      SELECT root_id, id, title, rollout_path, archived FROM fx_threads t WHERE root_id % 5 <> 0
        AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.root_id = t.root_id AND f.id = t.id)
      UNION ALL SELECT * FROM fresh),
    fresh_jobs AS (SELECT j.* FROM fx_store_jobs j WHERE EXISTS (
      SELECT 1 FROM ids i WHERE i.root_id = j.root_id AND i.id = j.assigned_thread_id)
      OR (j.assigned_thread_id IS NULL AND j.root_id % 5 = 0 AND j.root_id IN (SELECT root_id FROM ids)))
    SELECT 'file' AS part, root_id, rel_path AS k, CAST(size_bytes AS STRING) AS v FROM files
    UNION ALL SELECT 'history.jsonl', root_id, id, title FROM (
      SELECT root_id, id, title FROM fx_fleet_history UNION SELECT * FROM ({STORE_LINES}) l) h
    UNION ALL SELECT 'session_index.jsonl', root_id, id, 'name ' || CAST(again AS STRING) FROM fx_fleet_index
    UNION ALL SELECT 'thread', t.root_id, t.id, t.title || '|' || {REPAIRED}
    FROM threads t LEFT JOIN (SELECT f.* FROM files f JOIN ids i ON i.root_id = f.root_id AND i.id = f.id
      WHERE f.rel_path NOT LIKE 'shell%') f ON f.root_id = t.root_id AND f.id = t.id
    UNION ALL SELECT 'goal', root_id, thread_id, CAST(goal_no AS STRING) FROM fx_fleet_goals WHERE root_id % 5 <> 0
    UNION ALL SELECT 'job', root_id, CAST(item AS STRING), assigned_thread_id FROM fx_fleet_jobs j WHERE root_id % 5 <> 0
      AND NOT EXISTS (SELECT 1 FROM fresh_jobs f WHERE f.root_id = j.root_id AND f.item = j.item)
    UNION ALL SELECT 'job', root_id, CAST(item AS STRING), assigned_thread_id FROM fresh_jobs""")
def restore_conversations(tables: Tables) -> DataFrame:
    restored = restore_jobs.restore_conversations(
        store(tables), chosen(tables), current(tables), tables("fx_roots"), JOB_KEYS
    )
    return stacked(restored)


@check(f"""
    WITH ids AS ({IDS}),
    replaced AS (SELECT DISTINCT s.root_id, regexp_extract(s.rel_path, '^[^/]*') AS top FROM fx_store_files s
      JOIN fx_chosen c ON c.root_id = s.root_id WHERE s.rel_path NOT LIKE 'shell%'),
    files AS (
      SELECT * FROM fx_now_files n WHERE NOT EXISTS (SELECT 1 FROM replaced r
        WHERE r.root_id = n.root_id AND r.top = regexp_extract(n.rel_path, '^[^/]*'))
      UNION ALL SELECT s.* FROM fx_store_files s JOIN fx_chosen c ON c.root_id = s.root_id WHERE s.rel_path NOT LIKE 'shell%'),
    with_lines AS (SELECT DISTINCT h.root_id FROM fx_store_history h JOIN fx_chosen c ON c.root_id = h.root_id),
    kept_lines AS (SELECT root_id, id, title FROM fx_fleet_history WHERE root_id NOT IN (SELECT root_id FROM with_lines)),
    threads AS (
      SELECT root_id, id, title, rollout_path, archived FROM fx_threads
      WHERE root_id % 5 <> 0 AND (root_id % 5 = 1 OR root_id % 7 = 6)
      UNION ALL SELECT t.root_id, t.id, t.title, t.rollout_path, t.archived FROM fx_store_threads t
      JOIN ids i ON i.root_id = t.root_id AND i.id = t.id)
    SELECT 'file' AS part, root_id, rel_path AS k, CAST(size_bytes AS STRING) AS v FROM files
    UNION ALL SELECT 'history.jsonl', root_id, id, title FROM kept_lines
    WHERE root_id % 5 = 1 OR root_id % 7 = 6 OR id IN (SELECT id FROM ids WHERE ids.root_id = kept_lines.root_id)
    UNION ALL SELECT 'history.jsonl', root_id, id, title FROM ({STORE_LINES}) l
    UNION ALL SELECT 'session_index.jsonl', root_id, id, 'name ' || CAST(again AS STRING) FROM fx_fleet_index
    UNION ALL SELECT 'thread', t.root_id, t.id, t.title || '|' || {REPAIRED}
    FROM threads t LEFT JOIN (SELECT f.* FROM files f JOIN ids i ON i.root_id = f.root_id AND i.id = f.id
      WHERE f.rel_path NOT LIKE 'shell%') f ON f.root_id = t.root_id AND f.id = t.id
    UNION ALL SELECT 'job', root_id, CAST(item AS STRING), assigned_thread_id FROM fx_fleet_jobs
    WHERE root_id % 5 <> 0 AND (root_id % 5 = 1 OR root_id % 7 = 6)
    UNION ALL SELECT 'job', j.root_id, CAST(j.item AS STRING), j.assigned_thread_id FROM fx_store_jobs j
    WHERE EXISTS (SELECT 1 FROM ids i WHERE i.root_id = j.root_id
      AND (i.id = j.assigned_thread_id OR j.assigned_thread_id IS NULL))""")
def restore_full(tables: Tables) -> DataFrame:
    restored = restore_jobs.restore_full(store(tables), chosen(tables), current(tables), tables("fx_roots"))
    return stacked(restored, "files lines threads jobs")


FOUND = """
    SELECT s.root_id, s.id FROM fx_store_sessions s JOIN fx_chosen c ON c.root_id = s.root_id
    JOIN fx_picked p ON p.root_id = s.root_id AND p.id = s.id"""


@check(f"""
    WITH ids AS ({FOUND}),
    added AS (
      SELECT s.root_id, s.id, s.rel_path, s.size_bytes FROM fx_store_logs s JOIN ids i ON i.root_id = s.root_id AND i.id = s.id
      UNION ALL SELECT s.root_id, s.id, 'shell_snapshots/' || s.id || '.sh', s.size_bytes FROM fx_store_files s
      JOIN ids i ON i.root_id = s.root_id AND i.id = s.id WHERE s.rel_path LIKE 'shell%'),
    files AS (
      SELECT root_id, id, rel_path, size_bytes FROM fx_now_files n WHERE NOT EXISTS (
        SELECT 1 FROM added a WHERE a.root_id = n.root_id AND a.rel_path = n.rel_path)
      UNION ALL SELECT * FROM added),
    fresh AS (SELECT t.root_id, t.id, t.title, t.rollout_path, t.archived FROM fx_store_threads t
      JOIN ids i ON i.root_id = t.root_id AND i.id = t.id WHERE t.root_id % 5 <> 0),
    threads AS (
      SELECT root_id, id, title, rollout_path, archived FROM fx_threads t WHERE root_id % 5 <> 0
        AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.root_id = t.root_id AND f.id = t.id)
      UNION ALL SELECT * FROM fresh),
    fresh_jobs AS (SELECT j.* FROM fx_store_jobs j JOIN ids i ON i.root_id = j.root_id AND i.id = j.assigned_thread_id
      WHERE j.root_id % 5 <> 0)
    SELECT 'file' AS part, root_id, rel_path AS k, CAST(size_bytes AS STRING) AS v FROM files
    UNION ALL SELECT 'history.jsonl', root_id, id, title FROM (
      SELECT root_id, id, title FROM fx_fleet_history
      UNION SELECT h.root_id, h.id, h.title FROM fx_store_history h JOIN ids i ON i.root_id = h.root_id AND i.id = h.id) h
    UNION ALL SELECT 'session_index.jsonl', root_id, id, 'name ' || CAST(again AS STRING) FROM fx_fleet_index
    UNION ALL SELECT 'thread', t.root_id, t.id, t.title || '|' || {REPAIRED}
    FROM threads t LEFT JOIN (SELECT f.* FROM files f JOIN ids i ON i.root_id = f.root_id AND i.id = f.id
      WHERE f.rel_path NOT LIKE 'shell%') f ON f.root_id = t.root_id AND f.id = t.id
    UNION ALL SELECT 'job', root_id, CAST(item AS STRING), assigned_thread_id FROM fx_fleet_jobs j WHERE root_id % 5 <> 0
      AND NOT EXISTS (SELECT 1 FROM fresh_jobs f WHERE f.root_id = j.root_id AND f.item = j.item)
    UNION ALL SELECT 'job', root_id, CAST(item AS STRING), assigned_thread_id FROM fresh_jobs""")
def restore_sessions(tables: Tables) -> DataFrame:
    restored = restore_jobs.restore_sessions(
        store(tables), chosen(tables), tables("fx_picked"), current(tables), tables("fx_roots"), keys=JOB_KEYS
    )
    return stacked(restored, "files lines threads jobs")


LATEST = """
    SELECT root_id, id, rel_path, size_bytes FROM (
      SELECT f.*, row_number() OVER (PARTITION BY f.root_id, f.id ORDER BY s.created_epoch DESC, s.id) AS nth
      FROM fx_snapshot_files f JOIN fx_root_snapshots s ON s.root_id = f.root_id AND s.id = f.snapshot_id
      JOIN fx_picked p ON p.root_id = f.root_id AND p.id = f.id) r WHERE nth = 1"""


def three_snapshots(tables: Tables) -> Content:
    files = tables("SELECT root_id, snapshot_id, id, rel_path, size_bytes, CAST(0 AS BIGINT) AS mtime FROM fx_snapshot_files")
    none = history_lines(tables, "fx_fleet_history").withColumn("snapshot_id", F.lit("")).filter(F.lit(False))
    states = tables("SELECT root_id, 'snap-0' AS snapshot_id FROM fx_roots WHERE root_id < 0")
    return Content(files=timed(files), lines=none, states=states)


def three_manifests(tables: Tables) -> DataFrame:
    path = F.concat(F.lit("/home/u"), F.col("root_id").cast("string"), F.lit("/.codex"))
    return root_snapshots(tables).withColumn("snapshot_root", path)


@check(f"""
    SELECT 'file' AS part, root_id, rel_path AS k, CAST(size_bytes AS STRING) AS v FROM fx_now_files n WHERE NOT EXISTS (
      SELECT 1 FROM ({LATEST}) a WHERE a.root_id = n.root_id AND a.rel_path = n.rel_path)
    UNION ALL SELECT 'file', root_id, rel_path, CAST(size_bytes AS STRING) FROM ({LATEST}) a""")
def restore_from_latest(tables: Tables) -> DataFrame:
    restored = restore_jobs.restore_from_latest(
        three_snapshots(tables), three_manifests(tables), tables("fx_picked"), current(tables), tables("fx_roots")
    )
    return stacked(restored, "files")


GONE = "EXISTS (SELECT 1 FROM fx_picked p WHERE p.root_id = x.root_id AND p.id = x.{key})"


@check(f"""
    SELECT 'file' AS part, root_id, rel_path AS k, CAST(size_bytes AS STRING) AS v FROM fx_now_files x
    WHERE NOT {GONE.format(key='id')}
    UNION ALL SELECT 'history.jsonl', root_id, id, title FROM fx_fleet_history x WHERE NOT {GONE.format(key='id')}
    UNION ALL SELECT 'session_index.jsonl', root_id, id, 'name ' || CAST(again AS STRING) FROM fx_fleet_index x
    WHERE NOT {GONE.format(key='id')}
    UNION ALL SELECT 'thread', root_id, id, title || '|' || rollout_path || '|' || CAST(archived AS STRING) FROM fx_threads x
    WHERE root_id % 5 <> 0 AND NOT {GONE.format(key='id')}
    UNION ALL SELECT 'goal', root_id, thread_id, CAST(goal_no AS STRING) FROM fx_fleet_goals x
    WHERE root_id % 5 <> 0 AND NOT {GONE.format(key='thread_id')}
    UNION ALL SELECT 'job', root_id, CAST(item AS STRING), assigned_thread_id FROM fx_fleet_jobs x
    WHERE root_id % 5 <> 0 AND NOT {GONE.format(key='assigned_thread_id')}""")
def delete_sessions(tables: Tables) -> DataFrame:
    left, _ = restore_jobs.delete_sessions(
        current(tables), tables("fx_picked"), requests(tables, "pre-delete-session"), profiles(tables)
    )
    return stacked(left)


@check(f"""
    WITH logs AS (SELECT n.root_id, n.id, n.rel_path, n.size_bytes FROM fx_now_files n
      JOIN fx_picked p ON p.root_id = n.root_id AND p.id = n.id WHERE n.rel_path LIKE '%sessions/%'),
    light AS (SELECT DISTINCT root_id FROM fx_picked),
    kept AS (
      SELECT root_id, rel_path, size_bytes FROM logs
      UNION ALL SELECT n.root_id, 'shell_snapshots/' || n.id || '.sh', n.size_bytes FROM fx_now_files n
      JOIN fx_picked p ON p.root_id = n.root_id AND p.id = n.id WHERE n.rel_path LIKE 'shell%'
      UNION ALL SELECT h.root_id, 'history.jsonl', {HISTORY_BYTES} FROM fx_fleet_history h
      JOIN fx_picked p ON p.root_id = h.root_id AND p.id = h.id
      WHERE h.root_id % 5 = 0 OR EXISTS (SELECT 1 FROM logs l WHERE l.root_id = h.root_id AND l.id = h.id)
      UNION ALL SELECT i.root_id, 'session_index.jsonl', {INDEX_BYTES} FROM fx_fleet_index i
      JOIN fx_picked p ON p.root_id = i.root_id AND p.id = i.id
      WHERE i.again = 0 AND (i.root_id % 5 = 0 OR EXISTS (SELECT 1 FROM logs l WHERE l.root_id = i.root_id AND l.id = i.id)))
    SELECT r.root_id, coalesce(l.session_count, 0) AS session_count, coalesce(l.archived, 0) AS archived_session_count,
      CAST(coalesce(k.size_bytes, 0) AS BIGINT) AS size_bytes
    FROM light r
    LEFT JOIN (SELECT root_id, count(CASE WHEN rel_path LIKE 'sessions/%' THEN 1 END) AS session_count,
      count(CASE WHEN rel_path LIKE 'archived%' THEN 1 END) AS archived FROM logs GROUP BY root_id) l ON l.root_id = r.root_id
    LEFT JOIN (SELECT root_id, sum(size_bytes) AS size_bytes FROM kept GROUP BY root_id) k ON k.root_id = r.root_id""")
def protection_snapshot(tables: Tables) -> DataFrame:
    """Manifest of the lightweight snapshot taken before sessions are deleted."""
    _, manifest = snapshot_jobs.create_protection_snapshot(
        current(tables), requests(tables, "pre-delete-session"), profiles(tables), tables("fx_picked")
    )
    light = manifest.join(tables("fx_picked").select("root_id").distinct(), ["root_id"], "left_semi")
    return light.select("root_id", "session_count", "archived_session_count", "size_bytes")


@check("""
    SELECT 'file' AS part, root_id, snapshot_id || ':' || rel_path AS k, CAST(size_bytes AS STRING) AS v FROM fx_snapshot_files
    WHERE NOT (snapshot_no = 1 AND root_id % 3 = 0)
    UNION ALL SELECT 'manifest', root_id, id, reason FROM fx_root_snapshots WHERE NOT (snapshot_no = 1 AND root_id % 3 = 0)""")
def delete_snapshots(tables: Tables) -> DataFrame:
    ids = tables("SELECT root_id, id FROM fx_root_snapshots WHERE snapshot_no = 1 AND root_id % 3 = 0")
    return _stacked_store(*snapshot_jobs.delete_snapshots(three_snapshots(tables), three_manifests(tables), ids))


RETAINED = """
    WITH judged AS MATERIALIZED (SELECT root_id, id, reason,
      row_number() OVER (PARTITION BY root_id, reason = 'manual' ORDER BY created_epoch DESC, id) AS nth FROM fx_root_snapshots),
    stays AS MATERIALIZED (SELECT root_id, id, reason FROM judged WHERE reason = 'manual' OR nth = 1),
    held AS MATERIALIZED (SELECT root_id, snapshot_id, rel_path, size_bytes FROM fx_snapshot_files)
    SELECT 'file' AS part, f.root_id, f.snapshot_id || ':' || f.rel_path AS k, CAST(f.size_bytes AS STRING) AS v
    FROM held f JOIN stays s ON s.root_id = f.root_id AND s.id = f.snapshot_id
    UNION ALL SELECT 'manifest', root_id, id, reason FROM stays"""


@check(RETAINED)
def enforce_retention(tables: Tables) -> DataFrame:
    """Of the two system snapshots of each root the newer one stays."""
    return _stacked_store(*snapshot_jobs.enforce_retention(three_snapshots(tables), three_manifests(tables), max_system=1))


@check(RETAINED)
def store_after_retention(tables: Tables) -> DataFrame:
    """The same by tombstones in a store of files, whose shared files are written again and whose dead ones are deleted."""
    base = scratch_path(tables.spark, "store")
    stores.append_snapshots(three_snapshots(tables), three_manifests(tables), base, max_system=1)
    stores.compact(tables.spark, base)
    stores.vacuum(tables.spark, base, grace_seconds=0)
    return _stacked_store(*writers.read_snapshots(tables.spark, base))


def _stacked_store(content: Content, manifest: DataFrame) -> DataFrame:
    files = content.files.select(
        F.lit("file").alias("part"), "root_id", F.concat_ws(":", "snapshot_id", "rel_path").alias("k"),
        F.col("size_bytes").cast("string").alias("v"),
    )
    return files.unionByName(
        manifest.select(F.lit("manifest").alias("part"), "root_id", F.col("id").alias("k"), F.col("reason").alias("v"))
    )


@check(f"""
    SELECT p.root_id, p.model_provider, p.model, p.account_fingerprint, c.session_count, c.archived_sessions, c.missing_files,
      CAST(3 AS BIGINT) AS snapshot_count, k.id AS snapshot_id, k.recoverable,
      CASE WHEN k.id IS NULL THEN 'protect' WHEN k.recoverable > c.session_count THEN 'restore'
        WHEN k.recoverable < c.session_count THEN 'protect' ELSE 'ok' END AS decision
    FROM ({PROFILES}) p
    JOIN (SELECT root_id, count(*) AS session_count, count(CASE WHEN archived = 1 THEN 1 END) AS archived_sessions,
      count(CASE WHEN NOT exists_on_disk THEN 1 END) AS missing_files FROM fx_resolved GROUP BY root_id) c ON c.root_id = p.root_id
    LEFT JOIN ({CANDIDATES}) k ON k.root_id = p.root_id""")
def fleet_state(tables: Tables) -> DataFrame:
    held = tables("fx_snapshot_files").withColumn("exists_on_disk", F.lit(True))
    return fleet.fleet_state(full_catalog(tables), root_snapshots(tables), held, profiles(tables))
