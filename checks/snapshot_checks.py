"""Snapshots: kinds, retention, sizes, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.functions import naming
from chatstrata.operators import snapshots
from checks.catalog_checks import full_catalog
from checks.registry import Tables, check

REASON = "coalesce(reason, CASE WHEN length(id) > 16 THEN substr(id, 17) ELSE 'unknown' END)"
KIND = f"CASE WHEN {REASON} = 'manual' THEN 'manual' ELSE 'system' END"


@check(f"""
    SELECT n, {REASON} AS reason, {KIND} AS kind, CASE WHEN {KIND} = 'manual' THEN '手动' ELSE '系统自动' END AS label,
      CASE {REASON} WHEN 'manual' THEN '手动快照' WHEN 'auto-protect' THEN '自动会话保护点' WHEN 'pre-restore' THEN '恢复前自动备份'
        WHEN 'pre-delete-session' THEN '删除前自动备份' ELSE 'Snapshot' END || ' · p' || CAST(root_id AS STRING) || '/m' AS name
    FROM fx_snapshots""")
def snapshot_kinds(tables: Tables) -> DataFrame:
    s = tables("fx_snapshots")
    reason = naming.effective_reason(F.col("reason"), F.col("id"))
    kind = naming.effective_kind(F.col("kind"), F.col("reason"), F.col("id"))
    provider = F.concat(F.lit("p"), F.col("root_id").cast("string"))
    return s.select(
        "n", reason.alias("reason"), kind.alias("kind"), naming.kind_label(kind).alias("label"),
        naming.default_snapshot_name(reason, provider, F.lit("m")).alias("name"),
    )


@check(f"SELECT n, {KIND} AS kind FROM fx_snapshots")
def filtered_snapshots(tables: Tables) -> DataFrame:
    s = tables("fx_snapshots")
    found = [snapshots.filter_snapshots(s, which).select("n", F.lit(which).alias("kind")) for which in ("manual", "system")]
    return found[0].unionByName(found[1])


@check("SELECT n, id FROM fx_snapshots")
def sorted_snapshots(tables: Tables) -> DataFrame:
    return snapshots.sort_snapshots(tables("fx_snapshots")).select("n", "id")


@check(f"""
    WITH judged AS (SELECT n, root_id, created_at, {REASON} AS r, {KIND} AS k FROM fx_snapshots),
    first_cut AS (SELECT *, row_number() OVER (PARTITION BY root_id, r = 'auto-protect' ORDER BY created_at DESC, n) AS a
      FROM judged),
    left_over AS (SELECT * FROM first_cut WHERE r <> 'auto-protect' OR a <= 3),
    second_cut AS (SELECT *, row_number() OVER (PARTITION BY root_id, k ORDER BY created_at DESC, n) AS b FROM left_over)
    SELECT j.n, c.n IS NOT NULL AS keep FROM judged j
    LEFT JOIN (SELECT n FROM second_cut WHERE k = 'manual' OR b <= 24) c ON c.n = j.n""")
def retention(tables: Tables) -> DataFrame:
    return snapshots.apply_retention(tables("fx_snapshots"), key=("root_id", "n")).select("n", "keep")


@check("""
    WITH bases AS (
      SELECT n, root_id, strftime(created_at, '%Y%m%d-%H') || '0000-' || reason AS base,
        row_number() OVER (PARTITION BY root_id, strftime(created_at, '%Y%m%d-%H'), reason ORDER BY n) AS k
      FROM fx_snapshots WHERE reason IS NOT NULL)
    SELECT n, root_id, CASE WHEN k = 1 THEN base WHEN k = 2 THEN base || '-3' ELSE base || '-' || CAST(k + 1 AS STRING) END AS id
    FROM bases""")
def snapshot_ids(tables: Tables) -> DataFrame:
    """Requests of one hour collide; the second name of each is already taken."""
    requests = tables("SELECT n, n AS request, root_id, created_at, reason FROM fx_snapshots WHERE reason IS NOT NULL")
    requests = requests.withColumn("created_at", F.date_trunc("hour", "created_at"))
    base = naming.snapshot_base_id(F.col("created_at"), F.col("reason"))
    existing = requests.select("root_id", F.concat(base, F.lit("-2")).alias("id")).distinct()
    return snapshots.assign_snapshot_ids(requests, existing).select("n", "root_id", "id")


@check("""
    SELECT root_id, snapshot_id, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM fx_snapshot_files
    GROUP BY root_id, snapshot_id""")
def snapshot_sizes(tables: Tables) -> DataFrame:
    return snapshots.directory_sizes(tables("fx_snapshot_files"), ["root_id", "snapshot_id"])


@check("""
    SELECT root_id, regexp_extract(rel_path, '^[^/]*') AS top_dir, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
    FROM fx_fleet_files GROUP BY root_id, regexp_extract(rel_path, '^[^/]*')""")
def directory_sizes(tables: Tables) -> DataFrame:
    return snapshots.directory_sizes(tables("fx_fleet_files"), ["root_id", "top_dir"])


HELD = "SELECT DISTINCT root_id, snapshot_id, id FROM fx_snapshot_files"
COUNTED = f"""
    SELECT s.*, CASE WHEN h.c > 0 THEN h.c ELSE s.session_count + s.archived_session_count END AS recoverable
    FROM fx_root_snapshots s LEFT JOIN (SELECT root_id, snapshot_id, count(*) AS c FROM ({HELD}) x GROUP BY root_id, snapshot_id) h
      ON h.root_id = s.root_id AND h.snapshot_id = s.id"""
CANDIDATES = f"""
    SELECT root_id, id, recoverable FROM (
      SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY created_epoch DESC, id) AS nth FROM ({COUNTED}) c
      WHERE reason IN ('manual', 'auto-protect') AND recoverable > 0) r WHERE nth = 1"""


def root_snapshots(tables: Tables) -> DataFrame:
    return tables("fx_root_snapshots").withColumn("created_at", F.timestamp_seconds("created_epoch"))


def counted(tables: Tables) -> DataFrame:
    held = tables("fx_snapshot_files").select("root_id", "snapshot_id", "id", F.lit(True).alias("exists_on_disk"))
    return snapshots.recoverable_counts(root_snapshots(tables), held)


@check(f"SELECT root_id, id, recoverable FROM ({COUNTED}) c")
def recoverable_counts(tables: Tables) -> DataFrame:
    return counted(tables).select("root_id", "id", "recoverable")


@check(CANDIDATES)
def restore_candidates(tables: Tables) -> DataFrame:
    return snapshots.latest_restore_candidate(counted(tables)).select("root_id", "id", "recoverable")


CURRENT = "SELECT root_id, CAST(count(*) - root_id % 7 AS BIGINT) AS session_count FROM fx_files WHERE root_id % 4 <> 1 GROUP BY root_id"


@check(f"""
    SELECT coalesce(c.root_id, s.root_id) AS root_id, s.id AS snapshot_id, coalesce(c.session_count, 0) AS session_count,
      s.recoverable, CASE WHEN s.id IS NULL AND c.session_count > 0 THEN 'protect' WHEN s.id IS NULL THEN 'nothing'
        WHEN s.recoverable > coalesce(c.session_count, 0) THEN 'restore'
        WHEN s.recoverable < coalesce(c.session_count, 0) THEN 'protect' ELSE 'ok' END AS decision
    FROM ({CURRENT}) c FULL OUTER JOIN (SELECT * FROM ({CANDIDATES}) k WHERE root_id % 3 <> 2) s ON s.root_id = c.root_id""")
def recovery_decisions(tables: Tables) -> DataFrame:
    candidates = snapshots.latest_restore_candidate(counted(tables)).filter("root_id % 3 <> 2")
    return snapshots.recovery_decision(tables(CURRENT), candidates)


@check("""
    SELECT root_id, snapshot_id, id FROM fx_snapshot_files f
    WHERE NOT EXISTS (SELECT 1 FROM fx_threads t WHERE t.root_id = f.root_id AND t.id = f.id AND t.n % 7 <> 0)""")
def missing_sessions(tables: Tables) -> DataFrame:
    current = full_catalog(tables).filter(F.substr("id", F.lit(25)).cast("bigint") % 7 != 0)
    return snapshots.missing_sessions(tables("fx_snapshot_files"), current).select("root_id", "snapshot_id", "id")


@check("""
    SELECT root_id, id, snapshot_id, rel_path, size_bytes FROM (
      SELECT f.*, row_number() OVER (PARTITION BY f.root_id, f.id ORDER BY s.created_epoch DESC, s.id) AS nth
      FROM fx_snapshot_files f JOIN fx_root_snapshots s ON s.root_id = f.root_id AND s.id = f.snapshot_id
      WHERE CAST(substr(f.id, 25) AS BIGINT) % 4 <> 3) r WHERE nth = 1""")
def latest_snapshot_with_session(tables: Tables) -> DataFrame:
    ids = tables("SELECT root_id, id FROM fx_threads WHERE n % 4 <> 3")
    return snapshots.latest_snapshot_with_session(root_snapshots(tables), tables("fx_snapshot_files"), ids)


@check("""
    SELECT root_id, snapshot_id, count(CASE WHEN rel_path LIKE 'sessions/%' THEN 1 END) AS session_count,
      count(CASE WHEN rel_path LIKE 'archived%' THEN 1 END) AS archived_session_count
    FROM fx_snapshot_files WHERE CAST(substr(id, 25) AS BIGINT) % 5 <> 1 GROUP BY root_id, snapshot_id""")
def snapshot_session_counts(tables: Tables) -> DataFrame:
    """Some ids have a copy in the other directory and still count once."""
    files = tables("fx_snapshot_files")
    copies = files.filter("rel_path like 'sessions/%'").withColumn("rel_path", F.concat(F.lit("archived_"), "rel_path"))
    ids = files.select("root_id", "snapshot_id", "id").filter("cast(substr(id, 25) as bigint) % 5 <> 1")
    return snapshots.snapshot_session_counts(ids, files.unionByName(copies), ("root_id", "snapshot_id"))


@check("""
    SELECT root_id, string_agg(path, ',' ORDER BY path) AS included FROM (
      SELECT DISTINCT root_id, regexp_extract(rel_path, '^[^/]*') AS path FROM fx_fleet_files
      UNION SELECT root_id, 'state_5.sqlite' FROM fx_fleet_states) p GROUP BY root_id""")
def included_paths(tables: Tables) -> DataFrame:
    extra = tables("SELECT root_id, 'state_5.sqlite' AS path FROM fx_fleet_states")
    found = snapshots.included_paths(tables("fx_fleet_files"), extra)
    return found.select("root_id", F.array_join("included_paths", ",").alias("included"))


@check("""
    SELECT root_id, id, rel_path, size_bytes FROM fx_files f WHERE NOT EXISTS (
      SELECT 1 FROM fx_snapshot_files s WHERE s.snapshot_no = 1 AND s.root_id = f.root_id AND s.rel_path = f.rel_path)
    UNION ALL SELECT root_id, id, rel_path, size_bytes FROM fx_snapshot_files WHERE snapshot_no = 1""")
def overlay_files(tables: Tables) -> DataFrame:
    current = tables("SELECT root_id, id, rel_path, size_bytes FROM fx_files")
    return snapshots.overlay_files(current, tables("SELECT * FROM fx_snapshot_files WHERE snapshot_no = 1"))


@check("""
    WITH missing AS (
      SELECT f.root_id, f.rel_path, row_number() OVER (PARTITION BY f.root_id ORDER BY f.rel_path) AS nth FROM fx_files f
      WHERE NOT EXISTS (SELECT 1 FROM fx_snapshot_files s WHERE s.snapshot_no = 2 AND s.root_id = f.root_id AND s.rel_path = f.rel_path))
    SELECT root_id, nth, rel_path AS message FROM missing""")
def skipped_files(tables: Tables) -> DataFrame:
    copied = tables("SELECT * FROM fx_snapshot_files WHERE snapshot_no = 2")
    return snapshots.skipped_files(tables("fx_files"), copied)


PICKED = "(SELECT id FROM fx_picked p WHERE p.root_id = f.root_id)"


@check(f"""
    SELECT 'logs' AS kind, root_id, rel_path, size_bytes FROM fx_fleet_files f
    WHERE rel_path LIKE '%sessions/%' AND id IN {PICKED}
    UNION ALL SELECT 'shell', root_id, 'shell_snapshots/' || id || '.sh', size_bytes FROM fx_fleet_files f
    WHERE rel_path LIKE 'shell_snapshots/%' AND id IN {PICKED}
    UNION ALL SELECT 'left', root_id, rel_path, size_bytes FROM fx_fleet_files f
    WHERE id = '' OR id NOT IN {PICKED}""")
def snapshot_files_of_sessions(tables: Tables) -> DataFrame:
    """Files to copy for some sessions, and what removing the sessions leaves."""
    files, ids = tables("fx_fleet_files"), tables("fx_picked")
    parts = {
        "logs": snapshots.select_snapshot_files(files, ids, "logs"),
        "shell": snapshots.select_snapshot_files(files, ids, "shell"),
        "left": snapshots.remove_session_files(files, ids),
    }
    rows = [part.select(F.lit(kind).alias("kind"), "root_id", "rel_path", "size_bytes") for kind, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def profile_rows(tables: Tables) -> DataFrame:
    """Config texts with the keys in a later section, and account files, some empty."""
    roots = tables("fx_roots")
    name = F.col("root_id").cast("string")
    config = F.concat(
        F.lit('# model = "no"\n[a]\n  model_provider = "p'), name, F.lit('"  \nmodel="m'), name, F.lit('"\nmodel = "late"\n')
    )
    configs = roots.filter("root_id % 3 <> 0").select("root_id", F.lit("config.toml").alias("rel_path"), config.alias("content"))
    account = F.when(F.col("root_id") % 2 == 0, F.concat(F.lit("key "), name)).otherwise("")
    return configs.unionByName(roots.select("root_id", F.lit("auth.json").alias("rel_path"), account.alias("content")))


PROFILES = """
    SELECT r.root_id, CASE WHEN r.root_id % 3 <> 0 THEN 'p' || CAST(r.root_id AS STRING) ELSE 'unknown' END AS model_provider,
      CASE WHEN r.root_id % 3 <> 0 THEN 'm' || CAST(r.root_id AS STRING) ELSE 'unknown' END AS model,
      CASE WHEN r.root_id % 2 = 0 THEN substr(sha256('key ' || CAST(r.root_id AS STRING)), 1, 12) ELSE 'none' END
        AS account_fingerprint,
      count(CASE WHEN f.rel_path LIKE 'sessions/%' THEN 1 END) AS session_count,
      count(CASE WHEN f.rel_path LIKE 'archived%' THEN 1 END) AS archived_session_count
    FROM fx_roots r LEFT JOIN fx_files f ON f.root_id = r.root_id GROUP BY r.root_id"""


@check(PROFILES)
def profile_state(tables: Tables) -> DataFrame:
    return snapshots.profile_state(profile_rows(tables), tables("fx_files"))
