"""Session catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.functions import paths, text
from chatstrata.operators import catalog, snapshots
from chatstrata.sources.scans import parse_history, parse_session_index
from checks.message_checks import log_lines
from checks.registry import Tables, check

INDEX_TITLES = """
    SELECT root_id, id, max(thread_name) AS thread_name FROM fx_session_index i
    WHERE line_no = (SELECT max(line_no) FROM fx_session_index j WHERE j.root_id = i.root_id AND j.id = i.id)
    GROUP BY root_id, id"""
HISTORY_TITLES = """
    SELECT root_id, session_id AS id, first_text FROM (
      SELECT *, row_number() OVER (PARTITION BY root_id, session_id ORDER BY line_no DESC) AS nth
      FROM fx_history WHERE regexp_replace(first_text, '\\s+', '', 'g') <> '') h WHERE nth = 1"""
TITLES = f"""
    SELECT h.root_id, h.id, coalesce(i.thread_name, h.first_text) AS title
    FROM ({HISTORY_TITLES}) h LEFT JOIN ({INDEX_TITLES}) i ON i.root_id = h.root_id AND i.id = h.id"""
FLAGS = """
    SELECT root_id, session_id AS id, is_archived FROM (
      SELECT *, row_number() OVER (PARTITION BY root_id, session_id ORDER BY line_no DESC) AS nth
      FROM fx_history WHERE is_archived IS NOT NULL) h WHERE nth = 1"""


def history(tables: Tables) -> DataFrame:
    """History lines as JSON, parsed back; every tenth line is broken."""
    lines = tables("fx_history").select(
        "root_id", "line_no", F.to_json(F.struct("session_id", "first_text", "is_archived")).alias("line")
    )
    broken = lines.withColumn("line", F.concat(F.lit("{ broken "), "line")).withColumn("line_no", F.col("line_no") + 5000000)
    return parse_history(lines.unionByName(broken))


def session_index(tables: Tables) -> DataFrame:
    lines = tables("fx_session_index").select("root_id", "line_no", F.to_json(F.struct("id", "thread_name")).alias("line"))
    return parse_session_index(lines)


@check(TITLES)
def title_map(tables: Tables) -> DataFrame:
    return catalog.title_map(history(tables), session_index(tables))


@check(FLAGS)
def archived_map(tables: Tables) -> DataFrame:
    return catalog.archived_map(history(tables))


@check("""
    SELECT root_id, line_no, session_id, first_text, is_archived FROM fx_history
    UNION ALL SELECT root_id, line_no + 5000000, NULL, NULL, NULL FROM fx_history""")
def parsed_history(tables: Tables) -> DataFrame:
    return history(tables).select("root_id", "line_no", "session_id", "first_text", "is_archived")


@check("SELECT root_id, line_no, id, thread_name FROM fx_session_index")
def parsed_session_index(tables: Tables) -> DataFrame:
    return session_index(tables).select("root_id", "line_no", "id", "thread_name")


@check(f"""
    SELECT f.root_id, f.id, regexp_replace(coalesce(t.title, f.id), '^\\s+|\\s+$', '', 'g') AS title,
      f.rel_path AS rollout_path, CASE WHEN m.session_id IS NOT NULL THEN '/w/' || CAST(f.conv_id AS STRING) ELSE '' END AS cwd,
      CASE WHEN m.session_id IS NOT NULL THEN 'p' ELSE 'unknown' END AS model_provider, 'jsonl' AS source,
      f.mtime AS updated, coalesce(a.is_archived, f.rel_path LIKE 'archived_sessions/%') AS archived, f.size_bytes
    FROM fx_log_files f
    LEFT JOIN ({TITLES}) t ON t.root_id = f.root_id AND t.id = f.id
    LEFT JOIN ({FLAGS}) a ON a.root_id = f.root_id AND a.id = f.id
    LEFT JOIN (SELECT DISTINCT session_id FROM fx_messages
      WHERE role = 'system' AND conv_id % 5 <> 0) m ON m.session_id = f.id""")
def catalog_from_files(tables: Tables) -> DataFrame:
    files = tables("fx_log_files").withColumn("mtime", F.timestamp_seconds("mtime"))
    noise = files.limit(3).withColumn("rel_path", F.lit("sessions/notes.txt"))
    found = catalog.catalog_from_files(
        files.unionByName(noise),
        catalog.rollout_metadata(log_lines(tables)),
        catalog.title_map(history(tables), session_index(tables)),
        catalog.archived_map(history(tables)),
    )
    return found.select(
        "root_id", "id", "title", "rollout_path", "cwd", "model_provider", "source",
        F.unix_seconds("updated_at").alias("updated"), "archived", "size_bytes",
    )


def resolved(tables: Tables) -> DataFrame:
    return catalog.resolve_rollout_files(tables("fx_threads"), tables("fx_files"))


def files_of(tables: Tables, name: str = "fx_files") -> DataFrame:
    files = tables(name)
    return files.withColumn("mtime", F.timestamp_seconds("mtime")) if "mtime" in files.columns else files


@check("SELECT root_id, id, rel_path, exists_on_disk, size_bytes FROM fx_resolved")
def resolve_rollouts(tables: Tables) -> DataFrame:
    return resolved(tables).select("root_id", "id", "rel_path", "exists_on_disk", "size_bytes")


@check("""
    SELECT n, CASE WHEN n % 6 = 5 THEN NULL
      WHEN n % 6 = 4 THEN 'sessions/rollout-' || id || '.jsonl'
      ELSE CASE WHEN archived = 1 THEN 'archived_sessions' ELSE 'sessions' END || '/rollout-' || id || '.jsonl' END
      AS rel_path, id AS file_id
    FROM fx_threads""")
def rerooted_paths(tables: Tables) -> DataFrame:
    """Paths below either root, under the marker in any case, with backslashes, with dots, outside."""
    t = tables("fx_threads")
    rel = F.substring_index("rollout_path", "/.codex/", -1)
    shape = F.col("n") % 6
    path = (
        F.when(shape == 0, F.concat(F.lit("/old/root/"), rel))
        .when(shape == 1, F.concat(F.lit("/data/now/"), rel))
        .when(shape == 2, F.concat(F.lit("D:\\Users\\x\\.CODEX\\"), F.translate(rel, "/", "\\")))
        .when(shape == 3, F.concat(F.lit("/old/./root//x/../"), rel))
        .when(shape == 4, F.concat(F.lit("/elsewhere/.codex/a/../sessions/"), paths.base_name(rel)))
        .otherwise(F.concat(F.lit("/old/root/../"), rel))
    )
    rerooted = paths.reroot_path(path, F.lit("/old/root"), F.lit("/data/now/"))
    return t.select("n", rerooted.alias("rel_path"), paths.session_id_from_path(F.upper(path)).alias("file_id"))


FILE_CATALOG = """
    SELECT root_id, id, 'file ' || id AS title, rel_path, '' AS cwd, size_bytes, rel_path LIKE 'archived_sessions/%' AS archived
    FROM fx_snapshot_files WHERE snapshot_no = 0"""
THREAD_CATALOG = """
    SELECT t.root_id, t.id, CASE WHEN t.n % 11 = 0 THEN '' ELSE t.title END AS title, t.cwd, t.archived = 1 AS archived,
      coalesce(f.rel_path, t.rollout_path) AS rollout_path, f.id IS NOT NULL AS exists_on_disk,
      coalesce(f.size_bytes, 0) AS size_bytes
    FROM fx_threads t LEFT JOIN fx_files f ON f.root_id = t.root_id AND f.id = t.id AND t.n % 3 <> 0
    WHERE t.n % 4 <> 0"""
MERGED = f"""
    SELECT coalesce(p.root_id, f.root_id) AS root_id, coalesce(p.id, f.id) AS id,
      CASE WHEN p.id IS NULL THEN f.title WHEN NOT p.exists_on_disk AND f.id IS NOT NULL AND p.title = '' THEN f.title
        ELSE p.title END AS title,
      CASE WHEN p.id IS NULL OR (NOT p.exists_on_disk AND f.id IS NOT NULL) THEN f.rel_path ELSE p.rollout_path END
        AS rollout_path,
      CASE WHEN p.id IS NULL THEN f.cwd ELSE p.cwd END AS cwd,
      CASE WHEN p.id IS NULL THEN f.archived WHEN NOT p.exists_on_disk AND f.id IS NOT NULL THEN p.archived OR f.archived
        ELSE p.archived END AS archived,
      CASE WHEN p.id IS NULL OR (NOT p.exists_on_disk AND f.id IS NOT NULL) THEN true ELSE p.exists_on_disk END
        AS exists_on_disk,
      CASE WHEN p.id IS NULL OR (NOT p.exists_on_disk AND f.id IS NOT NULL) THEN f.size_bytes ELSE p.size_bytes END
        AS size_bytes
    FROM ({THREAD_CATALOG}) p FULL OUTER JOIN ({FILE_CATALOG}) f ON f.root_id = p.root_id AND f.id = p.id"""
SHOWN = ["root_id", "id", "title", "rollout_path", "cwd", "archived", "exists_on_disk", "size_bytes"]


def _file_catalog(tables: Tables) -> DataFrame:
    files = tables("SELECT *, CAST(0 AS BIGINT) AS mtime FROM fx_snapshot_files WHERE snapshot_no = 0")
    files = files.withColumn("mtime", F.timestamp_seconds("mtime"))
    none = log_lines(tables).filter(F.lit(False))
    titles = files.select("root_id", "id", F.concat(F.lit("file "), "id").alias("title"))
    return catalog.catalog_from_files(files, catalog.rollout_metadata(none), titles)


def _thread_catalog(tables: Tables) -> DataFrame:
    threads = tables("SELECT * FROM fx_threads WHERE n % 4 <> 0")
    files = tables("SELECT root_id, id, rel_path, size_bytes FROM fx_files WHERE n % 3 <> 0")
    return catalog.resolve_rollout_files(threads, files)


@check(MERGED)
def merge_catalogs(tables: Tables) -> DataFrame:
    primary = catalog.catalog_from_threads(_thread_catalog(tables))
    return catalog.merge_catalogs(primary, _file_catalog(tables)).select(*SHOWN)


@check(f"""
    SELECT root_id, id, CASE WHEN title = '' THEN id ELSE title END AS title, rollout_path, archived, exists_on_disk, size_bytes
    FROM ({MERGED}) m WHERE root_id IN (SELECT root_id FROM ({THREAD_CATALOG}) t WHERE NOT exists_on_disk)
      OR root_id NOT IN (SELECT root_id FROM ({THREAD_CATALOG}) t)
    UNION ALL
    SELECT root_id, id, CASE WHEN title = '' THEN id ELSE title END, rollout_path, archived, exists_on_disk, size_bytes
    FROM ({THREAD_CATALOG}) t WHERE root_id NOT IN (SELECT root_id FROM ({THREAD_CATALOG}) t WHERE NOT exists_on_disk)""")
def load_snapshot_catalog(tables: Tables) -> DataFrame:
    found = catalog.load_snapshot_catalog(_thread_catalog(tables), _file_catalog(tables))
    return found.select("root_id", "id", "title", "rollout_path", "archived", "exists_on_disk", "size_bytes")


@check(f"""
    SELECT root_id, id, title, exists_on_disk FROM (
      SELECT root_id, id, CASE WHEN title = '' THEN id ELSE title END AS title, exists_on_disk
      FROM ({THREAD_CATALOG}) t WHERE root_id % 3 <> 0
      UNION ALL SELECT root_id, id, title, true FROM ({FILE_CATALOG}) f
      WHERE root_id NOT IN (SELECT root_id FROM ({THREAD_CATALOG}) t WHERE root_id % 3 <> 0)) c""")
def load_catalog(tables: Tables) -> DataFrame:
    """Every third root has lost its threads table."""
    threads = _thread_catalog(tables).filter("root_id % 3 <> 0")
    return catalog.load_catalog(threads, _file_catalog(tables)).select("root_id", "id", "title", "exists_on_disk")


CATALOG = """
    SELECT root_id, id, CASE WHEN n % 11 = 0 THEN id ELSE title END AS title, cwd, model_provider,
      coalesce(model, 'unknown') AS model, source, coalesce(rel_path, rollout_path) AS rollout_path, archived = 1 AS archived,
      exists_on_disk, size_bytes, created_at AS created, updated_at AS updated
    FROM fx_resolved"""


def full_catalog(tables: Tables) -> DataFrame:
    return catalog.with_display_titles(catalog.catalog_from_threads(resolved(tables)))


@check(CATALOG)
def sorted_catalog(tables: Tables) -> DataFrame:
    found = catalog.sort_catalog(full_catalog(tables))
    return found.select(
        "root_id", "id", "title", "cwd", "model_provider", "model", "source", "rollout_path", "archived",
        "exists_on_disk", "size_bytes",
        F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"),
    )


@check(f"SELECT root_id, id FROM ({CATALOG}) c WHERE NOT archived")
def visible_sessions(tables: Tables) -> DataFrame:
    return catalog.filter_archived(full_catalog(tables)).select("root_id", "id")


@check(f"""
    SELECT root_id, id FROM ({CATALOG}) c WHERE contains(lower(id), 'urgent') OR contains(lower(title), 'urgent')
      OR contains(lower(cwd), 'urgent') OR contains(lower(source), 'urgent') OR contains(lower(rollout_path), 'urgent')""")
def search_sessions(tables: Tables) -> DataFrame:
    return catalog.search_sessions(full_catalog(tables), " URGENT ").select("root_id", "id")


@check(f"""
    SELECT root_id, id FROM ({CATALOG}) c
    WHERE contains(lower(concat_ws(' ', id, title, cwd, model_provider, model, source, rollout_path)), '2 cli /home')
      OR contains(lower(concat_ws(' ', id, title, cwd, model_provider, model, source, rollout_path)), '2 cli sessions')""")
def search_joined(tables: Tables) -> DataFrame:
    c = full_catalog(tables)
    both = [catalog.search_sessions(c, query, "joined") for query in ("2 cli /home", "2 CLI sessions")]
    return both[0].unionByName(both[1]).select("root_id", "id")


@check(f"SELECT DISTINCT root_id, id FROM ({CATALOG}) c WHERE exists_on_disk")
def restorable_sessions(tables: Tables) -> DataFrame:
    return catalog.restorable(full_catalog(tables))


@check("""
    SELECT root_id, CAST(sum(CASE WHEN rel_path LIKE 'sessions/%' THEN 1 ELSE 0 END) AS BIGINT) AS session_count,
      CAST(sum(CASE WHEN rel_path LIKE 'archived%' THEN 1 ELSE 0 END) AS BIGINT) AS archived_session_count
    FROM fx_files GROUP BY root_id""")
def file_counts(tables: Tables) -> DataFrame:
    return snapshots.file_counts(tables("fx_files"))


@check("""
    SELECT root_id, id, rel_path, CASE WHEN rel_path LIKE 'archived%' THEN 1 ELSE 0 END AS dir_rank FROM fx_fleet_files
    WHERE rel_path LIKE 'sessions/%' OR rel_path LIKE 'archived_sessions/%'""")
def session_dirs(tables: Tables) -> DataFrame:
    return catalog.union_session_dirs(tables("fx_fleet_files")).select("root_id", "id", "rel_path", "dir_rank")


NOW_EPOCH = 1701388800


@check(f"""
    SELECT root_id, id, CASE WHEN NOT exists_on_disk THEN 'missing' WHEN {NOW_EPOCH} - updated < 86400 THEN 'today'
        WHEN {NOW_EPOCH} - updated > 7 * 86400 THEN 'stale' ELSE 'recent' END AS freshness,
      CASE WHEN updated > {NOW_EPOCH} THEN 'ahead'
        WHEN {NOW_EPOCH} - updated < 60 THEN 'now'
        WHEN {NOW_EPOCH} - updated < 3600 THEN CAST(({NOW_EPOCH} - updated) // 60 AS STRING) || 'm'
        WHEN {NOW_EPOCH} - updated < 86400 THEN CAST(({NOW_EPOCH} - updated) // 3600 AS STRING) || 'h'
        WHEN {NOW_EPOCH} - updated < 7 * 86400 THEN CAST(({NOW_EPOCH} - updated) // 86400 AS STRING) || 'd'
        WHEN {NOW_EPOCH} - updated < 30 * 86400 THEN CAST(({NOW_EPOCH} - updated) // (7 * 86400) AS STRING) || 'w'
        ELSE 'past' END AS age
    FROM ({CATALOG}) c""")
def session_display(tables: Tables) -> DataFrame:
    now = F.lit("2023-12-01 00:00:00").cast("timestamp")
    c = full_catalog(tables)
    age = text.relative_age(F.col("updated_at"), now)
    shown = F.when(age.rlike(" "), "ahead").when(age.rlike("^....-..-..$"), "past").otherwise(age)
    return c.select(
        "root_id", "id", text.freshness(F.col("updated_at"), F.col("exists_on_disk"), now).alias("freshness"), shown.alias("age")
    )
