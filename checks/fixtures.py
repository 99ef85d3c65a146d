"""Archive tables derived from the test tables.

Each view is one SQL text that means the same in Spark and in DuckDB. A view may
use those before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["orders", "lineitem", "events", "documents", "conversations"]


def uuid_of(number: str) -> str:
    return f"'00000000-0000-4000-8000-' || lpad(CAST({number} AS STRING), 12, '0')"


VIEWS = {
    # The threads table: one root per customer.
    "fx_threads": f"""
        SELECT o_orderkey AS n, {uuid_of('o_orderkey')} AS id, o_custkey AS root_id,
          CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'order ' || CAST(o_orderkey AS STRING) END AS title,
          '/home/u' || CAST(o_custkey AS STRING) || '/.codex/'
            || CASE WHEN o_orderstatus = 'F' THEN 'archived_sessions' ELSE 'sessions' END
            || '/rollout-' || {uuid_of('o_orderkey')} || '.jsonl' AS rollout_path,
          '/work/' || o_orderpriority AS cwd, o_orderpriority AS model_provider,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'm' || CAST(o_orderkey % 4 AS STRING) END AS model,
          CASE WHEN o_orderkey % 2 = 0 THEN 'cli' ELSE 'vscode' END AS source,
          CAST(1700000000 + o_orderkey * 60 AS BIGINT) AS created_at,
          CAST(1700000000 + o_orderkey * 90 AS BIGINT) AS updated_at,
          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS archived
        FROM orders""",
    # Log files: every 5th missing, every 13th moved so that only its name tells.
    "fx_files": """
        SELECT t.n, t.root_id, t.id,
          CASE WHEN t.archived = 1 THEN 'archived_sessions' ELSE 'sessions' END
            || CASE WHEN t.n % 13 = 0 THEN '/moved' ELSE '' END || '/rollout-' || t.id || '.jsonl' AS rel_path,
          CAST(100 + coalesce(l.c, 0) * 1000 AS BIGINT) AS size_bytes, t.updated_at + 5 AS mtime
        FROM fx_threads t
        LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = t.n
        WHERE t.n % 5 <> 0""",
    "fx_snapshots": """
        SELECT event_id AS n,
          CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN '20240101-000000-manual'
            ELSE '20240101-000000-snap' || CAST(event_id AS STRING) END AS id,
          user_id AS root_id, ts AS created_at,
          CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'auto-protect' WHEN 'purchase' THEN 'pre-restore'
            WHEN 'error' THEN 'pre-delete-session' ELSE NULL END AS reason,
          CAST(NULL AS STRING) AS kind, CAST(event_id % 50 AS BIGINT) AS session_count,
          CAST(event_id % 7 AS BIGINT) AS archived_session_count
        FROM events""",
    # Three snapshots of every root; which is the newest depends on the root.
    "fx_root_snapshots": " UNION ALL ".join(
        f"""SELECT root_id, 'snap-{k}' AS id, {k} AS snapshot_no, '{reason}' AS reason, CAST(NULL AS STRING) AS kind,
          CAST(1700000000 + ((root_id + {k}) % 3) * 1000 AS BIGINT) AS created_epoch,
          CAST(root_id % 9 AS BIGINT) AS session_count, CAST(root_id % 2 AS BIGINT) AS archived_session_count
        FROM (SELECT DISTINCT root_id FROM fx_threads) r"""
        for k, reason in enumerate(["manual", "auto-protect", "pre-restore"])
    ),
    "fx_snapshot_files": " UNION ALL ".join(
        f"""SELECT {k} AS snapshot_no, 'snap-{k}' AS snapshot_id, root_id, id, rel_path, size_bytes + {k} AS size_bytes
        FROM fx_files WHERE n % {k + 2} = 0"""
        for k in range(3)
    ),
    # State tables of one root (computed, so that it is no constant to the optimizer), a current and a snapshot version with other columns.
    "fx_state_dst": """
        SELECT CAST(n * 0 + 1 AS BIGINT) AS root_id, id, title, model, archived, 'dst' AS only_in_dst
        FROM fx_threads WHERE n % 3 <> 0""",
    "fx_state_src": """
        SELECT CAST(n * 0 + 1 AS BIGINT) AS root_id, id, 'snap ' || id AS title, model, archived, 'src' AS only_in_src
        FROM fx_threads WHERE n % 2 = 0""",
    "fx_edges": f"""
        SELECT CAST(l_orderkey * 0 + 1 AS BIGINT) AS root_id,
          CASE WHEN l_linenumber = 5 THEN NULL ELSE {uuid_of('l_orderkey')} END AS parent_thread_id,
          CASE WHEN l_linenumber = 6 THEN NULL ELSE {uuid_of('l_partkey')} END AS child_thread_id,
          l_linenumber AS edge_no
        FROM lineitem""",
    "fx_jobs": f"""
        SELECT CAST(l_orderkey * 0 + 1 AS BIGINT) AS root_id, l_orderkey * 10 + l_linenumber AS item,
          CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE {uuid_of('l_orderkey')} END AS assigned_thread_id
        FROM lineitem""",
    "fx_allowed": "SELECT CAST(n * 0 + 1 AS BIGINT) AS root_id, id FROM fx_threads WHERE n % 4 = 0",
    # Log lines by kind; sessions of even number are logged as events.
    "fx_messages": f"""
        SELECT conv_id, turn, conv_id % 8 AS root_id, {uuid_of('conv_id')} AS session_id, role, text,
          CASE WHEN role = 'system' THEN 'session_meta' WHEN conv_id % 2 = 0 THEN 'event_msg'
            ELSE 'response_item' END AS line_type,
          CASE WHEN turn % 2 = 1 THEN '/tmp/att/' || CAST(conv_id % 40 AS STRING) || '-' || CAST(turn AS STRING)
            || CASE WHEN turn % 4 = 1 THEN '.PNG' ELSE '.exe' END ELSE NULL END AS attachment
        FROM conversations""",
    "fx_history": """
        SELECT conv_id, root_id, session_id, text AS first_text,
          CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id % 2 = 0 END AS is_archived, conv_id * 10 + turn AS line_no
        FROM fx_messages""",
    "fx_session_index": """
        SELECT conv_id, root_id, session_id AS id,
          'thread ' || CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS thread_name,
          conv_id * 10 + turn AS line_no
        FROM fx_messages WHERE conv_id % 3 = 0 AND turn < 3""",
    # Lines of one file: JSON with an id and a mention, or plain notes that repeat.
    "fx_log_lines": f"""
        SELECT CAST(conv_id * 0 + 1 AS BIGINT) AS root_id, 'history.jsonl' AS rel_path, conv_id * 100 + turn * 2 AS line_no,
          'json' AS kind, session_id, {uuid_of('(conv_id * 3 + turn) % 100')} AS ref_id, text
        FROM fx_messages
        UNION ALL
        SELECT CAST(conv_id * 0 + 1 AS BIGINT), 'history.jsonl', conv_id * 100 + turn * 2 + 1, 'note', NULL,
          {uuid_of('(conv_id * 3 + turn) % 100')}, NULL
        FROM fx_messages WHERE turn < 3""",
    "fx_line_ids": f"SELECT DISTINCT CAST(conv_id * 0 + 1 AS BIGINT) AS root_id, session_id AS id FROM fx_messages WHERE conv_id % 4 = 0",
    "fx_line_current": """
        SELECT CAST(doc_id * 0 + 1 AS BIGINT) AS root_id, 'history.jsonl' AS rel_path, doc_id AS line_no, text AS line
        FROM documents WHERE doc_id % 3 <> 0""",
    "fx_line_snapshot": """
        SELECT CAST(doc_id * 0 + 1 AS BIGINT) AS root_id, 'history.jsonl' AS rel_path, doc_id AS line_no, text AS line
        FROM documents WHERE doc_id % 2 = 0""",
    # Catalog log files and their copies in the other directory.
    "fx_log_files": """
        SELECT DISTINCT conv_id, root_id, session_id AS id,
          CASE WHEN conv_id % 5 = 0 THEN 'archived_sessions' ELSE 'sessions' END
            || '/rollout-' || session_id || '.jsonl' AS rel_path,
          CAST(1000 + conv_id AS BIGINT) AS size_bytes, CAST(1700000000 + conv_id AS BIGINT) AS mtime
        FROM fx_messages""",
    # Threads resolved by rule: path match, else by name.
    "fx_resolved": """
        SELECT t.*, f.rel_path, f.id IS NOT NULL AS exists_on_disk, coalesce(f.size_bytes, 0) AS size_bytes
        FROM fx_threads t LEFT JOIN fx_files f ON f.root_id = t.root_id AND f.id = t.id""",
    # A fleet for the jobs: files of all kinds, lines and state of every root.
    "fx_roots": """
        SELECT root_id, '/home/u' || CAST(root_id AS STRING) || '/.codex' AS root_path
        FROM (SELECT DISTINCT root_id FROM fx_threads) r""",
    "fx_fleet_files": """
        SELECT root_id, id, rel_path, size_bytes, mtime FROM fx_files
        UNION ALL
        SELECT root_id, id, 'shell_snapshots/' || CAST(n % 3 AS STRING) || '/' || id || '.sh', n % 100, updated_at
        FROM fx_threads WHERE n % 6 = 1
        UNION ALL SELECT root_id, '', 'history.jsonl', 1000, 0 FROM fx_roots
        UNION ALL SELECT root_id, '', 'session_index.jsonl', 500, 0 FROM fx_roots
        UNION ALL SELECT root_id, '', 'config.toml', 50, 0 FROM fx_roots
        UNION ALL SELECT root_id, '', 'notes.txt', 7, 0 FROM fx_roots""",
    "fx_fleet_history": "SELECT root_id, n AS line_no, id, title, n FROM fx_threads",
    "fx_fleet_index": """
        SELECT root_id, n * 2 AS line_no, id, 0 AS again, n FROM fx_threads WHERE n % 3 = 0
        UNION ALL SELECT root_id, n * 2 + 1, id, 1, n FROM fx_threads WHERE n % 9 = 0""",
    "fx_fleet_states": "SELECT root_id FROM fx_roots WHERE root_id % 5 <> 0",
    "fx_fleet_goals": """
        SELECT t.root_id, t.id AS thread_id, CAST(k.n % 2 AS BIGINT) AS goal_no
        FROM fx_threads t JOIN fx_threads k ON k.n = t.n WHERE t.n % 4 < 2""",
    "fx_fleet_jobs": """
        SELECT root_id, n AS item, CASE WHEN n % 8 = 0 THEN NULL ELSE id END AS assigned_thread_id
        FROM fx_threads WHERE n % 2 = 0""",
    # The current files lack every 7th log.
    "fx_now_files": """
        SELECT * FROM fx_fleet_files
        WHERE id = '' OR rel_path LIKE 'shell%' OR CAST(substr(id, 25) AS BIGINT) % 7 <> 3""",
    # One snapshot per root, older than the current state: other titles, fewer sessions.
    "fx_store_files": """
        SELECT root_id, id, rel_path, size_bytes + 1 AS size_bytes, mtime FROM fx_fleet_files
        WHERE id <> '' AND CAST(substr(id, 25) AS BIGINT) % 3 <> 0
        UNION ALL SELECT root_id, id, rel_path, size_bytes, mtime FROM fx_fleet_files WHERE rel_path = 'history.jsonl'""",
    "fx_store_logs": "SELECT * FROM fx_store_files WHERE rel_path LIKE '%sessions/%'",
    "fx_store_history": """
        SELECT root_id, n AS line_no, id, CASE WHEN n % 4 = 0 THEN title ELSE 'old ' || CAST(n AS STRING) END AS title, n
        FROM fx_threads WHERE n % 2 = 0 OR n % 8 = 1""",
    "fx_store_states": "SELECT root_id FROM fx_roots WHERE root_id % 5 <> 1",
    "fx_store_threads": """
        SELECT t.root_id, t.id, 'snap' AS title, t.rollout_path, t.cwd, t.model_provider, t.model, t.source,
          t.created_at, t.updated_at, t.archived, t.n, f.id IS NOT NULL AS held
        FROM fx_threads t LEFT JOIN fx_store_logs f ON f.root_id = t.root_id AND f.id = t.id
        WHERE t.n % 2 = 0 AND t.root_id % 5 <> 1""",
    "fx_store_jobs": """
        SELECT root_id, n AS item, CASE WHEN n % 16 = 2 THEN NULL ELSE id END AS assigned_thread_id
        FROM fx_threads WHERE n % 2 = 0 AND root_id % 5 <> 1""",
    # Sessions the snapshots can restore: all held ones, unless every thread has its file.
    "fx_store_sessions": """
        SELECT root_id, id FROM fx_store_threads WHERE held
        UNION SELECT root_id, id FROM fx_store_logs
        WHERE root_id NOT IN (SELECT root_id FROM fx_store_threads GROUP BY root_id HAVING min(CASE WHEN held THEN 1 ELSE 0 END) = 1)""",
    "fx_chosen": "SELECT root_id, root_path FROM fx_roots WHERE root_id % 7 <> 6",
    # Sessions named in the restore and delete jobs.
    "fx_picked": "SELECT root_id, id, n FROM fx_threads WHERE n % 4 = 1 OR n % 8 = 2",
}


def needed_views(sql: str) -> list[str]:
    """Views the SQL text uses, directly or through others, in order."""
    found: set[str] = set()
    pending = [sql]
    while pending:
        for name in set(re.findall(r"\bfx_\w+", pending.pop())) - found:
            found.add(name)
            pending.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def with_views(sql: str) -> str:
    """The SQL text with the views it uses as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in needed_views(sql)]
    if not parts:
        return sql
    text = sql.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {text[5:]}"
    return f"WITH {', '.join(parts)} {text}"


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Views of the test tables, made once per session and data folder."""
    if spark.conf.get("chatstrata.checks.tables", "") == sf_dir:
        return
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    spark.conf.set("chatstrata.checks.tables", sf_dir)


def view(spark: SparkSession, sql: str) -> DataFrame:
    """A view by name, or any query over the views."""
    return spark.sql(with_views(sql if " " in sql else f"SELECT * FROM {sql}"))
