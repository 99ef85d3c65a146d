"""State tables: prune, select, upsert, delete, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.operators import state
from checks.registry import Tables, check

EITHER = "parent_thread_id IN (SELECT id FROM fx_allowed) OR child_thread_id IN (SELECT id FROM fx_allowed)"


@check(f"""
    SELECT 'dst' AS part, id AS k1, CAST(NULL AS STRING) AS k2, CAST(0 AS BIGINT) AS item FROM fx_state_dst
    WHERE id IN (SELECT id FROM fx_allowed)
    UNION ALL SELECT 'edge', parent_thread_id, child_thread_id, edge_no FROM fx_edges
    WHERE parent_thread_id IS NULL OR child_thread_id IS NULL OR {EITHER}
    UNION ALL SELECT 'job', assigned_thread_id, NULL, item FROM fx_jobs
    WHERE assigned_thread_id IS NULL OR assigned_thread_id IN (SELECT id FROM fx_allowed)""")
def prune_state(tables: Tables) -> DataFrame:
    return _stacked(state.prune_state(_tables(tables), tables("fx_allowed")))


@check(f"""
    SELECT 'dst' AS part, id AS k1, CAST(NULL AS STRING) AS k2, CAST(0 AS BIGINT) AS item FROM fx_state_dst
    WHERE id IN (SELECT id FROM fx_allowed)
    UNION ALL SELECT 'edge', parent_thread_id, child_thread_id, edge_no FROM fx_edges WHERE {EITHER}
    UNION ALL SELECT 'job', assigned_thread_id, NULL, item FROM fx_jobs
    WHERE assigned_thread_id IN (SELECT id FROM fx_allowed)""")
def select_state(tables: Tables) -> DataFrame:
    return _stacked(state.select_state(_tables(tables), tables("fx_allowed")))


@check(f"""
    SELECT 'dst' AS part, id AS k1, CAST(NULL AS STRING) AS k2, CAST(0 AS BIGINT) AS item FROM fx_state_dst
    WHERE id NOT IN (SELECT id FROM fx_allowed)
    UNION ALL SELECT 'edge', parent_thread_id, child_thread_id, edge_no FROM fx_edges
    WHERE NOT coalesce(parent_thread_id IN (SELECT id FROM fx_allowed), false)
      AND NOT coalesce(child_thread_id IN (SELECT id FROM fx_allowed), false)
    UNION ALL SELECT 'job', assigned_thread_id, NULL, item FROM fx_jobs
    WHERE NOT coalesce(assigned_thread_id IN (SELECT id FROM fx_allowed), false)""")
def delete_state(tables: Tables) -> DataFrame:
    return _stacked(state.delete_state(_tables(tables), tables("fx_allowed")))


def _tables(tables: Tables) -> state.Tables:
    return {
        "threads": tables("fx_state_dst"),
        "thread_spawn_edges": tables("fx_edges"),
        "agent_job_items": tables("fx_jobs"),
    }


def _stacked(found: state.Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    threads = found["threads"].select(
        F.lit("dst").alias("part"), F.col("id").alias("k1"), none.alias("k2"), F.lit(0).cast("bigint").alias("item")
    )
    edges = found["thread_spawn_edges"].select(
        F.lit("edge").alias("part"), F.col("parent_thread_id").alias("k1"), F.col("child_thread_id").alias("k2"),
        F.col("edge_no").cast("bigint").alias("item"),
    )
    jobs = found["agent_job_items"].select(
        F.lit("job").alias("part"), F.col("assigned_thread_id").alias("k1"), none.alias("k2"), F.col("item")
    )
    return threads.unionByName(edges).unionByName(jobs)


@check("""
    SELECT root_id, id, title, model, archived, only_in_dst FROM fx_state_dst
    WHERE id NOT IN (SELECT id FROM fx_state_src)
    UNION ALL SELECT root_id, id, title, model, archived, NULL FROM fx_state_src""")
def upsert_state(tables: Tables) -> DataFrame:
    """Half of the source rows come twice; the later one counts."""
    src = tables("fx_state_src")
    older = src.filter("archived = 0").withColumn("title", F.lit("older"))
    src = src.withColumn("version", F.lit(2)).unionByName(older.withColumn("version", F.lit(1)))
    merged = state.upsert_state(
        {"threads": tables("fx_state_dst")}, {"threads": src, "stage1_outputs": src}, order_by=("version",)
    )
    return merged["threads"]


@check("""
    SELECT r.root_id, r.id, CASE WHEN f.id IS NOT NULL AND r.n % 4 = 0 THEN '/srv/r' || CAST(r.root_id AS STRING) || '/' || f.rel_path
        ELSE r.rollout_path END AS rollout_path,
      CASE WHEN f.id IS NOT NULL AND r.n % 4 = 0 THEN CASE WHEN f.rel_path LIKE 'archived%' THEN 1 ELSE 0 END
        ELSE r.archived END AS archived
    FROM fx_threads r LEFT JOIN fx_files f ON f.root_id = r.root_id AND f.id = r.id""")
def repair_paths(tables: Tables) -> DataFrame:
    target = F.concat(F.lit("/srv/r"), F.col("root_id").cast("string"), F.lit("/"))
    ids = tables("SELECT root_id, id FROM fx_threads WHERE n % 4 = 0")
    repaired = state.repair_rollout_paths(tables("fx_threads"), tables("fx_files"), target, ids)
    return repaired.select("root_id", "id", "rollout_path", "archived")
