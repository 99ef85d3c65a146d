"""Line files: membership, repeats, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.operators import lines, snapshots
from checks.registry import Tables, check

IDS = "(SELECT id FROM fx_line_ids)"
MENTION = f"(session_id IN {IDS} OR ref_id IN {IDS})"
KEY = f"(CASE WHEN kind = 'json' THEN session_id IN {IDS} ELSE ref_id IN {IDS} END)"
FIRST = """row_number() OVER (PARTITION BY kind, session_id, ref_id, text ORDER BY line_no) = 1"""


def mixed_lines(tables: Tables) -> DataFrame:
    """JSON lines with an id and a mention of another, and plain notes."""
    v = tables("fx_log_lines")
    noted = F.concat(F.lit("note "), "ref_id", F.lit(" seen"))
    json = F.to_json(F.struct("session_id", F.concat("text", F.lit(" ref "), "ref_id").alias("first_text")))
    return v.select("root_id", "rel_path", "line_no", F.when(F.col("kind") == "json", json).otherwise(noted).alias("line"))


@check(f"SELECT line_no FROM (SELECT line_no, {FIRST} AS first FROM fx_log_lines WHERE {MENTION}) l WHERE first")
def filter_lines(tables: Tables) -> DataFrame:
    return lines.filter_lines(mixed_lines(tables), tables("fx_line_ids")).select("line_no")


@check(f"SELECT line_no FROM (SELECT line_no, {FIRST} AS first FROM fx_log_lines WHERE {KEY}) l WHERE first")
def filter_lines_by_key(tables: Tables) -> DataFrame:
    return lines.filter_lines(mixed_lines(tables), tables("fx_line_ids"), "key").select("line_no")


@check(f"SELECT line_no FROM fx_log_lines WHERE NOT coalesce({KEY}, false)")
def delete_lines(tables: Tables) -> DataFrame:
    return lines.delete_lines(mixed_lines(tables), tables("fx_line_ids")).select("line_no")


@check(f"SELECT line_no FROM fx_log_lines WHERE NOT coalesce({MENTION}, false)")
def delete_mentions(tables: Tables) -> DataFrame:
    return lines.delete_lines(mixed_lines(tables), tables("fx_line_ids"), "mention").select("line_no")


@check("""
    SELECT line_no, line FROM (
      SELECT line_no, line, row_number() OVER (PARTITION BY line ORDER BY line_no) AS nth FROM fx_line_current) l
    WHERE nth = 1""")
def dedupe_lines(tables: Tables) -> DataFrame:
    return lines.dedupe_ordered(tables("fx_line_current")).select("line_no", "line")


@check("""
    SELECT root_id, id, min(line_no) AS line_no FROM fx_session_index GROUP BY root_id, id
    UNION ALL SELECT root_id, 'raw', min(line_no) + 1000000 FROM fx_session_index GROUP BY root_id""")
def dedupe_by_key(tables: Tables) -> DataFrame:
    """Index lines are told apart by their id, other lines by their text."""
    v = tables("fx_session_index").withColumn("rel_path", F.lit("session_index.jsonl"))
    entries = v.withColumn("line", F.to_json(F.struct("id", "thread_name")))
    raw = v.withColumn("line", F.lit("raw")).withColumn("id", F.lit("raw")).withColumn("line_no", F.col("line_no") + 1000000)
    return lines.dedupe_ordered(entries.unionByName(raw), "id").select("root_id", "id", "line_no")


@check("""
    WITH both_files AS (
      SELECT line_no, line FROM fx_line_current WHERE regexp_replace(line, '\\s+', '', 'g') <> ''
      UNION ALL SELECT line_no + (SELECT max(line_no) + 1 FROM fx_line_current), line FROM fx_line_snapshot
      WHERE regexp_replace(line, '\\s+', '', 'g') <> '')
    SELECT line_no, line FROM (
      SELECT line_no, line, row_number() OVER (PARTITION BY line ORDER BY line_no) AS nth FROM both_files) l WHERE nth = 1""")
def merge_lines(tables: Tables) -> DataFrame:
    return lines.merge_lines(tables("fx_line_current"), tables("fx_line_snapshot")).select("line_no", "line")


@check(f"""
    SELECT line_no FROM (
      SELECT line_no, {FIRST} AS first FROM (
        SELECT line_no, kind, session_id, ref_id, text FROM fx_log_lines WHERE line_no % 3 <> 0
        UNION ALL SELECT line_no + (SELECT max(line_no) + 1 FROM fx_log_lines WHERE line_no % 3 <> 0),
          kind, session_id, ref_id, text FROM fx_log_lines WHERE line_no % 2 = 0 AND {KEY}) u) l WHERE first""")
def merge_session_lines(tables: Tables) -> DataFrame:
    """Only the lines of some sessions come from the snapshot."""
    both = mixed_lines(tables)
    current, snapshot = both.filter("line_no % 3 <> 0"), both.filter("line_no % 2 = 0")
    return lines.merge_lines(current, snapshot, tables("fx_line_ids"), match="key").select("line_no")


@check("SELECT line_no FROM fx_line_current WHERE regexp_replace(line, '\\s+', '', 'g') <> ''")
def valid_lines(tables: Tables) -> DataFrame:
    return lines.valid_lines(tables("fx_line_current")).select("line_no")


# Ids inside longer words, with blanks, with other letters, and short ones.
ANY_IDS = """
    SELECT root_id, CASE WHEN substr(id, 36, 1) IN ('0', '4', '8', 'c') THEN id ELSE substr(id, 25, 12) END AS id FROM fx_line_ids
    UNION ALL SELECT 1, 'ref 0' UNION ALL SELECT 1, 'é ü7' UNION ALL SELECT 1, 'x' UNION ALL SELECT 1, 'zz-none-zz' UNION ALL SELECT 1, ''"""
ANY_LINES = """
    SELECT root_id, rel_path, line_no, CASE line_no % 5
      WHEN 0 THEN 'run' || ref_id || 'end' WHEN 1 THEN 'é ü' || CAST(line_no % 11 AS STRING) || ' ' || substr(ref_id, 25)
      WHEN 2 THEN 'a ref ' || ref_id WHEN 3 THEN '{"id": "a_' || ref_id || '", "n": "' || substr(ref_id, 1, 30) || '"}'
      ELSE coalesce(text, 'none') END AS line
    FROM fx_log_lines"""


@check(f"""
    SELECT DISTINCT l.line_no FROM ({ANY_LINES}) l JOIN ({ANY_IDS}) i ON i.id <> '' AND contains(l.line, i.id)""")
def mentions_anywhere(tables: Tables) -> DataFrame:
    """Lines that contain an id at any place."""
    return lines.keep_lines(tables(ANY_LINES), tables(ANY_IDS)).select("line_no")


@check(f"""
    SELECT rel_path FROM (SELECT DISTINCT rel_path FROM fx_log_files) f
    WHERE EXISTS (SELECT 1 FROM ({ANY_IDS}) i WHERE i.id <> '' AND contains(regexp_replace(f.rel_path, '.*/', ''), i.id))""")
def files_named_anywhere(tables: Tables) -> DataFrame:
    """Log files with an id at any place of their names."""
    files = tables("SELECT DISTINCT CAST(conv_id * 0 + 1 AS BIGINT) AS root_id, rel_path FROM fx_log_files")
    return snapshots.select_snapshot_files(files, tables(ANY_IDS)).select("rel_path")
