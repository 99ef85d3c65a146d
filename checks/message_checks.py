"""Messages, metadata and attachments out of JSON log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.functions import jsonlines, text
from chatstrata.operators import attachments, catalog, lines, messages
from checks.registry import Tables, check

# Even sessions log every message as an event and, one line later, as a response.
LINE_NO = "CASE WHEN conv_id % 2 = 0 THEN turn * 2 ELSE turn END"
SPOKEN = f"""
    SELECT root_id, 'sessions/rollout-' || session_id || '.jsonl' AS rel_path, session_id, conv_id, turn, role,
      CAST({LINE_NO} AS BIGINT) AS line_no,
      CASE WHEN conv_id % 2 = 0 THEN 'event-' ELSE 'response-' END || CAST({LINE_NO} AS STRING) AS message_id,
      regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text
    FROM fx_messages
    WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"""


def log_lines(tables: Tables) -> DataFrame:
    """JSON log lines of the conversations, so that parsing is really done."""
    m = tables("fx_messages")
    path = F.concat(F.lit("sessions/rollout-"), "session_id", F.lit(".jsonl"))
    stamp = F.concat(F.lit("2024-01-01T00:0"), F.col("turn").cast("string"), F.lit(":00.500Z"))

    def line(kind: str, **payload) -> F.Column:
        fields = [value.alias(name) for name, value in payload.items()]
        return F.to_json(F.struct(F.lit(kind).alias("type"), stamp.alias("timestamp"), F.struct(*fields).alias("payload")))

    meta = line(
        "session_meta",
        cwd=F.concat(F.lit("/w/"), F.col("conv_id").cast("string")),
        model_provider=F.lit("p"),
        model=F.lit("m"),
    )
    user = line(
        "event_msg",
        type=F.lit("user_message"),
        message=F.col("text"),
        images=F.array_compact(F.array("attachment")),
    )
    # Every third reply has an empty message and its text in the content.
    hidden = F.col("conv_id") % 3 == 0
    reply = line(
        "event_msg",
        type=F.lit("agent_message"),
        message=F.when(hidden, "").otherwise(F.col("text")),
        content=F.when(hidden, F.array(F.struct(F.struct(F.array(F.col("text")).alias("content")).alias("output")))),
    )
    response = line(
        "response_item",
        type=F.lit("message"),
        role=F.col("role"),
        content=F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"))),
    )
    own = (
        F.when(F.col("line_type") == "session_meta", meta)
        .when(F.col("line_type") == "response_item", response)
        .when(F.col("role") == "user", user)
        .otherwise(reply)
    )
    keys = ["root_id", path.alias("rel_path"), "session_id"]
    even = F.col("conv_id") % 2 == 0
    number = F.when(even, F.col("turn") * 2).otherwise(F.col("turn"))
    copies = m.filter(even).select(*keys, (number + 1).alias("line_no"), response.alias("line"))
    return m.select(*keys, number.alias("line_no"), own.alias("line")).unionByName(copies)


@check(f"""
    SELECT root_id, rel_path, session_id, line_no, message_id, role, text,
      CAST(1704067200500 + turn * 60000 AS BIGINT) AS ts_ms
    FROM ({SPOKEN}) s""")
def conversation_messages(tables: Tables) -> DataFrame:
    found = messages.conversation_messages(log_lines(tables))
    return found.select(
        "root_id", "rel_path", "session_id", "line_no", "message_id", "role", "text", F.unix_millis("ts").alias("ts_ms")
    )


@check(f"""
    SELECT session_id, count(*) AS message_count, least(count(*), 20) AS preview_count
    FROM ({SPOKEN}) s GROUP BY session_id""")
def message_counts(tables: Tables) -> DataFrame:
    counts = messages.conversation_counts(messages.conversation_messages(log_lines(tables)))
    return counts.select("session_id", "message_count", "preview_count")


@check(f"""
    SELECT session_id, line_no, nth, role,
      CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || ' …' ELSE text END AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS nth FROM ({SPOKEN}) s) n
    WHERE nth <= 3""")
def preview_messages(tables: Tables) -> DataFrame:
    found = messages.conversation_messages(log_lines(tables))
    return messages.preview_messages(found, 3, 60, " …").select("session_id", "line_no", "nth", "role", "text")


@check("""
    SELECT session_id, count(*) AS candidates, sum(CASE WHEN conv_id % 2 = 0 AND line_type = 'event_msg' THEN 1 ELSE 0 END)
      AS events
    FROM (
      SELECT session_id, conv_id, line_type FROM fx_messages WHERE line_type <> 'session_meta'
      UNION ALL SELECT session_id, conv_id, 'copy' FROM fx_messages WHERE conv_id % 2 = 0) l
    GROUP BY session_id""")
def message_line_candidates(tables: Tables) -> DataFrame:
    found = messages.message_line_prefilter(log_lines(tables))
    return found.groupBy("session_id").agg(
        F.count("*").alias("candidates"), F.count_if(messages.is_event_line(F.col("line"))).alias("events")
    )


@check(f"""
    SELECT session_id, max(CASE WHEN turn = 0 THEN 1 ELSE 0 END) = 1 AS any_line,
      coalesce(min(CASE WHEN role = 'user' AND conv_id % 2 = 0 AND turn = first_turn THEN text END), '') AS title,
      max(CASE WHEN has_meta = 1 THEN '/w/' || CAST(conv_id AS STRING) ELSE '' END) AS cwd,
      max(CASE WHEN has_meta = 1 THEN 'p' ELSE 'unknown' END) AS model_provider,
      max(CASE WHEN has_meta = 1 THEN 'm' ELSE 'unknown' END) AS model, 'jsonl' AS source
    FROM (
      SELECT *, min(CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN turn END) OVER (PARTITION BY session_id) AS first_turn,
        max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS has_meta
      FROM fx_messages) m
    GROUP BY session_id""")
def rollout_metadata(tables: Tables) -> DataFrame:
    meta = catalog.rollout_metadata(log_lines(tables))
    session = F.regexp_extract("rel_path", "rollout-(.*).jsonl", 1)
    return meta.select(
        session.alias("session_id"), F.lit(True).alias("any_line"), "title", "cwd", "model_provider", "model", "source"
    )


@check("""
    SELECT session_id, line_no FROM (
      SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN turn * 2 ELSE turn END AS line_no FROM fx_messages
      UNION ALL SELECT session_id, turn * 2 + 1 FROM fx_messages WHERE conv_id % 2 = 0) l
    WHERE line_no < 3""")
def head_lines(tables: Tables) -> DataFrame:
    return lines.head_lines(log_lines(tables), 3).select("session_id", "line_no")


INVENTORY = """
    SELECT DISTINCT root_id, attachment AS path, CAST(length(attachment) AS BIGINT) AS size_bytes
    FROM fx_messages WHERE attachment IS NOT NULL AND conv_id % 3 <> 0"""
COLLECTED = f"""
    SELECT a.root_id, a.session_id, a.attachment AS original_path,
      'external_attachments/' || a.session_id || '/' || sha256(a.attachment) || '-' || regexp_extract(a.attachment, '[^/]*$')
        AS stored_path, i.size_bytes
    FROM (SELECT root_id, attachment, min(session_id) AS session_id FROM fx_messages
      WHERE role = 'user' AND line_type = 'event_msg' AND attachment LIKE '%.PNG' AND conv_id % 7 <> 0
      GROUP BY root_id, attachment) a
    JOIN ({INVENTORY}) i ON i.root_id = a.root_id AND i.path = a.attachment"""


def _collected(tables: Tables) -> DataFrame:
    ids = tables("SELECT DISTINCT root_id, session_id AS id FROM fx_messages WHERE conv_id % 7 <> 0")
    return attachments.collect_attachments(log_lines(tables), ids, tables(INVENTORY))


@check(COLLECTED)
def collected_attachments(tables: Tables) -> DataFrame:
    return _collected(tables)


@check(f"""
    SELECT * FROM ({COLLECTED}) c
    WHERE CAST(substr(session_id, 25) AS BIGINT) % 5 <> 0 AND CAST(substr(session_id, 25) AS BIGINT) % 4 <> 3
      AND original_path NOT LIKE '%-5.PNG'""")
def attachments_to_restore(tables: Tables) -> DataFrame:
    manifest = _collected(tables)
    stored = manifest.filter("CAST(substr(session_id, 25) AS BIGINT) % 5 <> 0").select("root_id", "stored_path")
    in_place = tables(INVENTORY).filter("path LIKE '%-5.PNG'")
    ids = tables("SELECT DISTINCT root_id, session_id AS id FROM fx_messages WHERE conv_id % 4 <> 3")
    return attachments.restore_attachments(manifest, stored, in_place, ids)


@check("""
    SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN text
        WHEN conv_id % 4 = 1 THEN text || chr(10) || role
        WHEN conv_id % 4 = 2 THEN role ELSE text END AS body, conv_id % 4 = 3 AS deep
    FROM fx_messages""")
def extracted_text(tables: Tables) -> DataFrame:
    """Bodies of four shapes: a string, a list of parts, an object, and one nested 12 or 40 levels deep."""
    m = tables("fx_messages")
    part = F.struct(F.col("text").alias("text"))
    blank = F.struct(F.lit(" ").alias("text"))
    listed = F.to_json(F.array(part, blank, F.struct(F.col("role").alias("text"))))
    keyed = F.to_json(F.struct(F.lit(" ").alias("text"), F.struct(F.col("role").alias("output")).alias("content")))
    levels = F.when(F.col("turn") % 2 == 0, 12).otherwise(40)
    nested = F.concat(F.repeat(F.lit("["), levels), F.to_json(part), F.repeat(F.lit("]"), levels))
    string = F.concat(F.lit('"'), F.regexp_replace(F.to_json(part), r'^\{"text":"|"\}$', ""), F.lit('"'))
    shape = F.col("conv_id") % 4
    body = F.when(shape == 0, string).when(shape == 1, listed).when(shape == 2, keyed).otherwise(nested)
    value = jsonlines.parse_line(body)
    return m.select(
        "conv_id",
        "turn",
        jsonlines.whole_text(value).alias("body"),
        jsonlines.exceeds_depth(value).alias("deep"),
    )


@check("""
    SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS preview,
      CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '#' ELSE text END AS clipped
    FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t
      FROM documents) d""")
def text_previews(tables: Tables) -> DataFrame:
    d = tables("SELECT doc_id, text FROM documents")
    return d.select(
        "doc_id",
        text.one_line_preview(F.col("text")).alias("preview"),
        text.clip_text(F.col("text"), 200, "#").alias("clipped"),
    )
