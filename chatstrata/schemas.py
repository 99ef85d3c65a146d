"""Schemas of the archive tables."""

LINES = "root_id BIGINT, rel_path STRING, session_id STRING, line_no BIGINT, line STRING"
MESSAGES = (
    "root_id BIGINT, rel_path STRING, session_id STRING, line_no BIGINT, message_id STRING, "
    "role STRING, phase STRING, ts TIMESTAMP, text STRING"
)
FILES = "root_id BIGINT, id STRING, rel_path STRING, size_bytes BIGINT, mtime TIMESTAMP"
THREADS = (
    "root_id BIGINT, id STRING, title STRING, rollout_path STRING, cwd STRING, model_provider STRING, "
    "model STRING, source STRING, created_at BIGINT, updated_at BIGINT, archived INT"
)
CATALOG = (
    "root_id BIGINT, id STRING, title STRING, rollout_path STRING, cwd STRING, model_provider STRING, "
    "model STRING, source STRING, created_at TIMESTAMP, updated_at TIMESTAMP, archived BOOLEAN, "
    "exists_on_disk BOOLEAN, size_bytes BIGINT"
)
CATALOG_COLUMNS = [field.split()[0] for field in CATALOG.split(", ")]
SNAPSHOTS = (
    "root_id BIGINT, id STRING, name STRING, created_at TIMESTAMP, snapshot_root STRING, reason STRING, "
    "kind STRING, model_provider STRING, model STRING, account_fingerprint STRING, session_count BIGINT, "
    "archived_session_count BIGINT, size_bytes BIGINT, included_paths ARRAY<STRING>, app_version STRING, "
    "warnings ARRAY<STRING>"
)
# Manifest documents as they lie on disk.
MANIFEST = (
    "id STRING, name STRING, createdAt STRING, codexRoot STRING, reason STRING, kind STRING, "
    "modelProvider STRING, model STRING, accountFingerprint STRING, sessionCount BIGINT, "
    "archivedSessionCount BIGINT, sizeBytes BIGINT, includedPaths ARRAY<STRING>, appVersion STRING, "
    "warnings ARRAY<STRING>, _corrupt_record STRING"
)
ATTACHMENTS = (
    "root_id BIGINT, session_id STRING, original_path STRING, stored_path STRING, size_bytes BIGINT"
)
