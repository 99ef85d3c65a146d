"""Attachments outside the log root that messages refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.functions import jsonlines, paths

_KEYS = ["images", "local_images", "text_elements", "content"]


def attachment_paths(lines: DataFrame) -> DataFrame:
    """Attachment paths named by the lines of each session, repeats included."""
    line = F.col("line")
    may_name = line.contains('"images"')
    for key in _KEYS[1:]:
        may_name = may_name | line.contains(f'"{key}"')
    payloads = lines.filter(may_name).select(
        "root_id", "session_id", F.explode(F.array(jsonlines.part(jsonlines.parse_line(line), "payload"))).alias("payload")
    )
    found = payloads.select("root_id", "session_id", jsonlines.whole_attachment_paths(F.col("payload")).alias("found"))
    return found.select("root_id", "session_id", F.explode("found").alias("original_path"))


def collect_attachments(lines: DataFrame, ids: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest of the sessions' attachments that exist as plain files.

    ``inventory(root_id, path, size_bytes)`` lists the files. A path that several
    sessions name belongs to the first of them.
    """
    wanted = ids.select("root_id", F.col("id").alias("session_id"))
    named = attachment_paths(lines.join(wanted, ["root_id", "session_id"], "left_semi"))
    of_path = named.groupBy("root_id", "original_path").agg(F.min("session_id").alias("session_id"))
    existing = of_path.join(
        inventory.select("root_id", F.col("path").alias("original_path"), "size_bytes"), ["root_id", "original_path"]
    )
    return existing.select(
        "root_id",
        "session_id",
        "original_path",
        paths.attachment_store_path(F.col("session_id"), F.col("original_path")).alias("stored_path"),
        "size_bytes",
    )


def restore_attachments(
    manifest: DataFrame, stored: DataFrame, existing: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """Attachments to bring back: stored, of an allowed session, and not in place now.

    ``stored(root_id, stored_path)`` lists the copies, ``existing(root_id, path)``
    the files in place.
    """
    wanted = manifest
    if ids is not None:
        wanted = wanted.join(
            ids.select("root_id", F.col("id").alias("session_id")), ["root_id", "session_id"], "left_semi"
        )
    wanted = wanted.join(stored.select("root_id", "stored_path"), ["root_id", "stored_path"], "left_semi")
    in_place = existing.select("root_id", F.col("path").alias("original_path"))
    return wanted.join(in_place, ["root_id", "original_path"], "left_anti").select(*manifest.columns)
