"""Ordered line files as tables: order is the column ``line_no``."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import jsonlines, text
from chatstrata.operators import mentions
from chatstrata.operators.content import ROOT
from chatstrata.session import staged

Match = Literal["mention", "key"]
# Unique key of the lines of a file: one key, a key per file name, or none (whole lines).
UniqueKey = str | dict[str, str] | None
# A JSON object begins with a brace after JSON white space.
OBJECT_START = r"^[ \t\r\n]*\{"
LINE_FILE_KEYS = {C.INDEX_FILE: "id"}


def number_lines(scanned: DataFrame) -> DataFrame:
    """Give each scanned line its 0-based number in its file.

    ``scanned`` has the split of every line (part, file_block_start) and its order in
    the scan, which is consecutive within a split. So a line's number is its order less
    that of the split's first line, plus the lines of the file's splits before. These come from
    one row per split; no line is sorted or gathered. Lines that are null count, but
    are not returned and take no part in the exchange.
    """
    file = ["root_id", "rel_path"]
    split = [*file, "part", "file_block_start"]
    scanned = scanned.withColumn("part", F.coalesce("part", F.lit("")))
    splits = scanned.groupBy(*split).agg(F.count("*").alias("n"), F.min("scan_order").alias("first"))
    # Part files are in the order of their numbers; text order goes wrong after five digits.
    part_number = F.coalesce(F.regexp_extract("part", r"^part-(\d+)", 1).try_cast("bigint"), F.lit(-1))
    before = W.partitionBy(*file).orderBy(part_number, "part", "file_block_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    located = scanned.filter(F.col("line").isNotNull()).join(splits, split)
    within = F.col("scan_order") - F.col("first")
    # Both passes over the files must have cut them alike.
    line_no = F.when(within.between(0, F.col("n") - 1), F.col("start") + within).otherwise(
        F.raise_error(F.lit("the files changed during the scan")).cast("bigint")
    )
    return located.select(*file, line_no.alias("line_no"), "line")


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """First n lines of each file; the numbers say which, so nothing is shuffled."""
    return lines.filter(F.col("line_no") < n)


def valid_lines(lines: DataFrame) -> DataFrame:
    """Without blank lines; unparsable ones stay."""
    return lines.filter(~text.is_blank(F.col("line")))


def _identity(unique_key: UniqueKey) -> Column:
    if unique_key is None:
        return F.col("line")
    if isinstance(unique_key, str):
        return jsonlines.line_identity(F.col("line"), unique_key)
    identity = jsonlines.line_identity(F.col("line"), None)
    for name, key in unique_key.items():
        identity = F.when(F.col("rel_path") == name, jsonlines.line_identity(F.col("line"), key)).otherwise(identity)
    return identity


def dedupe_ordered(
    lines: DataFrame,
    unique_key: UniqueKey = None,
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """First line of each identity in each file.

    Spark keeps only the first row per identity of every task before the shuffle,
    so a line repeated without end does not pile up in one task.
    """
    same = W.partitionBy(*scope, "rel_path", "identity").orderBy("line_no")
    return (
        lines.withColumn("identity", _identity(unique_key))
        .withColumn("nth", F.row_number().over(same))
        .filter(F.col("nth") == 1)
        .drop("identity", "nth")
    )


def _lines_of_sessions(lines: DataFrame, ids: DataFrame, match: Match, scope: Sequence[str]) -> DataFrame:
    """Keys of the lines that belong to one of the sessions.

    'mention' takes the id keys of a JSON object and every line that contains an id; 'key' takes the id keys,
    and of lines that are no object those that contain an id.
    """
    row = [*scope, "rel_path", "line_no"]
    # an object begins with a brace, so other lines are not parsed
    objects = lines.filter(F.col("line").rlike(OBJECT_START))
    keys = objects.select(*row, F.explode(jsonlines.line_ids(F.col("line"))).alias("id"))
    keyed = keys.join(ids.select(*scope, "id"), [*scope, "id"], "left_semi").select(*row)
    texts = lines
    if match == "key":
        is_object = F.try_variant_get(jsonlines.parse_line(F.col("line")), "$", "struct<id:variant>").isNotNull()
        # written, as it is read several times and each would parse the lines anew
        texts = staged(lines.filter(~F.col("line").rlike(OBJECT_START) | ~is_object).select(*row, "line"), "plain-lines")
    mentioned = mentions.containing(texts.withColumnRenamed("line", "text"), ids, row, scope)
    # written, as the driver holds the whole plan of a job, which joins these in several places
    return keyed.unionByName(staged(mentioned, "mentioned"))


def keep_lines(
    lines: DataFrame, ids: DataFrame, match: Match = "mention", scope: Sequence[str] = ROOT
) -> DataFrame:
    """Non-blank lines that belong to one of the sessions, repeats included."""
    hits = _lines_of_sessions(lines, ids, match, scope)
    return valid_lines(lines).join(hits, [*scope, "rel_path", "line_no"], "left_semi").select(*lines.columns)


def filter_lines(
    lines: DataFrame,
    ids: DataFrame,
    match: Match = "mention",
    unique_key: UniqueKey = None,
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """Lines that belong to one of the sessions, without repeats, in order."""
    return dedupe_ordered(keep_lines(lines, ids, match, scope), unique_key, scope)


def delete_lines(lines: DataFrame, ids: DataFrame, match: Match = "key", scope: Sequence[str] = ROOT) -> DataFrame:
    """Non-blank lines that belong to none of the sessions."""
    hits = _lines_of_sessions(lines, ids, match, scope)
    return valid_lines(lines).join(hits, [*scope, "rel_path", "line_no"], "left_anti").select(*lines.columns)


def merge_lines(
    current: DataFrame,
    snapshot: DataFrame,
    ids: DataFrame | None = None,
    unique_key: UniqueKey = None,
    match: Match = "mention",
) -> DataFrame:
    """All current lines, then the snapshot lines of the given sessions; the first of
    equal lines wins. Without ids all snapshot lines take part.

    Snapshot lines are numbered on from the last current line; numbers give the
    order and may have gaps.
    """
    columns = ["root_id", "rel_path", "line_no", "line"]
    added = snapshot if ids is None else keep_lines(snapshot, ids, match)
    ends = current.groupBy("root_id", "rel_path").agg((F.max("line_no") + 1).alias("end"))
    added = (
        added.select(*columns)
        .join(ends, ["root_id", "rel_path"], "left")
        .withColumn("line_no", F.col("line_no") + F.coalesce("end", F.lit(0)))
    )
    both = current.select(*columns).unionByName(added.select(*columns))
    return dedupe_ordered(valid_lines(both), unique_key).select(*columns)
