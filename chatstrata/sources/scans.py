"""Scans of log roots and snapshot stores.

A log root is a directory ``root_id=<n>`` below the scanned base, so the owner
of a row can be read off its path. Files written by Spark are directories of
part files; both forms are read.

Folders are listed by tasks (``listing``). ``scan_report`` names what lies in no root and what could not be read.
"""

from __future__ import annotations

import fnmatch
import re
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chatstrata import constants as C
from chatstrata import schemas
from chatstrata.functions import jsonlines, paths, text
from chatstrata.operators.content import ROOT, Content
from chatstrata.operators.lines import number_lines
from chatstrata.operators.snapshots import profile_state
from chatstrata.sources import listing

# One group: the number of the root.
ROOT_PATTERN = r"/root_id=(\d+)/"
PART_FILE = r"/part-[^/]*$"


def _decoded(uri: Column) -> Column:
    """File path of a metadata uri, where special characters are percent-encoded."""
    return F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _root_id(path: Column, root_pattern: str) -> Column:
    return F.regexp_extract(path, root_pattern, 1).try_cast("bigint")


def _below_root(path: Column, root_pattern: str) -> Column:
    """Path below the root; the part files of a directory stand for one file."""
    below = F.regexp_replace(F.regexp_extract(path, f"{root_pattern}(.*)$", 2), PART_FILE, "")
    named = F.regexp_extract(below, "^rel_path=(.*)$", 1)
    # Spark escapes the slashes of a path it partitions by.
    return F.when(named != "", F.try_url_decode(named)).otherwise(below)


def _located(files: DataFrame, root_pattern: str) -> DataFrame:
    """Listed files with the root they belong to and their path in it, empty outside of any root."""
    return files.withColumns(
        {"root_id": _root_id(F.col("path"), root_pattern), "rel_path": _below_root(F.col("path"), root_pattern)}
    )


def _read_lines(
    spark: SparkSession,
    base: str | list[str],
    root_pattern: str,
    keep: Column,
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Non-empty lines with the position of their split, before numbering.

    The conditions on the path prune the file list. Lines that are not wanted
    still count, but their text is dropped before anything is shuffled.
    """
    raw = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(base)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
    )
    located = raw.withColumn("path", _decoded(F.col("file_path")))
    lines = (
        located.select(
            _root_id(F.col("path"), root_pattern).alias("root_id"),
            _below_root(F.col("path"), root_pattern).alias("rel_path"),
            F.when(F.col("path").rlike(PART_FILE), paths.base_name(F.col("path"))).alias("part"),
            "file_block_start",
            F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)"))
            .otherwise(F.col("value"))
            .alias("line"),
        )
        .filter(keep)
        .filter(F.col("line") != "")
        .withColumn("scan_order", F.monotonically_increasing_id())
    )
    if wanted is None:
        return lines
    return lines.withColumn("line", F.when(wanted(F.col("line")), F.col("line")))


def _session_log(rel_path: Column) -> Column:
    in_session_dir = rel_path.startswith(f"{C.ACTIVE_DIR}/") | rel_path.startswith(f"{C.ARCHIVED_DIR}/")
    return in_session_dir & rel_path.endswith(".jsonl")


def scan_rollout_lines(
    spark: SparkSession,
    base: str | list[str],
    root_pattern: str = ROOT_PATTERN,
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Lines of the session logs, numbered within their file.

    With ``wanted`` only the lines it holds for are returned, under the number
    they have among all lines.
    """
    raw = _read_lines(spark, base, root_pattern, _session_log(F.col("rel_path")), wanted)
    return number_lines(raw).select(
        "root_id",
        "rel_path",
        paths.session_id_from_path(F.col("rel_path")).alias("session_id"),
        "line_no",
        "line",
    )


def scan_line_files(
    spark: SparkSession,
    base: str | list[str],
    names: list[str] | None = None,
    root_pattern: str = ROOT_PATTERN,
) -> DataFrame:
    """Lines of the history and index files: (root_id, rel_path, line_no, line).

    No folder inside a root is listed. The driver gets the paths of these files, a few of each root.
    """
    names = names or C.LINE_FILES
    either = "|".join(re.escape(name) for name in names)
    listed = listing.list_files(spark, base, skip=f"{root_pattern}(?!rel_path=(?:{either})$)[^/]+$")
    found = _located(listed, root_pattern).filter(F.col("rel_path").isin(names))
    # The folder of part files stands for them.
    places = [r[0] for r in found.select(F.regexp_replace("path", PART_FILE, "")).distinct().collect()]
    if not places:
        return spark.createDataFrame([], "root_id bigint, rel_path string, line_no bigint, line string")
    # Spark takes a path as a pattern.
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", place) for place in sorted(places)]
    raw = _read_lines(spark, escaped, root_pattern, F.col("rel_path").isin(names))
    return number_lines(raw).select("root_id", "rel_path", "line_no", "line")


def parse_history(lines: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """History fields of each line; unparsable lines keep ``line`` and null keys."""
    parsed = lines.withColumn("value", jsonlines.parse_line(F.col("line")))
    flag = jsonlines.part(F.col("value"), "is_archived")
    kind = F.schema_of_variant(flag)
    archived = F.when(kind == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")).when(
        kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(flag, "$", "double") != 0
    )
    return parsed.select(
        *scope,
        jsonlines.field(F.col("value"), "session_id").alias("session_id"),
        jsonlines.field(F.col("value"), "first_text").alias("first_text"),
        archived.alias("is_archived"),
        "line_no",
        "line",
    )


def parse_session_index(lines: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    parsed = lines.withColumn("value", jsonlines.parse_line(F.col("line")))
    return parsed.select(
        *scope,
        jsonlines.field(F.col("value"), "id").alias("id"),
        jsonlines.field(F.col("value"), "thread_name").alias("thread_name"),
        "line_no",
        "line",
    )


def scan_history(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    return parse_history(scan_line_files(spark, base, [C.HISTORY_FILE], root_pattern))


def scan_session_index(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    return parse_session_index(scan_line_files(spark, base, [C.INDEX_FILE], root_pattern))


def scan_files(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    """Inventory of all files below the roots; no file body is read.

    Files that lie in no root are counted in a warning; ``scan_report`` says where they are.
    """
    listed = _located(listing.list_files(spark, base), root_pattern)
    strays = listed.filter(_unread(F.col("problem"), F.col("root_id"), F.col("rel_path"))).count()
    if strays:
        warnings.warn(f"{strays} files or folders lie in no root or were not read: see scan_report", stacklevel=2)
    inventory = listed.filter(F.col("problem").isNull() & (F.col("rel_path") != "") & F.col("root_id").isNotNull())
    # The parts of a file written by Spark add up to one file.
    return (
        inventory.groupBy("root_id", "rel_path")
        .agg(F.sum("size_bytes").alias("size_bytes"), F.max("mtime").alias("mtime"))
        .select(
            "root_id", paths.session_id_from_path(F.col("rel_path")).alias("id"), "rel_path", "size_bytes", "mtime"
        )
    )


def _unread(problem: Column, root_id: Column, rel_path: Column) -> Column:
    return problem.isNotNull() | root_id.isNull() | (rel_path == "")


def scan_report(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    """What the scans of ``base`` leave out: (place, problem, files).

    Files in no root are counted by the entry of ``base`` they lie below, such as ``root_id=abc``. Folders that went
    or could not be listed and manifests that could not be read or parsed have a row each.
    """
    listed = _located(listing.list_files(spark, base), root_pattern)
    outside = listed.filter(F.col("problem").isNull() & _unread(F.col("problem"), F.col("root_id"), F.col("rel_path")))
    place = F.col("path")
    for folder in [base] if isinstance(base, str) else base:
        inner = f"{folder.rstrip('/')}/"
        entry = F.substring_index(F.expr(f"substring(path, {len(inner) + 1})"), "/", 1)
        place = F.when(F.col("path").startswith(inner), F.concat(F.lit(inner), entry)).otherwise(place)
    strays = (
        outside.select(place.alias("place"), F.regexp_replace("path", PART_FILE, "").alias("path"))
        .groupBy("place")
        .agg(F.count_distinct("path").alias("files"))
        .select("place", F.lit("in no root").alias("problem"), "files")
    )
    unlisted = listed.filter(F.col("problem").isNotNull()).select(F.col("path").alias("place"), "problem")
    manifests = _manifests(listed.filter(F.col("problem").isNull()), "snapshot.json").select(
        F.col("path").alias("place"),
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "broken manifest")
        .alias("problem"),
    )
    single = unlisted.unionByName(manifests.filter(F.col("problem").isNotNull()))
    return strays.unionByName(single.withColumn("files", F.lit(1).cast("bigint")))


def list_session_files(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    """Session logs only, with the directory flag."""
    files = scan_files(spark, base, root_pattern)
    return files.filter(_session_log(F.col("rel_path"))).withColumn(
        "in_archive", paths.is_archived_path(F.col("rel_path"))
    )


def load_state_tables(spark: SparkSession, base: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The state tables found below ``base``, one Parquet dataset each.

    A missing table is left out; databases of other versions have fewer.
    """
    found = {}
    for table in tables or [*C.STATE_TABLE_KEYS, *C.ACCOUNT_TABLES, *C.APP_TABLE_KEYS]:
        try:
            found[table] = spark.read.parquet(f"{base}/{table}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return found


def _manifests(files: DataFrame, file_glob: str) -> DataFrame:
    """The documents of the listed files of that name: (path, doc, problem); a broken one has a ``_corrupt_record``."""
    named = files.filter(paths.base_name(F.col("path")).rlike(f"^{fnmatch.translate(file_glob)}"))
    return listing.read_files(named).select(
        "path", F.from_json("content", schemas.MANIFEST).alias("doc"), "problem"
    )


def scan_snapshot_manifests(
    spark: SparkSession,
    base: str | list[str],
    sizes: DataFrame | None = None,
    root_pattern: str = ROOT_PATTERN,
    file_glob: str = "snapshot.json",
) -> DataFrame:
    """One row per readable ``snapshots/<id>/snapshot.json``, missing fields filled in.

    ``sizes(root_id, id, data_bytes)`` gives the size of snapshots that do not state it.
    """
    # Neither the logs of a root nor the data of a snapshot hold manifests.
    logs = f"{root_pattern}(?:{C.ACTIVE_DIR}|{C.ARCHIVED_DIR}|snapshots/[^/]+/data)$"
    found = _manifests(listing.list_files(spark, base, skip=logs).filter(F.col("problem").isNull()), file_glob)
    readable = found.filter(F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull()).select("path", "doc.*")

    def given(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    folder = F.element_at(F.split("path", "/"), -2)
    no_strings = F.array().cast("array<string>")
    snapshots = readable.select(
        _root_id(F.col("path"), root_pattern).alias("root_id"),
        F.coalesce(given("id"), folder).alias("id"),
        F.coalesce(given("name"), folder).alias("name"),
        text.parse_ts(F.col("createdAt")).alias("created_at"),
        given("codexRoot").alias("snapshot_root"),
        given("reason").alias("reason"),
        given("kind").alias("kind"),
        F.coalesce(given("modelProvider"), F.lit("unknown")).alias("model_provider"),
        F.coalesce(given("model"), F.lit("unknown")).alias("model"),
        F.coalesce(given("accountFingerprint"), F.lit("none")).alias("account_fingerprint"),
        F.coalesce("sessionCount", F.lit(0)).alias("session_count"),
        F.coalesce("archivedSessionCount", F.lit(0)).alias("archived_session_count"),
        F.when(F.col("sizeBytes") != 0, F.col("sizeBytes")).alias("size_bytes"),
        F.coalesce("includedPaths", no_strings).alias("included_paths"),
        F.col("appVersion").alias("app_version"),
        F.coalesce("warnings", no_strings).alias("warnings"),
    )
    if sizes is not None:
        snapshots = snapshots.join(sizes.select("root_id", "id", "data_bytes"), ["root_id", "id"], "left")
        snapshots = snapshots.withColumn("size_bytes", F.coalesce("size_bytes", "data_bytes")).drop("data_bytes")
    return snapshots.withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))


def scan_content(
    spark: SparkSession, base: str | list[str], state_base: str | None = None, root_pattern: str = ROOT_PATTERN
) -> Content:
    """Log roots as they lie on disk, with the state tables below ``state_base``, as the content that jobs take.

    A root has a state database if its file is there or a state table has rows of it.
    """
    tables = {} if state_base is None else load_state_tables(spark, state_base)
    files = scan_files(spark, base, root_pattern)
    states = files.filter(F.col("rel_path") == C.STATE_FILE).select("root_id")
    for table in tables.values():
        states = states.unionByName(table.select("root_id"))
    return Content(
        files=files,
        lines=scan_line_files(spark, base, root_pattern=root_pattern),
        states=states.distinct(),
        tables=tables,
        bodies=scan_rollout_lines(spark, base, root_pattern).select("root_id", "rel_path", "line_no", "line"),
    )


# Two groups: the snapshot and the path in the root it was taken of.
SNAPSHOT_DATA = r"^snapshots/([^/]+)/data/(.*)$"


def _of_snapshots(table: DataFrame) -> DataFrame:
    """Rows below the data of a snapshot, under their path in the root."""
    found = table.withColumn("snapshot_id", F.regexp_extract("rel_path", SNAPSHOT_DATA, 1))
    return found.withColumn("rel_path", F.regexp_extract("rel_path", SNAPSHOT_DATA, 2)).filter("snapshot_id <> ''")


def scan_snapshot_content(
    spark: SparkSession, base: str | list[str], state_base: str | None = None, root_pattern: str = ROOT_PATTERN
) -> Content:
    """Snapshot folders ``snapshots/<id>/data`` of log roots as the content of a store.

    The state tables below ``state_base`` have a ``snapshot_id``.
    """
    inner = F.regexp_extract("rel_path", SNAPSHOT_DATA, 2)
    tables = {} if state_base is None else load_state_tables(spark, state_base)
    files = _of_snapshots(scan_files(spark, base, root_pattern))
    files = files.withColumn("id", paths.session_id_from_path(F.col("rel_path")))
    states = files.filter(F.col("rel_path") == C.STATE_FILE).select("root_id", "snapshot_id")
    for table in tables.values():
        states = states.unionByName(table.select("root_id", "snapshot_id"))

    def numbered(keep: Column) -> DataFrame:
        return _of_snapshots(number_lines(_read_lines(spark, base, root_pattern, keep)))

    return Content(
        files=files,
        lines=numbered(inner.isin(C.LINE_FILES)),
        states=states.distinct(),
        tables=tables,
        bodies=numbered(_session_log(inner)),
    )


def scan_profiles(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    """Text of the config and account files of each root, read whole (they are small)."""
    listed = listing.list_files(spark, base, skip=f"{root_pattern}[^/]+$")
    named = _located(listed, root_pattern).filter(F.col("rel_path").isin(C.CONFIG_FILE, C.AUTH_FILE))
    read = listing.read_files(named).filter(F.col("problem").isNull())
    return _located(read, root_pattern).select("root_id", "rel_path", "content")


def scan_profile_state(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    return profile_state(scan_profiles(spark, base, root_pattern), scan_files(spark, base, root_pattern))


def scan_attachments(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(schemas.ATTACHMENTS).parquet(base)
