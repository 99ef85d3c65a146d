"""The session catalog: from log files, from the threads table, and merged."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata import schemas
from chatstrata.functions import jsonlines, paths, text
from chatstrata.operators.content import ROOT
from chatstrata.operators.lines import head_lines

SEARCHED = ["id", "title", "cwd", "model_provider", "model", "source", "rollout_path"]


def _given(column: Column) -> Column:
    return F.when(column != "", column)


def session_files(files: DataFrame) -> DataFrame:
    """Log files of both session directories that carry a session id."""
    return files.filter(
        F.col("rel_path").endswith(".jsonl")
        & paths.top_entry(F.col("rel_path")).isin(C.ACTIVE_DIR, C.ARCHIVED_DIR)
        & (F.col("id") != "")
    )


def union_session_dirs(files: DataFrame) -> DataFrame:
    """Log files with the rank of their directory: active before archived."""
    return session_files(files).withColumn(
        "dir_rank", F.when(paths.is_archived_path(F.col("rel_path")), 1).otherwise(0)
    )


def one_file_per_session(files: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """The log file of each session: active before archived, then the smallest path."""
    of_session = W.partitionBy(*scope, "id").orderBy("dir_rank", "rel_path")
    return (
        union_session_dirs(files)
        .withColumn("nth", F.row_number().over(of_session))
        .filter(F.col("nth") == 1)
        .drop("nth")
    )


def rollout_metadata(
    lines: DataFrame,
    max_lines: int | None = None,
    title_mode: Literal["message", "role"] = "message",
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """Title and session data of each log file, or of its first ``max_lines`` lines.

    The title is the first user message; the data are the last stated values at
    or before the line of the title. ``title_mode='role'`` also takes messages
    known by their role and texts in their content.
    """
    line, value = F.col("line"), F.col("value")
    is_meta = line.contains('"session_meta"')
    may_title = line.contains('"user_message"')
    if title_mode == "role":
        may_title = may_title | line.contains('"user"')
    head = (lines if max_lines is None else head_lines(lines, max_lines)).filter(is_meta | may_title | (F.col("line_no") == 0))
    parsed = head.select(
        *scope,
        "rel_path",
        "line_no",
        is_meta.alias("is_meta"),
        may_title.alias("may_title"),
        F.when(is_meta | may_title, jsonlines.parse_line(line)).alias("value"),
    )
    title = _role_title(value) if title_mode == "role" else jsonlines.field(value, "payload.message")
    stated = parsed.select(
        *scope,
        "rel_path",
        "line_no",
        _given(F.when(F.col("may_title"), title)).alias("title"),
        *[
            _given(F.when(F.col("is_meta"), jsonlines.field(value, f"payload.{name}"))).alias(name)
            for name in ("cwd", "model_provider", "model", "source")
        ],
        F.when(F.col("is_meta"), text.parse_ts(jsonlines.field(value, "payload.timestamp"))).alias("created_at"),
    )
    # No file is gathered: the title lines are an aggregate, which meets the few stated values in a join.
    file = [*scope, "rel_path"]
    given = F.when(F.col("title").isNotNull(), F.col("line_no"))
    titles = stated.groupBy(*file).agg(F.min(given).alias("title_line"), F.min_by("title", given).alias("title"))
    data = ["cwd", "model_provider", "model", "source", "created_at"]
    known = stated.filter(F.coalesce(*[F.col(name).cast("string") for name in data]).isNotNull()).drop("title")
    known = known.join(titles.select(*file, "title_line"), file).filter(
        F.col("title_line").isNull() | (F.col("line_no") <= F.col("title_line"))
    )

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)

    latest = known.groupBy(*file).agg(*[last(name) for name in data])
    defaults = {"cwd": "", "model_provider": "unknown", "model": "unknown", "source": "jsonl"}
    return titles.join(latest, file, "left").select(
        *file,
        F.coalesce("title", F.lit("")).alias("title"),
        *[F.coalesce(name, F.lit(default)).alias(name) for name, default in defaults.items()],
        "created_at",
    )


def _role_title(value: Column) -> Column:
    is_user = (
        (jsonlines.field(value, "type") == "user_message")
        | (jsonlines.field(value, "payload.type") == "user_message")
        | (jsonlines.field(value, "payload.role") == "user")
    )
    message = jsonlines.as_string(jsonlines.part(value, "payload.message"))
    items = F.try_variant_get(value, "$.payload.content", "array<struct<text:variant>>")
    texts = F.filter(F.transform(items, lambda item: jsonlines.as_string(item["text"])), lambda t: t.isNotNull())
    return F.when(F.coalesce(is_user, F.lit(False)), text.strip(F.coalesce(message, F.get(texts, F.lit(0)))))


def title_map(history: DataFrame, index: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Last title of each session: the index overrides the history."""

    def last(frame: DataFrame, key: str, name: str) -> DataFrame:
        titled = frame.select(*scope, F.col(key).alias("id"), text.non_blank(F.col(name)).alias(name), "line_no")
        titled = titled.filter((F.col("id") != "") & F.col(name).isNotNull())
        return titled.groupBy(*scope, "id").agg(F.max_by(name, "line_no").alias(name))

    both = last(history, "session_id", "first_text").join(last(index, "id", "thread_name"), [*scope, "id"], "full")
    return both.select(*scope, "id", F.coalesce("thread_name", "first_text").alias("title"))


def archived_map(history: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    flagged = history.filter((F.col("session_id") != "") & F.col("is_archived").isNotNull())
    last = flagged.groupBy(*scope, F.col("session_id").alias("id")).agg(
        F.max_by("is_archived", "line_no").alias("is_archived")
    )
    return last.select(*scope, "id", "is_archived")


def catalog_from_files(
    files: DataFrame,
    metadata: DataFrame,
    titles: DataFrame | None = None,
    flags: DataFrame | None = None,
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """One catalog row per log file that carries a session id."""
    meta = metadata.select(
        *scope, "rel_path", F.col("title").alias("first_message"), "cwd", "model_provider", "model", "source", "created_at"
    )
    rows = session_files(files).join(meta, [*scope, "rel_path"], "left")
    title, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    if titles is not None:
        rows = rows.join(titles.select(*scope, "id", F.col("title").alias("listed_title")), [*scope, "id"], "left")
        title = F.col("listed_title")
    if flags is not None:
        rows = rows.join(flags.select(*scope, "id", "is_archived"), [*scope, "id"], "left")
        flag = F.col("is_archived")
    rows = rows.select(
        *scope,
        "id",
        text.strip(text.resolve_title(title, F.lit(None), F.col("first_message"), F.col("id"))).alias("title"),
        F.col("rel_path").alias("rollout_path"),
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        F.coalesce("model_provider", F.lit("unknown")).alias("model_provider"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce("source", F.lit("jsonl")).alias("source"),
        F.coalesce("created_at", "mtime").alias("created_at"),
        F.col("mtime").alias("updated_at"),
        paths.resolve_archived(flag, F.col("rel_path")).alias("archived"),
        F.lit(True).alias("exists_on_disk"),
        "size_bytes",
    )
    return rows.select(*_catalog_columns(scope))


def _catalog_columns(scope: Sequence[str]) -> list[str]:
    return [*scope, *[name for name in schemas.CATALOG_COLUMNS if name not in scope]]


def resolve_rollout_files(
    threads: DataFrame,
    files: DataFrame,
    snapshot_root: Column | None = None,
    current_root: Column | None = None,
    data_root: Column | None = None,
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """The log file of each thread.

    First the file under the re-rooted path, then the path itself below the data
    root, then any log file named after the thread. Adds ``rel_path`` (null if
    there is no file), ``exists_on_disk`` and ``size_bytes``.
    """
    wanted = paths.reroot_path(F.col("rollout_path"), snapshot_root, current_root)
    rows = threads.withColumn("wanted_path", wanted)
    rows = rows.join(_named(files, scope, "rel_path", "wanted_path", "path"), [*scope, "wanted_path"], "left")
    found = ["path"]
    if data_root is not None:
        rows = rows.withColumn("own_path", paths.relative_path(F.col("rollout_path"), data_root))
        rows = rows.join(_named(files, scope, "rel_path", "own_path", "own"), [*scope, "own_path"], "left")
        found.append("own")
    by_id = _named(one_file_per_session(files, scope), scope, "id", "lower_id", "by_id")
    rows = rows.withColumn("lower_id", F.lower("id")).join(by_id, [*scope, "lower_id"], "left")
    found.append("by_id")
    hit = F.coalesce(*found)
    return rows.select(
        *[F.col(name) for name in threads.columns],
        hit["rel_path"].alias("rel_path"),
        hit.isNotNull().alias("exists_on_disk"),
        F.coalesce(hit["size_bytes"], F.lit(0)).alias("size_bytes"),
    )


def _named(files: DataFrame, scope: Sequence[str], key: str, join_name: str, name: str) -> DataFrame:
    return files.select(*scope, F.col(key).alias(join_name), F.struct("rel_path", "size_bytes").alias(name))


def catalog_from_threads(resolved: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Catalog rows of resolved threads; blank titles stay blank until the end."""
    rows = resolved.select(
        *scope,
        "id",
        F.coalesce(text.strip(F.col("title")), F.lit("")).alias("title"),
        F.coalesce("rel_path", "rollout_path", F.lit("")).alias("rollout_path"),
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        F.coalesce(_given(F.col("model_provider")), F.lit("unknown")).alias("model_provider"),
        F.coalesce(_given(F.col("model")), F.lit("unknown")).alias("model"),
        F.coalesce(_given(F.col("source")), F.lit("jsonl")).alias("source"),
        text.epoch_ts(F.col("created_at")).alias("created_at"),
        text.epoch_ts(F.col("updated_at")).alias("updated_at"),
        F.coalesce(F.col("archived") == 1, F.lit(False)).alias("archived"),
        "exists_on_disk",
        "size_bytes",
    )
    return rows.select(*_catalog_columns(scope))


def with_display_titles(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("title", text.display_title(F.col("title"), F.col("id")))


def merge_catalogs(primary: DataFrame, fallback: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Union by session. The primary row wins; where only the fallback has the file,
    its path, size and existence are taken, its title for a blank one, and either
    archived flag counts."""
    key = [*scope, "id"]
    others = [name for name in _catalog_columns(scope) if name not in key]
    ordered = W.partitionBy(*key).orderBy("archived_path", "rollout_path")
    one_each = (
        fallback.filter(F.col("id") != "")
        .withColumn("archived_path", paths.is_archived_path(F.col("rollout_path")))
        .withColumn("nth", F.row_number().over(ordered))
        .filter(F.col("nth") == 1)
    )
    p = primary.filter(F.col("id") != "").select(*key, F.struct(*others).alias("p"))
    f = one_each.select(*key, F.struct(*others).alias("f"))
    both = p.join(f, key, "full")
    p, f = F.col("p"), F.col("f")
    rescued = F.coalesce(~p["exists_on_disk"] & f["exists_on_disk"], F.lit(False))

    def taken(name: str) -> Column:
        own = F.when(p.isNull(), f[name]).otherwise(p[name])
        if name in ("rollout_path", "size_bytes", "exists_on_disk"):
            return F.when(rescued, f[name]).otherwise(own)
        if name == "title":
            return F.when(rescued & text.is_blank(p[name]), f[name]).otherwise(own)
        if name == "archived":
            return F.when(rescued, p[name] | f[name]).otherwise(own)
        return own

    return both.select(*key, *[taken(name).alias(name) for name in others]).select(*_catalog_columns(scope))


def load_catalog(resolved_threads: DataFrame, file_catalog: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Threads where a root has any, else its log files."""
    with_threads = resolved_threads.select(*scope).distinct()
    only_files = file_catalog.join(with_threads, list(scope), "left_anti")
    return with_display_titles(catalog_from_threads(resolved_threads, scope).unionByName(only_files))


def _complete(resolved_threads: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Roots whose threads all have a file; there the files add nothing."""
    return resolved_threads.groupBy(*scope).agg(F.min("exists_on_disk").alias("all_exist")).filter("all_exist")


def load_snapshot_catalog(
    resolved_threads: DataFrame, file_catalog: DataFrame, scope: Sequence[str] = ROOT
) -> DataFrame:
    """Catalog of a snapshot: its threads if all their files exist, else merged with the files."""
    needed = file_catalog.join(_complete(resolved_threads, scope), list(scope), "left_anti")
    return with_display_titles(merge_catalogs(catalog_from_threads(resolved_threads, scope), needed, scope))


def restorable(catalog: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Ids of the sessions whose log file exists."""
    return catalog.filter(F.col("exists_on_disk") & (F.col("id") != "")).select(*scope, "id").distinct()


def restorable_ids(resolved_threads: DataFrame, files: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Restorable ids of a snapshot, without building its catalog."""
    of_threads = resolved_threads.filter("exists_on_disk").select(*scope, "id")
    needed = session_files(files).join(_complete(resolved_threads, scope), list(scope), "left_anti")
    return of_threads.unionByName(needed.select(*scope, "id")).filter(F.col("id") != "").distinct()


def filter_archived(catalog: DataFrame, show: bool = False) -> DataFrame:
    return catalog if show else catalog.filter(~F.col("archived"))


def search_sessions(catalog: DataFrame, query: str, mode: Literal["any", "joined"] = "any") -> DataFrame:
    """Case-insensitive substring search in any field, or in the fields joined by blanks."""
    needle = query.strip().lower()
    if not needle:
        return catalog
    if mode == "joined":
        joined = F.concat_ws(" ", *[F.coalesce(name, F.lit("")) for name in SEARCHED])
        return catalog.filter(F.lower(joined).contains(needle))
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.coalesce(F.lower(name).contains(needle), F.lit(False))
    return catalog.filter(hit)


def sort_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("updated_at"), F.desc("created_at"), "root_id", "id")
