"""Paths inside a log root, session ids in file names, attachment paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions.text import bound


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def top_entry(rel_path: Column) -> Column:
    """First segment of a path relative to its root."""
    return F.substring_index(rel_path, "/", 1)


def session_id_from_path(path: Column) -> Column:
    """First UUID in the file name, in lower case; '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), C.UUID, 0))


def mentioned_ids(text: Column) -> Column:
    """What may be an id in a text, as written: every token, and every UUID, overlapping ones included.

    A token is a run of letters, digits, '_' and '-'. Ids of any form are found by it
    with an equality join, if they are made of these and stand between others.
    """
    tokens = F.split(text, "[^0-9A-Za-z_-]+")
    return F.filter(F.array_distinct(F.concat(tokens, _uuids(text))), lambda token: token != "")


def _uuids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?=({C.UUID}))"), F.lit(1))


def named_ids(path: Column) -> Column:
    """What may be an id in a file name: its UUIDs, or without any its tokens and the runs of their parts between '-'."""

    def runs(token: Column) -> Column:
        def of_parts(parts: Column) -> Column:
            def ending(start: Column) -> Column:
                lengths = F.sequence(F.lit(1), F.size(parts) - start)
                return F.transform(lengths, lambda n: F.array_join(F.slice(parts, start + 1, n), "-"))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), ending))

        return bound(F.split(token, "-"), of_parts)

    def of_tokens(ids: Column) -> Column:
        return F.array_distinct(F.concat(ids, F.flatten(F.transform(ids, runs))))

    def of_name(name: Column) -> Column:
        uuids = _uuids(name)
        return F.when(F.size(uuids) > 0, uuids).otherwise(bound(mentioned_ids(name), of_tokens))

    return bound(base_name(path), of_name)


def is_archived_path(rel_path: Column) -> Column:
    return rel_path.startswith(f"{C.ARCHIVED_DIR}/")


def resolve_archived(flag: Column, rel_path: Column) -> Column:
    return F.coalesce(flag, is_archived_path(rel_path))


def normalize_path(path: Column) -> Column:
    """Resolve '.', '..' and doubled slashes; leading '..' of a relative path stays."""

    def clean(p: Column) -> Column:
        # Few paths come near needing it; the others are not even matched.
        suspect = p.contains("/.") | p.contains("//") | p.startswith(".") | p.endswith("/")
        unclean = F.when(suspect, p.rlike(r"(^|/)\.{1,2}(/|$)|//|./$")).otherwise(False)
        return F.when(unclean, _resolved(p)).otherwise(p)

    return bound(path, clean)


def _resolved(path: Column) -> Column:
    absolute = path.startswith("/")

    def add(done: Column, part: Column) -> Column:
        above_start = (F.size(done) == 0) | (F.get(done, F.size(done) - 1) == "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & above_start, F.when(absolute, done).otherwise(F.concat(done, F.array(part))))
            .when(part == "..", F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def relative_path(path: Column, root: Column) -> Column:
    """Path below a root; null when it is the root itself or lies outside."""
    base = F.rtrim(normalize_path(_slashes(root)), F.lit("/"))
    names = F.struct(normalize_path(_slashes(path)).alias("full"), F.concat(base, F.lit("/")).alias("base"))
    below = bound(
        names, lambda n: F.when(n["full"].startswith(n["base"]), F.substr(n["full"], F.length(n["base"]) + 1))
    )
    return F.when(root != "", bound(below, lambda rel: F.when((rel != "") & ~rel.startswith(".."), rel)))


def reroot_path(path: Column, snapshot_root: Column | None = None, current_root: Column | None = None) -> Column:
    """Path relative to either root, else what follows the root marker, else null."""
    slashed = _slashes(path)
    start = F.locate(C.ROOT_MARKER, F.lower(slashed))
    after_marker = F.when(start > 0, F.substr(slashed, start + len(C.ROOT_MARKER)))
    below_roots = [relative_path(path, root) for root in (snapshot_root, current_root) if root is not None]
    below_marker = bound(
        normalize_path(after_marker), lambda rel: F.when((rel != "") & ~rel.rlike(r"^\.\.(/|$)"), rel)
    )
    return F.coalesce(*below_roots, below_marker)


def attachment_store_path(session_id: Column, path: Column) -> Column:
    return F.concat(
        F.lit(f"{C.ATTACHMENT_DIR}/"), session_id, F.lit("/"), F.sha2(path, 256), F.lit("-"), base_name(path)
    )


def is_local_attachment(path: Column) -> Column:
    return path.rlike(rf"(?is)^/.*\.({'|'.join(C.ATTACHMENT_EXTENSIONS)})\z")


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
