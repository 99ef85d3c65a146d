"""State tables: prune, select, upsert and delete by session, repair paths.

Every table has the scope columns (a root, or a snapshot of one) besides its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import paths
from chatstrata.operators.catalog import one_file_per_session
from chatstrata.operators.content import ROOT

Tables = dict[str, DataFrame]

# What makes a row unique where the tables do not say; other tables are compared
# by all common columns unless the caller names their key.
PRIMARY_KEYS = {"threads": ["id"], "thread_spawn_edges": ["parent_thread_id", "child_thread_id"]}

# Null keys of an outer join are spread over this many values.
_NULL_SALTS = 1024


def _key_columns(table: str) -> list[str]:
    return C.STATE_TABLE_KEYS.get(table) or C.APP_TABLE_KEYS[table]


def _as_key(ids: DataFrame, scope: Sequence[str], key: str) -> DataFrame:
    return ids.select(*scope, F.col("id").alias(key))


def _any_null(keys: list[str]) -> Column:
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return missing


def _marked(rows: DataFrame, keys: list[str], ids: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows with ``hit``: whether any key is one of the ids. One hash join per key."""
    known = ids.select(*scope, "id").distinct().withColumn("found", F.lit(True))
    hit = F.lit(False)
    marked = rows
    for number, key in enumerate(keys):
        # Rows without a key would all meet in one task; they cannot match anyway.
        salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*rows.columns), F.lit(_NULL_SALTS)).cast("string"))
        other = known.select(*scope, F.col("id").alias(f"key_{number}"), F.col("found").alias(f"found_{number}"))
        marked = marked.withColumn(f"key_{number}", F.coalesce(key, salt)).join(
            other, [*scope, f"key_{number}"], "left"
        )
        hit = hit | F.col(f"found_{number}").isNotNull()
    return marked.select(*rows.columns, hit.alias("hit"))


def prune_rows(rows: DataFrame, keys: list[str], ids: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Rows of the given sessions. A row without a key stays as well, unless its root
    has no session at all: then everything goes."""
    with_ids = ids.select(*scope).distinct()
    keyless = rows.filter(_any_null(keys)).join(with_ids, list(scope), "left_semi")
    keyed = rows.filter(~_any_null(keys))
    return select_rows(keyed, keys, ids, scope).unionByName(keyless)


def select_rows(rows: DataFrame, keys: list[str], ids: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Rows with a key among the ids; rows without a key are not selected."""
    if len(keys) == 1:
        return rows.join(_as_key(ids, scope, keys[0]), [*scope, keys[0]], "left_semi").select(*rows.columns)
    return _marked(rows, keys, ids, scope).filter("hit").drop("hit")


def delete_rows(rows: DataFrame, keys: list[str], ids: DataFrame, scope: Sequence[str] = ROOT) -> DataFrame:
    """Rows of other sessions; rows without a key stay."""
    for key in keys:
        rows = rows.join(_as_key(ids, scope, key), [*scope, key], "left_anti").select(*rows.columns)
    return rows


def prune_state(tables: Tables, ids: DataFrame, scope: Sequence[str] = ROOT) -> Tables:
    return {
        name: prune_rows(rows, _key_columns(name), ids, scope) if name in C.STATE_TABLE_KEYS else rows
        for name, rows in tables.items()
    }


def select_state(tables: Tables, ids: DataFrame | None, scope: Sequence[str] = ROOT) -> Tables:
    chosen = {name: rows for name, rows in tables.items() if name in C.STATE_TABLE_KEYS}
    if ids is None:
        return chosen
    return {name: select_rows(rows, _key_columns(name), ids, scope) for name, rows in chosen.items()}


def delete_state(tables: Tables, ids: DataFrame, scope: Sequence[str] = ROOT) -> Tables:
    affected = {**C.STATE_TABLE_KEYS, **C.APP_TABLE_KEYS}
    return {
        name: delete_rows(rows, _key_columns(name), ids, scope) if name in affected else rows
        for name, rows in tables.items()
    }


def common_columns(dst: DataFrame, src: DataFrame) -> list[str]:
    """Columns of both tables, in the order of the destination."""
    return [name for name in dst.columns if name in src.columns]


def upsert_rows(
    dst: DataFrame,
    src: DataFrame,
    keys: list[str],
    scope: Sequence[str] = ROOT,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Insert the source rows over the common columns, replacing rows of the same key.

    Replaced rows lose their destination-only columns. Of several source rows
    with one key the last by ``order_by`` counts (the greatest without it).
    Rows without a full key never replace anything.
    """
    common = common_columns(dst, src)
    key = [*scope, *[name for name in keys if name not in scope]]
    new = src.select(*common, *[name for name in order_by if name not in common])
    last_first = [F.desc(name) for name in (*order_by, *common)]
    keyed = (
        new.filter(~_any_null(key))
        .withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*last_first)))
        .filter(F.col("nth") == 1)
    )
    new_rows = keyed.select(*common).unionByName(new.filter(_any_null(key)).select(*common))
    kept = dst.join(keyed.select(*key), key, "left_anti").select(*dst.columns)
    return kept.unionByName(new_rows, allowMissingColumns=True).select(*dst.columns)


def upsert_state(
    dst: Tables,
    src: Tables,
    keys: dict[str, list[str]] | None = None,
    scope: Sequence[str] = ROOT,
    order_by: Sequence[str] = (),
) -> Tables:
    """Upsert each state table that both sides have; the others stay as they are."""
    keys = {**PRIMARY_KEYS, **(keys or {})}
    merged = dict(dst)
    for name in C.STATE_TABLE_KEYS:
        if name in dst and name in src:
            key = keys.get(name) or common_columns(dst[name], src[name])
            merged[name] = upsert_rows(dst[name], src[name], key, scope, order_by)
    return merged


def seed_state(src: Tables, ids: DataFrame | None, scope: Sequence[str] = ROOT) -> Tables:
    """State of a root that had none: the source without its account tables, pruned."""
    seeded = {name: rows for name, rows in src.items() if name not in C.ACCOUNT_TABLES}
    return seeded if ids is None else prune_state(seeded, ids, scope)


def merge_state(
    dst: Tables,
    dst_states: DataFrame,
    src: Tables,
    ids: DataFrame,
    keys: dict[str, list[str]] | None = None,
) -> Tables:
    """Upsert where a root has a state database, seed it where it has none."""
    existing = dst_states.select("root_id").distinct()

    def of(tables: Tables, how: str) -> Tables:
        return {name: rows.join(existing, ["root_id"], how) for name, rows in tables.items()}

    updated = upsert_state(dst, select_state(of(src, "left_semi"), ids), keys)
    for name, rows in seed_state(of(src, "left_anti"), ids).items():
        known = updated.get(name)
        updated[name] = rows if known is None else known.unionByName(rows, allowMissingColumns=True)
    return updated


def repair_rollout_paths(
    threads: DataFrame,
    files: DataFrame,
    target_root: Column,
    ids: DataFrame,
    scope: Sequence[str] = ROOT,
) -> DataFrame:
    """Point the threads of the given sessions to their log file below ``target_root``."""
    of_ids = one_file_per_session(files, scope).withColumnRenamed("rel_path", "found_path")
    wanted = ids.select(*scope, "id").distinct().withColumn("lower_id", F.lower("id"))
    targets = wanted.join(
        of_ids.select(*scope, F.col("id").alias("lower_id"), "found_path"), [*scope, "lower_id"]
    ).select(*scope, "id", "found_path")
    rows = threads.join(targets, [*scope, "id"], "left")
    found = F.col("found_path").isNotNull()
    path = F.concat(F.regexp_replace(target_root, "/+$", ""), F.lit("/"), F.col("found_path"))
    archived = paths.is_archived_path(F.col("found_path")).cast(threads.schema["archived"].dataType)
    repaired = {
        "rollout_path": F.when(found, path).otherwise(F.col("rollout_path")),
        "archived": F.when(found, archived).otherwise(F.col("archived")),
    }
    return rows.select(*[repaired.get(name, F.col(name)).alias(name) for name in threads.columns])
