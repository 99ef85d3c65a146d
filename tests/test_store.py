"""A store that drops snapshots by tombstones: one state before, during and after each step."""

import os

import pytest
from pyspark.sql import functions as F

from chatstrata.operators.content import Content
from chatstrata.sources import store, writers
from tests.test_operators import FILES, LINES


def snapshots(spark, ids, roots=(1, 2)):
    """Each snapshot has one file and one log line, which name it; the later in ``ids``, the newer."""
    rows = [(r, i) for r in roots for i in ids]
    files = [(r, "", f"f-{i}", 1) for r, i in rows]
    named = lambda frame: frame.withColumn("snapshot_id", F.regexp_extract("rel_path", "-(.*)$", 1))
    content = Content(
        files=named(spark.createDataFrame(files, FILES).withColumn("mtime", F.timestamp_seconds(F.lit(5)))).coalesce(1),
        lines=named(spark.createDataFrame([], LINES)),
        states=named(spark.createDataFrame([], "root_id bigint, rel_path string")).drop("rel_path"),
        bodies=named(spark.createDataFrame([(r, f"sessions-{i}", 0, i) for r, i in rows], LINES)).coalesce(1),
    )
    manifest = spark.createDataFrame(
        [(r, i, int(i[1:]), "pre-restore", "system") for r, i in rows],
        "root_id bigint, id string, at bigint, reason string, kind string",
    )
    return content, manifest.withColumn("created_at", F.timestamp_seconds("at")).drop("at")


def state(spark, base):
    content, manifest = writers.read_snapshots(spark, base)
    live = sorted((r.root_id, r.id) for r in manifest.collect())
    assert sorted((r.root_id, r.snapshot_id) for r in content.files.collect()) == live
    assert sorted((r.root_id, r.line) for r in content.bodies.collect()) == live
    return live


def files_below(base, name):
    return sum(f.endswith(".parquet") for _, _, files in os.walk(f"{base}/{name}") for f in files)


def test_drop_compact_vacuum(spark, tmp_path):
    base = str(tmp_path / "store")
    writers.write_snapshot(*snapshots(spark, ["s1", "s2", "s3"]), base)
    before = writers.read_snapshots(spark, base)[0].files
    ids = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s2")], "root_id bigint, id string")
    assert store.drop_snapshots(spark, base, ids) == 3
    left = [(1, "s3"), (2, "s1"), (2, "s3")]
    assert state(spark, base) == left
    assert spark.read.parquet(f"{base}/dropped").count() == 3
    with pytest.raises(ValueError):
        store.drop_snapshots(spark, base, ids)
    # Nothing goes within the grace period, so a reader that began before the drop still ends.
    assert store.vacuum(spark, base) == 0 and before.count() == 6
    # Only the whole partition of s2 can go; s1 shares its file with a live snapshot.
    whole = files_below(base, "files")
    store.vacuum(spark, base, 0)
    assert state(spark, base) == left and files_below(base, "files") < whole
    assert store.compact(spark, base) == 1
    assert state(spark, base) == left
    store.vacuum(spark, base, 0)
    assert state(spark, base) == left
    held = spark.read.parquet(f"{base}/files").select("root_id", "snapshot_id").collect()
    assert sorted(map(tuple, held)) == left
    assert store.compact(spark, base) == 0 and store.vacuum(spark, base, 0) == 0


def test_crash_between_the_rows_and_the_log(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    writers.write_snapshot(*snapshots(spark, ["s1", "s2"]), base)
    store.drop_snapshots(spark, base, spark.createDataFrame([(1, "s1")], "root_id bigint, id string"))
    left = state(spark, base)
    content, manifest = snapshots(spark, ["s1"])
    # What a compaction or an append leaves that ends before its manifest row.
    lost = content.files.withColumn(writers.ATTEMPT, F.lit("lost"))
    lost.write.mode("append").partitionBy("snapshot_id").parquet(f"{base}/files")
    assert state(spark, base) == left
    assert store.compact(spark, base) == 1
    assert state(spark, base) == left
    store.vacuum(spark, base, 0)
    assert state(spark, base) == left
    # A writer that has not committed keeps its rows.
    assert spark.read.parquet(f"{base}/files").filter("attempt_id = 'lost'").count() == 2


def test_retention_with_every_append_and_ids_used_again(spark, tmp_path):
    base = str(tmp_path / "store")
    assert store.append_snapshots(*snapshots(spark, ["s1", "s2"]), base, max_system=2) == 0
    assert store.append_snapshots(*snapshots(spark, ["s3"]), base, max_system=2) == 2
    assert state(spark, base) == [(1, "s2"), (1, "s3"), (2, "s2"), (2, "s3")]
    store.drop_snapshots(spark, base, spark.createDataFrame([(1, "s3")], "root_id bigint, id string"))
    # A dropped id may come again.
    writers.write_snapshot(*snapshots(spark, ["s3"], roots=(1,)), base)
    assert state(spark, base) == [(1, "s2"), (1, "s3"), (2, "s2"), (2, "s3")]


def test_an_empty_store_after_all_is_dropped(spark, tmp_path):
    base = str(tmp_path / "store")
    writers.write_snapshot(*snapshots(spark, ["s1"]), base)
    store.drop_snapshots(spark, base, spark.createDataFrame([(1, "s1"), (2, "s1")], "root_id bigint, id string"))
    assert store.vacuum(spark, base, 0) > 0
    content, manifest = writers.read_snapshots(spark, base)
    assert manifest.count() == content.files.count() == 0
