"""Jobs on one small root: round trips, errors and roots without a database."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chatstrata.operators.content import Content
from chatstrata.plans import restore_jobs, snapshot_jobs
from chatstrata.sources import scans, writers
from tests.conftest import sid
from tests.test_operators import FILES, LINES, ids_frame, log, threads

ROOT_PATH = "/home/u/.codex"


def content(spark, numbers, with_state=True, title="t"):
    files = [log(n) for n in numbers] + [(1, "", "history.jsonl", 1), (1, "", "config.toml", 1)]
    if with_state:
        files.append((1, "", "state_5.sqlite", 7))
    lines = [(1, "history.jsonl", n, json.dumps({"session_id": sid(n), "first_text": title})) for n in (*numbers, 90)]
    bodies = [(1, f"sessions/rollout-{sid(n)}.jsonl", 0, f"{title} body {n}") for n in numbers]
    tables = {}
    if with_state:
        # Session 91 is only in the database.
        rows = [(n, f"{ROOT_PATH}/sessions/rollout-{sid(n)}.jsonl", 0) for n in (*numbers, 91)]
        tables["threads"] = threads(spark, rows).withColumn("title", F.lit(title))
    states = spark.createDataFrame([(1,)] if with_state else [], "root_id bigint")
    return Content(
        files=spark.createDataFrame(files, FILES).withColumn("mtime", F.timestamp_seconds(F.lit(5))),
        lines=spark.createDataFrame(lines, LINES),
        states=states,
        tables=tables,
        bodies=spark.createDataFrame(bodies, LINES),
    )


def requests(spark, snapshot_id="20240101-000000-manual", reason="manual"):
    rows = [(1, snapshot_id, ROOT_PATH, reason, "", dt.datetime(2024, 1, 1))]
    return spark.createDataFrame(
        rows, "root_id bigint, snapshot_id string, root_path string, reason string, name string, created_at timestamp"
    )


def profiles(spark):
    return spark.createDataFrame(
        [(1, "p", "m", "f", 8, 9)],
        "root_id bigint, model_provider string, model string, account_fingerprint string, "
        "session_count bigint, archived_session_count bigint",
    )


def roots(spark):
    return spark.createDataFrame([(1, ROOT_PATH)], "root_id bigint, root_path string")


def ids_in(table, key="id"):
    return sorted(int(r[0][-3:]) for r in table.select(key).collect() if r[0])


def session_lines(lines):
    return sorted(json.loads(r.line)["session_id"][-2:] for r in lines.collect())


def test_store_round_trip(spark, tmp_path):
    now = content(spark, [1, 2, 3])
    snapshot, manifest = snapshot_jobs.create_snapshot(now, requests(spark), profiles(spark))
    writers.write_snapshot(snapshot, manifest, str(tmp_path))
    store, rows = writers.read_snapshots(spark, str(tmp_path))
    row = rows.collect()[0]
    assert (row.session_count, row.archived_session_count, row.kind) == (3, 0, "manual")
    assert row.included_paths == ["config.toml", "history.jsonl", "sessions", "state_5.sqlite"]
    # The database entry without a log and the line of an unknown session are gone.
    assert ids_in(store.tables["threads"]) == [1, 2, 3]
    assert session_lines(store.lines) == ["01", "02", "03"]

    changed = content(spark, [2, 4], title="changed")
    full = restore_jobs.restore_full(store, rows, changed, roots(spark))
    assert ids_in(full.tables["threads"]) == [1, 2, 3]
    assert session_lines(full.lines) == ["01", "02", "03"]
    assert sorted(r.line for r in full.bodies.collect()) == ["t body 1", "t body 2", "t body 3"]

    merged = restore_jobs.restore_conversations(store, rows, changed, roots(spark))
    assert ids_in(merged.tables["threads"]) == [1, 2, 3, 4, 91]
    assert sorted(r.line for r in merged.bodies.collect()) == ["changed body 4", "t body 1", "t body 2", "t body 3"]
    assert session_lines(merged.lines) == ["01", "02", "02", "03", "04", "90"]

    one = restore_jobs.restore_sessions(store, rows, ids_frame(spark, [3, 50]), changed, roots(spark))
    assert ids_in(one.tables["threads"]) == [2, 3, 4, 91]
    assert sorted(r.line for r in one.bodies.collect()) == ["changed body 2", "changed body 4", "t body 3"]
    with pytest.raises(ValueError):
        restore_jobs.restore_sessions(store, rows, ids_frame(spark, [50]), changed, roots(spark))

    left, left_rows = snapshot_jobs.delete_snapshots(store, rows, rows.select("root_id", "id"))
    assert left_rows.count() == left.files.count() == 0
    with pytest.raises(ValueError):
        snapshot_jobs.delete_snapshots(store, rows, rows.select("root_id", F.lit("none").alias("id")))


def test_root_without_database(spark):
    now = content(spark, [1, 2], with_state=False)
    snapshot, manifest = snapshot_jobs.create_snapshot(now, requests(spark), profiles(spark))
    row = manifest.collect()[0]
    # Counts come from the profile and no line is filtered.
    assert (row.session_count, row.archived_session_count) == (8, 9)
    assert session_lines(snapshot.lines) == ["01", "02", "90"]


def test_delete_with_protection(spark):
    now = content(spark, [1, 2, 3])
    left, (saved, manifest) = restore_jobs.delete_sessions(
        now, ids_frame(spark, [1]), requests(spark, "x", "pre-delete-session"), profiles(spark)
    )
    assert ids_in(left.files.filter("id <> ''")) == [2, 3]
    assert ids_in(left.tables["threads"]) == [2, 3, 91]
    assert session_lines(left.lines) == ["02", "03", "90"]
    assert sorted(r.line for r in left.bodies.collect()) == ["t body 2", "t body 3"]
    assert ids_in(saved.files.filter("id <> ''")) == ids_in(saved.tables["threads"]) == [1]
    assert session_lines(saved.lines) == ["01"]
    assert [r.line for r in saved.bodies.collect()] == ["t body 1"]
    row = manifest.collect()[0]
    assert (row.kind, row.session_count, row.name) == ("system", 1, "删除前自动备份 · p/m")


def test_full_protection_without_sessions(spark):
    now = content(spark, [1, 2])
    saved, manifest = snapshot_jobs.create_protection_snapshot(
        now, requests(spark, "x", "pre-restore"), profiles(spark), ids_frame(spark, [])
    )
    assert manifest.collect()[0].session_count == 2
    assert "config.toml" in {r.rel_path for r in saved.files.collect()}


def test_extra_paths_of_a_light_snapshot(spark):
    now = content(spark, [1, 2])
    saved, manifest = snapshot_jobs.create_protection_snapshot(
        now, requests(spark, "x", "pre-restore-lightweight"), profiles(spark), ids_frame(spark, [2]), extra_paths=["config.toml"]
    )
    assert manifest.collect()[0].included_paths == ["config.toml", "history.jsonl", "sessions", "state_5.sqlite"]
    assert ids_in(saved.files.filter("id <> ''")) == [2]


def test_attachments_travel_with_the_snapshot(spark, tmp_path):
    now = content(spark, [1, 2])
    named = json.dumps({"payload": {"images": ["/a/1.png", "/a/gone.png"]}})
    now = now.with_(bodies=now.bodies.withColumn("line", F.when(F.col("rel_path").contains(sid(1)), named).otherwise("x")))
    inventory = spark.createDataFrame([(1, "/a/1.png", 40), (1, "/a/2.png", 50)], "root_id bigint, path string, size_bytes bigint")
    bare, bare_rows = snapshot_jobs.create_snapshot(now, requests(spark), profiles(spark))
    saved, rows = snapshot_jobs.create_snapshot(now, requests(spark), profiles(spark), attachment_files=inventory)
    assert [(r.session_id, r.original_path) for r in saved.attachments.collect()] == [(sid(1), "/a/1.png")]
    row, bare_row = rows.collect()[0], bare_rows.collect()[0]
    assert row.size_bytes == bare_row.size_bytes + 40
    assert set(row.included_paths) - set(bare_row.included_paths) == {"external_attachments"}
    for in_place, expected in (([], 1), ([(1, "/a/1.png")], 0)):
        found = spark.createDataFrame(in_place, "root_id bigint, path string")
        back = restore_jobs.restore_sessions(saved, rows, ids_frame(spark, [1]), now, roots(spark), in_place=found)
        assert back.attachments.count() == expected


def test_roots_in_and_out(spark, tmp_path):
    """Raw roots are scanned, a session is deleted and restored, and the result written and scanned again."""
    writers.write_content(content(spark, [1, 2, 3]), f"{tmp_path}/logs", f"{tmp_path}/state")
    now = scans.scan_content(spark, f"{tmp_path}/logs", f"{tmp_path}/state")
    assert ids_in(now.files.filter("id <> ''")) == [1, 2, 3] and now.states.count() == 1
    saved, manifest = snapshot_jobs.create_snapshot(now, requests(spark), profiles(spark))
    left, _ = restore_jobs.delete_sessions(
        now, ids_frame(spark, [1]), requests(spark, "x", "pre-delete-session"), profiles(spark)
    )
    writers.write_content(left, f"{tmp_path}/logs2", f"{tmp_path}/state2")
    after = scans.scan_content(spark, f"{tmp_path}/logs2", f"{tmp_path}/state2")
    assert ids_in(after.files.filter("id <> ''")) == [2, 3] and session_lines(after.lines) == ["02", "03", "90"]
    back = restore_jobs.restore_sessions(saved, manifest, ids_frame(spark, [1]), after, roots(spark))
    writers.write_content(back, f"{tmp_path}/logs3", f"{tmp_path}/state3")
    again = scans.scan_content(spark, f"{tmp_path}/logs3", f"{tmp_path}/state3")
    assert ids_in(again.files.filter("id <> ''")) == [1, 2, 3] and ids_in(again.tables["threads"]) == [1, 2, 3, 91]
    assert sorted(r.line for r in again.bodies.collect()) == ["t body 1", "t body 2", "t body 3"]


def test_content_of_raw_snapshots(spark, tmp_path):
    for name, number in (("a", 1), ("2024-01-01", 2)):
        data = tmp_path / "root_id=7" / "snapshots" / name / "data"
        (data / "sessions").mkdir(parents=True)
        (data / "sessions" / f"rollout-{sid(number)}.jsonl").write_text("one\ntwo\n")
        (data / "history.jsonl").write_text(json.dumps({"session_id": sid(number)}) + "\n")
        (data / "state_5.sqlite").write_bytes(b"x")
    found = scans.scan_snapshot_content(spark, str(tmp_path))
    assert sorted((r.snapshot_id, r.id) for r in found.files.filter("id <> ''").collect()) == [("2024-01-01", sid(2)), ("a", sid(1))]
    assert sorted((r.snapshot_id, r.line_no, r.line) for r in found.bodies.collect()) == [
        (name, n, line) for name in ("2024-01-01", "a") for n, line in enumerate(("one", "two"))
    ]
    assert sorted((r.root_id, r.snapshot_id) for r in found.states.collect()) == [(7, "2024-01-01"), (7, "a")]
    assert session_lines(found.lines) == ["01", "02"]


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    saved, rows = snapshot_jobs.create_snapshot(content(spark, [1, 2]), requests(spark, "2024-01-01"), profiles(spark))
    writers.write_snapshot(saved, rows.limit(0), str(tmp_path))
    writers.write_snapshot(saved, rows, str(tmp_path))
    for only in (None, ["2024-01-01"]):
        store, found = writers.read_snapshots(spark, str(tmp_path), only)
        assert store.files.count() == saved.files.count() and found.count() == 1
        assert {r.snapshot_id for r in store.files.collect()} == {"2024-01-01"}
    assert writers.read_snapshots(spark, str(tmp_path), ["other"])[1].count() == 0


def test_retention_when_snapshots_are_added(spark):
    store, rows = snapshot_jobs.create_snapshot(content(spark, [1]), requests(spark, "s-2", "pre-restore"), profiles(spark))
    later = requests(spark, "s-10", "pre-restore").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    taken, new = snapshot_jobs.create_snapshot(content(spark, [1, 2]), later, profiles(spark))
    left, kept = snapshot_jobs.add_snapshots(store, rows, taken, new, max_system=1)
    assert [r.id for r in kept.collect()] == ["s-10"] and {r.snapshot_id for r in left.files.collect()} == {"s-10"}


def test_the_snapshot_made_later_counts(spark):
    """Ids whose order as text is not that of their times."""
    made = {}
    for name, day, number, status in (("s-2", 1, 1, "old"), ("s-10", 2, 2, "new")):
        request = requests(spark, name).withColumn("created_at", F.col("created_at") + F.make_dt_interval(F.lit(day)))
        now = content(spark, [1, 2] if number == 1 else [2])
        edges = spark.createDataFrame([(1, sid(1), sid(2), status)], "root_id bigint, parent_thread_id string, child_thread_id string, status string")
        made[name] = snapshot_jobs.create_snapshot(now.with_(tables={**now.tables, "thread_spawn_edges": edges}), request, profiles(spark))
    store = snapshot_jobs.union_contents(made["s-2"][0], made["s-10"][0])
    # Both snapshots keep the edge, whoever pruned it.
    edges = spark.createDataFrame(
        [(1, name, sid(1), sid(2), status) for name, status in (("s-2", "old"), ("s-10", "new"))],
        "root_id bigint, snapshot_id string, parent_thread_id string, child_thread_id string, status string",
    )
    store = store.with_(tables={**store.tables, "thread_spawn_edges": edges})
    manifest = made["s-2"][1].unionByName(made["s-10"][1])
    now = content(spark, [3])
    now = now.with_(tables={**now.tables, "thread_spawn_edges": edges.drop("snapshot_id").limit(0)})
    back = restore_jobs.restore_from_latest(store, manifest, ids_frame(spark, [1, 2]), now, roots(spark))
    assert [r.status for r in back.tables["thread_spawn_edges"].collect()] == ["new"]


def joins(table):
    return table._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def on_disk(spark, tmp_path, name, found):
    """Content that is read from files, as plans on rows of the driver are cut short."""

    def written(table):
        number = len(list(tmp_path.iterdir()))
        table.write.parquet(f"{tmp_path}/{name}-{number}")
        return spark.read.parquet(f"{tmp_path}/{name}-{number}")

    return found.map_tables(written)


def all_joins(found):
    return sum(joins(table) for table in found.named_tables().values())


# A job's plan stays on the driver, with a copy for each time that Spark plans anew, so it must not grow with what its inputs are made of.
def of_root(spark, rows):
    """Rows that are the result of a join."""
    return rows.join(spark.range(1, 2).withColumnRenamed("id", "root_id"), ["root_id"], "left_semi")


def test_plan_of_a_snapshot_is_small(spark, tmp_path):
    now = on_disk(spark, tmp_path, "now", content(spark, [1, 2, 3]))
    snapshot, manifest = snapshot_jobs.create_snapshot(now, of_root(spark, requests(spark)), profiles(spark))
    assert all_joins(snapshot) < 40 and joins(manifest) < 30


def test_plan_of_a_protection_snapshot_is_small(spark, tmp_path):
    now = on_disk(spark, tmp_path, "now", content(spark, [1, 2, 3]))
    snapshot, manifest = snapshot_jobs.create_protection_snapshot(now, of_root(spark, requests(spark)), profiles(spark), ids_frame(spark, [2]))
    assert all_joins(snapshot) < 80 and joins(manifest) < 60


def test_plan_of_a_deletion_is_small(spark, tmp_path):
    now = on_disk(spark, tmp_path, "now", content(spark, [1, 2, 3]))
    ids = of_root(spark, ids_frame(spark, [2]))
    left, _ = restore_jobs.delete_sessions(now, ids, of_root(spark, requests(spark)), profiles(spark))
    assert all_joins(left) < 12


def test_plan_of_a_restore_is_small(spark, tmp_path):
    snapshot, manifest = snapshot_jobs.create_snapshot(content(spark, [1, 2, 3]), requests(spark), profiles(spark))
    now, store = on_disk(spark, tmp_path, "now", content(spark, [2, 4])), on_disk(spark, tmp_path, "store", snapshot)
    chosen = of_root(spark, manifest)
    assert all_joins(restore_jobs.restore_conversations(store, chosen, now, roots(spark))) < 100
    assert all_joins(restore_jobs.restore_full(store, chosen, now, roots(spark))) < 120
