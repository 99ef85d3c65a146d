"""Folders listed by tasks: nothing lost, nothing unseen."""

import os
import warnings

import pytest

from chatstrata.sources import listing, scans, writers


def made(base, *names):
    for name in names:
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


@pytest.mark.parametrize("entries", [3, 100_000])
def test_all_files_in_any_number_of_rounds(spark, tmp_path, entries):
    names = [f"root_id={r}/sessions/{d}/{n} %+.jsonl" for r in range(3) for d in ("a/b/c", "a/b", "x y") for n in range(4)]
    made(tmp_path, *names, "root_id=0/.hidden", "_SUCCESS", "root_id=0/.part-1.crc")
    (tmp_path / "empty" / "deeper").mkdir(parents=True)
    rows = listing.list_files(spark, str(tmp_path), entries_per_task=entries).collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in rows) == sorted([*names, "root_id=0/.hidden"])
    assert all(r.problem is None and r.size_bytes == os.path.getsize(r.path) for r in rows)


def test_closed_folders_several_bases_and_uris(spark, tmp_path):
    made(tmp_path, "a/one", "a/in/two", "b/three")
    found = listing.list_files(spark, [f"file://{tmp_path}/a/", str(tmp_path / "b")], skip="/in$").collect()
    assert sorted(r.path for r in found) == sorted([f"file://{tmp_path}/a/one", f"{tmp_path}/b/three"])
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path / "none"))


def test_what_goes_meanwhile_is_reported(spark, tmp_path):
    walk = listing._walker(None, 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "gone")]})
    rows = pa.Table.from_batches(walk([batch])).to_pylist()
    assert [(r["path"], r["problem"]) for r in rows] == [(str(tmp_path / "gone"), "vanished")]
    made(tmp_path, "here")
    files = listing.list_files(spark, str(tmp_path))
    os.remove(tmp_path / "here")
    assert [(r.content, r.problem) for r in listing.read_files(files).collect()] == [(None, "vanished")]


def test_files_written_and_deleted(spark, tmp_path):
    rows = [(f"{tmp_path}/w/{n}/x", f"text ü {n}") for n in range(30)]
    frame = spark.createDataFrame(rows, "path string, content string")
    assert listing.write_files(frame) == listing.write_files(frame) == 30
    files = listing.list_files(spark, f"{tmp_path}/w")
    assert sorted((r.path, r.content) for r in listing.read_files(files).collect()) == sorted(rows)
    assert listing.delete_files(files) == 30 and listing.delete_files(files) == 0


def test_report_names_what_scans_leave_out(spark, tmp_path):
    made(
        tmp_path, "root_id=abc/sessions/2024/x.jsonl", "root_id=abc/config.toml", "notes.txt", "root_id=1/config.toml",
        "root_id=1/snapshots/s/snapshot.json",
    )
    (tmp_path / "root_id=1" / "snapshots" / "s" / "snapshot.json").write_text('{"id": ')
    (tmp_path / "root_id=99999999999999999999").mkdir()
    made(tmp_path, "root_id=99999999999999999999/x")
    found = {(r.place.replace(str(tmp_path), ""), r.problem, r.files) for r in scans.scan_report(spark, str(tmp_path)).collect()}
    assert found == {
        ("/root_id=abc", "in no root", 2),
        ("/notes.txt", "in no root", 1),
        ("/root_id=99999999999999999999", "in no root", 1),
        ("/root_id=1/snapshots/s/snapshot.json", "broken manifest", 1),
    }
    with pytest.warns(UserWarning, match="4 files"):
        assert scans.scan_files(spark, str(tmp_path)).count() == 2


def test_inventory_has_hidden_files(spark, tmp_path):
    made(tmp_path, "root_id=1/.codex-global-state.json", "root_id=1/history.jsonl")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = scans.scan_files(spark, str(tmp_path))
    assert {r.rel_path for r in found.collect()} == {".codex-global-state.json", "history.jsonl"}


def test_line_files_of_roots_only(spark, tmp_path):
    made(tmp_path, "team [1]/root_id=1/history.jsonl", "root_id=2/sessions/history.jsonl", "history.jsonl")
    part = tmp_path / "root_id=3" / "rel_path=history.jsonl"
    part.mkdir(parents=True)
    (part / "part-00000-x.txt").write_text("one\n")
    (part / "part-00001-x.txt").write_text("two\n")
    found = scans.scan_line_files(spark, str(tmp_path)).collect()
    assert sorted((r.root_id, r.line_no, r.line) for r in found) == [
        (1, 0, "team [1]/root_id=1/history.jsonl"), (3, 0, "one"), (3, 1, "two"),
    ]
    assert scans.scan_line_files(spark, str(tmp_path), ["session_index.jsonl"]).count() == 0


def test_manifests_written_and_read(spark, tmp_path):
    made(tmp_path, "root_id=1/snapshots/a/data/snapshot.json", "root_id=1/sessions/snapshot.json")
    rows = [(1, "a", "n", ["sessions"], 3), (2, "b", None, None, None)]
    manifest = spark.createDataFrame(rows, "root_id bigint, id string, name string, included_paths array<string>, session_count bigint")
    assert writers.write_manifests(manifest, str(tmp_path)) == 2
    found = scans.scan_snapshot_manifests(spark, str(tmp_path)).collect()
    assert sorted((r.root_id, r.id, r.name, r.included_paths, r.session_count) for r in found) == [
        (1, "a", "n", ["sessions"], 3), (2, "b", "b", [], 0),
    ]
