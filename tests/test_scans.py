"""Scans of raw files, compared with plain Python readers."""

import json

import pytest

from chatstrata.operators import messages
from chatstrata.sources import scans
from tests.conftest import sid


def split_lines(data: str) -> list[str]:
    return [line for line in (part.removesuffix("\r") for part in data.split("\n")) if line]


def expected_lines(files: dict[tuple[int, str], str]) -> list[tuple]:
    return sorted(
        (root, path, number, line)
        for (root, path), data in files.items()
        for number, line in enumerate(split_lines(data))
    )


def write(base, files):
    for (root, path), data in files.items():
        target = base / f"root_id={root}" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data.encode())


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "40000")
    yield
    spark.conf.set(key, before)


@pytest.fixture()
def files():
    long_file = "".join(f"line {n} {'x' * (n % 37)}{'\r' if n % 3 == 0 else ''}\n{'' if n % 5 else chr(10)}" for n in range(20000))
    return {
        (1, f"sessions/2024/a b/rollout-{sid(1)}.jsonl"): "one\r\n\r\n  \r\ntwo\n{broken\n",
        (1, f"archived_sessions/rollout-{sid(2)}.jsonl"): "no newline at the end",
        (2, f"sessions/rollout-{sid(3)}.jsonl"): long_file,
        (2, f"sessions/100%+x/rollout-{sid(4)}.jsonl"): "".join(f"short {n}\n" for n in range(500)),
    }


@pytest.fixture(params=[1000, 40_000, 10**9])
def split_bytes(spark, request):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    yield
    spark.conf.set(key, before)


def test_line_numbers(spark, tmp_path, split_bytes, files):
    others = {(1, "sessions/notes.txt"): "no", (1, "elsewhere/x.jsonl"): "no"}
    write(tmp_path, files | others)
    found = scans.scan_rollout_lines(spark, str(tmp_path))
    rows = [(r.root_id, r.rel_path, r.line_no, r.line) for r in found.collect()]
    assert sorted(rows) == expected_lines(files)
    assert {r.session_id for r in found.select("session_id").distinct().collect()} == {sid(n) for n in (1, 2, 3, 4)}


def test_wanted_lines_keep_their_numbers(spark, tmp_path, files):
    write(tmp_path, files)
    found = scans.scan_rollout_lines(spark, str(tmp_path), wanted=lambda line: line.contains("7"))
    rows = sorted((r.root_id, r.rel_path, r.line_no, r.line) for r in found.collect())
    assert rows == [row for row in expected_lines(files) if "7" in row[3]]


def test_parts_are_in_the_order_of_their_numbers(spark, tmp_path):
    folder = tmp_path / "root_id=1" / "rel_path=history.jsonl"
    folder.mkdir(parents=True)
    for number in (99_999, 100_000, 7):
        (folder / f"part-{number:05d}-x.txt").write_text(f"{number}\n")
    found = scans.scan_line_files(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in found] == [(0, "7"), (1, "99999"), (2, "100000")]


def test_lines_are_read_twice_and_not_sorted(spark, tmp_path, files):
    write(tmp_path, files)
    frame = scans.scan_rollout_lines(spark, str(tmp_path), wanted=messages.is_message_line)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
    physical = frame._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Window ") == 1 and "isnotnull(line" in physical.lower()


def test_only_log_files_are_read(spark, tmp_path, files):
    write(tmp_path, files | {(3, "shell_snapshots/big.sh"): "x" * 100000})
    frame = scans.scan_rollout_lines(spark, str(tmp_path))
    frame.collect()
    read = []

    def visit(plan):
        name = plan.nodeName()
        if "Scan" in name:
            read.append(plan.metrics().get("numFiles").get().value())
        if name == "AdaptiveSparkPlan":
            visit(plan.executedPlan())
        if name.endswith("QueryStage"):
            visit(plan.plan())
        children = plan.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(frame._jdf.queryExecution().executedPlan())
    assert read and max(read) <= len(files)


def test_inventory(spark, tmp_path, files):
    write(tmp_path, files | {(1, "config.toml"): "12345"})
    found = {(r.root_id, r.rel_path): (r.id, r.size_bytes) for r in scans.scan_files(spark, str(tmp_path)).collect()}
    assert found[(1, "config.toml")] == ("", 5)
    for (root, path), data in files.items():
        assert found[(root, path)][1] == len(data.encode())
    logs = scans.list_session_files(spark, str(tmp_path)).collect()
    assert {(r.root_id, r.rel_path) for r in logs} == set(files)
    assert {r.rel_path for r in logs if r.in_archive} == {f"archived_sessions/rollout-{sid(2)}.jsonl"}


def test_history_flags(spark, tmp_path):
    lines = [
        '{"session_id":"a","first_text":"t","is_archived":true}',
        '{"session_id":"a","is_archived":0}',
        '{"session_id":"b","is_archived":2}',
        '{"session_id":"c","is_archived":"false"}',
        '{"session_id":"d","is_archived":null}',
        "{broken session_id",
        '{"session_id":7,"first_text":""}',
    ]
    write(tmp_path, {(1, "history.jsonl"): "\n".join(lines)})
    found = scans.scan_history(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.is_archived for r in found] == [True, False, True, None, None, None, None]
    assert [r.session_id for r in found] == ["a", "a", "b", "c", "d", None, "7"]
    assert [r.line for r in found] == lines


def test_index(spark, tmp_path):
    write(tmp_path, {(1, "session_index.jsonl"): '{"id":"a","thread_name":"x"}\nnope\n'})
    found = scans.scan_session_index(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.id, r.thread_name, r.line_no) for r in found] == [("a", "x", 0), (None, None, 1)]


def test_manifests(spark, tmp_path):
    full = {
        "id": "20240101-000000-manual", "name": "n", "createdAt": "2024-01-01T00:00:00.250Z", "codexRoot": "/r",
        "reason": "manual", "kind": "manual", "modelProvider": "p", "model": "m", "accountFingerprint": "f",
        "sessionCount": 3, "archivedSessionCount": 1, "sizeBytes": 9, "includedPaths": ["sessions"], "warnings": ["w"],
    }
    write(
        tmp_path,
        {
            (1, "snapshots/a/snapshot.json"): json.dumps(full, indent=2),
            (1, "snapshots/b/snapshot.json"): "{}",
            (1, "snapshots/c/snapshot.json"): '{"id": "c", "name": ',
            (1, "snapshots/d/other.json"): "{}",
        },
    )
    found = {r.id: r for r in scans.scan_snapshot_manifests(spark, str(tmp_path)).collect()}
    assert set(found) == {"20240101-000000-manual", "b"}
    row = found["20240101-000000-manual"]
    assert (row.session_count, row.included_paths, row.warnings, row.snapshot_root) == (3, ["sessions"], ["w"], "/r")
    assert row.created_at.microsecond == 250000
    empty = found["b"]
    assert (empty.name, empty.model, empty.account_fingerprint, empty.session_count) == ("b", "unknown", "none", 0)
    assert (empty.created_at, empty.included_paths, empty.size_bytes) == (None, [], 0)


def test_profiles(spark, tmp_path):
    write(
        tmp_path,
        {
            (1, "config.toml"): 'model_provider = "p"\n[x]\nmodel = "m"\n',
            (1, "auth.json"): "secret",
            (1, f"sessions/{sid(1)}.jsonl"): "x",
            (2, f"archived_sessions/deep/{sid(1)}.jsonl"): "x",
        },
    )
    found = {r.root_id: r for r in scans.scan_profile_state(spark, str(tmp_path)).collect()}
    assert (found[1].model_provider, found[1].model, found[1].session_count) == ("p", "m", 1)
    assert found[1].account_fingerprint == "2bb80d537b1d"
    assert (found[2].model, found[2].account_fingerprint, found[2].archived_session_count) == ("unknown", "none", 1)


def test_conversations_from_files(spark, tmp_path):
    event = {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "user_message", "message": " hi "}}
    response = {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": "yes"}}
    meta = {"type": "session_meta", "payload": {"cwd": "/w"}}
    with_event = "\r\n".join(json.dumps(o) for o in (meta, response, event, response))
    only_response = "\n".join(["", json.dumps(meta), "", json.dumps(response)])
    write(
        tmp_path,
        {
            (1, f"sessions/rollout-{sid(1)}.jsonl"): with_event,
            (1, f"sessions/rollout-{sid(2)}.jsonl"): only_response,
        },
    )
    found = messages.scan_conversations(spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.message_id, r.role, r.text) for r in found) == [
        (sid(1), "event-2", "user", "hi"),
        (sid(2), "response-1", "assistant", "yes"),
    ]
