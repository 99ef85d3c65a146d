"""Logs that grow between refreshes: the rows of one batch scan, each byte read once."""

import io
import json
import os
import random

from chatstrata.operators import messages
from chatstrata.sources import growth
from chatstrata.streaming import ingest
from tests.conftest import sid

COLUMNS = ["root_id", "rel_path", "session_id", "line_no", "message_id", "role", "phase", "ts", "text"]


def event(text, kind="user_message"):
    return json.dumps({"timestamp": "2024-05-01T00:00:00Z", "type": "event_msg", "payload": {"type": kind, "message": text}})


def response(text, role="assistant"):
    content = [{"type": "output_text", "text": text}]
    payload = {"type": "message", "role": role, "content": content}
    return json.dumps({"timestamp": "2024-05-01T00:00:01Z", "type": "response_item", "payload": payload})


def log(base, root, number, folder="sessions/2024"):
    path = base / f"root_id={root}" / folder / f"rollout-{sid(number)}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def append(path, *lines, end="\n"):
    with open(path, "ab") as out:
        out.write("".join(line + "\n" for line in lines).encode()[: None if end else -1])


def rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()))


def same_as_scan(spark, base, store, **options):
    found = rows(ingest.refresh(spark, str(base), store, **options))
    assert found == rows(messages.scan_conversations(spark, str(base)))
    return found


def test_chunks_give_each_line_once():
    rng = random.Random(3)
    for _ in range(300):
        text = b"".join(rng.choice([b"", b"a", b"\r", b"x" * rng.randrange(12)]) + b"\n" for _ in range(rng.randrange(9)))
        text += rng.choice([b"", b"open"])
        first = text.find(b"\n") + 1 if rng.random() < 0.5 else 0
        step = rng.randrange(1, 9)
        found = []
        for begin in range(first, len(text), step):
            stop = min(begin + step, len(text))
            found += growth.whole_lines(io.BytesIO(text), begin, first, stop, len(text))
        assert [line for _, _, line in found] == text[first:].split(b"\n")[:-1]
        assert all(a[1] == b[0] for a, b in zip(found, found[1:])) and (not found or found[0][0] == first)


def test_blocks_are_joined(monkeypatch):
    monkeypatch.setattr(growth, "BLOCK_BYTES", 3)
    test_chunks_give_each_line_once()


def test_three_batches_give_the_rows_of_a_scan(spark, tmp_path):
    base, store = tmp_path / "logs", str(tmp_path / "store")
    for n in range(6):
        append(log(base, n % 2, n), response(f"first {n} ü"), "", "not json", response("two\r") + "\r")
    first = same_as_scan(spark, base, store, chunk_bytes=100)
    assert len(first) == 12
    # an event takes back the responses before it; a new file, a moved one, long lines over many chunks
    append(log(base, 0, 0), event("late event"), response("no more"))
    append(log(base, 1, 1), response("x" * 1000), response("after"))
    append(log(base, 1, 9), event("new file"))
    log(base, 1, 3).rename(log(base, 1, 3, "archived_sessions"))
    second = same_as_scan(spark, base, store, chunk_bytes=100)
    assert [r[8] for r in second if sid(0) in r[1]] == ["late event"]
    append(log(base, 0, 0), event("answer", "agent_message"))
    append(log(base, 0, 8, "archived_sessions"), response("archived"))
    same_as_scan(spark, base, store)
    # nothing new: no span, and the same rows
    assert growth.refresh(spark, str(base), f"{store}/feed") == 0
    same_as_scan(spark, base, store)


def test_only_what_was_appended_is_read(spark, tmp_path):
    base, feed = tmp_path / "logs", str(tmp_path / "feed")
    for n in range(4):
        append(log(base, 0, n), *[response("old")] * 5)
    assert growth.refresh(spark, str(base), feed) == 4
    append(log(base, 0, 2), response("new"))
    assert growth.refresh(spark, str(base), feed) == 1
    spans = growth.spans(spark, feed).filter("start_byte > 0").collect()
    assert [(s.rel_path, s.end_byte, s.n_lines) for s in spans] == [
        (f"sessions/2024/rollout-{sid(2)}.jsonl", os.path.getsize(log(base, 0, 2)), 1)
    ]
    assert spark.read.parquet(f"{feed}/lines").filter("line is not null").count() == 21


def test_open_last_line_waits_for_its_end(spark, tmp_path):
    base, store = tmp_path / "logs", str(tmp_path / "store")
    append(log(base, 0, 0), response("whole"), response("half"), end="")
    assert [r[8] for r in rows(ingest.refresh(spark, str(base), store))] == ["whole"]
    append(log(base, 0, 0), "", response("next"))
    assert [r[8] for r in same_as_scan(spark, base, store)] == ["whole", "half", "next"]


def test_rewritten_files_are_read_anew(spark, tmp_path):
    base, store = tmp_path / "logs", str(tmp_path / "store")
    changes = {
        "shorter": [event("c")],
        "same size": [event("aaaa"), event("cccc")],
        "longer": [response("aaaa")] * 5,
        "empty": [],
        "gone": None,
    }
    logs = [log(base, 0, n) for n in range(len(changes))]
    for path in logs:
        append(path, event("aaaa"), event("bbbb"))
    append(log(base, 0, 9), response("stays"))
    same_as_scan(spark, base, store)
    for path, lines in zip(logs, changes.values()):
        os.remove(path)
        if lines is not None:
            append(path, *lines)
            os.utime(path, (2e9, 2e9))
    assert len(same_as_scan(spark, base, store)) == 1 + 1 + 2 + 5
    for path in logs:
        append(path, response("again"))
    same_as_scan(spark, base, store)


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    base, store = tmp_path / "logs", str(tmp_path / "store")
    append(log(base, 0, 0), response("one"), event("two"))
    same_as_scan(spark, base, store)
    # lines of a refresh that ended before its spans were written
    lost = spark.read.schema(growth.READ).parquet(f"{store}/feed/lines").drop("attempt")
    lost.write.parquet(f"{store}/feed/lines/attempt=attempt-lost")
    append(log(base, 0, 0), event("three"))
    append(log(base, 0, 1), response("four"))
    same_as_scan(spark, base, store)


def test_no_logs_no_whole_line_no_message(spark, tmp_path):
    base, store = tmp_path / "logs", str(tmp_path / "store")
    (base / "root_id=1").mkdir(parents=True)
    assert rows(ingest.refresh(spark, str(base), store)) == []
    append(log(base, 1, 0), "open", end="")
    assert rows(ingest.refresh(spark, str(base), store)) == []
    append(log(base, 1, 0), " line without a message", "")
    assert rows(ingest.refresh(spark, str(base), store)) == []
    append(log(base, 1, 0), response("one"))
    assert [r[3] for r in same_as_scan(spark, base, store)] == [1]
