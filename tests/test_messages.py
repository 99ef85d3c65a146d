"""Message parsing and session metadata on hand-written lines."""

import json

import pytest
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import jsonlines
from chatstrata.operators import attachments, catalog, messages
from tests.conftest import sid


def lines_frame(spark, lines, session=1):
    rows = [
        (1, f"sessions/rollout-{sid(session)}.jsonl", sid(session), n, line if isinstance(line, str) else json.dumps(line))
        for n, line in enumerate(lines)
    ]
    return spark.createDataFrame(rows, "root_id bigint, rel_path string, session_id string, line_no bigint, line string")


def event(kind="user_message", **payload):
    return {"type": "event_msg", "timestamp": "2024-05-01T10:00:00.123Z", "payload": {"type": kind, **payload}}


def response(role="user", content="x", **more):
    return {"type": "response_item", "payload": {"type": "message", "role": role, "content": content, **more}}


def texts(spark, lines):
    found = messages.conversation_messages(lines_frame(spark, lines)).orderBy("line_no").collect()
    return [(r.message_id, r.role, r.text) for r in found]


def test_event_text_falls_back_to_content(spark):
    lines = [
        event(message="", content="from content"),
        event(message="   ", content="blank messages are dropped"),
        event("agent_message", message="kept", phase="final"),
        event("agent_reasoning", message="no role"),
        '{"type":"event_msg","payload":{"type":"user_message"',
    ]
    assert texts(spark, lines) == [("event-0", "user", "from content"), ("event-2", "assistant", "kept")]


def test_responses_only_without_events(spark):
    lines = [response("user", "a"), response("system", "b"), response("assistant", [{"text": "c"}, {"text": " "}, "d"])]
    assert texts(spark, lines) == [("response-0", "user", "a"), ("response-2", "assistant", "c\nd")]
    assert texts(spark, [*lines, event(message="e")]) == [("event-3", "user", "e")]


def test_a_blank_event_does_not_hide_responses(spark):
    assert texts(spark, [event(message=" "), response("user", "a")]) == [("response-1", "user", "a")]


def test_phase_and_time(spark):
    row = messages.conversation_messages(lines_frame(spark, [event(message="x", phase="p")])).collect()[0]
    assert (row.phase, row.ts.microsecond) == ("p", 123000)
    late = {"type": "event_msg", "timestamp": "never", "payload": {"type": "user_message", "message": "x"}}
    frame = lines_frame(spark, [late])
    assert messages.conversation_messages(frame).collect()[0].ts is None
    epoch = messages.conversation_messages(frame, epoch_default=True).select(F.unix_seconds("ts").alias("s"))
    assert epoch.collect()[0].s == 0


def plain_text(value):
    """The rule of the text search, as a recursive function."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(plain_text, value) if t.strip())
    if isinstance(value, dict):
        for key in C.TEXT_KEYS:
            found = plain_text(value.get(key))
            if found.strip():
                return found
    return ""


def nest(value, levels):
    for level in range(levels):
        value = [value] if level % 2 else {"content": value}
    return value


def test_text_of_all_shapes(spark):
    bodies = [
        "s", "", " ", 5, 0, True, None, [], {}, [[]], ["a", 1, "b"], [["a", ["b"]], "c"],
        {"text": " ", "output": "o"}, {"message": {"content": [{"input": "i"}]}}, {"other": "x"},
        {"text": ["", {"text": "deep"}], "content": "later"}, [{"text": "a\n"}, {"content": ["b", {"output": "c"}]}],
        {"text": 5, "message": "m"}, '{"text":"a string that looks like JSON"}',
        *[nest("n", levels) for levels in range(1, jsonlines.TEXT_DEPTH + 1)],
    ]
    frame = spark.createDataFrame([(n, json.dumps(b)) for n, b in enumerate(bodies)], "n int, body string")
    value = F.try_parse_json("body")
    found = frame.select("n", jsonlines.extract_text(value).alias("t"), jsonlines.exceeds_depth(value).alias("d"))
    rows = sorted(found.collect())
    assert [(r.n, r.t) for r in rows] == [(n, plain_text(b)) for n, b in enumerate(bodies)]
    assert not any(r.d for r in rows)


@pytest.mark.parametrize("levels", [jsonlines.TEXT_DEPTH + 1, 12, 40, 400])
def test_bodies_of_any_depth_are_read_and_reported(spark, levels):
    deep = response("user", [" ", nest("n", levels), {"text": "after"}])
    frame = lines_frame(spark, [response("user", "a"), deep])
    assert [r.line_no for r in messages.deep_lines(frame).collect()] == [1]
    assert [r.text for r in messages.conversation_messages(frame).orderBy("line_no").collect()] == ["a", "n\nafter"]


@pytest.mark.parametrize("levels", [3, 6, 7, 10, 100])
def test_attachments_at_any_depth(spark, levels):
    inner = "/a/deep.png"
    for level in range(levels):
        inner = [inner] if level % 2 else {"type": "file", "any": inner, "url": "file:///a/b%20c.bin", "path": "relative.png"}
    payload = {"images": [inner, "/a/x/../1.png"], "content": [[{"type": "text", "path": "/a/no.txt"}]]}
    frame = lines_frame(spark, [{"type": "event_msg", "payload": payload}])
    found = sorted(r.original_path for r in attachments.attachment_paths(frame).collect())
    assert found == ["/a/1.png", "/a/b c.bin", "/a/deep.png"]


def meta(**payload):
    return {"type": "session_meta", "payload": payload}


def metadata(spark, lines, **options):
    return catalog.rollout_metadata(lines_frame(spark, lines), **options).collect()[0]


def test_last_value_before_the_title_counts(spark):
    row = metadata(
        spark,
        [
            meta(cwd="/a", model_provider="p1", timestamp="2024-01-01T00:00:00Z"),
            meta(cwd="", model_provider="p2"),
            event(message="first"),
            meta(cwd="/late", model="late"),
            event(message="second"),
        ],
    )
    assert (row.title, row.cwd, row.model_provider, row.model, row.source) == ("first", "/a", "p2", "unknown", "jsonl")
    assert row.created_at.year == 2024


def test_title_anywhere_or_within_the_first_lines(spark):
    filler = ["{}"] * 200
    assert metadata(spark, [*filler, event(message="late")]).title == "late"
    assert metadata(spark, [*filler, event(message="late")], max_lines=160).title == ""
    assert metadata(spark, [*filler[:120], event(message="late")], max_lines=120).title == ""


def test_title_by_role(spark):
    lines = [response("user", [{"kind": 1}, {"text": " from content "}]), event(message="from event")]
    assert metadata(spark, lines).title == "from event"
    assert metadata(spark, lines, title_mode="role").title == "from content"


def test_attachments_of_all_shapes(spark):
    payload = {
        "images": ["/a/1.PNG", "relative.png", "/a/no.exe", ["/a/2.jpg"]],
        "local_images": [{"path": "/a/x/../3.pdf", "image_url": "file:///a/b%20c+d.bin"}],
        "text_elements": [{"filename": "4.md"}, {"filename": "/a/4.md"}],
        "content": [
            {"type": "input_image", "image_url": "file://host/a/5.xyz?q#f", "detail": {"path": "/a/6.csv"}},
            {"type": "text", "path": "/a/ignored.txt"},
            [{"type": "FILE", "more": ["/a/7.zip", {"type": "attachment", "any": "/a/8.doc"}]}],
            {"type": "file", "url": "https://h/a/9.png"},
        ],
    }
    frame = lines_frame(spark, [{"type": "event_msg", "payload": payload}, "broken images"])
    found = sorted(r.original_path for r in attachments.attachment_paths(frame).collect())
    assert found == sorted(
        ["/a/1.PNG", "/a/2.jpg", "/a/3.pdf", "/a/b c+d.bin", "/a/4.md", "/a/5.xyz", "/a/6.csv", "/a/7.zip", "/a/8.doc"]
    )
