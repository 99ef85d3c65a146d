"""Catalog, state, line and snapshot operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatstrata.functions import naming, paths, text
from chatstrata.operators import attachments, catalog, lines, mentions, snapshots, state
from tests.conftest import sid

FILES = "root_id bigint, id string, rel_path string, size_bytes bigint"


def log(number, directory="sessions", size=10, root=1):
    return (root, sid(number), f"{directory}/rollout-{sid(number)}.jsonl", size)


def threads(spark, rows):
    """Rows of (number, path, archived)."""
    full = [(1, sid(n), f"t{n}", path, "", "p", None, "cli", 1, 2, archived) for n, path, archived in rows]
    return spark.createDataFrame(
        full,
        "root_id bigint, id string, title string, rollout_path string, cwd string, model_provider string, "
        "model string, source string, created_at bigint, updated_at bigint, archived int",
    )


def ids_frame(spark, numbers, root=1):
    return spark.createDataFrame([(root, sid(n)) for n in numbers], "root_id bigint, id string")


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/old/root/sessions/a.jsonl", "sessions/a.jsonl"),
        ("/new/root/sessions/a.jsonl", "sessions/a.jsonl"),
        ("/old/root", None),
        ("/old/rootless/a.jsonl", None),
        ("/old/root/../secret", None),
        ("/old/root/..hidden", None),
        ("/x/.CODEX/sessions/a.jsonl", "sessions/a.jsonl"),
        ("C:\\u\\.codex\\sessions\\a.jsonl", "sessions/a.jsonl"),
        ("/x/.codex/a/.codex/b", "a/.codex/b"),
        ("/x/.codex/../b", None),
        ("/x/.codex/", None),
        ("/elsewhere/a.jsonl", None),
        ("", None),
        (None, None),
    ],
)
def test_reroot_path(spark, path, expected):
    frame = spark.createDataFrame([(path,)], "p string")
    found = paths.reroot_path(F.col("p"), F.lit("/old/root/"), F.lit("/new//root"))
    assert frame.select(found.alias("x")).collect()[0].x == expected


@pytest.mark.parametrize(
    "path, expected",
    [("/a/b", "/a/b"), ("/a//b/", "/a/b"), ("/a/./b/../c", "/a/c"), ("/../a", "/a"), ("../a/../b", "../b"), ("a/..", "")],
)
def test_normalize_path(spark, path, expected):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(paths.normalize_path(F.col("p")).alias("x")).collect()[0].x == expected


def test_ids_in_names(spark):
    overlapping = "11111111-1111-4111-8111-111122222222-2222-4222-8222-222222222222"
    names = [f"dir-{sid(9)}/rollout-{sid(1).upper()}-{sid(2)}.jsonl", "none.jsonl", f"x{overlapping}x"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    rows = frame.select(paths.session_id_from_path(F.col("p")).alias("i"), paths.mentioned_ids(F.col("p")).alias("m")).collect()
    assert [r.i for r in rows] == [sid(1), "", "11111111-1111-4111-8111-111122222222"]
    uuids = ["11111111-1111-4111-8111-111122222222", "22222222-2222-4222-8222-222222222222"]
    assert rows[2].m == [f"x{overlapping}x", *uuids]


def test_ids_of_any_form(spark):
    names = spark.createDataFrame([("a/rollout-2024-sess-7.jsonl",), ("sess-77.jsonl",)], "p string")
    assert ["sess-7" in r.x for r in names.select(paths.named_ids(F.col("p")).alias("x")).collect()] == [True, False]
    texts = ["note sess-7 seen", '{"id":"sess-7"}', '{"id":"sess-8","x":"sess-7"}', "sess-77", '{"thread_id":"a.b"}']
    rows = [(1, "history.jsonl", n, text) for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "root_id bigint, rel_path string, line_no bigint, line string")
    ids = spark.createDataFrame([(1, "sess-7"), (1, "a.b")], "root_id bigint, id string")
    for match, left in (("mention", []), ("key", [2])):
        found = lines.delete_lines(frame, ids, match)
        assert sorted(r.line_no for r in found.collect()) == left
        assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1


def test_times(spark):
    values = ["2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05+01:00", "soon", "", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r.x for r in frame.select(F.unix_millis(text.parse_ts(F.col("v"))).alias("x")).collect()]
    assert found == [1704164645678, 1704161045000, None, None, None]
    numbers = spark.createDataFrame([("1700000000",), ("1.5",), ("x",), ("1e300",), ("NaN",)], "v string")
    found = [r.x for r in numbers.select(F.unix_millis(text.epoch_ts(F.col("v"))).alias("x")).collect()]
    assert found == [1700000000000, 1500, None, None, None]
    default = numbers.select(F.unix_millis(text.epoch_ts(F.col("v"), epoch_default=True)).alias("x")).collect()
    assert default[2].x == 0


def test_reason_from_id(spark):
    rows = [("20240101-0000000", None), ("20240101-000000-m", None), ("20240101-000000-manual", None),
            ("20240101-000000-manual-2", ""), ("x", "manual"), ("20240101-000000-manual", "other")]
    frame = spark.createDataFrame(rows, "id string, reason string").withColumn("kind", F.lit(None).cast("string"))
    found = frame.select(
        naming.effective_reason(F.col("reason"), F.col("id")).alias("r"),
        naming.effective_kind(F.col("kind"), F.col("reason"), F.col("id")).alias("k"),
    ).collect()
    assert [(r.r, r.k) for r in found] == [
        ("unknown", "system"), ("m", "system"), ("manual", "manual"), ("manual-2", "system"), ("manual", "manual"), ("other", "system"),
    ]


def test_attachment_extensions(spark):
    values = ["/a/b.PNG", "/a/b.exe", "b.png", "/a/b.yaml", "/a/b.png\n", "/a/bpng", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r.x for r in frame.select(paths.is_local_attachment(F.col("v")).alias("x")).collect()]
    assert found == [True, False, False, True, False, False, None]


def test_resolution_order(spark):
    files = spark.createDataFrame(
        [log(1), log(1, "archived_sessions", 11), log(2, "archived_sessions", 12), log(3, "archived_sessions/b", 13),
         log(3, "archived_sessions/a", 14), (1, "", "other.txt", 15)],
        FILES,
    )
    rows = [
        (1, f"/r/archived_sessions/rollout-{sid(1)}.jsonl", 0),
        (2, "/gone/x.jsonl", 0),
        (3, None, 0),
        (4, "/r/other.txt", 0),
        (5, "/r/nothing.jsonl", 0),
        (6, f"/data/sessions/rollout-{sid(1)}.jsonl", 0),
    ]
    found = catalog.resolve_rollout_files(threads(spark, rows), files, F.lit("/r"), data_root=F.lit("/data")).orderBy("id")
    assert [r.size_bytes for r in found.collect()] == [11, 12, 14, 15, 0, 10]


def test_search_modes(spark):
    rows = catalog.catalog_from_threads(
        catalog.resolve_rollout_files(threads(spark, [(1, "/a", 0), (2, "/b", 1)]), spark.createDataFrame([], FILES))
    )
    assert catalog.search_sessions(rows, "  ").count() == 2
    assert [r.id for r in catalog.search_sessions(rows, "T1").collect()] == [sid(1)]
    assert catalog.search_sessions(rows, "p unknown").count() == 0
    assert catalog.search_sessions(rows, "p unknown", "joined").count() == 2


def edges(spark):
    rows = [(1, sid(1), sid(9)), (1, sid(9), sid(1)), (1, sid(8), sid(9)), (1, None, sid(9)), (1, None, None), (2, None, sid(1))]
    return spark.createDataFrame(rows, "root_id bigint, parent_thread_id string, child_thread_id string")


def pairs(frame):
    return sorted(((r[0], r[1] and int(r[1][-3:]), r[2] and int(r[2][-3:])) for r in frame.collect()), key=repr)


def test_null_keys_and_empty_roots(spark):
    tables = {"thread_spawn_edges": edges(spark)}
    ids = ids_frame(spark, [1])
    kept = state.prune_state(tables, ids)["thread_spawn_edges"]
    # Root 2 has no session left, so even its rows without a key go.
    assert pairs(kept) == sorted([(1, 1, 9), (1, 9, 1), (1, None, 9), (1, None, None)], key=repr)
    assert pairs(state.prune_state({"thread_spawn_edges": kept}, ids)["thread_spawn_edges"]) == pairs(kept)
    assert pairs(state.select_state(tables, ids)["thread_spawn_edges"]) == [(1, 1, 9), (1, 9, 1)]
    assert pairs(state.delete_state(tables, ids)["thread_spawn_edges"]) == sorted(
        [(1, 8, 9), (1, None, 9), (1, None, None), (2, None, 1)], key=repr
    )
    none = ids_frame(spark, [])
    assert state.prune_state(tables, none)["thread_spawn_edges"].count() == 0
    assert state.select_state(tables, none)["thread_spawn_edges"].count() == 0
    assert state.select_state(tables, None)["thread_spawn_edges"].count() == 6


def test_upsert_keeps_whole_rows(spark):
    goals = "root_id bigint, thread_id string, goal string"
    dst = spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], goals)
    src = spark.createDataFrame([(1, "a", "y"), (1, "a", "z"), (1, None, "n"), (1, None, "n2"), (1, "b", "x")], goals)
    # Without a known key no goal of a thread is lost; with one it is replaced.
    merged = state.upsert_state({"thread_goals": dst}, {"thread_goals": src, "stage1_outputs": src})
    assert sorted(map(tuple, merged["thread_goals"].collect()), key=repr) == sorted(
        [(1, "a", "x"), (1, "a", "y"), (1, "a", "z"), (1, "b", "x"), (1, None, "n"), (1, None, "n2")], key=repr
    )
    assert "stage1_outputs" not in merged
    merged = state.upsert_state({"thread_goals": dst}, {"thread_goals": src}, {"thread_goals": ["thread_id"]})
    assert sorted(map(tuple, merged["thread_goals"].collect()), key=repr) == sorted(
        [(1, "a", "z"), (1, "b", "x"), (1, None, "n"), (1, None, "n2")], key=repr
    )


def test_seeding_a_missing_database(spark):
    src = {"threads": threads(spark, [(1, "/a", 0), (2, "/b", 0)]), "device_key_bindings": edges(spark)}
    dst_states = spark.createDataFrame([(2,)], "root_id bigint")
    merged = state.merge_state({}, dst_states, src, ids_frame(spark, [1]))
    assert set(merged) == {"threads"}
    assert [r.id for r in merged["threads"].collect()] == [sid(1)]


LINES = "root_id bigint, rel_path string, line_no bigint, line string"


def line_rows(spark, texts, name="history.jsonl"):
    return spark.createDataFrame([(1, name, n, t) for n, t in enumerate(texts)], LINES)


def in_order(frame):
    return [r.line for r in frame.orderBy("line_no").collect()]


def test_membership_of_lines(spark):
    a, b = sid(1), sid(2)
    texts = [
        f'{{"session_id":"{a}"}}', f'{{"text":"about {a}"}}', f"{{broken {a}", f'{{"id":"{b}","thread_id":"{a}"}}', "  ", f'"{a}"',
        f'{{"session_id":"\\u0030{a[1:]}"}}', f'[{{"session_id":"{a}"}}]', "nothing",
    ]
    frame, ids = line_rows(spark, texts), ids_frame(spark, [1])
    by_mention = in_order(lines.filter_lines(frame, ids))
    assert by_mention == [texts[n] for n in (0, 1, 2, 3, 5, 6, 7)]
    by_key = in_order(lines.filter_lines(frame, ids, "key"))
    assert by_key == [texts[n] for n in (0, 2, 3, 5, 6, 7)]
    for match, kept in (("mention", by_mention), ("key", by_key)):
        left = in_order(lines.delete_lines(frame, ids, match))
        assert sorted(left + kept) == sorted(t for t in texts if t.strip())
    assert in_order(lines.filter_lines(frame, ids_frame(spark, []))) == []


def test_repeats_by_key(spark):
    texts = ['{"id":1,"t":"a"}', '{"id":"1","t":"b"}', "k:id:1", "raw", "raw", '{"id":null}', '{"id":null}', '{"t":1}']
    frame = line_rows(spark, texts, "session_index.jsonl")
    assert in_order(lines.dedupe_ordered(frame, "id")) == [texts[n] for n in (0, 2, 3, 5, 7)]
    assert in_order(lines.dedupe_ordered(frame)) == [texts[n] for n in (0, 1, 2, 3, 5, 7)]
    assert in_order(lines.dedupe_ordered(frame, lines.LINE_FILE_KEYS)) == in_order(lines.dedupe_ordered(frame, "id"))


def test_merging_lines(spark):
    current = line_rows(spark, ["c", "a", "", "a", "b"])
    snapshot = line_rows(spark, ["d", "a", "e", "d"])
    merged = lines.merge_lines(current, snapshot)
    assert in_order(merged) == ["c", "a", "b", "d", "e"]
    assert in_order(lines.merge_lines(merged, snapshot)) == in_order(merged)
    empty = current.filter(F.lit(False))
    assert in_order(lines.merge_lines(empty, snapshot)) == ["d", "a", "e"]
    assert in_order(lines.merge_lines(current, empty)) == ["c", "a", "b"]


def manifest(spark, kinds):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, f"s{n:03d}", start + dt.timedelta(minutes=n), reason, kind) for n, (reason, kind) in enumerate(kinds)]
    return spark.createDataFrame(rows, "root_id bigint, id string, created_at timestamp, reason string, kind string")


def brute_retention(rows, max_system, max_auto):
    kept = sorted(rows, key=lambda r: r.created_at, reverse=True)

    def drop(matches, limit):
        nonlocal kept
        if limit >= 0:
            doomed = [r for r in kept if matches(r)][limit:]
            kept = [r for r in kept if r not in doomed]

    def kind(r):
        return r.kind or ("manual" if r.reason == "manual" else "system")

    drop(lambda r: r.reason == "auto-protect", max_auto)
    drop(lambda r: kind(r) != "manual", max_system)
    return sorted(r.id for r in kept)


@pytest.mark.parametrize("limits", [(24, 3), (0, 0), (-1, -1), (5, -1), (-1, 2), (2, 3)])
def test_retention(spark, limits):
    kinds = [("auto-protect", None)] * 4 + [("pre-restore", None)] * 26 + [("manual", None)] * 3
    kinds += [("auto-protect", "manual")] * 2 + [("x", "manual"), ("manual", "system")] + [("auto-protect", None)] * 2
    frame = manifest(spark, kinds)
    judged = snapshots.apply_retention(frame, *limits)
    kept = sorted(r.id for r in judged.filter("keep").collect())
    assert kept == brute_retention(frame.collect(), *limits)
    assert judged.count() == frame.count()
    again = snapshots.apply_retention(judged.filter("keep").drop("keep"), *limits)
    assert again.filter("not keep").count() == 0


def test_snapshot_ids(spark):
    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    requests = spark.createDataFrame([(n, 1, at, "manual") for n in range(4)], "request int, root_id bigint, created_at timestamp, reason string")
    existing = spark.createDataFrame(
        [(1, "20240506-070809-manual"), (1, "20240506-070809-manual-3"), (2, "20240506-070809-manual-2")], "root_id bigint, id string"
    )
    found = snapshots.assign_snapshot_ids(requests, existing).orderBy("request").collect()
    assert [r.id.removeprefix("20240506-070809-manual") for r in found] == ["-2", "-4", "-5", "-6"]


def test_decisions(spark):
    current = spark.createDataFrame([(1, 2), (2, 0), (3, 1), (4, 5), (5, 3)], "root_id bigint, session_count bigint")
    candidates = spark.createDataFrame([(3, "s", 4), (4, "s", 4), (5, "s", 3), (6, "s", 1)], "root_id bigint, id string, recoverable bigint")
    found = {r.root_id: r.decision for r in snapshots.recovery_decision(current, candidates).collect()}
    assert found == {1: "protect", 2: "nothing", 3: "restore", 4: "protect", 5: "ok", 6: "restore"}
    only = snapshots.recovery_decision(current, candidates, restore_only=True)
    assert sorted(r.root_id for r in only.collect()) == [3, 6]


def test_shell_snapshots_are_flattened(spark):
    rows = [(1, "", f"shell_snapshots/{d}/{sid(1)}.sh", n) for n, d in enumerate("ab")] + [(1, "", f"shell_snapshots/{sid(2)}.sh", 9), log(1)]
    found = snapshots.select_snapshot_files(spark.createDataFrame(rows, FILES), ids_frame(spark, [1]), "shell").collect()
    assert [(r.rel_path, r.size_bytes) for r in found] == [(f"shell_snapshots/{sid(1)}.sh", 1)]


def test_skipped_report(spark):
    files = spark.createDataFrame([log(n) for n in range(9)] + [log(20, root=2)], FILES)
    copied = files.filter(F.col("id") == sid(0))
    assert snapshots.skipped_files(files, copied).count() == 9
    found = snapshots.skipped_files(files, copied, cap=6).orderBy("root_id", "nth").collect()
    assert len(found) == 8 and found[6].message.startswith("还有更多") and found[6].message.endswith("(2)")
    assert found[7].root_id == 2


def test_attachments_in_place_are_not_restored(spark):
    rows = [(1, sid(n), f"/a/{n}.png", f"external_attachments/{n}", 1) for n in range(4)]
    manifest_rows = spark.createDataFrame(rows, "root_id bigint, session_id string, original_path string, stored_path string, size_bytes bigint")
    stored = manifest_rows.filter("session_id <> '" + sid(3) + "'").select("root_id", "stored_path")
    existing = spark.createDataFrame([(1, "/a/0.png")], "root_id bigint, path string")
    assert attachments.restore_attachments(manifest_rows, stored, existing).count() == 2
    found = attachments.restore_attachments(manifest_rows, stored, existing, ids_frame(spark, [1])).collect()
    assert [r.original_path for r in found] == ["/a/1.png"]


def test_ids_at_any_place(spark):
    texts = [
        "runsess-7end", "a b c", "aé ü7b", "sess 7", "日本語の文", "", None, "x" * 5000 + "sess-7" + "y" * 5000, "SESS-7", "ab", '{"a":"sess-7',
    ]
    rows = [(root, "history.jsonl", n, text) for root in (1, 2) for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "root_id bigint, rel_path string, line_no bigint, text string")
    ids = ["sess-7", "b c", "é ü", "本語", "", None, "ab", "none of them", "a", "sess-77"]
    wanted = spark.createDataFrame([(1, i) for i in ids] + [(2, "x" * 40)], "root_id bigint, id string")
    found = {(r.root_id, r.line_no) for r in mentions.containing(frame, wanted, ["root_id", "rel_path", "line_no"]).collect()}
    expected = {(1, n) for n, text in enumerate(texts) if text and any(i and i in text for i in ids)}
    assert found == expected | {(2, 7)}
    assert mentions.containing(frame, wanted.limit(0), ["root_id", "rel_path", "line_no"]).count() == 0
    plan = mentions.containing(frame, wanted, ["root_id", "rel_path", "line_no"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_mentions_need_no_nested_loop(spark):
    frame = spark.createDataFrame([(1, "h", n, f"see id-{n} here") for n in range(50)], "root_id bigint, rel_path string, line_no bigint, text string")
    wanted = spark.createDataFrame([(1, "id-4"), (1, "d-1 h")], "root_id bigint, id string")
    found = mentions.containing(frame, wanted, ["root_id", "rel_path", "line_no"])
    assert {r.line_no for r in found.collect()} == {4, 1, *range(40, 50)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ids_of_one_shape_take_one_pass_over_the_texts(spark):
    other = sid(7)[:-1] + "x"
    texts = [f"rollout-{sid(1)}.jsonl", f"{sid(2)}{sid(3)}", f"a{sid(4)[1:]}", f"9{sid(5)}-{sid(6)}_", f"see {sid(7)}", other, None, sid(8) + "\n"]
    rows = [(root, "h", n, text) for root in (1, 2) for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "root_id bigint, rel_path string, line_no bigint, text string")
    wanted = spark.createDataFrame([(1, sid(n)) for n in (1, 3, 4, 6, 7, 8)], "root_id bigint, id string")
    found = mentions.containing(frame, wanted, ["root_id", "rel_path", "line_no"])
    assert sorted((r.root_id, r.line_no) for r in found.collect()) == [(1, n) for n in (0, 1, 3, 4, 7)]
    # the driver keeps the whole plan, and a job has many of these
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 1


def test_ids_of_many_shapes(spark):
    ids = ["-" * n + "ab" for n in range(2, 40)] + ["line\n"]
    texts = ["--ab", "x---abc", "-ab", "a line\nb", "line", "y" + "-" * 50 + "ab"]
    frame = spark.createDataFrame([(1, "h", n, text) for n, text in enumerate(texts)], "root_id bigint, rel_path string, line_no bigint, text string")
    wanted = spark.createDataFrame([(1, i) for i in ids], "root_id bigint, id string")
    for some in (wanted, wanted.filter("length(id) < 10")):
        found = mentions.containing(frame, some, ["root_id", "rel_path", "line_no"]).collect()
        assert sorted(r.line_no for r in found) == [0, 1, 3, 5]
