"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib

import numpy as np
import pytest

from chatstrata.llm import (
    block_naming,
    decontaminate,
    kd_sharding,
    language_id,
    packing,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    warc_zip,
)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_exact_groups(hard, empty):
    expected = collections.defaultdict(list)
    for key, text in pairs(hard):
        expected[lowered(text)].append(key)
    found = block_naming.exact_groups(hard, block_bytes=64).collect()
    assert len(found) == hard.count()
    by_digest = {hashlib.sha256(text.encode()).hexdigest(): keys for text, keys in expected.items()}
    for row in found:
        keys = by_digest[row["digest"]]
        assert row["group_size"] == len(keys)
        assert row["keep_id"] == max((k for k in keys if k is not None), default=None)
    kept = collections.Counter(r["digest"] for r in found if r["kept"])
    assert set(kept) == set(by_digest) and set(kept.values()) == {1}
    assert block_naming.exact_groups(empty).count() == 0


def test_dropping_exact_copies_leaves_one_row_of_each(hard, empty):
    kept = block_naming.drop_copies(hard)
    assert kept.columns == hard.columns
    assert sorted(lowered(t) for _, t in pairs(kept)) == sorted({lowered(t) for _, t in pairs(hard)})
    assert block_naming.drop_copies(empty).count() == 0


def brute_repeats(rows):
    """(doc_id, n_bytes, n_removed, kept) by a dictionary of all 50-byte strings."""
    least = {}
    order = [(-(1 << 63) if key is None else key, key, (text or "").encode()) for key, text in rows]
    for rank, _, body in order:
        for i in range(len(body) - 49):
            window = body[i : i + 50]
            least[window] = min(rank, least.get(window, rank))
    result = []
    for rank, key, body in order:
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - 49):
            if least[body[i : i + 50]] < rank:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(body, gone) if not g)
        result.append((key, len(body), int(gone.sum()), kept))
    return result


def by_repr(rows):
    return sorted(rows, key=repr)


def test_repeats(hard, empty):
    found = suffix_dedup.remove_repeats(hard).collect()
    ours = [(r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found]
    assert by_repr(ours) == by_repr(brute_repeats(pairs(hard)))
    assert all(r["n_removed"] == sum(b - a for a, b in r["spans"]) for r in found)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_quality(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (11, 0, 0), (None, 1, 0), (2, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    classifier = quality.train(hard, labels)
    scored = quality.score(hard, classifier).collect()
    assert len(scored) == hard.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.accepted(hard, classifier).columns == hard.columns
    assert {r["score"] for r in quality.score(hard, quality.train(hard, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_language(hard, empty):
    from pyspark.sql import functions as F

    model = language_id.train(hard, F.lit(True))
    found = language_id.identify(hard, model).collect()
    assert len(found) == hard.count()
    for row in found:
        letters = any(c.isalpha() for c in row["text"] or "")
        assert row["lang_pred"] == ("en" if letters else "und") and 0 <= row["score"] <= 1
    nothing = language_id.train(empty, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(hard, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_decontamination(spark, hard, empty):
    items = [(0, PLAIN_ITEM), (1, None), (2, "the fox"), (3, ""), (4, "Never seen anywhere at all. Not even here in part."), (0, PLAIN_ITEM), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(hard, benchmark).collect()
    hit = [k for k, t in pairs(hard) if "quick brown fox" in lowered(t)]
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(map(repr, hit * 2))
    left = decontaminate.drop_contaminated(hard, benchmark)
    assert left.columns == hard.columns and left.count() == hard.count() - len(hit)
    assert decontaminate.drop_contaminated(hard, benchmark.limit(0)).count() == hard.count()
    assert decontaminate.contaminated(empty, benchmark).count() == 0


PLAIN_ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow again and again."


def test_packing(hard, empty):
    packed = packing.pack_documents(hard)
    rows = packed.pieces.join(packed.placement, "key").collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE
    assert len(by_sequence) == packed.sequences
    assert len({(r["key"]) for r in rows}) == len(rows)
    assert sum(r["piece"] == 0 for r in rows) == hard.count()
    whole = packed.packed().collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(r["ids"]) for r in rows)
    nothing = packing.pack_documents(empty)
    assert nothing.placement.count() == 0 and nothing.sequences == 0


def brute_components(values, radius):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_components(hard, empty):
    rows = simhash.near_components(hard).collect()
    values = [int(r["fingerprint"], 16) for r in rows]
    roots = brute_components(values, simhash.RADIUS)
    for r, root in zip(rows, roots):
        own = [o["doc_id"] for o, other in zip(rows, roots) if other == root and o["doc_id"] is not None]
        assert r["component_id"] == min(own, default=None)
    assert simhash.near_components(empty).count() == 0
    kept = simhash.drop_near_copies(hard)
    assert kept.columns == hard.columns
    assert {1, 4, 8} <= {r["doc_id"] for r in kept.collect()}
    assert not {2, 5, 6} & {r["doc_id"] for r in kept.collect()}
    assert simhash.drop_near_copies(empty).count() == 0


def test_token_files(spark, hard, empty):
    found = token_files.round_trip(spark, hard).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    expected = [(k, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in pairs(hard)]
    ours = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found]
    assert by_repr(ours) == by_repr(expected)
    ends = sorted((r["start"], r["start"] + len(r["ids"]) // 4) for r in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    assert token_files.round_trip(spark, empty).count() == 0


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    html = [(1, "u1", "<p>a page of some length</p>"), (2, None, "<p>a page of some length</p>"), (3, "u\r\n3", ""), (4, "u", None)]
    html += [(4, "u", None), (None, "u", "<p>a page of some length</p>"), (5, "ü", "é" * 70_000), (6, "w", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*h, "x") for h in html], "page_id long, url string, html string, revisit string").repartition(2)
    found = warc_zip.round_trip(spark, pages, least).collect()
    expected = []
    for key, _, text in html:
        body = (text or "").encode()
        same = [k for k, _, t in html if (t or "").encode() == body and k is not None]
        first = len(body) < least or key == max(same)
        expected.append((key, len(body), warc_zip.base32_sha1(body), "response" if first else "revisit", None if first else max(same)))
    ours = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert by_repr(ours) == by_repr(expected)
    assert warc_zip.round_trip(spark, pages.limit(0)).count() == 0


def test_sharding(spark, hard, empty, tmp_path):
    rows = kd_sharding.shard_documents(hard, shards=5).collect()
    assert len(rows) == hard.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and set(slots) <= set(range(5))
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(shards) == 1 for shards in by_text.values())
    assert kd_sharding.shard_documents(empty, shards=3).count() == 0
    assert {r["shard"] for r in kd_sharding.shard_documents(hard, target_bytes=1 << 40).collect()} == {0}
    kd_sharding.write_shards(hard, str(tmp_path / "shards"), 5)
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert again.count() == hard.count()
    assert {k: len(v) for k, v in slots.items()} == {r["shard"]: r["count"] for r in again.groupBy("shard").count().collect()}


def test_pipeline_hands_rows_to_python_in_small_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    import corpus_pipeline
    from chatstrata.session import BATCH_BYTES, BATCH_LIMIT

    runs, before = block_naming._runs, spark.conf.get(BATCH_LIMIT, None)

    def measured(batches):
        def seen():
            for batch in batches:
                assert batch.nbytes < BATCH_BYTES + 100_000, batch.nbytes
                yield batch

        yield from runs(seen())

    # 2,500 different texts of 4,000 bytes, in one partition below the 10,000 rows of a batch
    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 4000, "x").alias("text"))
    monkeypatch.setattr(block_naming, "_runs", measured)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")
    spark.conf.unset(BATCH_LIMIT)
    try:
        assert corpus_pipeline.exact_dedup(spark, docs, "").count() == 2500
        assert spark.conf.get(BATCH_LIMIT, None) == str(BATCH_BYTES)
        spark.conf.set(BATCH_LIMIT, "1000000")
        assert corpus_pipeline.exact_dedup(spark, docs, "").count() == 2500
        assert spark.conf.get(BATCH_LIMIT, None) == "1000000"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.unset(BATCH_LIMIT)
        if before:
            spark.conf.set(BATCH_LIMIT, before)


def test_workers_give_freed_memory_back(spark):
    from chatstrata.llm.common import give_back

    def held(batches):
        import re
        from pathlib import Path

        def size():
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10

        for batch in batches:
            blocks = [bytearray(50_000) for _ in range(4000)]
            last = blocks[-1]
            del blocks
            before = size()
            give_back()
            yield batch.from_pydict({"freed": [before - size()], "last": [len(last)]})

    assert spark.range(0, 1, 1, 1).mapInArrow(held, "freed long, last long").first()["freed"] > 100
