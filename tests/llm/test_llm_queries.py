"""The queries over whole tables: against SQL, brute force, exact round trips or held-out rows."""

import base64
import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from chatstrata.llm import simhash
from chatstrata.llm.common import table
from chatstrata.llm.queries import ORACLES, QUERIES
from chatstrata.session import staged
from tests.llm.test_edge_cases import brute_components, brute_repeats, by_repr, lowered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"


def rows(spark, name, *columns, folder=SF):
    return [tuple(r) for r in table(spark, folder, name).select(*columns).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return dict(rows(spark, "documents", "doc_id", "text"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from chatstrata.llm.token_ids import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def test_thirteen_operators_have_a_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_exact_dedup_against_sql(spark):
    from checks.compare import difference

    found = QUERIES["op10_exact_dedup"](spark, SF)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    result = duck.execute(ORACLES["op10_exact_dedup"])
    columns = [item[0] for item in result.description]
    assert difference([tuple(r) for r in found.collect()], found.columns, result.fetchall(), columns) is None


def test_repeated_strings(spark, texts):
    found = QUERIES["op1_suffix_dedup"](spark, SF).collect()
    expected = {key: (size, gone, hashlib.sha256(kept).hexdigest()) for key, size, gone, kept in brute_repeats(list(texts.items()))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in found} == expected
    assert any(r["n_spans"] > 1 for r in found)


def accuracy(pairs):
    pairs = list(pairs)
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality_of_held_out_documents(spark):
    labels = dict(rows(spark, "labels", "doc_id", "quality", folder=LARGER))
    found = QUERIES["op2_quality"](spark, LARGER).collect()
    assert len(found) == table(spark, LARGER, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert accuracy(judged) > 0.95


def test_language_of_held_out_documents(spark):
    languages = dict(rows(spark, "documents", "doc_id", "lang", folder=LARGER))
    found = QUERIES["op3_language_id"](spark, LARGER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert accuracy((r["lang_pred"], languages[r["doc_id"]]) for r in found if r["held_out"]) > 0.98
    assert np.mean([r["accepted"] for r in found]) > 0.9


def test_decontamination_finds_whole_items(spark):
    texts = dict(rows(spark, "documents", "doc_id", "text", folder=LARGER))
    items = rows(spark, "benchmark", "item_id", "text", folder=LARGER)

    def words(text):
        return " ".join(re.findall(r"[^\W_]+", text.lower()))

    normal = {key: f" {words(text)} " for key, text in texts.items()}
    expected = {(key, item) for item, text in items for key, body in normal.items() if f" {words(text)} " in body}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, LARGER).collect()}
    assert expected and found == expected


def test_packing_round_trip(spark, texts, tokenizer):
    found = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    ids = {key: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for key, t in texts.items()}
    by_sequence = collections.defaultdict(list)
    seen = collections.Counter()
    for r in found:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["start"] == 2048 * r["piece"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    assert seen == {key: len(own) for key, own in ids.items()}
    for places in by_sequence.values():
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1].tolist()]
    assert max(sum(n for _, n in places) for places in by_sequence.values()) <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(by_sequence) <= 1.03 * least + 1


def test_simhash_against_all_pairs(spark, texts):
    import xxhash

    def fingerprint(text):
        words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
        runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    keys = list(texts)
    values = [fingerprint(texts[key]) for key in keys]
    least = {}
    roots = brute_components(values, 4)
    for key, root in zip(keys, roots):
        least[root] = min(key, least.get(root, key))
    expected = {key: (f"{v:016x}", least[root]) for key, v, root in zip(keys, values, roots)}
    found = QUERIES["op6_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == expected


def test_token_files_round_trip(spark, texts, tokenizer):
    found = {r["doc_id"]: r for r in QUERIES["op7_token_files"](spark, SF).collect()}
    start = 0
    for key in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[key]["start"], found[key]["n_tokens"], found[key]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(texts)


def test_warc_round_trip(spark):
    pages = dict(rows(spark, "pages", "page_id", "html", folder=LARGER))
    first = {}
    for key, text in pages.items():
        first[text or ""] = max(key, first.get(text or "", key))
    expected = []
    for key, text in pages.items():
        body = (text or "").encode()
        response = first[text or ""] == key
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected.append((key, len(body), digest, "response" if response else "revisit", None if response else first[text or ""]))
    assert by_repr(tuple(r) for r in QUERIES["op8_warc_zip"](spark, LARGER).collect()) == by_repr(expected)


def test_shards(spark, texts):
    found = QUERIES["op9_kd_sharding"](spark, SF).collect()
    assert {r["doc_id"] for r in found} == set(texts) and {r["shard"] for r in found} <= set(range(24))
    slots, sizes, groups = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in found:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert all(len(shards) == 1 for shards in groups.values())
    largest = max(len(t.encode()) for t in texts.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_pipeline_stage_by_stage(spark):
    """Each stage on its own input, against a plain computation of what it must drop and keep."""
    docs = table(spark, LARGER, "documents")
    columns = docs.columns
    results = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, LARGER), "stage")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
            results.append({r["doc_id"]: r["text"] for r in docs.collect()})
    before, good, unique, distinct, clean = results
    labels = dict(rows(spark, "labels", "doc_id", "quality", folder=LARGER))
    assert accuracy((key in good, labels[key] == 1) for key in before if key in labels) > 0.97
    last = {}
    for key, text in good.items():
        last[lowered(text)] = max(key, last.get(lowered(text), key))
    assert set(unique) == set(last.values())
    runs = {key: set(simhash.shingle_hashes(text, 5).tolist()) for key, text in unique.items()}
    near = [(a, b) for a in runs for b in runs if a < b and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) - 1e-9]
    root = {key: key for key in runs}

    def least(key):
        while root[key] != key:
            key = root[key]
        return key

    for a, b in near:
        low, high = sorted((least(a), least(b)))
        root[high] = low
    # of each group of linked documents the smallest id stays, and every other document
    assert near and set(distinct) == {key for key in runs if least(key) == key}
    items = [text for _, text in rows(spark, "benchmark", "item_id", "text", folder=LARGER)]
    leaked = {key for key, text in distinct.items() if any(item in text for item in items)}
    assert leaked and not leaked & set(clean) and len(set(distinct) - set(clean) - leaked) <= 2
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(clean)
    filled = collections.Counter()
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


