"""Parts of the operators on their own."""

import io
import itertools
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatstrata.llm import packing, simhash, suffix_dedup, warc_zip
from chatstrata.llm.components import components
from chatstrata.llm.token_ids import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


SNIPPETS = [*"aAzZ09 '\t\n.,!_<|>éÉß日ſİΣ²½", "\u0301", "\u00a0", "\u2003", "'s", "'LL", "<|endoftext|>", "the "]
ODD = st.lists(st.sampled_from(SNIPPETS), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(ODD, max_size=4))
def test_ids_by_piece_are_those_of_the_library(encoder, texts):
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == expected


def test_the_cache_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr("chatstrata.llm.token_ids.CACHED_PIECES", 3)
    small = Encoder(tokenizer_path())
    texts = ["one two", "three four five", "six", "one six two"]
    expected = [e.ids for e in small.tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = [list(small.encode([text]))[0].tolist() for text in texts]
    assert found == expected and len(small.numbers) <= 3


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 100])
def test_members_by_central_directory(monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    sink = io.BytesIO(b"")
    writer = warc_zip.PackageWriter(sink)
    for part in (b"a" * 90, b"b" * 150):
        writer.add(part)
    writer.close()
    data = sink.getvalue()
    assert (limit == 100) == (warc_zip.END64_LOCATOR_SIGNATURE in data)
    for tail in (b"", b"0"):
        package = warc_zip.Package(io.BytesIO(data), len(data))
        assert package.read(warc_zip.DATA) == b"a" * 90 + b"b" * 150
        assert package.read(warc_zip.INDEX) == b"0 90\n90 150\n"
    with pytest.raises(ValueError):
        warc_zip.Package(io.BytesIO(b"no archive"), 10)


def test_nnls_against_all_active_sets():
    rng = np.random.default_rng(3)
    for _ in range(20):
        columns, target = rng.random((5, 4)), rng.normal(size=5)
        best = np.linalg.norm(target)
        for size in range(1, 5):
            for chosen in itertools.combinations(range(4), size):
                x = np.linalg.lstsq(columns[:, chosen], target, rcond=None)[0]
                if (x >= 0).all():
                    best = min(best, np.linalg.norm(columns[:, chosen] @ x - target))
        x = packing.nnls(columns, target)
        assert (x >= 0).all() and np.linalg.norm(columns @ x - target) <= best + 1e-6


@settings(max_examples=30, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plans_place_every_piece_once(counts):
    plan = packing.plan_packing(counts, size=64, bins=16)
    used: dict[int, list] = {}
    placed = {length: [] for length in counts}
    for length, rank, count, sequence, offset in plan.slots:
        placed[length] += range(rank, rank + count)
        for i in range(count):
            used.setdefault(sequence + i, []).append((offset, length))
    assert all(sorted(ranks) == list(range(counts[length])) for length, ranks in placed.items())
    for places in used.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 64
    assert len(used) == plan.sequences


def test_groups_of_references_miss_no_pair():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    for radius, count in ((4, 10), (4, 10**5), (4, 10**8), (4, 10**10)):
        groups, agree = simhash.group_plan(count)
        for value in values[:50]:
            bits = rng.choice(64, radius, replace=False)
            other = value ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
            keys = simhash.pivot_keys(np.array([[value], [other]], np.uint64), groups, agree)
            assert (keys[0] == keys[1]).any()


def test_a_large_group_of_near_copies_is_dealt_in_chunks(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 63))
    flips = [0, *(1 << int(b) for b in range(64)), *((1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2)))]
    values = sorted({base ^ flip for flip in flips} | {int(v) for v in rng.integers(0, 1 << 63, 200)})
    rows = [(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "id long, print binary")
    found = components(simhash.links(prints, lambda words: simhash.pivot_keys(words, 5, 1), 4, chunk=40))
    roots = {r["node"]: r["root"] for r in found.collect()}
    near = [i for i, v in enumerate(values) if bin(v ^ base).count("1") <= 2]
    assert {roots[i] for i in near} == {min(near)}
    assert all(i in near for i in roots)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_the_index_does_not_depend_on_its_levels():
    rng = np.random.default_rng(8)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    records = np.zeros(600, suffix_dedup.RECORD)
    starts = rng.integers(0, 300, 600)
    records["bytes"] = np.lib.stride_tricks.sliding_window_view(text, suffix_dedup.CONTEXT)[starts]
    records["first"], records["last"] = rng.integers(0, 16, 600), rng.integers(16, 31, 600)
    records["doc"], records["place"] = rng.integers(0, 50, 600), np.arange(600)
    results = []
    for size in (10, 100, 10_000):
        index = suffix_dedup.LogarithmicIndex(size)
        for run in np.array_split(records, 23):
            index.add(run)
        found, gone = index.finish()
        results.append(dict(zip(found["place"].tolist(), gone.tolist())))
    assert results[0] == results[1] == results[2] and results[0]
    least = {}
    for r in records:
        for bit in range(r["first"], r["last"] + 1):
            window = r["bytes"][bit : bit + suffix_dedup.MATCH].tobytes()
            least.setdefault((bit, window), []).append(r["doc"])
    for r in records:
        expected = sum(
            1 << bit
            for bit in range(r["first"], r["last"] + 1)
            if min(least[(bit, r["bytes"][bit : bit + suffix_dedup.MATCH].tobytes())]) < r["doc"]
        )
        assert results[0].get(int(r["place"]), 0) == expected


def test_a_scan_sorts_only_what_repeats(monkeypatch):
    """Records without a repeat are sorted once from each side, not once for each window; marked windows are not sorted again."""
    rng = np.random.default_rng(9)
    count = 2000
    records = np.zeros(count, suffix_dedup.RECORD)
    records["bytes"] = rng.integers(0, 256, (count, suffix_dedup.CONTEXT))
    records["last"] = suffix_dedup.LEFT
    records["doc"] = records["place"] = np.arange(count)
    work = [0]
    argsort, lexsort = np.argsort, np.lexsort

    def counted_argsort(values, *args, **more):
        work[0] += len(values)
        return argsort(values, *args, **more)

    def counted_lexsort(keys, *args, **more):
        work[0] += sum(map(len, keys))
        return lexsort(keys, *args, **more)

    monkeypatch.setattr(np, "argsort", counted_argsort)
    monkeypatch.setattr(np, "lexsort", counted_lexsort)
    gone = np.zeros(count, np.uint32)
    suffix_dedup.scan(records, gone)
    assert not gone.any() and 0 < work[0] <= 4 * count

    records["bytes"] = records["bytes"][0]
    suffix_dedup.scan(records, gone)
    first, work[0] = work[0], 0
    assert gone[0] == 0 and (gone[1:] == (1 << suffix_dedup.WINDOWS) - 1).all()
    again = gone.copy()
    suffix_dedup.scan(records, again)
    assert (again == gone).all() and work[0] < first - 25 * count


def test_near_copies_are_linked_by_the_sets_themselves(spark):
    """Every pair of a similarity of 0.8 or more is linked and no other, from short texts to long ones and in a large group."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(150):
        words = [f"w{v}" for v in rng.integers(0, 10**6, rng.choice([8, 10, 14, 40, 200, 600]))]
        for copy in range(int(rng.integers(2, 4))):
            own = words[: len(words) - copy] if len(words) < 20 else list(words)
            if len(words) >= 20:
                for at in rng.integers(0, len(words), int(rng.integers(0, len(words) // 25 + 1))):
                    own[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(own))
    base = [f"h{v}" for v in range(300)]
    for _ in range(120):
        own = list(base)
        for at in rng.integers(0, 300, int(rng.integers(0, 9))):
            own[at] = f"y{rng.integers(10**6)}"
        texts.append(" ".join(own))
    sets = [set(simhash.shingle_hashes(text, 5).tolist()) for text in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert found == {i: find(i) for i in range(len(texts))}
    assert 150 < len(set(found.values())) < len(texts) - 150


def test_near_copies_at_the_bound(spark):
    """Pairs at a similarity of exactly 0.8 are all linked, pairs just below it never."""
    texts = []
    for pair in range(300):
        # 40 or 39 shingles in common and 5 more in each
        words = [f"p{pair}w{i}" for i in range(44 - pair % 2)]
        texts += [" ".join(words + [f"p{pair}{side}{i}" for i in range(5)]) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert found == {i: i - i % 2 if i // 2 % 2 == 0 else i for i in range(len(texts))}
