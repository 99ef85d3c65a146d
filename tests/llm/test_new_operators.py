"""Clustering, collocations and main text against brute force and on hard inputs."""

import collections
import hashlib
import html
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from chatstrata.llm import centroids, collocations, main_text, page_maker, simhash
from chatstrata.llm.html_nodes import parse
from chatstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- centroid clustering


def plain_clusters(rows, count, rounds):
    points = []
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    vectors = [(key, [math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v]) for key, v in rows]
    points = [[math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v] for _, v in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), number) for number, p in enumerate(points))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in vectors:
            own[nearest(v)[1]].append(v)
        points = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else p for n, p in enumerate(points)]
    return sorted((key or -1, nearest(v)[1], nearest(v)[0]) for key, v in vectors), points


@pytest.mark.parametrize("values", ["ties", "floats"])
def test_clusters_like_brute_force(spark, values):
    r = random.Random(5)
    draw = (lambda: float(r.randint(-1, 1))) if values == "ties" else (lambda: r.gauss(0, 0.3))
    rows = [(number // 2, [draw() for _ in range(8)]) for number in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = centroids.cluster_vectors(frame, count=7, rounds=3, dimensions=8)
    want, points = plain_clusters(rows, 7, 3)
    assert found.points == points
    assert sorted((x.vec_id or -1, x.cluster, x.distance) for x in found.rows.collect()) == want


def test_clusters_of_huge_numbers(spark):
    r = random.Random(6)
    rows = [(number, [r.choice([1e18, -3e30, 0.25, 2e9]) * r.random() for _ in range(4)]) for number in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = centroids.cluster_vectors(frame, count=5, rounds=2, dimensions=4)
    want, points = plain_clusters(rows, 5, 2)
    assert found.points == points
    got = sorted((x.vec_id or -1, x.cluster, x.distance) for x in found.rows.collect())
    assert got == [(key, cluster, d if d < 1 << 63 else None) for key, cluster, d in want]


def test_clusters_leave_out_unusable_vectors(spark):
    bad = [[1.0], None, [float("nan"), 1.0], [float("inf"), 0.0], [None, 1.0], [], [-float("inf"), 0.0]]
    rows = [(n, v, n, "x") for n, v in enumerate(bad)] + [(None, [1.0, 2.0], 7, "y"), (50, [1.0, 2.0], 7, "y"), (50, [1.0, 2.0], 7, "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster long, distance string")
    found = centroids.cluster_vectors(frame, count=16, rounds=2, dimensions=2)
    # equal centroids: the smaller number takes all
    assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in found.rows.collect()) == [(-1, 0, 0), (50, 0, 0), (50, 0, 0)]
    assert centroids.cluster_vectors(frame.limit(0), dimensions=2).rows.count() == 0


def test_threshold_walk_stops_early():
    r = np.random.default_rng(0)
    points = (r.normal(size=(200, 3)) * 1000).astype(int).tolist()
    vectors = np.array(points)[:50] + 1
    measured = []

    class Recorded(np.ndarray):
        def __getitem__(self, key):
            measured.append(key)
            return np.asarray(super().__getitem__(key))

    lists = centroids.Centroids(points)
    lists.points = lists.points.view(Recorded)
    cluster, distance = lists.nearest(vectors[:1])
    exact = ((vectors[:1, None] - np.array(points)[None]) ** 2).sum(axis=2)
    assert distance[0] == exact.min() and cluster[0] == exact.argmin()
    # most centroids never got an exact distance
    assert 0 < len(measured) < 100


@pytest.mark.parametrize("value", [0, -1, 1 << 40, -(1 << 40), (1 << 200) + 12345, -(1 << 133) - 7])
def test_digits_add_up(value):
    assert sum(part << (centroids.DIGIT * place) for place, part in enumerate(centroids.digits(value))) == value


# --- collocations


def plain_collocations(rows, least=10, top=2000):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            around = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in around):
                continue
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return found


def phrase_rows():
    r = random.Random(3)
    names = ["a", "B", "c", "É", "日本", "d\x1c", "e f", "\U0001f600", "x" * 50]
    texts = [(r.choice(["en", "de", None]), "".join(r.choice(names) + r.choice([" ", " ", " ", "\t ", ". ", "\n"]) for _ in range(r.randint(0, 60)))) for _ in range(120)]
    # one pair of words before everything else, and texts that repeat
    return texts + [("en", f"hot pair {word}{i % 12}") for i, word in enumerate(["u", "v"] * 100)] + [("en", None), (None, ""), ("fr", " \t\n")] + texts[:30]


@pytest.mark.parametrize("entries", [collocations.ENTRIES, 40])
def test_collocations_like_brute_force(spark, monkeypatch, entries):
    rows = phrase_rows()
    monkeypatch.setattr(collocations.counts, "__defaults__", (10, 3, 1 << 10, entries, collocations.PART_BYTES))
    frame = spark.createDataFrame([(lang, text, 1, "s", 2) for lang, text in rows], "lang string, text string, f long, phrase string, prefix int")
    got = [tuple(r) for r in collocations.collocations(frame.repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(rows)
    assert {r[0] for r in got} == {"en", "de", "und"}


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    r = random.Random(4)
    text = " ".join(r.choice("abcdefgh") for _ in range(5000)) + ". " + "solid" * 400 + " end"
    frame = spark.createDataFrame([("en", text), ("en", text[:500])], "lang string, text string").coalesce(1)
    monkeypatch.setattr(collocations.counts, "__defaults__", (10, 3, 1 << 10, 60, 37))
    got = {tuple(row) for row in collocations.collocations(frame).collect()}
    assert got == plain_collocations([("en", text), ("en", text[:500])])


def test_trie_bursts_and_spills_whole_subtrees():
    trie = collocations.HatTrie(burst=3)
    clean = b"a b c a b d a c d a e f a g h a b c".translate(collocations.CLEAN)
    trie.add("en", trie.ids(clean))
    assert any(isinstance(node, collocations.Branch) for node in trie.roots["en"].values())
    trie.add("en", trie.ids(clean))
    found = collections.Counter()
    for _, partition, phrases, f in trie.runs(8, 4):
        assert (np.diff(partition) >= 0).all()
        for p in set(partition.tolist()):
            own = [(n, *x.split(" ")) for x, n, at in zip(phrases.to_pylist(), f.tolist(), partition) if at == p]
            assert own == sorted(own)
        found.update(dict(zip(phrases.to_pylist(), f.tolist())))
    assert found["a b"] == 6 and found["a b c"] == 4 and found["a"] == 12 and sum(found.values()) == 2 * (18 + 17 + 16)


def test_exact_products(spark):
    big = 10**12
    rows = [("en", "", 5), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, f long")
    assert collocations.scored(frame).first()["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 1))


def test_no_phrases(spark, empty):
    assert collocations.collocations(empty).count() == 0
    with pytest.raises(ValueError):
        collocations.counts(empty, longest=4)


# --- main text


@pytest.fixture(scope="module")
def forest():
    return main_text.trained()


def one(source, forest):
    return next(main_text.texts([source], forest))


def test_pages_of_the_table(spark, forest):
    got = {r.page_id: r for r in QUERIES["op13_html_extraction"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    hits = 0
    for row in rows:
        inside = re.search(r"<article>(.*)</article>", row.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inside)).split())
        r = got[row.page_id]
        hits += want == " ".join(r.text.split())
        assert r.n_chars == len(r.text) and r.url == row.url
    assert hits >= 0.98 * len(rows)


def test_made_pages_held_out(forest):
    sources = page_maker.pages(200, seed=99)
    _, labels, parsed = main_text.labelled(sources)
    good = found = wanted = at = 0
    for page, text in zip(parsed, main_text.texts([s.replace(page_maker.MARK, "") for s in sources], forest)):
        own = labels[at : at + len(page.parent)]
        at += len(page.parent)
        want = [t for t, label in zip(page.text, own) if t and label]
        wanted += sum(map(len, want))
        found += len(text)
        good += sum(len(t) for t in want if t in text)
    assert good >= 0.98 * wanted and good >= 0.96 * found


LAYOUT = """<body><div id="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
<header><a href="/">Site</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="layout"><div class="post-content"><h1>A title &amp; more</h1><p>First   paragraph of the story, which is long enough to be read
by somebody.<p>Second one with a <a href="/x">link</a> in it, and quite some words after that link.<script>var x = "<p>no</p>";</script>
<div class="ad-slot">Buy now! Cheap things for all.</div><p>Third one &lt;tag&gt; ends it &mdash; and then there is no more to be said here.</p></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Another story</a></li><li><a href="/2">One more</a></li></ul></aside></div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thank you for writing it.</p></div>
<form><label>Your comment</label><textarea>no</textarea><button>Send</button></form></div>
<footer><p>Copyright by the site, all rights reserved.</p></footer>"""


def test_layout_without_semantic_article(forest):
    assert one(LAYOUT, forest) == (
        "A title & more First paragraph of the story, which is long enough to be read by somebody. Second one with a link in it, and quite"
        " some words after that link. Third one <tag> ends it — and then there is no more to be said here."
    )


def test_nothing_is_accepted_below_a_rejected_node():
    r = np.random.default_rng(1)
    for source in page_maker.pages(20, seed=5):
        page = parse(source)
        odds = r.normal(size=len(page.parent)) * 3
        take = main_text.decode(page, odds)
        assert all(take[page.parent[n]] for n in range(1, len(take)) if take[n])


def test_decoding_is_the_best_labelling():
    page = parse("<div>a<p>b</p>c</div><p>d</p>")
    r = np.random.default_rng(2)
    count = len(page.parent)
    for _ in range(20):
        odds = r.normal(size=count) * 2
        own = np.where(main_text.alone(page), 0.0, odds)

        def value(labels):
            return sum(-np.logaddexp(0, -o if on else o) for o, on in zip(own, labels))

        allowed = [
            labels
            for labels in ([bool(bits >> n & 1) for n in range(count)] for bits in range(1 << count))
            if all(labels[page.parent[n]] for n in range(1, count) if labels[n])
        ]
        assert value(main_text.decode(page, odds)) == pytest.approx(max(map(value, allowed)))


HARD_PAGES = [
    None, "", "   ", "plain words only", "<", "<p", "<p class='a", "</p></div>", "<p>a<p>b", "<table><tr><td>x<td>y</table>",
    "<div>" * 3000 + "deep" + "</div>" * 3000, "<!-- never closed", "<script>never closed", "<p>&#0;&bogus;&amp;amp;</p>",
    "<a " + '"' * 501 + ">" * 3, "<p>" + "long " * 200_000 + "</p>", "<br>" * 10_000, "<b><i><u>x", "<p> 　</p>",
]


def test_hard_pages(spark, forest):
    rows = [(n, None if n % 3 else f"u{n}", source, "x", 1) for n, source in enumerate(HARD_PAGES)] + [(None, "u", "<p>a</p>", "x", 1)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    found = main_text.extract(frame, forest).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[16] == by_id[18] == ""
    assert by_id[3] == "plain words only" and len(by_id[15]) == len("long " * 200_000) - 1
    assert main_text.extract(frame.limit(0), forest).count() == 0


def test_pages_are_read_like_browsers_do():
    texts = [t for t in parse("<ul><li>a<li>b</ul><p>x<div>y</div>z<dl><dt>k<dd>v</dl><b>i<p>j</b>k").text if t]
    assert texts == ["a", "b", "x", "y", "z", "k", "v", "i", "jk"]
    page = parse("<head><title>t</title><body><p>a<style>p{}</style>b<svg><p>no</p></svg></p><noscript>no</noscript>")
    assert [t for t in page.text if t] == ["a b"]


def test_batches_do_not_change_results(forest):
    sources = page_maker.pages(30, seed=3)
    assert list(main_text.texts(sources, forest)) == [one(source, forest) for source in sources]


# --- near copies


def near_rows():
    words = [f"w{n}" for n in range(60)]
    other = [f"x{n}" for n in range(60)]
    return [
        (3, " ".join(words)),
        (5, " ".join([*words[:-1], "end"])),
        (5, " ".join(other)),
        (7, " ".join([*other[:-1], "end"])),
        (9, "a text of its own with nothing in common"),
        (9, "a text of its own with nothing in common"),
        (None, " ".join(["start", *words])),
        (None, None),
    ]


def test_near_copies_go_where_a_row_of_their_id_stays(spark):
    frame = spark.createDataFrame(near_rows(), "doc_id long, text string").withColumn("_set", simhash.F.lit("x")).repartition(3)
    kept = sorted((r.doc_id or -1, (r.text or "")[:2], r._set) for r in simhash.drop_near_copies(frame).collect())
    assert kept == [(-1, "", "x"), (3, "w0", "x"), (5, "x0", "x"), (9, "a ", "x")]


def test_long_sets_are_compared_in_slices(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    r = random.Random(8)
    base = [f"w{n}" for n in range(400)]
    rows = [(0, " ".join(base))]
    for key in range(1, 40):
        words = list(base)
        for place in r.sample(range(400), r.randint(5, 30)):
            words[place] = f"n{key}"
        rows.append((key, " ".join(words[: r.choice([400, 360])])))
    runs = {key: set(simhash.shingle_hashes(text, 5).tolist()) for key, text in rows}
    linked = {key for key in runs if key and len(runs[0] & runs[key]) >= 0.8 * len(runs[0] | runs[key])}
    found = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert linked and all(found[key] == 0 for key in linked)
    alone_ = {a for a in runs if all(a == b or len(runs[a] & runs[b]) < 0.8 * len(runs[a] | runs[b]) for b in runs)}
    assert alone_ and all(found[key] == key for key in alone_)


def test_a_group_of_near_copies_gives_trees_not_all_pairs():
    """Sets that are all similar, each with a root of its own and two groups: a pair less than members."""
    sets = [np.array([*range(100), 1000 + n], np.uint64) for n in range(80)]
    bits = np.stack([np.frombuffer(simhash.bitmap(s, simhash.WIDE_BITS), np.uint64) for s in sets])
    groups, sizes = np.repeat([3, 9], [30, 50]), np.full(80, 101)
    left, right = simhash.joining(groups, bits, sizes, np.arange(80), 0.8)
    assert len(left) == 29 + 49 and set(right.tolist()) == set(range(80)) - {0, 30}
    assert len(simhash.candidates_between(groups, bits, sizes, np.arange(80), 0.8)[0]) == 30 * 29 // 2 + 50 * 49 // 2
    # equal roots are joined already, unlike sets never
    assert not len(simhash.joining(groups, bits, sizes, groups, 0.8)[0])
    other = np.stack([np.frombuffer(simhash.bitmap(s * np.uint64(n + 1) + np.uint64(n), simhash.WIDE_BITS), np.uint64) for n, s in enumerate(sets)])
    assert not len(simhash.joining(groups, other, sizes, np.arange(80), 0.8)[0])


def chained(r, count=70, words=60):
    """Near copies around the bound: each changes some words of one of the texts before it."""
    texts = [[f"w{n}" for n in range(words)]]
    while len(texts) < count:
        text = list(r.choice(texts))
        for place in r.sample(range(words), r.randint(1, 2)):
            text[place] = f"n{len(texts)}"
        texts.append(text)
    return [(key, " ".join(text)) for key, text in enumerate(texts)]


@pytest.mark.parametrize("wide", [64, 8192])
def test_trees_of_near_copies_lose_no_link(spark, monkeypatch, wide):
    """Also where the wide bitmaps tell little, so that trees hold pairs that are no links."""
    monkeypatch.setattr(simhash, "WIDE_BITS", wide)
    rows = chained(random.Random(5))
    runs = {key: set(simhash.shingle_hashes(text, 5).tolist()) for key, text in rows}
    root = {key: key for key in runs}

    def least(key):
        while root[key] != key:
            key = root[key]
        return key

    for a in runs:
        for b in runs:
            if a < b and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) - 1e-9:
                low, high = sorted((least(a), least(b)))
                root[high] = low
    found = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {key: least(key) for key in runs}
    assert 1 < len(set(found.values())) < 60


def test_fingerprints_give_pairs_of_near_copies(spark):
    """near_dedup asks the distance tables of the fingerprints, as op6 does: pairs within the radius are connected, no others are pairs."""
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(20)]
    for value in prints[:10]:
        prints += [value, value ^ sum(1 << bit for bit in r.sample(range(64), 4)), value ^ sum(1 << bit for bit in r.sample(range(64), 6))]
    rows = [(key, bytearray(value.to_bytes(8, "little"))) for key, value in enumerate(prints)]
    found = {tuple(p) for p in simhash.fingerprint_pairs(spark.createDataFrame(rows, "id long, print binary")).collect()}
    near = {(a, b) for a in range(50) for b in range(a + 1, 50) if (prints[a] ^ prints[b]).bit_count() <= 4}
    assert found <= near and {a for pair in near for a in pair} == {a for pair in found for a in pair}


def test_near_dedup_asks_the_fingerprints(spark, monkeypatch):
    asked = []
    found = simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *more: asked.append(prints.count()) or found(prints, *more))
    kept = simhash.drop_near_copies(spark.createDataFrame(near_rows(), "doc_id long, text string"))
    assert kept.count() == 4 and asked == [7]


def test_near_dedup_moves_no_text_again(spark, monkeypatch):
    """Texts of candidates and rows that stay are found in the buckets of their rows: only the wanted numbers are exchanged."""
    asked = []
    found = simhash.texts_of
    monkeypatch.setattr(simhash, "texts_of", lambda *some: asked.append(found(*some)) or asked[-1])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.drop_near_copies(spark.createDataFrame(near_rows(), "doc_id long, text string"))
        plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in [*asked, kept]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert asked and [plan.count("Exchange") for plan in plans] == [1] * len(plans)
    assert kept.count() == 4


def test_long_unlike_sets_are_no_candidates():
    """Bitmaps grow with the sets, also those of the first searches; bitmaps of two lengths are compared as well."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 62, size).astype(np.uint64)) for size in (2100, 2200, 4000, 4300, 9000, 9500, 17000, 20000)]
    sets += [s[: len(s) * 9 // 10] for s in sets]
    sizes = np.array([len(s) for s in sets])
    values, widths = simhash.padded_words(simhash.pd.Series([simhash.bitmap(s, simhash.bits_for(len(s))) for s in sets]))
    assert widths[0] == 2 * widths[8] and widths.max() == simhash.WIDE_BITS // 64
    left, right = simhash.candidates(np.zeros(16, np.int64), values, sizes, 0.8, widths)
    assert sorted(zip(left.tolist(), right.tolist())) == [(n, n + 8) for n in range(8)]
