"""SimHash near-dedup with pivot distance tables.

Each distinct fingerprint has a table of Hamming distances to reference fingerprints: zero,
the 64 with one bit, and rows of a Hadamard matrix. Distances of two fingerprints to one
reference differ by no more than the fingerprints do. The difference of the distances
to zero and to a one-bit reference can change at most in as many references as bits differ. With
the references dealt into `radius + t` groups, a pair within the radius therefore agrees in
all references of at least t groups: fingerprints meet where they do so. Of the pairs that meet, those whose
largest difference in the Hadamard coordinates exceeds the radius are discarded, and the rest verified.

More groups give longer keys: their number follows the number of fingerprints, so that as many fall
together by chance at any size. A key that many share is dealt out in pairs of chunks.
Only links that join two parts of a key's fingerprints are returned, which has the same components.

`similar_components` confirms links by the Jaccard similarity of sets of shingles (64-bit hashes). The fingerprints of the sets give
candidates by their distance tables, as above; fingerprints further apart may still belong to similar sets, so the rest is found exactly:
two sets that are similar enough share one of the first shingles of each, in any order that all sets are put in, and meet in those (common
shingles come last). Of the pairs that meet, those are candidates whose sizes and whose bitmaps can belong to similar sets: a bit is the
parity of the shingles that fall on it, so bitmaps differ in no more bits than the sets do in shingles. Long sets have longer bitmaps;
bitmaps of two lengths are compared at the shorter one, to which the longer folds. Every candidate is confirmed on
the sets themselves before it counts. Groups of more than two give stars first, then trees over what the confirmed links have left apart,
which have fewer rows than the group. Only where a pair of a tree is no link do all pairs follow that are left apart and that wide bitmaps allow.

The documents are written once as a table bucketed by row, in the shared folder: neither the texts of candidates nor
the rows that stay are found by moving texts again.

Defined cases: a null text has no words; texts without words have fingerprint zero and are linked like
any other. Rows that repeat are linked with each other. A null doc_id is never the least of
its component, unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chatstrata.llm.byte_text import mixed
from chatstrata.llm.common import unused
from chatstrata.llm.components import components
from chatstrata.session import scratch_path, staged

SHINGLE, RADIUS, SEED = 4, 4, 42
BITS = 64
# The sets of shingles: words in each, the wanted similarity, and the least bits of a bitmap.
SET_SHINGLE, SIMILARITY, SET_BITS = 5, 0.8, 1024
# The most common shingles, counted in one of so many documents, so many at a time.
COMMON, COMMON_PART, COMMON_BATCH = 50_000, 4, 1 << 21
# At most so many fingerprints share a key by chance, on average.
EXPECTED = 4
CHUNK = 4000
# Shingles of a set that are compared in one row.
SLICE = 4096
# Most bits of a bitmap, and those of all bitmaps that thin the candidates.
WIDE_BITS = 8192
# Groups of up to this size are compared pair by pair, larger ones by growing components.
SMALL = 8
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the word runs of a whole text, repeats included."""
    import xxhash

    # lower() of bytes changes A-Z only
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[start:end], SEED) for start, end in pairs), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit word per column of `hashes`; a bit is set if it is in over half of the rows."""
    words = hashes.shape[1]
    ones = np.zeros(BITS * words, np.int64)
    for first in range(0, len(hashes), 1 << 12):
        part = np.ascontiguousarray(hashes[first : first + (1 << 12)]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text."""
    hashes = shingle_hashes(text, shingle)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def hadamard() -> np.ndarray:
    """Half of the rows of the 64-bit Hadamard matrix as reference fingerprints."""
    rows = np.arange(1, BITS, 2)[:, None] & np.arange(BITS)[None, :]
    bits = np.array([[bin(v).count("1") & 1 for v in row] for row in rows], np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


PIVOTS = hadamard()


def distances(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The table of Hamming distances: a row for each fingerprint, a column for each reference.

    Both are rows of 64-bit words; a reference of one word is repeated to the fingerprints' length.
    """
    table = np.zeros((len(values), len(references)), np.int16)
    for word in range(values.shape[1]):
        other = references[:, word % references.shape[1]]
        table += np.bitwise_count(values[:, word][:, None] ^ other[None, :])
    return table


def nearer_to_one_bit(values: np.ndarray) -> np.ndarray:
    """Per fingerprint and one-bit reference: whether that reference is nearer than zero."""
    words = values.shape[1]
    ones = np.zeros((BITS * words, words), np.uint64)
    ones[np.arange(BITS * words), np.arange(BITS * words) // BITS] = np.uint64(1) << (np.arange(BITS * words, dtype=np.uint64) % np.uint64(BITS))
    zero = distances(values, np.zeros((1, words), np.uint64))
    return distances(values, ones) < zero


def group_plan(count: int, radius: int = RADIUS) -> tuple[int, int]:
    """(groups, groups that must agree) for so many distinct fingerprints."""
    agree = 1
    while count / 2 ** (BITS * agree / (radius + agree)) > EXPECTED and agree < 6:
        agree += 1
    return radius + agree, agree


def pivot_keys(values: np.ndarray, groups: int, agree: int) -> np.ndarray:
    """A row for each fingerprint of one key for each choice of `agree` groups of one-bit references."""
    nearer = nearer_to_one_bit(values)
    members = np.array_split(np.arange(nearer.shape[1]), groups)
    codes = [_packed(nearer[:, m]) for m in members]
    keys = []
    for number, choice in enumerate(itertools.combinations(range(groups), agree)):
        key = np.full(len(values), number, np.uint64)
        for g in choice:
            key = (key << np.uint64(len(members[g]))) | codes[g]
        keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return (bits * (np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def near(values: np.ndarray, left: np.ndarray, right: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of places are within the radius: first by the largest difference of coordinates, then exactly."""
    gap = np.abs(table[left] - table[right]).max(axis=1) <= radius
    gap[gap] = np.bitwise_count(values[left[gap]] ^ values[right[gap]]).sum(axis=1) <= radius
    return gap


def group_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that hold the components of one group together: pairs of places."""
    table = distances(values, PIVOTS)
    waiting, links = np.arange(len(values)), []
    while len(waiting):
        reached, waiting = [int(waiting[-1])], waiting[:-1]
        while reached and len(waiting):
            at = reached.pop()
            hit = near(values, np.full(len(waiting), at), waiting, table, radius)
            links += [(at, int(i)) for i in waiting[hit]]
            reached += waiting[hit].tolist()
            waiting = waiting[~hit]
    return links


def sorted_links(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of places) within groups of equal, sorted group numbers."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    left: list[np.ndarray] = [np.zeros(0, np.int64)]
    right: list[np.ndarray] = [np.zeros(0, np.int64)]
    places = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    if len(places):
        own, group, table = values[places], groups[places], distances(values[places], PIVOTS)
        for lag in range(1, SMALL):
            first = np.flatnonzero(group[:-lag] == group[lag:])
            if not len(first):
                break
            hit = first[near(own, first, first + lag, table, radius)]
            left.append(places[hit])
            right.append(places[hit + lag])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        found = np.array(group_links(values[start : start + size], radius), np.int64).reshape(-1, 2) + start
        left.append(found[:, 0])
        right.append(found[:, 1])
    return np.concatenate(left), np.concatenate(right)


def words_of(prints: pd.Series) -> np.ndarray:
    """Binary fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


def links(prints: DataFrame, make_keys, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between the ids of distinct fingerprints (`id` long, `print` binary) that meet and are within the radius.

    make_keys gives a row of keys for each row of words; fingerprints meet in equal keys.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.iloc[first : first + 2048]
                keys = make_keys(words_of(part["print"]))
                yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), keys.shape[1])})

    keys = prints.select("id", "print").mapInPandas(keyed, "key long, id long")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(counts, "key").withColumn("chunks", F.ceil(F.col("n") / chunk))
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    dealt = met.select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id")
    dealt = dealt.join(prints.select("id", "print"), "id")
    part = ["key", "low", "high"]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, held = held, None
            else:
                rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
                last = (rows[part].to_numpy() == rows[part].to_numpy()[-1]).all(axis=1)
                # the last group may go on in the next batch
                rows, held = rows[~last], rows[last]
            if rows is None or not len(rows):
                continue
            columns = rows[part].to_numpy()
            number = np.cumsum(np.concatenate([[True], (columns[1:] != columns[:-1]).any(axis=1)]))
            left, right = sorted_links(number, words_of(rows["print"]), radius)
            ids = rows["id"].to_numpy()
            yield pd.DataFrame({"a": ids[left], "b": ids[right]})

    return dealt.repartition(*part).sortWithinPartitions(*part).mapInPandas(linked, "a long, b long").distinct()


def _with_components(prints: DataFrame, make_keys_of, radius: int) -> DataFrame:
    """Rows of `prints` (doc_id, print) with component_id: the least doc_id linked with theirs.

    make_keys_of gives the keys for a number of distinct fingerprints.
    """
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    distinct = staged(distinct, "distinct-fingerprints")
    roots = components(links(distinct, make_keys_of(distinct.count()), radius)).withColumnRenamed("node", "id")
    named = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.join(least, "root").select("print", "component_id"), "fingerprint-components")
    return prints.join(named, "print")


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of `docs`: all links within the radius count."""

    @pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle).to_bytes(8, "big") for t in texts], dtype=object)

    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed("text").alias("print"))
    found = _with_components(
        staged(prints, "fingerprints"),
        lambda count: lambda values: pivot_keys(values, *group_plan(count, radius)),
        radius,
    )
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def set_prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: a similar set has one of them among its own first. `common` is sorted."""
    if not len(hashes):
        return hashes
    weight = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))][: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


def bitmap(hashes: np.ndarray, bits: int = SET_BITS) -> bytes:
    """For each of so many bits the parity of the shingles that fall on it."""
    fallen = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(fallen & 1 == 1, bitorder="little").tobytes()


def bits_for(size: int) -> int:
    """The bits of the bitmap of a set of that size: with less than half a bit a shingle, unlike sets look alike."""
    bits = SET_BITS
    while 2 * bits < size and 2 * bits <= WIDE_BITS:
        bits *= 2
    return bits


def padded_words(bits: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps as rows of 64-bit words, filled up with zeros, and the number of words of each."""
    widths = bits.map(len).to_numpy(np.int64) // 8
    values = np.zeros((len(bits), widths.max(initial=0)), np.uint64)
    for width in np.unique(widths):
        own = widths == width
        values[own, :width] = words_of(bits[own])
    return values, widths


def possible(
    values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, widths: np.ndarray | None = None
) -> np.ndarray:
    """Which pairs of places may be as similar as that; no pair that is gets lost. Bitmaps are as wide as `widths`, by default all alike."""
    a, b = sizes[left], sizes[right]
    fit = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    one, other = left[fit], right[fit]
    if widths is None or not len(one):
        apart = np.bitwise_count(values[one] ^ values[other]).sum(axis=1, dtype=np.int64)
    else:
        widest = max(widths[one].max(), widths[other].max())
        differing, shorter = values[:, :widest][one] ^ values[:, :widest][other], np.minimum(widths[one], widths[other])
        apart = np.zeros(len(one), np.int64)
        for width in np.unique(shorter):
            own = shorter == width
            folded = np.bitwise_xor.reduce(differing[own].reshape(-1, widest // width, width), axis=1)
            apart[own] = np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
    fit[fit] = apart <= (a + b)[fit] * (1 - similarity) / (1 + similarity) + 1e-9
    return fit


def candidates(
    groups: np.ndarray, values: np.ndarray, sizes: np.ndarray, similarity: float, widths: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs of places within groups of equal, sorted numbers: in groups of more than two, stars that take in all they can."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    lengths = np.diff(np.append(starts, len(groups)))
    left: list[np.ndarray] = [np.zeros(0, np.int64)]
    right: list[np.ndarray] = [np.zeros(0, np.int64)]
    two = starts[lengths == 2]
    two = two[possible(values, sizes, two, two + 1, similarity, widths)]
    left.append(two)
    right.append(two + 1)
    for start, length in zip(starts[lengths > 2], lengths[lengths > 2]):
        waiting = np.arange(start, start + length)
        while len(waiting) > 1:
            at, waiting = np.full(len(waiting) - 1, waiting[0]), waiting[1:]
            hit = possible(values, sizes, at, waiting, similarity, widths)
            left.append(at[hit])
            right.append(waiting[hit])
            waiting = waiting[~hit]
    return np.concatenate(left), np.concatenate(right)


def candidates_between(
    groups: np.ndarray, values: np.ndarray, sizes: np.ndarray, roots: np.ndarray, similarity: float, widths: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """All possible pairs of places within groups of equal, sorted numbers that have different roots: for what `joining` has left."""
    ends = np.searchsorted(groups, groups, "right")
    left: list[np.ndarray] = [np.zeros(0, np.int64)]
    right: list[np.ndarray] = [np.zeros(0, np.int64)]
    for at in range(len(groups)):
        rest = np.arange(at + 1, ends[at])
        rest = rest[roots[rest] != roots[at]]
        one = np.full(len(rest), at)
        hit = possible(values, sizes, one, rest, similarity, widths)
        left.append(one[hit])
        right.append(rest[hit])
    return np.concatenate(left), np.concatenate(right)


def joining(
    groups: np.ndarray, values: np.ndarray, sizes: np.ndarray, roots: np.ndarray, similarity: float, widths: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs of places within groups of equal, sorted numbers that join different roots: a tree over the roots they can join.

    A group gives fewer pairs than it has roots. If all of them are links, its possible pairs have the same root.
    """
    ends = np.searchsorted(groups, groups, "right")
    roots, begin = roots.copy(), np.searchsorted(groups, groups, "left")
    left: list[np.ndarray] = [np.zeros(0, np.int64)]
    right: list[np.ndarray] = [np.zeros(0, np.int64)]
    for at in range(len(groups)):
        rest = np.arange(at + 1, ends[at])
        rest = rest[roots[rest] != roots[at]]
        rest = rest[possible(values, sizes, np.full(len(rest), at), rest, similarity, widths)]
        if len(rest):
            others, first = np.unique(roots[rest], return_index=True)
            left.append(np.full(len(first), at))
            right.append(rest[first])
            own = roots[begin[at] : ends[at]]
            own[np.isin(own, others)] = roots[at]
    return np.concatenate(left), np.concatenate(right)


def common_shingles(docs: DataFrame, shingle: int, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of most documents, sorted, and about how many have each. This only sets an order: it may be inexact."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch["text"][::COMMON_PART]:
                held.append(np.unique(shingle_hashes(text, shingle)))
                size += len(held[-1])
                if size >= COMMON_BATCH:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(held: list[np.ndarray]) -> pd.DataFrame:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"hash": hashes[n > 1].view(np.int64), "n": n[n > 1]})

    counts = docs.select("text").mapInPandas(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n")).limit(limit).toPandas()
    hashes, n = found["hash"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, in as many buckets of it as a shuffle has partitions, and the name of that column."""
    spark = docs.sparkSession
    row, count = unused(docs, "_row"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"near_documents_{uuid.uuid4().hex}"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    writer = numbered.repartition(count, row).write.bucketBy(count, row).option("compression", "zstd")
    writer.option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name), row


def shingle_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row, doc_id and id, size, bits (bitmap), print (fingerprint) and prefix of the set of shingles of every row; equal sets have equal ids."""
    common, counts = common_shingles(docs, shingle)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = np.unique(shingle_hashes(text, shingle))
                print_ = majority(hashes[:, None]).tobytes() if len(hashes) else bytes(8)
                bits = bitmap(hashes, bits_for(len(hashes)))
                rows.append((set_id(hashes), len(hashes), bits, print_, set_prefix(hashes, common, counts, similarity).tobytes()))
            found = pd.DataFrame(rows, columns=["id", "size", "bits", "print", "prefix"])
            yield found.assign(row=batch["row"].array, doc_id=batch["doc_id"].array)

    texts = docs.select("row", "doc_id", "text")
    # text: a nullable long would pass through Pandas as a float
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    sets = texts.mapInPandas(described, "id long, size long, bits binary, print binary, prefix binary, row long, doc_id string")
    return sets.withColumn("doc_id", F.col("doc_id").cast("long"))


def set_id(hashes: np.ndarray) -> int:
    """XXH64 of a whole sorted set, as a signed number."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _pairs(met: DataFrame, sets: DataFrame, find, chunk: int) -> DataFrame:
    """(a, b), a < b: the candidates among the ids that meet in a key; `met` has key, id and n, the ids of the key."""
    met = met.withColumn("chunks", F.ceil(F.col("n") / chunk))
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    dealt = met.select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id")
    part = ["key", "low", "high"]
    dealt = dealt.join(sets, "id").repartition(*part).sortWithinPartitions(*part, "id")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, held = held, None
            else:
                rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
                last = (rows[part].to_numpy() == rows[part].to_numpy()[-1:]).all(axis=1)
                # the last group may go on in the next batch
                rows, held = rows[~last], rows[last]
            if rows is None or not len(rows):
                continue
            columns = rows[part].to_numpy()
            number = np.cumsum(np.concatenate([[True], (columns[1:] != columns[:-1]).any(axis=1)]))
            left, right = find(number, *padded_words(rows["bits"]), rows)
            ids = rows["id"].to_numpy()
            yield pd.DataFrame({"a": np.minimum(ids[left], ids[right]), "b": np.maximum(ids[left], ids[right])}).drop_duplicates()

    return dealt.mapInPandas(found, "a long, b long").distinct()


def fingerprint_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: ids of sets (id, print) whose fingerprints are within the radius, as many as hold their components together."""
    prints = staged(sets.groupBy("print").agg(F.min("id").alias("id")), "distinct-fingerprints")
    plan = group_plan(prints.count(), radius)
    near_ = links(prints, lambda values: pivot_keys(values, *plan), radius)
    same = sets.join(prints.withColumnRenamed("id", "a"), "print").where("a < id").select("a", F.col("id").alias("b"))
    return near_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same).distinct()


def texts_of(ids: DataFrame, least: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of one row of each of those ids; `least` has a row of each id. Only the ids move: `docs` is in buckets of row."""
    wanted = staged(least.join(ids, "id").select("row"), "candidate-sets")
    return docs.join(wanted.hint("shuffle_hash"), "row", "left_semi").select("text")


def wide_bitmaps(ids: DataFrame, least: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """id, size and bits (wide bitmap) of the sets of those ids, one row each."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                sets = [np.unique(shingle_hashes(text, shingle)) for text in batch["text"].iloc[first : first + 512]]
                rows = [(set_id(s), len(s), bitmap(s, WIDE_BITS)) for s in sets]
                yield pd.DataFrame(rows, columns=["id", "size", "bits"])

    return staged(texts_of(ids, least, docs).mapInPandas(described, "id long, size long, bits binary"), "wide-bitmaps")


def confirmed(pairs: DataFrame, least: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are as similar as that; `least` has a row of each id.

    Sets are cut into slices by their hashes, and the slices of a pair are intersected row by row in the
    JVM: no row is longer than a slice, however long a text is, and no batch of whole sets is built.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                sets = [np.unique(shingle_hashes(text, shingle)) for text in batch["text"].iloc[first : first + 512]]
                yield pd.DataFrame(
                    {
                        "id": np.array([set_id(s) for s in sets], np.int64),
                        "size": list(map(len, sets)),
                        "bits": [bitmap(s, WIDE_BITS) for s in sets],
                        "hashes": [s.view(np.int64) for s in sets],
                    }
                )

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = len(batch)
            if not count:
                continue
            values = words_of(pd.concat([batch["one"], batch["other"]], ignore_index=True))
            sizes = np.concatenate([batch["size_a"].to_numpy(), batch["size_b"].to_numpy()])
            left = np.arange(count)
            yield batch.loc[possible(values, sizes, left, left + count, similarity), ["a", "b", "size_a", "size_b"]]

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = staged(texts_of(ids, least, docs).mapInPandas(hashed, "id long, size long, bits binary, hashes array<long>"), "hash-sets")
    # wide bitmaps thin the pairs before whole sets are moved
    small = sets.select("id", "size", "bits")
    one = small.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("one"))
    other = small.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("other"))
    near_ = pairs.join(one, "a").join(other, "b").select("a", "b", "size_a", "size_b", "one", "other")
    sized = near_.mapInPandas(thinned, "a long, b long, size_a long, size_b long")
    # both sets are cut by the number of slices of the larger one
    slices = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), F.ceil(F.greatest("size_a", "size_b") / SLICE))))).cast("long")
    sized = staged(sized.withColumn("slices", slices), "sized-pairs")

    def cut(side: str, name: str) -> DataFrame:
        cuts = sized.select(F.col(side).alias("id"), "slices").distinct().join(sets.select("id", "hashes"), "id")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
        cuts = cuts.select("id", "slices", "hashes", each)
        own = F.expr("filter(hashes, h -> pmod(h, slices) = slice)")
        own = F.when(F.col("slices") == 1, F.col("hashes")).otherwise(own)
        return cuts.select(F.col("id").alias(side), "slices", "slice", own.alias(name))

    both = sized.join(cut("a", "one"), ["a", "slices"]).join(cut("b", "other"), ["b", "slices", "slice"])
    common = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("one", "other")).alias("common"))
    whole = common.groupBy("a", "b", "size_a", "size_b").agg(F.sum("common").alias("common"))
    similar = F.col("common") >= similarity * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9
    return staged(whole.where(similar).select("a", "b"), "similar-pairs")


def similar_links(sets: DataFrame, least: DataFrame, docs: DataFrame, shingle: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """(node, root): the components of the sets (id, size, bits, prefix) that are linked with others."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.iloc[first : first + 1024]
                lengths = part["prefix"].map(len).to_numpy() // 8
                yield pd.DataFrame({"key": np.frombuffer(b"".join(part["prefix"]), np.int64), "id": np.repeat(part["id"].to_numpy(), lengths)})

    close = fingerprint_pairs(sets.select("id", "print"))
    keys = sets.select("id", "prefix").mapInPandas(keyed, "key long, id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    # rows of equal sets are one
    met = staged(keys.join(shared, "key").distinct(), "shared-shingles")
    first, last, mix = F.min("id").alias("first"), F.max("id").alias("last"), F.bit_xor(F.xxhash64("id")).alias("mix")
    groups = met.groupBy("key").agg(F.count("*").alias("n"), first, last, mix).where("n > 1")
    # keys of the same ids are needed once
    groups = staged(groups.groupBy("n", "first", "last", "mix").agg(F.min("key").alias("key")).select("key", "n"), "groups")
    met = staged(met.join(groups, "key"), "met")
    sets = sets.join(met.select("id").distinct(), "id", "left_semi").groupBy("id")
    sets = staged(sets.agg(F.first("size").alias("size"), F.first("bits").alias("bits")), "bitmaps")
    stars = _pairs(met, sets, lambda number, values, widths, rows: candidates(number, values, rows["size"].to_numpy(), similarity, widths), chunk)
    linked = confirmed(staged(close.union(stars).distinct(), "candidates"), least, docs, shingle, similarity)
    roots = staged(components(linked), "first-components")
    large = _apart(met.where("n > 2"), roots)

    def between(rows: DataFrame, sets: DataFrame, find) -> DataFrame:
        rooted = sets.join(rows.select("id", "root").distinct(), "id")

        def found(number: np.ndarray, values: np.ndarray, widths: np.ndarray, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            return find(number, values, part["size"].to_numpy(), part["root"].to_numpy(), similarity, widths)

        return _pairs(rows.select("key", "id", "n"), rooted, found, chunk)

    trees = staged(between(large, sets, joining), "trees")
    right = confirmed(trees, least, docs, shingle, similarity)
    wrong = staged(trees.join(right, ["a", "b"], "left_anti"), "no-links")
    linked = linked.union(right)
    roots = staged(components(linked), "second-components")
    if wrong.isEmpty():
        return roots
    # a pair that a tree has left apart is in a group that has a pair that is no link
    here = large.select("key", "id")
    open_ = wrong.join(here.withColumnRenamed("id", "a"), "a").join(here.withColumnRenamed("id", "b"), ["key", "b"])
    large = _apart(large.drop("root").join(open_.select("key").distinct(), "key"), roots)
    wide = wide_bitmaps(large.select("id").distinct(), least, docs, shingle)
    more = staged(between(large, wide, candidates_between).join(wrong, ["a", "b"], "left_anti"), "more-candidates")
    if more.isEmpty():
        return roots
    return components(linked.union(confirmed(more, least, docs, shingle, similarity)))


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """key, id, n and root of the ids that meet in keys whose ids have different roots."""
    roots = roots.withColumnRenamed("node", "id")
    large = staged(met.select("key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "large-groups")
    apart = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return staged(large.join(apart, "key").select("key", "id", "n", "root"), "groups-apart")


def _similar_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row, doc_id, id (of the set), root and component_id of every row of `docs`: row, doc_id and text in buckets of row."""
    sets = staged(shingle_sets(docs, shingle, similarity), "sets")
    least = staged(sets.groupBy("id").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")), "least-documents")
    roots = similar_links(sets, least, docs, shingle, similarity).withColumnRenamed("node", "id")
    named = staged(least.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "set-roots")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.join(lowest, "root").select("id", "root", "component_id"), "set-components")
    return sets.select("row", "doc_id", "id").join(named, "id")


def _texts(table: DataFrame, row: str) -> DataFrame:
    return table.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def similar_components(docs: DataFrame, shingle: int = SET_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every row of `docs`: all pairs of at least that Jaccard similarity are links, and no others."""
    return _similar_sets(_texts(*by_row(docs.select("doc_id", "text"))), shingle, similarity).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SET_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each component: of the least doc_id, and of several rows with it one of the least set id."""
    table, row = by_row(docs)
    found = _similar_sets(_texts(table, row), shingle, similarity)
    # a null doc_id comes last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "row")).alias("first")
    kept = staged(found.groupBy("root").agg(first).select(F.col("first.row").alias(row)), "kept-rows")
    return table.join(kept.hint("shuffle_hash"), row, "left_semi").drop(row)
