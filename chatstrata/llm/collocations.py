"""Collocations of two and three words, counted in HAT-tries.

Each task counts the words and phrases of its texts in a trie: word ids lead from the root to hash
containers of what follows, and a container that grows too large bursts into one per next word. When a
trie holds `ENTRIES` phrases, its subtrees are written out whole, as runs in the order of their words,
one run per prefix partition and count, and it starts anew. A prefix partition has the phrases of some
two-word prefixes; below each prefix the third words are dealt into `FAN` slices, so that the phrases
after one hot pair of words are spread over as many partitions. Runs of one partition meet in one
exchange, where their counts are merged.

Defined cases: a null text is empty and has no word, a null lang counts as `und`. Words are never cut, and
a text of any length is read in parts that hand their last two words on, so no phrase is lost. Rows
that repeat count again. An empty table, or one without a phrase that is frequent enough, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstrata.llm.common import LOWER, UPPER, ranked
from chatstrata.session import staged

LEAST, LONGEST, TOP = 10, 3, 2000
MILLION = 1_000_000
# A candidate goes if a longer one around it has at least this share of its occurrences.
HALF = 50
NO_LANG = "und"
# Bytes of text read at once, entries of a trie before it is spilled, of a container before it bursts.
PART_BYTES, ENTRIES, BURST = 1 << 20, 500_000, 4096
# Text of one task that merges runs, the most such tasks, prefix partitions of each, and slices of third words.
MERGED_BYTES, MOST_MERGES, PREFIXES, FAN = 4 << 20, 100_000, 8, 64
# A phrase is one number of three word ids; 0 stands for no word, and for the end of a piece.
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1

# Piece ends become line breaks, blanks spaces; 0xFF is no byte of UTF-8.
CLEAN = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0b\x0c\r", LOWER.encode() + b" " + b"\n" * 9)
END = b" \xff "
CUT = re.compile(rb"[ \n]")


class Words(dict):
    """Word ids in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Branch:
    """A burst container: one container of last words per second word."""

    __slots__ = ("children",)

    def __init__(self, container: dict[int, int]):
        self.children: dict[int, dict[int, int]] = {}
        for rest, n in container.items():
            self.children.setdefault(rest >> ID_BITS, {})[rest & ID_MASK] = n

    def add(self, rests: list[int], counts: list[int]) -> int:
        new = 0
        for rest, n in zip(rests, counts):
            child = self.children.setdefault(rest >> ID_BITS, {})
            last = rest & ID_MASK
            before = child.get(last)
            child[last] = n if before is None else before + n
            new += before is None
        return new


class HatTrie:
    """Counts of the phrases of each language, by first word."""

    def __init__(self, longest: int = LONGEST, burst: int = BURST):
        self.longest, self.burst = longest, burst
        self.clear()

    def clear(self) -> None:
        self.words = Words({b"\xff": 0})
        self.roots: dict[str, dict[int, dict[int, int] | Branch]] = {}
        self.totals: dict[str, int] = {}
        self.entries = 0

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of a cleaned text's words, 0 where a piece ends."""
        words = text.replace(b"\n", END).split(b" ")
        return np.fromiter(map(self.words.__getitem__, filter(None, words)), np.int64)

    def add(self, lang: str, ids: np.ndarray, known: int = 0) -> None:
        """Counts the words after the first `known` ids, and the phrases that end in them."""
        word = ids != 0
        first = ids << (2 * ID_BITS)
        codes = [first[known:][word[known:]]]
        self.totals[lang] = self.totals.get(lang, 0) + len(codes[0])
        if len(ids) > 1:
            two = word[:-1] & word[1:]
            pairs = first[:-1] | ids[1:] << ID_BITS
            at = max(known - 1, 0)
            codes.append(pairs[at:][two[at:]])
            if self.longest > 2 and len(ids) > 2:
                three = two[:-1] & word[2:]
                at = max(known - 2, 0)
                codes.append((pairs[:-1] | ids[2:])[at:][three[at:]])
        self._insert(lang, *np.unique(np.concatenate(codes), return_counts=True))

    def _insert(self, lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
        root = self.roots.setdefault(lang, {})
        firsts = codes >> (2 * ID_BITS)
        starts = np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]])) if len(codes) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(codes))
        rests, numbers = (codes & ((1 << 2 * ID_BITS) - 1)).tolist(), counts.tolist()
        for word, start, end in zip(firsts[starts].tolist(), starts.tolist(), ends.tolist()):
            node = root.get(word)
            if node is None:
                root[word] = node = dict(zip(rests[start:end], numbers[start:end]))
                self.entries += end - start
            elif isinstance(node, Branch):
                self.entries += node.add(rests[start:end], numbers[start:end])
            else:
                size = len(node)
                for rest, n in zip(rests[start:end], numbers[start:end]):
                    node[rest] = node.get(rest, 0) + n
                self.entries += len(node) - size
            if len(node.children if isinstance(node, Branch) else node) > self.burst and not isinstance(node, Branch):
                root[word] = Branch(node)

    def runs(self, prefixes: int, fan: int) -> Iterator[tuple[str, np.ndarray, pa.Array, np.ndarray]]:
        """For each language: prefix partitions, phrases and counts, by partition, count and the words of the phrase."""
        words = list(self.words)
        ranks = np.empty(len(words), np.int64)
        ranks[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        # 0 stays below all words
        ranks[0] = -1
        ranks += 1
        hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        hashes[0] = 0
        # as binary: the end mark is no UTF-8
        names = pa.array(words[:1] and [None, *words[1:]], pa.binary())
        for lang, root in self.roots.items():
            if not root:
                continue
            found: list[int] = []
            numbers: list[int] = []
            for word, node in root.items():
                first = word << (2 * ID_BITS)
                below = {first: node} if isinstance(node, dict) else {first | second << ID_BITS: c for second, c in node.children.items()}
                for prefix, container in below.items():
                    found += [prefix | rest for rest in container]
                    numbers += container.values()
            codes, counts = np.array(found, np.int64), np.array(numbers, np.int64)
            parts = [codes >> (2 * ID_BITS), codes >> ID_BITS & ID_MASK, codes & ID_MASK]
            partition = self._partition(lang, [hashes[p] for p in parts], prefixes, fan)
            order = np.lexsort((ranks[parts[2]], ranks[parts[1]], ranks[parts[0]], counts, partition))
            columns = [names.take(pa.array(p[order])) for p in parts]
            phrases = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()), null_handling="skip")
            yield lang, partition[order], phrases.cast(pa.string()), counts[order]

    @staticmethod
    def _partition(lang: str, hashes: list[np.ndarray], prefixes: int, fan: int) -> np.ndarray:
        """The prefix partition: of the language, the first two words and the third one's slice."""
        with np.errstate(over="ignore"):
            mixed = np.full(len(hashes[0]), zlib.crc32(lang.encode()), np.uint64)
            for part in (hashes[0], hashes[1], hashes[2] % np.uint64(fan)):
                mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(prefixes)).astype(np.int64)


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A cleaned text in parts of about `size` bytes, cut before a blank or line break."""
    at = 0
    while at < len(text):
        found = CUT.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def counts(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    merged_bytes: int = MERGED_BYTES,
    entries: int = ENTRIES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """lang, phrase, f of all phrases of up to `longest` words with f >= `least`; the empty phrase has the number of all words."""
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words")

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    merges = min(1 + size // merged_bytes, MOST_MERGES)
    prefixes = PREFIXES * merges

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(longest)

        def full() -> bool:
            return trie.entries >= entries or len(trie.words) > ID_MASK - part_bytes

        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            size = 0
            langs = batch.column(0).to_pylist()
            for row, lang in enumerate(langs):
                text = batch.column(1)[row].as_py() or b""
                clean = text.translate(CLEAN)
                if len(clean) > part_bytes:
                    known = np.zeros(0, np.int64)
                    for part in _parts(clean, part_bytes):
                        ids = np.concatenate([known, trie.ids(part)])
                        trie.add(lang, ids, len(known))
                        known = ids[-2:]
                        if full():
                            # the last words keep their phrases, so they get ids in the new trie
                            names = list(trie.words)
                            tail = [names[i] for i in known.tolist()]
                            yield _runs(trie, prefixes)
                            trie.clear()
                            known = np.array([trie.words[word] for word in tail], np.int64)
                    continue
                waiting.setdefault(lang, []).append(clean)
                size += len(clean)
                if size >= part_bytes or row + 1 == len(langs):
                    for name, texts in waiting.items():
                        trie.add(name, trie.ids(b"\n".join(texts)))
                    waiting, size = {}, 0
                    if full():
                        yield _runs(trie, prefixes)
                        trie.clear()
            for name, texts in waiting.items():
                trie.add(name, trie.ids(b"\n".join(texts)))
        if trie.totals:
            yield _runs(trie, prefixes)

    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    runs = texts.mapInArrow(counted, "prefix int, lang string, f long, phrases string")
    pairs = runs.repartition(merges, "prefix").select("prefix", "lang", "f", F.explode(F.split("phrases", "\n")).alias("phrase"))
    # a phrase has one prefix partition, so its runs are in one place already
    merged = pairs.groupBy("prefix", "lang", "phrase").agg(F.sum("f").alias("f"))
    return merged.where((F.col("f") >= least) | (F.col("phrase") == "")).select("lang", "phrase", "f")


def _runs(trie: HatTrie, prefixes: int) -> pa.RecordBatch:
    """One row per language, prefix partition and count with its phrases in lines, and one per language for the number of its words."""
    columns: list[list] = [[], [], [], []]
    for lang, partition, phrases, f in trie.runs(prefixes, FAN):
        starts = np.flatnonzero(np.concatenate([[True], (partition[1:] != partition[:-1]) | (f[1:] != f[:-1])]))
        offsets = pa.array(np.append(starts, len(partition)).astype(np.int32))
        columns[0].append(pa.array(partition[starts], pa.int32()))
        columns[1].append(pa.array([lang] * len(starts), pa.string()))
        columns[2].append(pa.array(f[starts], pa.int64()))
        columns[3].append(pc.binary_join(pa.ListArray.from_arrays(offsets, phrases), "\n"))
    langs = list(trie.totals)
    columns[0].append(pa.array([zlib.crc32(lang.encode()) % prefixes for lang in langs], pa.int32()))
    columns[1].append(pa.array(langs, pa.string()))
    columns[2].append(pa.array([trie.totals[lang] for lang in langs], pa.int64()))
    columns[3].append(pa.array([""] * len(langs), pa.string()))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["prefix", "lang", "f", "phrases"])


def _exact(column: str) -> Column:
    # 16 digits: three factors of a product stay below 38
    return F.col(column).cast("decimal(16,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of several words, by their lowest-scoring cut.

    `frequent` has every phrase that is at least as frequent as a candidate, so both sides of a cut are in it.
    """
    words = F.split("phrase", " ")
    candidates = frequent.where("phrase LIKE '% %'").select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "*",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"),
    )
    sides = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    above = _exact("a") * _exact("a") * F.lit(MILLION).cast("decimal(7,0)")
    cuts = cuts.withColumns({"above": above, "below": _exact("l") * _exact("r")}).withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase").agg(lowest, F.first("a").alias("a"), F.first("words").alias("words"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase, around: the highest frequency of a longer candidate around each shorter phrase."""
    longer = candidates.where(F.size("words") > 2)
    inner = F.array(
        *[F.array_join(F.slice("words", start, 2), " ") for start in (1, 2)],
    )
    pairs = longer.select("lang", F.explode(inner).alias("phrase"), "a")
    return pairs.groupBy("lang", "phrase").agg(F.max("a").alias("around"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, half: int = HALF) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language (None: all)."""
    frequent = staged(counts(docs, least, longest), "frequent-phrases")
    candidates = staged(scored(frequent), "candidate-phrases")
    left = candidates.join(_contained(candidates), ["lang", "phrase"], "left")
    # decimals: the product may pass 64 bits
    swallowed = F.col("around").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * half
    left = left.where(F.col("around").isNull() | ~swallowed)
    # places in one global order, so that no language is gathered in one task
    keys = ["lang", "_score", "_a", "phrase"]
    placed = staged(ranked(left.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), keys, "phrase-order"), "phrase-places")
    starts = placed.groupBy("lang").agg(F.min("position").alias("_start"))
    ordered = placed.join(starts, "lang").withColumn("rank", F.col("position") - F.col("_start") + 1)
    if top is not None:
        ordered = ordered.where(F.col("rank") <= top)
    words = frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ordered.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
