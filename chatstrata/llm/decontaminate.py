"""Benchmark decontamination with a BM25 index of the test items.

The index holds the terms of the items. Every document is cut into overlapping passages
of 2 x SPAN words, a new one each SPAN words, so that each item of up to SPAN words is
whole in one of them; longer items have an index with longer passages. A passage is a query of all its
terms. Impacts are scaled so that an item's threshold is 1. The items are in blocks; a block whose
summed term maxima stay below the threshold is skipped, in the others each item is scored. All
items above the threshold are verified: five-word runs of the item, and the words of its question
and of its answer (its last sentence, or what follows its last question mark), must be found in the passage.

An item's threshold is what remains of its BM25 score if the most telling words are missing that
verification allows to miss, so the retrieval loses no item that would be verified.

Indexes are built for SHARD_POSTINGS postings at a time, so that what is sent to the tasks is bounded;
more items mean more indexes, each asked for all documents.

Defined cases: a null text or item has no words and matches nothing; neither do items of fewer than
five words, which ordinary text contains as well. Rows that repeat are answered one by one, repeated
items are separate items. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chatstrata.llm.byte_text import WORD, buffers, mixed, tokens
from chatstrata.session import staged

SPAN = 128
SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 4
SHARD_POSTINGS = 1_000_000
BUFFER_BYTES = 1 << 20
MATCHES = "array<struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the lower-cased words of each whole text, one text after another."""
    parts: list[np.ndarray] = []
    current = 0
    for buffer, starts, owners in buffers(((t or "").lower() for t in texts), BUFFER_BYTES):
        at, _, kind, hashes = tokens(buffer)
        at, hashes = at[kind == WORD], hashes[kind == WORD]
        cuts = np.append(np.searchsorted(at, starts), len(at))
        for i, owner in enumerate(owners):
            if owner != current:
                yield np.concatenate(parts)
                parts, current = [], owner
            parts.append(hashes[cuts[i] : cuts[i + 1]])
    if parts:
        yield np.concatenate(parts)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        value = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            value = mixed(value * np.uint64(3)) + words[k : len(words) - size + 1 + k]
    return value


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: around the last question mark, else the last sentence is the answer."""
    body = text.strip()
    if "?" in body[:-1]:
        at = body[:-1].rindex("?") + 1
    else:
        ends = [m.end() for m in re.finditer(r"[.!]\s", body)]
        at = ends[-1] if ends else 0
    return (body[:at], body[at:]) if body[:at].strip() and body[at:].strip() else (body, body)


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    shingles: np.ndarray


@dataclass
class Index:
    """Impacts (terms x items) of items that passages of 2 x span words can hold, and their maxima by block."""

    span: int
    items: list[Item]
    terms: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]
    block_max: np.ndarray

    def matches(self, words: np.ndarray) -> dict[int, tuple]:
        """Of each item found in the document, the best passage's figures."""
        best: dict[int, tuple] = {}
        place = np.searchsorted(self.terms, words)
        known = self.terms[np.minimum(place, len(self.terms) - 1)] == words
        at, term = np.flatnonzero(known), place[known]
        if not len(at):
            return best
        # a word is in the passage that begins in its stretch and in the one before
        stretch = at // self.span
        both = np.concatenate([stretch, stretch[stretch > 0] - 1])
        pairs = np.unique(both * len(self.terms) + np.concatenate([term, term[stretch > 0]]))
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        for first in range(0, len(starts), 512):
            own = starts[first : first + 512]
            end = starts[first + 512] if first + 512 < len(starts) else len(term)
            bounds = np.add.reduceat(self.block_max[term[own[0] : end]], own - own[0], axis=0)
            for i, block in zip(*np.nonzero(bounds >= 1 - 1e-6)):
                after = own[i + 1] if i + 1 < len(own) else end
                number = int(passage[own[i]])
                self._verify(words[number * self.span : (number + 2) * self.span], term[own[i] : after], int(block), best)
        return best

    def _verify(self, words: np.ndarray, terms: np.ndarray, block: int, best: dict[int, tuple]) -> None:
        found = None
        for number in range(block * BLOCK, min((block + 1) * BLOCK, len(self.items))):
            own, impact = self.postings[number]
            score = float(impact[np.isin(own, terms)].sum())
            if score < 1 - 1e-6:
                continue
            item = self.items[number]
            found = shingles(words) if found is None else found
            overlap = float(np.isin(item.shingles, found).mean())
            question, answer = (float(np.isin(part, words).mean()) for part in (item.question, item.answer))
            if min(overlap, question, answer) >= OVERLAP:
                share = score / float(impact.sum())
                best[number] = max(best.get(number, (0.0,)), (overlap, share, question, answer))


def build(items: list[Item], idf: dict[int, float], average: float, span: int) -> Index:
    terms = np.unique(np.concatenate([i.words for i in items]))
    postings, block_max = [], np.zeros((len(terms), -(-len(items) // BLOCK)), np.float32)
    for number, item in enumerate(items):
        words, counts = np.unique(item.words, return_counts=True)
        weight = np.array([idf[int(w)] for w in words.view(np.int64)])
        impact = weight * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(item.words) / average))
        # each missing word breaks a run at least; only a word with no other place is missing as a term
        missing = int(np.floor((1 - OVERLAP) * len(item.shingles) + 1e-9))
        needed = impact.sum() - np.sort(impact)[::-1][:missing].sum()
        impact = impact / max(needed, 1e-9)
        own = np.searchsorted(terms, words)
        postings.append((own, impact))
        np.maximum.at(block_max[:, number // BLOCK], own, impact.astype(np.float32))
    return Index(span, items, terms, postings, block_max)


def indexes(benchmark: DataFrame, shard_postings: int = SHARD_POSTINGS) -> Iterator[list[Index]]:
    """Lists of indexes of a bounded number of postings, over all items; idf and lengths are of all items."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch["text"]):
                parts = [next(word_hashes([t])) for t in (text or "", *split_item(text or ""))]
                rows.append((item_id, len(parts[0]), *(p.tobytes() for p in parts)))
            yield pd.DataFrame(rows, columns=["item_id", "size", "words", "question", "answer"])

    columns = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = columns.mapInPandas(parsed, "item_id long, size long, words binary, question binary, answer binary")
    items = staged(items.where(F.col("size") >= SHINGLE), "benchmark-items")
    total = items.agg(F.count("*").alias("n"), F.avg("size").alias("average"), F.sum("size").alias("postings")).first()
    if not total["n"]:
        return

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words, shard in zip(batch["words"], batch["shard"]):
                yield pd.DataFrame({"term": np.unique(np.frombuffer(words, np.int64)), "shard": shard})

    shards = -(-total["postings"] // shard_postings)
    items = items.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
    postings = items.select("words", "shard").mapInPandas(distinct, "term long, shard long")
    frequency = staged(postings.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards")), "benchmark-terms")
    for shard in range(shards):
        known = frequency.where(F.array_contains("shards", F.lit(shard).cast("long"))).select("term", "df").collect()
        idf = {r["term"]: float(np.log1p((total["n"] - r["df"] + 0.5) / (r["df"] + 0.5))) for r in known}
        by_span: dict[int, list[Item]] = {}
        for r in items.where(F.col("shard") == shard).orderBy("item_id", "words").collect():
            words, question, answer = (np.frombuffer(r[c], np.uint64) for c in ("words", "question", "answer"))
            span = SPAN
            while span < len(words):
                span *= 2
            item = Item(r["item_id"], words, question, answer, np.unique(shingles(words)))
            by_span.setdefault(span, []).append(item)
        if by_span:
            yield [build(own, idf, total["average"], span) for span, own in sorted(by_span.items())]


def _asker(shared):
    """The function that asks all broadcast indexes for the items of each text."""
    names = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")

    @pandas_udf(MATCHES)
    def ask(texts: pd.Series) -> pd.Series:
        rows = []
        for words in word_hashes(texts.tolist()):
            hits = []
            for index in shared.value:
                for number, (overlap, score, question, reply) in sorted(index.matches(words).items()):
                    hits.append(dict(zip(names, (index.items[number].item_id, score, overlap, question, reply))))
            rows.append(hits)
        return pd.Series(rows, dtype=object)

    return ask


def leaks(docs: DataFrame, benchmark: DataFrame, shard_postings: int = SHARD_POSTINGS) -> Column:
    """The items found in each text: an array of item_id, score (part of the item's own), overlaps."""
    context = docs.sparkSession.sparkContext
    found = [_asker(context.broadcast(part))("text") for part in indexes(benchmark, shard_postings)]
    return F.concat(*found) if found else F.array().cast(MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap of each item found in a document."""
    hits = docs.select("doc_id", F.explode(leaks(docs, benchmark)).alias("hit"))
    return hits.select("doc_id", "hit.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without those in which an item is found."""
    return docs.where(F.size(leaks(docs, benchmark)) == 0)
