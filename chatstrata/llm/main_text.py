"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

Every block element and every run of text is a node (`html_nodes`). Trees give each node the odds of having
article text, from its subtree's density of text and links, tokens of its and its ancestors' attributes,
depth, place and siblings. Decoding picks the likeliest labels of the whole page in which nothing below a
rejected node is accepted: a node's subtree is either rejected as a whole, or the node is accepted and its
children are decided in the same way. The texts of the accepted leaves are the main text.

The trees are fitted on `TRAINING_PAGES` pages made by rule (`page_maker`), a fixed number whatever the input; they are sent to
all tasks and every page is read whole, in its own task.

Defined cases: a null or empty page, and one whose nodes are all rejected, has the empty text. A null url stays
null. Rows that repeat a page_id are pages of their own. Broken markup is read as browsers repair it. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.llm.boosting import Forest, fit
from chatstrata.llm.html_nodes import MARKS, Page, features, parse
from chatstrata.llm.page_maker import MARK, pages as made_pages

TRAINING_PAGES, TRAINING_SEED = 1000, 1
# Pages are scored together up to so many nodes.
NODES = 20_000


def alone(page: Page) -> np.ndarray:
    """Which nodes are a run of text that is all its block has: they are decided with their block."""
    parent, end = np.array(page.parent), np.array(page.end)
    number = np.arange(len(end))
    return (number > 0) & (np.array(page.mark) == MARKS["leaf"]) & (end[parent] - parent == 2) & (parent > 0)


def labelled(sources: list[str]) -> tuple[np.ndarray, np.ndarray, list[Page]]:
    """Features and labels of the nodes of made pages: 1 for a node with article text in its subtree."""
    parsed, labels = [], []
    for source in sources:
        page = parse(source)
        own = np.zeros(len(page.parent), np.int64)
        for number, text in enumerate(page.text):
            if text and MARK in text:
                own[number] = 1
                page.text[number] = text.replace(MARK, "").strip() or "x"
        sums = np.concatenate([[0], np.cumsum(own)])
        labels.append(sums[np.array(page.end)] > sums[np.arange(len(own))])
        parsed.append(page)
    return features(parsed), np.concatenate(labels).astype(np.float64), parsed


@lru_cache(maxsize=4)
def trained(count: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Forest:
    """The trees fitted on `count` made pages."""
    rows, labels, parsed = labelled(made_pages(count, seed))
    decided = ~np.concatenate([alone(page) for page in parsed])
    return fit(rows[decided], labels[decided])


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The likeliest labels of which none is accepted below a rejected one; `odds` are log-odds."""
    count = len(page.parent)
    # no odds of their own: they follow their block
    odds = np.where(alone(page), 0.0, odds)
    accepted, rejected = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    # best[i]: the likeliest labelling of the subtree; all[i]: rejecting it as a whole
    best, whole = accepted, rejected
    take = [False] * count
    for number in range(count - 1, -1, -1):
        take[number] = best[number] >= whole[number]
        chosen = best[number] if take[number] else whole[number]
        up = page.parent[number]
        if up >= 0:
            best[up] += chosen
            whole[up] += whole[number]
    for number in range(1, count):
        take[number] = take[number] and take[page.parent[number]]
    return take


def texts(sources: list[str | None], forest: Forest) -> Iterator[str]:
    """The main text of each page."""
    waiting: list[Page] = []
    size = 0

    def decided() -> Iterator[str]:
        if not waiting:
            return
        odds = forest.score(features(waiting))
        at = 0
        for page in waiting:
            count = len(page.parent)
            take = decode(page, odds[at : at + count])
            at += count
            yield " ".join(text for text, kept in zip(page.text, take) if text and kept)

    for source in sources:
        waiting.append(parse(source or ""))
        size += len(waiting[-1].parent)
        if size >= NODES:
            yield from decided()
            waiting, size = [], 0
    yield from decided()


def extract(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(forest or trained())
    key = pages.schema["page_id"].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = pa.array(list(texts(part.column(2).to_pylist(), shared.value)), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["page_id", "url", "text"])

    found = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = found.mapInArrow(extracted, f"page_id {key}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
