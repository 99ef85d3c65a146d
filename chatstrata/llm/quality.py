"""Quality classifier: random-indexing word vectors, pooled per document, under a small network.

Words (and runs of marks) are hashed to WORDS buckets. Each bucket has a sparse random
index vector; its word vector is the sum of the index vectors of its neighbours over the
whole corpus, scaled to unit length. A document is the mean of its word vectors and of its
index vectors, where the shapes of its words (case, marks, repeats) count as words too.
A two-layer network in numpy turns that into a probability of label 1, calibrated by a
temperature on rows kept out of its training.

The network is fitted on at most TRAIN_ROWS labelled documents, chosen by the hash of
their doc_id; the corpus sums and the scores cover all documents and whole texts.

Defined cases: a null text counts as empty and has the score of a document without words.
Labels that are null or have a null doc_id are not learned from; repeated labels count
repeatedly. Without labels every score is 0.5, with one kind of label it is nearly that label.
Rows that repeat are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chatstrata.llm.byte_text import MARK, WORD, buffers, tokens
from chatstrata.llm.common import give_back, unused

TRAIN_ROWS = 12000
WORD_BITS = 13
WORDS = 1 << WORD_BITS
DIMENSIONS = 32
NONZERO = 4
NEIGHBOURS = 2
HIDDEN = 24
EPOCHS = 60
BUFFER_BYTES = 1 << 19
ACCEPTED = 0.3
SEED = 11

# Shapes of a token; the first two exclude each other with MARKS.
LOWER_WORD, UPPER_WORD, TITLE_WORD, MARKS, AS_BEFORE, LONG, HAS_DIGIT, LINE_END = range(8)
SHAPES = 8


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the non-zero numbers of each bucket's (and shape's) index vector."""
    rng = np.random.default_rng(SEED)
    count = WORDS + SHAPES
    places = rng.permuted(np.tile(np.arange(DIMENSIONS, dtype=np.int32), (count, 1)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1.0, 1.0]), (count, NONZERO))


def index_matrix() -> np.ndarray:
    places, signs = index_vectors()
    dense = np.zeros((len(places), DIMENSIONS), np.float32)
    np.put_along_axis(dense, places, signs.astype(np.float32), axis=1)
    return dense


def words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, shape bits) of the tokens, buffer by buffer."""
    for buffer, starts, owners in buffers(texts, BUFFER_BYTES):
        at, size, kind, hashes = tokens(buffer)
        if not len(at):
            continue
        document = owners[np.searchsorted(starts, at, "right") - 1]
        bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        first, last = buffer[at], buffer[at + size - 1]
        upper_first = (first >= 65) & (first <= 90)
        upper_last = (last >= 65) & (last <= 90) & (size > 1)
        word = kind == WORD
        # equal to the word before, or to the one before that if marks stand between
        before, before2 = np.zeros(len(at), bool), np.zeros(len(at), bool)
        before[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
        before2[2:] = (hashes[2:] == hashes[:-2]) & (document[2:] == document[:-2])
        digit = (first >= 48) & (first <= 57)
        following = buffer[np.minimum(at + size, len(buffer) - 1)]
        flags = [
            word & ~upper_first,
            word & upper_first & upper_last,
            word & upper_first & ~upper_last,
            kind == MARK,
            word & (before | before2),
            size > 12,
            digit,
            following == 10,
        ]
        shape = np.zeros(len(at), np.uint8)
        for bit, flag in enumerate(flags):
            shape |= flag.astype(np.uint8) << np.uint8(bit)
        yield document, bucket, shape


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Of each bucket, the sum of the index vectors of its neighbours over all documents: WORDS x DIMENSIONS numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = index_vectors()
        sums = np.zeros(WORDS * DIMENSIONS)
        for batch in batches:
            for document, bucket, _ in words_of(batch["text"].tolist()):
                for step in range(1, NEIGHBOURS + 1):
                    left, right = bucket[:-step], bucket[step:]
                    same = document[:-step] == document[step:]
                    left, right = left[same], right[same]
                    for word, near in ((left, right), (right, left)):
                        cells = (word * DIMENSIONS)[:, None] + places[near]
                        sums += np.bincount(cells.ravel(), signs[near].ravel(), minlength=len(sums))
        table = sums.reshape(WORDS, DIMENSIONS)
        seen = np.flatnonzero(np.abs(table).sum(axis=1))
        yield pd.DataFrame(table[seen], columns=columns).assign(bucket=seen)

    columns = [f"c{i}" for i in range(DIMENSIONS)]
    schema = ", ".join(f"{c} double" for c in columns) + ", bucket long"
    parts = docs.select(F.col(text).alias("text")).mapInPandas(partial, schema)
    total = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    result = np.zeros((WORDS, DIMENSIONS))
    result[total["bucket"].to_numpy(np.int64)] = total[columns].to_numpy()
    return result


@dataclass
class WordVectors:
    vectors: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> WordVectors:
        context = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        context = np.vstack([context, np.zeros((SHAPES, DIMENSIONS))])
        return cls(np.hstack([context, index_matrix()]).astype(np.float32))

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """The document vectors: the mean over words, then the mean over the words' shapes, then the log of their number."""
        width = self.vectors.shape[1]
        sums, shapes, counts = np.zeros((len(texts), width)), np.zeros((len(texts), SHAPES)), np.zeros(len(texts))
        for document, bucket, shape in words_of(texts):
            firsts = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
            owner = document[firsts]
            np.add.at(sums, owner, np.add.reduceat(self.vectors[bucket], firsts, axis=0, dtype=np.float64))
            bits = (shape[:, None] >> np.arange(SHAPES, dtype=np.uint8)) & 1
            np.add.at(shapes, owner, np.add.reduceat(bits, firsts, axis=0, dtype=np.int64))
            np.add.at(counts, owner, np.diff(np.append(firsts, len(bucket))))
        size = np.maximum(counts, 1)[:, None]
        marks = shapes / size
        return np.hstack([sums / size, marks @ self.vectors[WORDS:, DIMENSIONS:], np.log1p(counts)[:, None]])


@dataclass
class Network:
    """Two layers; `temperature` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled - self.mean) / self.scale @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.outer_bias

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(pooled) / self.temperature)


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def fit(pooled: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Network:
    """The network of document vectors and 0/1 labels; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    width = pooled.shape[1]
    if not len(labels):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    order = rng.permutation(len(labels))
    held = len(labels) // 5
    kept, training = order[:held], order[held:]
    mean, scale = pooled[training].mean(axis=0), pooled[training].std(axis=0) + 1e-3
    x, y = (pooled[training] - mean) / scale, labels[training].astype(float)
    prior = np.clip(y.mean(), 0.01, 0.99)
    values = [
        rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.array(np.log(prior / (1 - prior))),
    ]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    step = 0
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(len(y))
        for batch in np.array_split(shuffled, max(1, len(y) // 64)):
            step += 1
            hidden = np.tanh(x[batch] @ values[0] + values[1])
            error = (_sigmoid(hidden @ values[2] + values[3]) - y[batch]) / len(batch)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [x[batch].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ error + 1e-4 * values[2], error.sum()]
            rate = 0.01 * (1 - epoch / EPOCHS)
            for value, slope, moment in zip(values, slopes, moments):
                moment[0] += 0.1 * (slope - moment[0])
                moment[1] += 0.001 * (slope**2 - moment[1])
                value -= rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, *values[:3], float(values[3]))
    judged = kept if len(kept) else training
    logits = network.logits(pooled[judged])

    def loss(temperature: float) -> float:
        chance = np.clip(_sigmoid(logits / temperature), 1e-9, 1 - 1e-9)
        return -np.where(labels[judged] == 1, np.log(chance), np.log(1 - chance)).mean()

    network.temperature = float(min(np.geomspace(0.1, 20, 120), key=loss))
    return network


@dataclass
class Classifier:
    words: WordVectors
    network: Network


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Word vectors of all `docs` and a network of at most `train_rows` rows of `labels` (where `usable` holds)."""
    words = WordVectors.of(context_sums(docs))
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked if usable is None else marked.where(usable)
    chosen = marked.select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    # at most train_rows ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pooled = shared.value.pooled(batch["text"].tolist()).astype(np.float32)
            yield pd.DataFrame({"quality": batch["quality"], "vector": [v.tobytes() for v in pooled]})

    rows = sample.mapInPandas(vectors, "quality int, vector binary").orderBy("vector", "quality").limit(train_rows).collect()
    pooled = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], np.float64)
    pooled = pooled.reshape(len(rows), words.vectors.shape[1] + DIMENSIONS + 1)
    return Classifier(words, fit(pooled, np.array([r["quality"] for r in rows], int)))


def accepted(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """`docs` without those that the classifier rejects."""
    name = unused(docs, "_score")
    return score(docs, classifier, name).where(F.col(name) >= ACCEPTED).drop(name)


def score(docs: DataFrame, classifier: Classifier, name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 as column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series(model.network.scores(model.words.pooled(texts.tolist())))
        give_back()

    return docs.withColumn(name, chance("text"))
