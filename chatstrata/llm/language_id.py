"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte 2- to 4-grams of the lower-cased text with everything but letters
taken as white space. Each is hashed to an embedding; a document is the mean of its
embeddings, and a linear softmax over it is trained by stochastic gradient descent.
A temperature and a rejection threshold are set on documents kept out of the training.

The model is fitted on at most TRAIN_ROWS labelled documents, in equal parts by language,
chosen by the hash of their doc_id; each of them, and every document scored, counts whole.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if
there is no labelled document. Rows that repeat are scored one by one; an empty table
gives an empty result. Documents with a null doc_id or language are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chatstrata.llm.byte_text import buffers
from chatstrata.llm.common import unused

TRAIN_ROWS = 3000
HASH_BITS = 14
ORDERS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 4
RATE = 0.5
BUFFER_BYTES = 1 << 20
UNKNOWN = "und"
# Part of correct documents that the threshold may reject.
REJECTED_RIGHT = 0.01

SPACE = 32


def _letters() -> np.ndarray:
    kept = np.full(256, SPACE, np.uint8)
    kept[128:] = np.arange(128, 256)
    for byte in b"abcdefghijklmnopqrstuvwxyz":
        kept[byte] = byte
        kept[byte - 32] = byte
    return kept


LETTER = _letters()


def subwords(buffer: np.ndarray) -> list[np.ndarray]:
    """For each order, the embedding number of the n-gram at each byte (-1: only white space at its start)."""
    body = LETTER[buffer]
    wide = np.concatenate([body, np.full(3, SPACE, np.uint8)]).astype(np.uint32)
    n = len(body)
    skip = (body == SPACE) & (wide[1 : n + 1] == SPACE)
    gram, result = wide[:n].copy(), []
    for order in ORDERS:
        gram |= wide[order - 1 : order - 1 + n] << np.uint32(8 * (order - 1))
        with np.errstate(over="ignore"):
            numbers = ((gram * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)).astype(np.int32)
        numbers += (order - ORDERS[0]) << HASH_BITS
        numbers[skip] = -1
        result.append(numbers)
    return result


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The embedding numbers of a whole text and how often each occurs."""
    total = np.zeros(len(ORDERS) << HASH_BITS, np.int64)
    for buffer, _, _ in buffers([text.lower()], BUFFER_BYTES):
        for numbers in subwords(buffer):
            total += np.bincount(numbers[numbers >= 0], minlength=len(total))
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


@dataclass
class Model:
    """`table` is embeddings times weights: the share of each subword in each language's logit."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        size = len(self.languages)
        sums, counts = np.zeros((len(texts), size)), np.zeros(len(texts))
        for buffer, starts, owners in buffers((t.lower() if t else t for t in texts), BUFFER_BYTES):
            score, seen = np.zeros((len(buffer), size), np.float32), np.zeros(len(buffer), np.int64)
            for numbers in subwords(buffer):
                score += self.table[numbers]
                seen += numbers >= 0
            np.add.at(sums, owners, np.add.reduceat(score, starts, axis=0, dtype=np.float64))
            np.add.at(counts, owners, np.add.reduceat(seen, starts))
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return scaled / scaled.sum(axis=1, keepdims=True)


def _softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max())
    return grown / grown.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """A model of (language, embedding numbers, counts)."""
    languages = sorted({language for language, numbers, _ in rows if len(numbers)})
    if not languages:
        return Model()
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (len(ORDERS) << HASH_BITS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    data = [(languages.index(language), n, c / c.sum()) for language, n, c in rows if len(n)]
    order = rng.permutation(len(data))
    held = max(1, len(data) // 5) if len(data) >= 5 else 0
    calibration, training = [data[i] for i in order[:held]], [data[i] for i in order[held:]]
    steps, step = EPOCHS * len(training), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(training)):
            label, numbers, share = training[i]
            mean = share @ embeddings[numbers]
            error = _softmax(mean @ weights + bias)
            error[label] -= 1
            rate = RATE * (1 - step / steps)
            pull = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # a subword's gradient is its share; scaled so that rare subwords learn as well
            embeddings[numbers] -= (rate * np.sqrt(share))[:, None] * pull
            step += 1
    model = Model(languages, np.vstack([embeddings @ weights, np.zeros((1, len(languages)))]).astype(np.float32), bias)
    judged = calibration or training
    logits = np.array([share @ (embeddings[numbers] @ weights) + bias for _, numbers, share in judged])
    labels = np.array([label for label, _, _ in judged])

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -np.log(model.probabilities(logits)[np.arange(len(labels)), labels] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
    chances = model.probabilities(logits)
    right = chances.max(axis=1)[chances.argmax(axis=1) == labels]
    model.threshold = float(np.quantile(right, REJECTED_RIGHT)) if len(right) else 0.0
    return model


def train(docs: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of at most `train_rows` documents of `docs` where `usable` holds."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    # a language's documents with the least hashes, some twice as many as can be needed, before any are ranked
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_documents"))
    least = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / (1 << 31)
    # a row per language, as many as the model has columns; so no language's rows are shuffled together
    few = labelled.join(F.broadcast(counts), "lang").where(least * F.col("_documents") <= 2 * train_rows + 100).select("doc_id", "lang")
    shuffled = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    turns = few.withColumn("_turn", F.row_number().over(shuffled)).where(F.col("_turn") <= train_rows)
    chosen = turns.orderBy("_turn", "lang", "doc_id").limit(train_rows).select("doc_id").distinct()
    # at most train_rows ids
    sample = docs.where(usable).join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    sample = sample.where("lang IS NOT NULL AND text IS NOT NULL")

    def features(batches):
        for batch in batches:
            found = [counted(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "lang": batch["lang"],
                    "numbers": [n.tobytes() for n, _ in found],
                    "counts": [c.astype(np.float32).tobytes() for _, c in found],
                }
            )

    rows = sample.mapInPandas(features, "lang string, numbers binary, counts binary").orderBy("lang", "numbers").collect()
    return fit([(r["lang"], np.frombuffer(r["numbers"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and accepted (the score reaches the calibrated threshold); columns of these names give way."""
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "accepted": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        chances = fitted.probabilities(fitted.logits(texts.tolist())) if len(texts) else np.zeros((0, 1))
        best = chances.argmax(axis=1)
        return pd.DataFrame({"lang": np.array(fitted.languages, object)[best], "score": chances[np.arange(len(best)), best]})

    name = unused(docs, "_found")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = F.col(name)
    return docs.withColumn(name, predict("text")).withColumns(
        {
            "lang_pred": F.when(known, found["lang"]).otherwise(UNKNOWN),
            "score": F.when(known, found["score"]).otherwise(0.0),
            "accepted": known & (found["score"] >= model.threshold),
        }
    ).drop(name)
